"""Which sets are light must not follow the size of the table."""

import numpy as np
from test_hot_lists import brute, linked

from areal.llm import ngram_join


def test_boundary_of_a_larger_table_of_the_same_kind():
    """Five times the rows: lists of common elements are five times as long, those of rare ones, where sets meet, are as long as before."""
    rng = np.random.default_rng(5)
    sizes = np.full(ngram_join.LIGHT_MOST, 50)
    rule = ngram_join.Rule(3, 90)
    found = []
    for times in (1, 5, 25):
        slots = rng.poisson(6 * times, ngram_join.SLOTS)  # of rare elements
        slots[rng.integers(0, ngram_join.SLOTS, 20_000)] += 300 * times
        found.append(ngram_join.boundary(slots.astype(np.int32), sizes * times, rule))
    assert len(set(found)) == 1


def test_boundary_rises_where_even_rare_elements_have_long_lists():
    slots, sizes = np.zeros(ngram_join.SLOTS, np.int32), np.full(ngram_join.LIGHT_MOST, 50)
    slots[:500] = 5000
    assert ngram_join.boundary(slots, sizes, ngram_join.Rule(3, 90)) > 20
    assert ngram_join.boundary(np.zeros_like(slots), np.zeros_like(sizes), ngram_join.Rule(3, 90)) >= 1


def test_links_are_the_same_wherever_the_boundary_is(spark, monkeypatch):
    docs = [(4 * n + k, " ".join([f"s{n}w{i}" for i in range(n + 2 - (k == 3))] + ["z"] * (k == 1) + ["y"] * (k == 2))) for n in range(0, 36, 3) for k in range(4)]
    for light in (1, 10, 30, 40):
        monkeypatch.setattr(ngram_join, "boundary", lambda *_, light=light: light)
        assert linked(spark, docs, ngram_join.Rule(3, 80)) == brute(docs, ngram_join.Rule(3, 80))
