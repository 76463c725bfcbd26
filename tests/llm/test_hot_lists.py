"""Lists that are split and compared in blocks, and rows without an id."""

import random

from areal.llm import ngram_join


def brute(docs, rule):
    sets = [{tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if (w := (t or "").split()) else set() for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and group[i] != group[j] and 100 * len(a & sets[j]) >= rule.percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(docs, group, strict=True):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    return sorted(((d, len(s), least[g] if s else d) for (d, _), s, g in zip(docs, sets, group, strict=True)), key=str)


def linked(spark, docs, rule):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int"), rule).collect()), key=str)


def test_blocks_of_a_hot_list(spark, monkeypatch):
    """Near copies in many families around one passage: their lists hold dozens of members in several components."""
    monkeypatch.setattr(ngram_join, "PART", 4)
    rng = random.Random(8)
    rule = ngram_join.Rule(3, 80)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for family in range(8):
        own = [f"f{family}x{i}" for i in range(9)]
        for k in range(7):
            text = passage + own
            at = rng.randrange(len(text))
            docs.append((10 * family + k, " ".join(text[:at] + [f"n{rng.randrange(9)}"] + text[at + rng.randrange(2) :])))
    assert linked(spark, docs, rule) == brute(docs, rule)


def test_rows_without_an_id_link_by_their_text(spark):
    words = [f"w{i}" for i in range(40)]
    near, other = " ".join(words[:-1]), " ".join(["v", *words[1:-1]])
    docs = [(5, " ".join(words)), (None, near), (None, near), (9, other), (None, "quite alone here"), (None, None), (3, "")]
    assert linked(spark, docs, ngram_join.Rule(3, 90)) == brute(docs, ngram_join.Rule(3, 90))
    assert linked(spark, docs, ngram_join.Rule(3, 90))[0][0] is not Ellipsis and any(r == (9, 37, 5) for r in linked(spark, docs, ngram_join.Rule(3, 90)))
