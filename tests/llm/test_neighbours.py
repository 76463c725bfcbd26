"""Probing retrieves every code within the radius, and awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from areal.llm import ann

SF = "/root/testdata/sf0.001"


def test_probing_finds_every_code_within_the_radius(spark):
    """With the floats' order equal to the codes' distances, whatever is within the radius is found, by probes only."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base + 0.1 * rng.standard_normal((40, 16)) for _ in range(12)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    turn = ann.learn(v, 2)
    plan = ann.Plan(bits=32, width=8, radius=6, lead=3)
    assert [plan.reach(j) for j in range(4)] == [1, 1, 1, 0]
    codes = ann.packed(ann.signs(v, turn))
    far = np.bitwise_count(codes[:, None] ^ codes[None, :]).sum(axis=2)
    got = ann._probed(rows, rows.where("vec_id % 20 = 0"), plan, turn, 16, ann.Settings(k=480, part_rows=50, part_queries=7)).collect()
    want = {(q, x) for q in range(0, 480, 20) for x in range(480) if x != q and far[q, x] <= 6}
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == len(want) > 200


def test_many_equal_vectors_and_lengths(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(400 + i, [float(i), -1.0]) for i in range(30)] + [(None, [1.0, 1.0]), (500, [float("inf"), 1.0]), (501, []), (502, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(vectors, ann.Settings(part_rows=64, part_queries=4)).collect()
    at = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in {r.query_id for r in got}}
    assert set(at) == {*range(0, 300, 20), 400, 420}
    assert all(at[q] == [(i, 14.0) for i in range(21) if i != q][:20] for q in range(0, 300, 20))
    assert at[420] == sorted([(400 + i, 20.0 * i + 1) for i in range(30) if i != 20], key=lambda x: -x[1])[:20]


def test_few_candidates_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 0.0]), (1, [0.5, 0.5]), (20, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.75), (0, 2, 1, -1.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.nearest(vectors).collect()
    want = ann.exact(vectors, sorted({r.query_id for r in got}))
    hits = sum((r.vec_id, r.score) in want[r.query_id] for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9 and len(got) == 20 * len(want)
    assert vectors.where(F.col("vec_id") % 20 == 0).count() == len(want)
