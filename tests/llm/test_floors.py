"""Floors from parts of the rows change how much is returned, not what is found."""

import numpy as np
from pyspark.sql import functions as F

from areal.llm import ann


def test_floors_lose_nothing_and_bound_what_probing_returns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_normal((4000, 12)), 1)  # ties occur
    v[100:160] = v[100]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").persist()
    asked = rows.where("vec_id % 20 = 0")
    turn = ann.learn(v, 3)
    plan, settings = ann.Plan(bits=36, width=12, radius=13, lead=6), ann.Settings(k=10, part_rows=32, first_rows=64)
    made, met = [], ann._met

    def counted(*args):
        found = met(*args).persist()
        made.append(found.count())
        return found

    want = ann._ranked(counted(rows, asked.withColumn("floor", F.lit(None).cast("double")), plan, turn, 12, settings), 10).collect()
    monkeypatch.setattr(ann, "_met", counted)
    got = ann._probed(rows, asked, plan, turn, 12, settings).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 1900
    without, *parts = made
    assert len(parts) == 4 and sum(parts) < without / 2
    assert sum(parts) < 200 * (64 + 3 * 10 * 4 * 1.5)  # rows a query: the first part, and k * growth of each larger one
