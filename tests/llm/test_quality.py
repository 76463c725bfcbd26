"""Whole verdicts against the SQL in DuckDB, on documents among which cut-offs are significant."""

import random

import duckdb
import pandas as pd

from areal.llm import quality


def tables():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(rng.randrange(8, 40))]
        bad = i % 10 == 0
        if bad:
            words = [w.upper() + "!!!" if i % 20 else w + "###" for w in words]
        docs.append((i if i % 97 else None, "\n".join([" ".join(words)] + ["same line"] * (i % 3)), ["en", "de", None][i % 3], i))
        labels += [(i, int(not bad))] * (1 + (i % 50 == 0)) + ([(i, 0)] if i % 60 == 1 else [])
    docs += [(5000 + i, "One more copy of the same good text, ten words long! " * 1, "en", i) for i in range(300)]
    labels += [(5000 + i, 1) for i in range(300)]
    docs += [(9000, None, "en", 0), (9000, None, "en", 0), (9001, "", "xx", 0), (9002, "w " * 3000, "en", 0), (9003, "x" * 20_000, "en", 0)]
    return docs, labels


def test_against_sql(spark):
    docs, labels = tables()
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_words int")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(rows, known).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "n_words"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]))
    want = con.sql(quality.SQL).df()
    key = lambda df: sorted(map(str, df[list(got.columns)].astype(object).where(df[list(got.columns)].notna(), None).values.tolist()))
    clean = lambda xs: [x.replace(".0,", ",") for x in xs]
    assert clean(key(got)) == clean(key(want))
    rejected = got[~got.base_failed & ~got.kept]
    assert len(rejected) > 100 and {"exclamations", "symbols_per_word"} <= set(",".join(rejected.rejected_by).split(","))


def test_copies_are_one_trial(spark):
    docs = spark.createDataFrame([(i, "the same ten words stand in all of these documents " + " " * (i % 4), "en") for i in range(500)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert quality.judge(docs, labels).where("kept").count() == 500  # one trial allows no cut-off


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
