"""Statistics that follow a stream equal those of the whole table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from areal.operators import fh, prep
from areal.operators.direct import direct_means
from areal.sources.tables import TableError
from areal.streaming import refresh

SF = "/root/testdata/sf0.001"


def test_running_means_and_models_follow_the_stream(spark, tmp_path):
    units = spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 7).cast("double").alias("x"))
    for part in (0, 1):
        units.where(f"x % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def each(areas, batch):
        areas = areas.where("vardir > 0")
        seen.append((areas.agg(F.sum("n")).first()[0], {r.domain: r.eblup for r in fh.fit(areas, "y", "vardir", ["mean_x"]).estimates.collect()}))

    refresh.refreshed(refresh.running_means(stream, "c_nationkey", "c_acctbal", ["x"]), str(tmp_path / "state"), each).awaitTermination()
    whole = direct_means(units, "c_nationkey", "c_acctbal", ["x"]).withColumnRenamed("c_nationkey", "domain").where("vardir > 0")
    want = {r.domain: r.eblup for r in fh.fit(whole, "y", "vardir", ["mean_x"]).estimates.collect()}
    assert len(seen) == 2 and seen[0][0] < seen[1][0] and seen[1][1].keys() == want.keys() and all(abs(seen[1][1][k] - want[k]) < 1e-6 * abs(want[k]) for k in want)


def test_windows_leave_late_units_out(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    for i, rows in enumerate(([(at(1), 1, 2.0), (at(2), 1, 4.0)], [(at(40), 1, 1.0)], [(at(41), 1, 1.0)], [(at(3), 1, 100.0), (at(55), 1, 3.0)])):
        spark.createDataFrame(rows, "t timestamp, d int, y double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("t timestamp, d int, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = refresh.windowed_means(stream, "t", "10 minutes", "5 minutes", "d", "y")
    out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = {r.start.minute: (r.n, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[0] == (2, 3.0)


def test_self_benchmarks_meet_their_targets(spark):
    rows = [(i, None if i % 7 == 0 else 2.0 + i / 10 + (i % 4), 0.3 + (i % 3) / 10, float(i % 5), "ab"[i % 2], 1.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "domain int, y double, vardir double, x double, g string, w double")
    fit, table = fh.self_benchmarked(df, "y", "vardir", ["x"], weight="w", group="g", target={"a": 5.0})
    got = {r.group: r for r in table.collect()}
    assert abs(got["a"].benchmarked - 5.0) < 1e-9 and abs(got["b"].benchmarked - got["b"].direct) < 1e-9 and got["b"].shift == 0
    assert {r.domain: r.y for r in fit.estimates.collect()} == {r[0]: r[1] for r in rows}
    with pytest.raises(TableError):
        fh.self_benchmarked(df.withColumn("w", -F.col("w")), "y", "vardir", ["x"], weight="w")


def test_variance_functions_of_other_terms(spark):
    df = spark.createDataFrame([(i, 1.0 + i, 2.0 * (1 + i) ** 1.5, float(i % 4)) for i in range(20)], "domain int, y double, v double, x double")
    _, exact = prep.gvf_smooth(df, "y", "v")
    out, other = prep.gvf_smooth(df, "y", "v", terms_of=["x"])
    assert abs(exact["r2"] - 1) < 1e-9 and abs(exact["coef"][1] - 1.5) < 1e-9 and 0 <= other["r2"] < 0.5 and out.where("vardir_smooth > 0").count() == 20
    assert prep.gvf_smooth(df, "y", "v", method="gamma_glm")[1]["r2"] > 0.999
