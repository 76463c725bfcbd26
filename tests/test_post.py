"""Benchmark errors and the matrix of errors, ranks, neighbours, sheets and tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areal.operators import area_models, compare, fh, report, simulate, spatial, weights
from areal.operators.benchmark import benchmark
from areal.sources.tables import TableError


@pytest.fixture(scope="module")
def areas(spark):
    return simulate.area_data(spark, 30, "grid", unsampled=3).selectExpr("area as domain", "y_gaussian as y", "vardir", "x1", "x2", "area % 3 as region", "cast(area as double) as n")


def test_benchmark_errors(spark):
    df = spark.createDataFrame([(1, "a", 0.2, 1.0), (2, "a", 0.4, 2.0), (3, "b", 0.3, 1.0)], "domain int, g string, e double, w double")
    target = spark.createDataFrame([("a", 0.3), ("b", 0.3)], "g string, target double")
    assert benchmark(df, "e", target, "w", "g", "logit").count() == 3
    null = F.lit(None).cast("double")
    bad = [
        (df.withColumn("w", F.lit(0.0)), target, "ratio", {}), (df.withColumn("w", null), target, "ratio", {}), (df, target.where("g = 'a'"), "difference", {}), (df.withColumn("e", F.lit(0.0)), target, "ratio", {}), (df.withColumn("e", F.lit(1.5)), target, "logit", {}),
        (df, 0.3, "ratio", {"national_target": 0.3}), (df.withColumn("e", null), target, "difference", {}),
    ]
    for rows, t, method, more in bad:
        with pytest.raises(TableError):
            benchmark(rows, "e", t, "w", "g", method, **more).count()


def test_errors_of_benchmarked_estimates_use_the_whole_matrix(spark, areas):
    fit = fh.fit(areas, "y", "vardir", ["x1", "x2"])
    rows = fit.estimates.join(areas.select("domain", "region", "n"), "domain")
    out = {r.domain: r for r in benchmark(rows, "eblup", 2.0, "n", "region", "difference", mse="mse", fit=fit).collect()}
    local = areas.orderBy("domain").toPandas()
    x = np.column_stack([np.ones(30), local.x1, local.x2])
    seen, s2 = ~local.y.isna().to_numpy(), fit.sigma2_u
    b = np.where(seen, local.vardir / (s2 + local.vardir), 1.0)
    q = np.linalg.inv((x[seen] / (s2 + local.vardir.to_numpy()[seen])[:, None]).T @ x[seen])
    m = np.diag(s2 * b) + (b[:, None] * x) @ q @ (b[:, None] * x).T
    mse = np.array([out[d].mse for d in local.domain])
    m = m * np.sqrt(np.outer(mse, mse) / np.outer(np.diag(m), np.diag(m)))
    for i, d in enumerate(local.domain):
        same = (local.region == local.region[i]).to_numpy()
        w = np.where(same, local.n / local.n[same].sum(), 0.0)
        want = mse[i] - 2 * (m @ w)[i] + out[d].adjustment ** 2
        assert math.isclose(out[d].mse_benchmarked, max(want, 0), rel_tol=1e-8, abs_tol=1e-10)
    w, _ = simulate.weights(30, "grid")
    found = area_models.spatial(areas, simulate.edges_of(spark, w), "y", "vardir", ["x1", "x2"])
    rows = found.estimates.join(areas.select("domain", "region", "n"), "domain")
    assert benchmark(rows, "eblup", 2.0, "n", "region", "ratio", mse="mse", fit=found).where("mse_benchmarked >= 0").count() == 30


def test_average_ranks_and_numbers(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(12)]) for _ in range(200)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double")
    known = [v for v in values if v is not None]
    want = {i: None if v is None else sum(x > v for x in known) + (known.count(v) + 1) / 2 for i, v in enumerate(values)}
    assert {r.id: r.r for r in compare.with_average_ranks(df, {"v": "r"}).collect()} == want
    assert sorted(r.n for r in compare.numbered(df, [F.col("v"), F.col("id")], "n").collect()) == list(range(1, 201))


def test_neighbours_by_cells_are_those_by_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.random((60, 2)), 50 + rng.random((5, 2)), [[1000.0, 1000.0]]]).round(3)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "k int, a double, b double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(66) for j in sorted((j for j in range(66) if j != i), key=lambda j: (d[i, j], j))[:4]}
    assert {(r.src, r.dst) for r in weights.knn(points, "k", ["a", "b"], 4).collect()} == want
    assert {(r.src, r.dst) for r in weights.distance(points, "k", ["a", "b"], 0.3).collect()} == {(i, j) for i in range(66) for j in range(66) if i != j and d[i, j] <= 0.3}
    joined = weights.islands_joined(weights.distance(points, "k", ["a", "b"], 0.3), points, "k", ["a", "b"])
    assert weights.check(joined, points, "k")["without"] == 0
    with pytest.raises(TableError):
        weights.check(joined.withColumn("w", F.lit(-1.0)), points, "k")


def test_spatial_test_decides_by_the_likelihood_ratio(spark, areas):
    w, _ = simulate.weights(30, "grid")
    found = spatial.spatial_test(areas, simulate.edges_of(spark, w), x="x1", vardir="vardir")
    assert found["decision"]["test"] == "lrt" and found["lrt"]["statistic"] >= 0 and found["decision"]["spatial"] == (found["lrt"]["pvalue"] < 0.05)


def test_diagnose_and_class_probabilities(spark, areas):
    fit = fh.fit(areas, "y", "vardir", ["x1", "x2"])
    w, _ = simulate.weights(30, "grid")
    found = compare.diagnose(fit.estimates, edges=simulate.edges_of(spark, w), truth=areas.selectExpr("domain", "y as truth"))
    assert found["status"] in ("pass", "caution", "warning") and found["spatial"]["n"] == 27 and found["simulation"]["mean_abs_rb"] > 0
    rows = compare.class_probabilities(fit.estimates, [0.0, 1.0]).collect()
    for r in rows:
        z = lambda b, r=r: 0.5 * math.erfc(-(b - r.eblup) / math.sqrt(2 * r.mse))
        low, high = [-math.inf, 0.0, 1.0, math.inf][r.est_class : r.est_class + 2]
        assert math.isclose(r.prob_class, (1.0 if high == math.inf else z(high)) - (0.0 if low == -math.inf else z(low)), abs_tol=1e-12)


def test_sheets_and_tables(spark, areas, tmp_path):
    fit = fh.fit(areas, "y", "vardir", ["x1", "x2"])
    both = fit.estimates.join(areas.select("domain", "region", "n"), "domain")
    sheets = report.sheets(fit, benchmarked=benchmark(both, "eblup", 2.0, "n", "region", "ratio"))
    assert set(sheets) == {"Estimates", "Model_Summary", "Benchmarked", "Benchmarked_Groups"}
    for kind in ("parquet", "csv"):
        paths = report.export(sheets, str(tmp_path), kind)
        assert spark.read.format(kind).option("header", True).load(paths[0]).count() == 30
    names = areas.selectExpr("concat('x', domain) as label", "cast(domain as string) as code", "region as other")
    assert report.matched_key(names, fit.estimates) == "code"
    assert report.map_table(names, fit.estimates, {"e": F.col("eblup"), "r": F.col("rse")}).count() == 60
    with pytest.raises(ValueError):
        report.matched_key(names.select("label"), fit.estimates)
    assert report.qq_table(compare.residual_table(fit.estimates)).count() <= 27 and report.scatter_table(fit.estimates, fit.estimates, ("a", "b")).count() == 30


def test_simulators_depend_on_the_seed_only(spark):
    a, b = (sorted(map(str, simulate.series_data(spark, 8, 3, seed=s).collect())) for s in (4, 4))
    assert a == b != sorted(map(str, simulate.series_data(spark, 8, 3, seed=5).collect())) and len(a) == 24
    rows = simulate.area_data(spark, 12, "ring", unsampled=2).collect()
    assert sum(r.y_beta is None for r in rows) == 2 and all(r.trials >= r.y_binomial for r in rows if r.y_binomial is not None)
