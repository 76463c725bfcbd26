"""Area models against independent dense algebra, and the two tiers of the Fay-Herriot fit against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areal.functions.special import chi2_tail, normal_tail
import dense_mixed as mixed
from areal.operators import fh, prep
from areal.operators.benchmark import benchmark
from areal.sources.tables import TableError

RNG = np.random.default_rng(5)
D = 40
X = RNG.normal(size=D)
PSI = RNG.uniform(0.3, 1.2, D)
Y = 1 + 0.8 * X + RNG.normal(0, 0.8, D) + RNG.normal(0, np.sqrt(PSI))


@pytest.fixture(scope="module")
def area(spark):
    rows = [(i, float(Y[i]) if i % 9 else None, float(PSI[i]), float(X[i]), i % 3, float(1 + i % 5)) for i in range(D)]
    return spark.createDataFrame(rows, "domain int, y double, vardir double, x double, g int, w double").cache()


def test_fit_maximises_the_restricted_likelihood_and_matches_dense_algebra(area):
    fit = fh.fit(area, "y", "vardir", ["x"], precision=1e-10)
    s = np.array([i for i in range(D) if i % 9])
    xs = np.column_stack([np.ones(D), X])

    def dense(s2):
        v = np.diag(PSI[s] + s2)
        vi = np.linalg.inv(v)
        q = np.linalg.inv(xs[s].T @ vi @ xs[s])
        beta = q @ xs[s].T @ vi @ Y[s]
        r = Y[s] - xs[s] @ beta
        return -0.5 * (np.linalg.slogdet(v)[1] - np.linalg.slogdet(q)[1] + r @ vi @ r), beta

    best, beta = dense(fit.sigma2_u)
    assert fit.converged and all(best >= dense(fit.sigma2_u * k)[0] for k in (0.9, 1.1))
    assert np.allclose(beta, [c["beta"] for c in fit.coef])
    got = {r.domain: r for r in fit.estimates.collect()}
    assert np.isclose(got[0].eblup, beta @ xs[0]) and got[0].random_effect is None and got[0].mse > 0
    b = PSI[1] / (PSI[1] + fit.sigma2_u)
    assert np.isclose(got[1].eblup, beta @ xs[1] + (1 - b) * (Y[1] - beta @ xs[1]))


def test_both_tiers_agree(area):
    a, b = (fh.fit(area, "y", "vardir", ["x"], method="ML", local_rows=n) for n in (10**6, 0))
    assert a.n_iter == b.n_iter and np.isclose(a.sigma2_u, b.sigma2_u, rtol=1e-10) and np.isclose(a.goodness["loglik"], b.goodness["loglik"], rtol=1e-10)


def test_dense_engine_agrees_with_fay_herriot_when_areas_are_independent(area):
    y = np.array([Y[i] if i % 9 else np.nan for i in range(D)])
    x = np.column_stack([np.ones(D), X])
    alone = mixed.Structure(lambda t: t[0] * np.eye(D), lambda t: [np.eye(D)], lambda t: {}, np.zeros(1), np.full(1, np.inf), lambda m: np.array([m]), ("sigma2_u",))
    for method in ("REML", "ML"):
        fit = fh.fit(area, "y", "vardir", ["x"], method=method, precision=1e-10)
        own = mixed.fit(y, x, PSI, alone, method, precision=1e-10)
        got = {r.domain: r for r in fit.estimates.collect()}
        assert np.isclose(own.params["sigma2_u"], fit.sigma2_u, rtol=1e-6)
        assert np.allclose(own.eblup, [got[i].eblup for i in range(D)], rtol=1e-6)
        if method == "ML":  # for REML the area model takes the plain information, 2 / sum v^2, in g3; the dense engine the restricted one
            assert np.allclose(own.mse, [got[i].mse for i in range(D)], rtol=1e-5)


def test_spatial_slopes_and_curves_are_derivatives():
    w = np.roll(np.eye(6), 1, axis=0) / 2 + np.roll(np.eye(6), -1, axis=0) / 2
    for structure, t in ((mixed.spatial(w), np.array([0.8, 0.4])), (mixed.spatio_temporal(w, 3), np.array([0.8, 0.4, 0.5, 0.3]))):
        h = 1e-5
        for j, slope in enumerate(structure.slopes(t)):
            step = np.eye(len(t))[j] * h
            assert np.allclose(slope, (structure.cov(t + step) - structure.cov(t - step)) / (2 * h), atol=1e-6)
            for k in range(len(t)):
                want = (structure.slopes(t + np.eye(len(t))[k] * h)[j] - structure.slopes(t - np.eye(len(t))[k] * h)[j]) / (2 * h)
                assert np.allclose(structure.curves(t).get((min(j, k), max(j, k)), 0 * want), want, atol=1e-5)


@pytest.mark.parametrize("method", ["ratio", "difference", "optimal", "logit"])
def test_benchmarks_meet_their_targets(spark, method):
    rows = spark.createDataFrame([(i, i % 3, 0.1 + 0.02 * i, 0.001 * (1 + i), 1.0 + i) for i in range(20)], "domain int, g int, p double, m double, w double")
    target = spark.createDataFrame([(0, 0.3), (1, 0.25), (2, 0.35)], "g int, target double")
    out = benchmark(rows, "p", target, "w", "g", method, mse="m")
    sums = out.groupBy("g").agg((F.sum(F.col("w") * F.col("benchmarked")) / F.sum("w")).alias("a"), F.first("target").alias("t")).collect()
    assert all(abs(r.a - r.t) < 1e-8 for r in sums)
    hier = benchmark(rows, "p", None, "w", "g", method, mse="m", national_target=0.4)
    assert abs(hier.agg((F.sum(F.col("w") * F.col("benchmarked")) / F.sum("w")).alias("a")).first().a - 0.4) < 1e-8


def test_effective_trials_of_a_small_table(spark):
    v = lambda y, n, d: d * y * (1 - y) / n
    rows = [(1, 0.10, 100, v(0.1, 100, 1.5), None), (1, 0.20, 50, v(0.2, 50, 2.0), None), (1, 0.0, 80, 0.0, 2.5), (2, 0.05, 200, v(0.05, 200, 1.2), None), (2, 0.15, 40, v(0.15, 40, 1.8), None), (3, 0.0, 30, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, prov int, y double, n int, vardir double, fb double")
    pooled = prep.effective_trials(df, "y", "vardir", "n", "prov").orderBy("id").collect()
    assert [r.deff_source for r in pooled] == ["group"] * 5 + ["overall"]
    area = prep.effective_trials(df, "y", "vardir", "n", "prov", "area", "fb").orderBy("id").collect()
    assert np.allclose([r.deff for r in area[:5]], [1.5, 2, 2.5, 1.2, 1.8]) and area[2].deff_source == "fallback" and area[5].deff_source == "overall"


def test_input_errors(spark, area):
    with pytest.raises(TableError):
        fh.fit(area.withColumn("x", F.when(F.col("domain") > 1, F.col("x"))), "y", "vardir", ["x"])
    with pytest.raises(TableError):
        fh.fit(area.withColumn("vardir", F.lit(0.0)), "y", "vardir", ["x"])
    with pytest.raises(TableError):
        fh.fit(area.withColumn("x2", F.col("x") * 2), "y", "vardir", ["x", "x2"])


def test_tails():
    assert np.isclose(chi2_tail(3.841458820694124, 1), 0.05) and np.isclose(chi2_tail(18.307038053275146, 10), 0.05) and np.isclose(normal_tail(1.959963984540054), 0.05)
