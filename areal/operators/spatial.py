"""Tests for spatial dependence: Moran's I and Lagrange multipliers, as sums over an edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.functions.special import chi2_tail, normal_tail
from areal.sources.tables import TableError


def moran(values: DataFrame, edges: DataFrame, key: str = "domain", value: str = "y", floor: float = 1e-10) -> DataFrame:
    """One row: n, moran_i, expected, variance (randomisation) and z. Edges to areas without a value are left out, weights are not restyled."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    mean = rows.agg(F.avg("v").alias("m"))
    z = rows.crossJoin(F.broadcast(mean)).select("k", (F.col("v") - F.col("m")).alias("z"))
    e = edges.join(z.withColumnRenamed("k", "src").withColumnRenamed("z", "zi"), "src").join(z.withColumnRenamed("k", "dst").withColumnRenamed("z", "zj"), "dst")
    sums = e.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"))
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("wt"))
    both = e.select("src", "dst", "w").join(back, ["src", "dst"], "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("wt", F.lit(0.0))).alias("p"))
    s1 = both.agg((F.sum(F.col("p") ** 2) / 2).alias("s1"))
    ends = e.select(F.col("src").alias("k"), "w").unionByName(e.select(F.col("dst").alias("k"), "w")).groupBy("k").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") ** 2).alias("s2"))
    moments = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") ** 2).alias("zz"), (F.avg(F.col("z") ** 4) / F.avg(F.col("z") ** 2) ** 2).alias("b2"))
    one = sums.crossJoin(s1).crossJoin(s2).crossJoin(moments)
    n, s0, b2 = F.col("n"), F.col("s0"), F.col("b2")
    a = n * ((n * n - 3 * n + 3) * F.col("s1") - n * F.col("s2") + 3 * s0 * s0)
    b = b2 * ((n * n - n) * F.col("s1") - 2 * n * F.col("s2") + 6 * s0 * s0)
    expected = -1 / (n - 1)
    variance = F.greatest((a - b) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected, F.lit(floor))
    i = n / s0 * F.col("num") / F.col("zz")
    return one.select(n.cast("long").alias("n"), i.alias("moran_i"), expected.alias("expected"), variance.alias("variance"), ((i - expected) / F.sqrt(variance)).alias("z"))


def ols_residuals(areas: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """key, y, e (residual of y on x) and fitted, over rows with a y."""
    rows = areas.where(F.col(y).isNotNull())
    line = rows.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("b"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("a"))
    fitted = F.col("a") + F.col("b") * F.col(x)
    return rows.crossJoin(F.broadcast(line)).select(F.col(key), F.col(y).alias("y"), F.col(x).alias("x"), (F.col(y) - fitted).alias("e"), fitted.alias("fitted"))


def lagrange(areas: DataFrame, edges: DataFrame, key: str = "domain", y: str = "y", x: str = "x") -> DataFrame:
    """One row: lm_error and lm_lag of the regression of y on x."""
    r = ols_residuals(areas, key, y, x)
    side = r.select(F.col(key).alias("dst"), F.col("e").alias("ej"), F.col("y").alias("yj"), F.col("fitted").alias("fj"))
    e = edges.join(side, "dst").join(r.select(F.col(key).alias("src"), F.col("e").alias("ei")), "src")
    cross = e.agg(F.sum(F.col("w") * F.col("ei") * F.col("ej")).alias("ewe"), F.sum(F.col("w") * F.col("ei") * F.col("yj")).alias("ewy"))
    inside = e.select("src", "dst", "w")
    back = inside.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("wt"))
    trace = inside.join(back, ["src", "dst"], "left").agg(F.sum(F.col("w") ** 2 + F.col("w") * F.coalesce("wt", F.lit(0.0))).alias("t"))
    lag = e.groupBy("src").agg(F.sum(F.col("w") * F.col("fj")).alias("wf"))
    lagged = r.select(F.col(key).alias("src"), "x").join(lag, "src", "left").select("x", F.coalesce("wf", F.lit(0.0)).alias("wf"))
    rss = lagged.agg((F.regr_syy("wf", "x") - F.regr_sxy("wf", "x") ** 2 / F.regr_sxx("wf", "x")).alias("mwf"))
    s2 = r.agg((F.sum(F.col("e") ** 2) / F.count("*")).alias("s2"))
    one = cross.crossJoin(trace).crossJoin(rss).crossJoin(s2)
    return one.select(((F.col("ewe") / F.col("s2")) ** 2 / F.col("t")).alias("lm_error"), ((F.col("ewy") / F.col("s2")) ** 2 / (F.col("t") + F.col("mwf") / F.col("s2"))).alias("lm_lag"))


def likelihood_ratio(areas: DataFrame, edges: DataFrame, y: str, vardir: str, covariates: list[str], key: str = "domain") -> dict:
    """Fay-Herriot against its spatial extension, both by maximum likelihood: rho = 0 lies inside the larger model, so chi-square with one degree."""
    from areal.operators import area_models, fh

    plain = fh.fit(areas, y, vardir, covariates, key, method="ML", mse_type="none")
    larger = area_models.spatial(areas, edges, y, vardir, covariates, key, method="ML", mse_type="none")
    statistic = max(0.0, 2 * (larger.goodness["loglik"] - plain.goodness["loglik"]))
    return {
        "loglik_fh": plain.goodness["loglik"], "loglik_sfh": larger.goodness["loglik"], "statistic": statistic, "pvalue": chi2_tail(statistic, 1), "delta_aic": larger.goodness["aic"] - plain.goodness["aic"],
        "delta_bic": larger.goodness["bic"] - plain.goodness["bic"], "rho": larger.params["rho"], "sigma2_fh": plain.sigma2_u, "sigma2_sfh": larger.params["sigma2_u"],
    }


def spatial_test(areas: DataFrame, edges: DataFrame, key: str = "domain", y: str = "y", x: str = "x", vardir: str | None = None, alpha: float = 0.05, alternative: str = "greater") -> dict:
    """Statistics and p-values of Moran's I on y and on residuals, LM-error, LM-lag and, with direct variances, the likelihood ratio; and a decision.

    One test decides, so that its level is alpha: the likelihood ratio, or LM-error without direct variances. At least five sampled areas.
    """
    if areas.where(F.col(y).isNotNull()).limit(5).count() < 5:
        raise TableError("fewer than five sampled areas")
    out = {}
    for name, rows, value in (("moran_y", areas, y), ("moran_residuals", ols_residuals(areas, key, y, x), "e")):
        m = moran(rows, edges, key, value).first()
        two = float(normal_tail(m.z))
        upper = two / 2 if m.z > 0 else 1 - two / 2
        out[name] = {"statistic": m.moran_i, "z": m.z, "pvalue": {"greater": upper, "less": 1 - upper, "two.sided": two}[alternative]}
    lm = lagrange(areas, edges, key, y, x).first()
    out |= {k: {"statistic": lm[k], "pvalue": chi2_tail(lm[k], 1) if not math.isnan(lm[k]) else None} for k in ("lm_error", "lm_lag")}
    if vardir:
        out["lrt"] = likelihood_ratio(areas, edges, y, vardir, [x], key)
    by = "lrt" if vardir else "lm_error"
    spatial = out[by]["pvalue"] is not None and out[by]["pvalue"] < alpha
    return out | {"decision": {"test": by, "spatial": spatial, "model": "spatial Fay-Herriot" if spatial else "Fay-Herriot"}}
