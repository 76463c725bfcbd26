"""Comparison of two sets of estimates, reliability flags and diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.functions.special import binomial_cdf, binomial_pmf, chi2_tail, ks_tail, normal_cdf, normal_quantile, normal_tail, poisson_cdf, poisson_pmf
from areal.operators.hb.laplace import designed
from areal.sources.tables import settled


def tier(rse: Column, thresholds: tuple[float, float] = (25.0, 50.0)) -> Column:
    """reliable up to the first threshold, use with caution up to the second, unreliable beyond; NULL stays NULL."""
    return F.when(rse <= thresholds[0], "reliable").when(rse <= thresholds[1], "caution").when(rse > thresholds[1], "unreliable")


def value_class(value: Column, bounds: list[float]) -> Column:
    """Number of the class [b_(k-1), b_k) that holds the value, from 0."""
    out = F.lit(0)
    for b in bounds:
        out = out + (value >= b).cast("int")
    return F.when(value.isNotNull(), out)


def add_reliability_flags(df: DataFrame, rse: str = "rse", thresholds: tuple[float, float] = (25.0, 50.0), estimate: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    out = df.withColumn("reliability", tier(F.col(rse), thresholds))
    return out.withColumn("est_class", value_class(F.col(estimate), bounds)) if estimate and bounds else out


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's number, from 1, in an order over the whole table: sorted by ranges, with offsets of few partitions."""
    # settled first, so that both uses see the same partitions
    placed = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def with_average_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a rank for each column (column -> rank): 1 is the highest; ties share the mean of their ranks; NULL has none.

    Distinct values are ranked, after their rows are counted, so no task sorts the table or gets all rows of a tie.
    """
    for column, rank in columns.items():
        values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_k"))
        placed = settled(values.repartitionByRange(F.col("_v").desc()).withColumn("_part", F.spark_partition_id()))
        totals = placed.groupBy("_part").agg(F.sum("_k").alias("_t"))
        before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
        within = Window.partitionBy("_part").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranks = placed.withColumn("_above", F.coalesce(F.sum("_k").over(within), F.lit(0))).join(F.broadcast(before), "_part")
        ranks = ranks.select("_v", (F.col("_above") + F.col("_before") + (F.col("_k") + 1) / 2).alias(rank))
        df = df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")
    return df


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys with est_1, mse_1, est_2, mse_2: rows of both, matched by the keys as strings."""
    side = lambda d, i: d.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("est").cast("double").alias(f"est_{i}"), F.col("mse").cast("double").alias(f"mse_{i}"))
    return side(a, 1).join(side(b, 2), keys)


def compare_rows(both: DataFrame, keys: list[str]) -> DataFrame:
    """Differences, z_diff, MSE ratio, ranks and rank change of every row."""
    diff = F.col("est_2") - F.col("est_1")
    out = both.withColumns({"diff": diff, "z_diff": F.when(F.col("mse_1") > 0, diff / F.sqrt("mse_1")), "mse_ratio": F.when(F.col("mse_2") > 0, F.col("mse_1") / F.col("mse_2"))})
    out = with_average_ranks(out, {"est_1": "rank_1", "est_2": "rank_2"})
    return out.withColumn("rank_change", F.col("rank_2") - F.col("rank_1")).orderBy(*keys)


def compare_metrics(both: DataFrame) -> DataFrame:
    """One row: n, mean_diff, sd_diff, limits of agreement, mae, rmsd, ccc (Lin), pearson and spearman."""
    d = F.col("est_2") - F.col("est_1")
    ranked = with_average_ranks(both, {"est_1": "r1", "est_2": "r2"})
    ccc = 2 * F.covar_pop("est_1", "est_2") / (F.var_pop("est_1") + F.var_pop("est_2") + (F.avg("est_1") - F.avg("est_2")) ** 2)
    return ranked.agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_lower"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_upper"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmsd"), ccc.alias("ccc"), F.corr("est_1", "est_2").alias("pearson"), F.corr("r1", "r2").alias("spearman"),
    )


def top_overlap(both: DataFrame, key: str, top: float = 0.1) -> DataFrame:
    """One row: k, and how many of the k highest (lowest) of one are among those of the other; ties by key."""
    n = both.count()
    k = max(1, round(top * n)) if top < 1 else int(top)
    rows = both
    for i in (1, 2):
        rows = numbered(rows, [F.col(f"est_{i}").desc(), F.col(key)], f"top_{i}")
        rows = numbered(rows, [F.col(f"est_{i}").asc(), F.col(key)], f"bottom_{i}")
    within = lambda name: F.count_if((F.col(f"{name}_1") <= k) & (F.col(f"{name}_2") <= k))
    return rows.agg(F.lit(k).alias("k"), within("top").alias("top_overlap"), within("bottom").alias("bottom_overlap"))


def precision_summary(estimates: DataFrame, estimate: str = "eblup", threshold: float = 25.0) -> DataFrame:
    """One row: n, quartiles and mean of rse, share of rows up to the threshold, mean reduction of the direct error."""
    direct = 100 * F.sqrt("vardir") / F.abs("y")
    return estimates.agg(
        F.count("rse").alias("n"), F.avg("rse").alias("rse_mean"), F.percentile("rse", 0.25).alias("rse_q1"), F.median("rse").alias("rse_median"), F.percentile("rse", 0.75).alias("rse_q3"), F.max("rse").alias("rse_max"),
        F.avg(F.when(F.col("rse").isNotNull(), F.when(F.col("rse") <= threshold, 1.0).otherwise(0.0))).alias("share_reliable"), F.avg(1 - F.col("rse") / direct).alias("mean_gain"),
    )


def brown(estimates: DataFrame, estimate: str = "eblup") -> DataFrame:
    """One row: m, W = sum (y - est)^2 / (vardir + mse), and slope, intercept, r2 of the regression of y on the estimates."""
    rows = estimates.where(F.col("y").isNotNull() & (F.col("vardir") + F.col("mse") > 0))
    y, e = F.col("y"), F.col(estimate)
    return rows.agg(F.count("*").alias("m"), F.sum((y - e) ** 2 / (F.col("vardir") + F.col("mse"))).alias("w"), F.regr_slope(y, e).alias("slope"), F.regr_intercept(y, e).alias("intercept"), F.regr_r2(y, e).alias("r2"))


def residual_table(estimates: DataFrame, estimate: str = "eblup") -> DataFrame:
    """domain, direct_y, sae_pred, vardir, mse, direct_rse, sae_rse, eff_ratio, residual, std_residual and is_sampled of every row.

    Standardised where the direct variance exceeds the model's error.
    """
    y, e, v, m = F.col("y"), F.col(estimate), F.col("vardir"), F.col("mse")
    known = y.isNotNull()
    rse = lambda var, of: F.when(of != 0, 100 * F.sqrt(var) / F.abs(of))
    return estimates.select(
        "domain", y.alias("direct_y"), e.alias("sae_pred"), v.alias("vardir"), m.alias("mse"), F.when(known, rse(v, y)).alias("direct_rse"), rse(m, e).alias("sae_rse"), F.when(known & (m > 0), v / m).alias("eff_ratio"),
        (y - e).alias("residual"), F.when(known & (v > m), (y - e) / F.sqrt(v - m)).alias("std_residual"), known.alias("is_sampled"),
    )


def simulation_metrics(estimates: DataFrame, truth: DataFrame, estimate: str = "eblup") -> DataFrame:
    """One row: mean_rb, mean_abs_rb, rrmse (percent) and, with ci_lower and ci_upper, coverage_rate. truth: domain, truth."""
    both = estimates.join(truth, "domain")
    error, t = F.col(estimate) - F.col("truth"), F.col("truth")
    known = F.when(error.isNotNull(), t)
    rate = F.avg(F.when((t >= F.col("ci_lower")) & (t <= F.col("ci_upper")), 100.0).when(F.col("ci_lower").isNotNull(), 0.0)) if "ci_lower" in estimates.columns else F.lit(None).cast("double")
    return both.agg(F.avg(100 * error / t).alias("mean_rb"), F.avg(F.abs(100 * error / t)).alias("mean_abs_rb"), (100 * F.sqrt(F.avg(error**2)) / F.avg(F.abs(known))).alias("rrmse"), rate.alias("coverage_rate"))


def calibration(below: np.ndarray, up_to: np.ndarray, seed: int = 1, alpha: float = 0.05) -> dict:
    """Of predictive probabilities: P(Y < y) and P(Y <= y) of each row, from which randomised values are drawn where they differ.

    Kolmogorov-Smirnov distance from uniform with its p-value, and the share of values in the central 90 percent with its range under calibration.
    """
    u = np.random.default_rng(seed + 1).random(len(up_to))
    pit = np.where(up_to > below, below + u * (up_to - below), up_to)
    pit = np.sort(pit[np.isfinite(pit)])
    n = len(pit)
    if n < 5:
        return {"n": n}
    steps = np.arange(1, n + 1) / n
    d = float(max((steps - pit).max(), (pit - steps + 1 / n).max()))
    half = normal_quantile(1 - alpha / 2) * math.sqrt(0.9 * 0.1 / n)
    p = ks_tail(d, n)
    return {"n": n, "d": d, "pvalue": p, "calibrated": p >= alpha, "central90": float(((pit >= 0.05) & (pit <= 0.95)).mean()), "central90_range": (0.9 - half, 0.9 + half), "pit": pit}


def mixed_predictive(fit, n_draws: int = 1000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """P(Y < y) and P(Y <= y) of sampled rows when their area effects are drawn anew: for gaussian, binomial and poisson Bayesian fits.

    The area effect of each draw is replaced by a fresh one of the same hyperparameters; what is left of the linear predictor stays.
    """
    post = fit.posterior
    f = post.field
    if fit.family not in ("gaussian", "binomial", "poisson"):
        raise ValueError("mixed predictive checks are made for gaussian, binomial and poisson models")
    rng = np.random.default_rng(seed)
    of = rng.choice(len(post.points), n_draws, p=post.weights)
    below, up_to = np.zeros(len(f.row)), np.zeros(len(f.row))
    y = f.likelihood.y
    for k in np.unique(of):
        p, many = post.points[k], int((of == k).sum())
        _, parts = designed(f, p.values)
        z = p.mode[:, None] + np.linalg.solve(p.root.T, rng.standard_normal((len(p.mode), many)))
        area = parts[[e.name for e in f.effects].index("area")]
        z[area] = rng.standard_normal((area.stop - area.start, many))
        mean = f.likelihood.mean(p.design[f.row] @ z + p.offset[f.row][:, None])
        if fit.family == "gaussian":
            at = normal_cdf((y[:, None] - mean) / np.sqrt(f.likelihood.extra["vardir"])[:, None]).sum(axis=1)
            below, up_to = below + at, up_to + at
        else:
            n = f.likelihood.extra.get("trials")
            e = np.broadcast_to(f.likelihood.extra.get("exposure", 1.0), y.shape)
            for i, value in enumerate(y):
                if fit.family == "binomial":
                    upper, own = binomial_cdf(round(value), round(n[i]), mean[i]), binomial_pmf(round(value), round(n[i]), mean[i])
                else:
                    upper, own = poisson_cdf(round(value), mean[i] * e[i]), poisson_pmf(round(value), mean[i] * e[i])
                up_to[i] += upper.sum()
                below[i] += (upper - own).sum()
    return below / n_draws, up_to / n_draws


def diagnose(
    estimates: DataFrame, estimate: str = "eblup", threshold: float = 25.0, alpha: float = 0.05, edges: DataFrame | None = None, truth: DataFrame | None = None, fit=None, n_draws: int = 1000, seed: int = 1,
) -> dict:
    """Precision, calibration against direct estimates (p-value: three rows at least; the line: five), Moran's I of residuals with edges, errors with truth,
    criteria and predictive calibration with a Bayesian fit, the table of residuals, and a status: pass, caution or warning."""
    p, b = precision_summary(estimates, estimate, threshold).first().asDict(), brown(estimates, estimate).first().asDict()
    b["pvalue"] = chi2_tail(b["w"], b["m"]) if b["m"] >= 3 else None
    if b["m"] < 5:
        b |= {"slope": None, "intercept": None, "r2": None}
    table = residual_table(estimates, estimate)
    out = {"precision": p, "calibration": b, "residuals": table}
    if edges is not None:
        from areal.operators.spatial import moran

        m = moran(table.select("domain", "residual"), edges, value="residual", floor=1e-8).first()
        out["spatial"] = m.asDict() | {"pvalue": float(normal_tail(m.z))} if m.n >= 5 else None
    if truth is not None:
        out["simulation"] = simulation_metrics(estimates, truth, estimate).first().asDict()
    if fit is not None:
        out["bayesian"] = dict(fit.goodness)
        if fit.family in ("gaussian", "binomial", "poisson"):
            out["bayesian"]["pit"] = calibration(*mixed_predictive(fit, n_draws, seed), seed, alpha)
    fits = b["pvalue"] is None or b["pvalue"] >= alpha
    precise = p["share_reliable"] is None or p["share_reliable"] >= 0.8
    return out | {"status": "pass" if fits and precise else "caution" if not fits else "warning"}


def class_probabilities(estimates: DataFrame, bounds: list[float], estimate: str = "eblup", se: Column | None = None) -> DataFrame:
    """estimates with est_class and prob_class: how likely the true value lies in the class of the estimate, as a normal with the model's error."""
    se = F.sqrt("mse") if se is None else se
    edges = [-math.inf, *bounds, math.inf]

    @F.pandas_udf("double")
    def chance(e: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        ok = e.notna() & s.notna() & (s > 0)
        at = np.where(ok, k.fillna(0), 0).astype(int)
        low, high = np.array(edges)[at], np.array(edges)[at + 1]
        with np.errstate(invalid="ignore"):
            both = normal_cdf((high - e.fillna(0)) / s.where(ok, 1.0)) - normal_cdf((low - e.fillna(0)) / s.where(ok, 1.0))
        return pd.Series(both).where(ok.reset_index(drop=True))

    out = estimates.withColumn("est_class", value_class(F.col(estimate), bounds))
    return out.withColumn("prob_class", chance(F.col(estimate).cast("double"), se.cast("double"), F.col("est_class")))
