"""Fay-Herriot area model: fitted from sums over the area table, scored by column expressions.

The variance of the area effects is found by Fisher scoring. Each iteration needs sums of p x p products only: for up to LOCAL_ROWS
rows they are taken in NumPy, beyond that by one aggregation per iteration on the executors; both give the same fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areal.functions.special import normal_tail
from areal.sources.tables import TableError, check_area_table, settled

LOCAL_ROWS = 200_000


@dataclass(frozen=True)
class FayHerriot:
    estimates: DataFrame
    coef: list[dict]
    sigma2_u: float
    n_iter: int
    converged: bool
    goodness: dict = field(default_factory=dict)
    beta: np.ndarray | None = None
    q: np.ndarray | None = None
    covariates: tuple[str, ...] = ()
    method: str = "REML"
    n_sampled: int = 0
    #: domain, g1 and r (array): the matrix of the leading error terms is diag(g1) + r q r'; None on the log scale.
    error_parts: DataFrame | None = None
    error_q: np.ndarray | None = None


@dataclass
class Sums:
    """Sums over sampled rows at one variance: weights v = 1 / (psi + s2), their powers, and residuals."""

    v: float
    v2: float
    a1: np.ndarray  # sum v x x'
    a2: np.ndarray
    a3: np.ndarray
    xy: np.ndarray
    pairs: Callable[[np.ndarray], tuple[float, float]]  # beta -> sum v^2 r^2, -2 loglik


def local_sums(x: np.ndarray, y: np.ndarray, psi: np.ndarray) -> Callable[[float], Sums]:
    def at(s2: float) -> Sums:
        v = 1 / (psi + s2)
        gram = lambda w: (x * w[:, None]).T @ x

        def pairs(beta: np.ndarray) -> tuple[float, float]:
            r = y - x @ beta
            return float(np.sum((v * r) ** 2)), float(np.sum(np.log(2 * np.pi / v) + v * r * r))

        return Sums(v.sum(), (v**2).sum(), gram(v), gram(v**2), gram(v**3), x.T @ (v * y), pairs)

    return at


def _distributed(rows: DataFrame, p: int) -> Callable[[float], Sums]:
    """rows: y, psi, x (array); two aggregations per iteration, no more than p * p numbers reach the driver."""

    def at(s2: float) -> Sums:
        v = 1 / (F.col("psi") + float(s2))
        xs = [F.col("x")[i] for i in range(p)]
        terms = [(f"g{k}_{i}_{j}", v**k * xs[i] * xs[j]) for k in (1, 2, 3) for i in range(p) for j in range(i, p)]
        got = rows.agg(F.sum(v).alias("v"), F.sum(v**2).alias("v2"), *[F.sum(v * xs[i] * F.col("y")).alias(f"b_{i}") for i in range(p)], *[F.sum(t).alias(n) for n, t in terms]).first().asDict()
        gram = [np.array([[got[f"g{k}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for k in (1, 2, 3)]

        def pairs(beta: np.ndarray) -> tuple[float, float]:
            r = F.col("y") - sum((xs[i] * float(beta[i]) for i in range(1, p)), xs[0] * float(beta[0]))
            row = rows.agg(F.sum((v * r) ** 2).alias("s"), F.sum(F.log(2 * math.pi / v) + v * r * r).alias("l")).first()
            return row.s, row.l

        return Sums(got["v"], got["v2"], *gram, np.array([got[f"b_{i}"] for i in range(p)]), pairs)

    return at


def scoring(at: Callable[[float], Sums], start: float, method: str, maxiter: int, precision: float) -> tuple[float, int, bool]:
    """The variance, how many steps it took, and whether it settled."""
    s2, change, step = start, math.inf, 0
    while change > precision and step < maxiter:
        s = at(s2)
        q = np.linalg.pinv(s.a1, hermitian=True)
        quadratic, _ = s.pairs(q @ s.xy)
        k2 = q @ s.a2
        if method == "REML":
            score = 0.5 * (quadratic - s.v + np.trace(k2))
            info = 0.5 * (s.v2 - 2 * np.trace(q @ s.a3) + np.trace(k2 @ k2))
        else:
            score, info = 0.5 * (quadratic - s.v), 0.5 * s.v2
        new = s2 + score / info if info > 0 else 0.0
        new = new if math.isfinite(new) and new > 0 else 0.0
        change = abs(new - s2) / max(s2, 1e-12)
        s2, step = new, step + 1
    return s2, step, change <= precision


def fit(
    df: DataFrame, y: str, vardir: str, covariates: list[str], domain: str = "domain", method: str = "REML", transform: str = "none", mse_type: str = "analytical",
    maxiter: int = 100, precision: float = 1e-4, intercept: bool = True, local_rows: int = LOCAL_ROWS,
) -> FayHerriot:
    """Fay-Herriot model of y on covariates; rows with a NULL y are predicted.

    estimates: domain, y, eblup, vardir, random_effect, mse, rse (and eblup_log, mse_log with transform="log"), the order and
    number of rows of df. Errors: NULL covariates, direct variances that aren't positive, too few rows, rank deficiency.
    """
    if method not in ("REML", "ML") or transform not in ("none", "log") or mse_type not in ("analytical", "none"):
        raise ValueError("method is REML or ML, transform none or log, mse_type analytical or none")
    df = settled(df)
    check_area_table(df, y, vardir, covariates, domain)
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    yv, pv = F.when(known, F.col(y).cast("double")), F.when(known, F.col(vardir).cast("double"))
    if transform == "log":
        if df.where(known & (F.col(y) <= 0)).limit(1).count():
            raise TableError("the log transform needs positive y")
        yv, pv = F.log(yv), pv / F.col(y).cast("double") ** 2
    means = df.where(known).agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(covariates)], F.avg(yv).alias("my"), F.median(pv).alias("psi"), F.count("*").alias("m")).first()
    shift = [means[f"m{i}"] if intercept else 0.0 for i in range(len(covariates))]
    my = means.my if intercept else 0.0
    centred = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") - F.lit(s) for c, s in zip(covariates, shift, strict=True)]]
    p, m = len(centred), means.m
    rows = df.where(known).select((yv - F.lit(my)).alias("y"), pv.alias("psi"), F.array(*centred).alias("x"))
    if m <= local_rows:
        got = rows.toArrow()
        at = local_sums(np.array(got.column("x").to_pylist()), got.column("y").to_numpy(), got.column("psi").to_numpy())
    else:
        at = _distributed(settled(rows), p)
    gram = at(0.0).a1
    scale = np.sqrt(np.diag(gram))
    if (scale == 0).any() or np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10) < p:
        raise TableError("the covariates are linearly dependent")

    s2, n_iter, converged = scoring(at, means.psi, method, maxiter, precision)
    s = at(s2)
    q = np.linalg.inv(s.a1)
    beta = q @ s.xy
    _, minus2 = s.pairs(beta)
    bias = -np.trace(q @ s.a2) / s.v2 if method == "ML" else 0.0
    rows_of = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") - F.lit(x) for c, x in zip(covariates, shift, strict=True)]]
    linear = F.lit(my) + sum((rows_of[i] * float(beta[i]) for i in range(1, p)), rows_of[0] * float(beta[0]))
    xqx = sum((rows_of[i] * rows_of[j] * float(q[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    shrink = pv / (pv + s2)
    effect = F.when(known, (1 - shrink) * (yv - linear))
    theta = linear + F.coalesce(effect, F.lit(0.0))
    mse = F.when(known, pv * (1 - shrink) + shrink**2 * xqx + 2 * shrink**2 * (2 / s.v2) / (pv + s2) - bias * shrink**2).otherwise(s2 + xqx)
    mse = mse if mse_type == "analytical" else F.lit(None).cast("double")
    out = df.select("*", theta.alias("_theta"), mse.alias("_mse"), effect.alias("random_effect"), F.when(known, 1 - shrink).alias("_gamma"))
    if transform == "log":
        gamma = F.coalesce("_gamma", F.lit(0.0))
        out = out.withColumn("eblup", F.exp(F.col("_theta") + 0.5 * s2 * (1 - gamma))).withColumn("mse", F.col("eblup") ** 2 * F.col("_mse"))
        extra = [F.col("_theta").alias("eblup_log"), F.col("_mse").alias("mse_log")]
    else:
        out, extra = out.withColumn("eblup", F.col("_theta")).withColumn("mse", F.col("_mse")), []
    rse = F.when(F.col("eblup") != 0, 100 * F.sqrt("mse") / F.abs("eblup"))
    estimates = out.select(F.col(domain).alias("domain"), F.col(y).alias("y"), "eblup", F.col(vardir).alias("vardir"), "random_effect", "mse", rse.alias("rse"), *extra)
    parts = None
    if transform == "none":
        lead = F.when(known, shrink).otherwise(F.lit(1.0))
        parts = df.select(F.col(domain).alias("domain"), (F.lit(s2) * lead).alias("g1"), F.array(*[lead * c for c in rows_of]).alias("r"))
    # back to covariates that aren't centred
    names = [*(["(intercept)"] if intercept else []), *covariates]
    back = np.eye(p)
    if intercept:
        back[0, 1:] = [-x for x in shift]
    coef, cov = back @ beta, back @ q @ back.T
    if intercept:
        coef = coef + np.eye(p)[0] * my
    se = np.sqrt(np.diag(cov))
    table = [{"term": t, "beta": float(b), "std_error": float(e), "zvalue": float(b / e), "pvalue": float(normal_tail(b / e))} for t, b, e in zip(names, coef, se, strict=True)]
    loglik = -0.5 * minus2
    goodness = {"loglik": loglik, "aic": -2 * loglik + 2 * (p + 1), "bic": -2 * loglik + (p + 1) * math.log(m), "kic": -2 * loglik + 3 * (p + 1)}
    return FayHerriot(estimates, table, s2, n_iter, converged, goodness, coef, cov, tuple(names), method, m, parts, q)


def benchmark_covariate(df: DataFrame, y: str, vardir: str, weight: str | None = None, group: str | None = None) -> DataFrame:
    """df with z = normalised weight times vardir over sampled rows (0 elsewhere): fitted with it, the estimates add up."""
    known = F.col(y).isNotNull()
    w = F.when(known, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).otherwise(0.0)
    df = df.withColumn("_w", w)
    if group:
        total = F.sum("_w").over(Window.partitionBy(group))
    else:
        total = F.lit(df.agg(F.sum("_w").alias("t")).first().t)
    return df.withColumn("z", F.when(known, F.col("_w") / total * F.coalesce(F.col(vardir), F.lit(0.0))).otherwise(0.0)).drop("_w")


#: Groups that can be benchmarked within the model, as each is a coefficient.
MOST_BENCHMARKS = 200


def self_benchmarked(
    df: DataFrame, y: str, vardir: str, covariates: list[str], domain: str = "domain", weight: str | None = None, group: str | None = None, target: float | dict | None = None, **how,
) -> tuple[FayHerriot, DataFrame]:
    """A fit whose estimates of sampled rows add up, by weight, to a target in each group; and a table of groups.

    A covariate for each group, normalised weight times vardir, makes weighted sums of residuals vanish; y is moved first by the distance of the
    direct aggregate from the target (by default there is none). Rows without y get no weight; NULL weights count as 0, negative ones and
    groups whose weights add up to 0 are errors. The table: group, direct, target, shift, benchmarked.
    """
    df = settled(df)
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    key = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("All")
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.withColumns({"_g": key, "_w": F.when(known, own).otherwise(0.0)})
    sums = rows.where(known).groupBy("_g").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(y)).alias("wy"), F.min("_w").alias("least")).orderBy("_g").limit(MOST_BENCHMARKS + 1).collect()
    if len(sums) > MOST_BENCHMARKS:
        raise TableError(f"{MOST_BENCHMARKS} groups at most can be benchmarked within the model")
    if any(r.least < 0 for r in sums):
        raise TableError("weights must not be negative")
    if any(r.w <= 0 for r in sums):
        raise TableError("the weights of a group's sampled rows must add up to more than 0")
    direct = {r["_g"]: r.wy / r.w for r in sums}
    wanted = {g: d if target is None else float(target.get(g, d)) if isinstance(target, dict) else float(target) for g, d in direct.items()}
    shift, total = F.lit(0.0), F.lit(1.0)
    for r in sums:
        here = F.col("_g") == r["_g"]
        shift = F.when(here, wanted[r["_g"]] - direct[r["_g"]]).otherwise(shift)
        total = F.when(here, r.w).otherwise(total)
    z = F.col("_w") / total * F.when(known, F.col(vardir).cast("double")).otherwise(0.0)
    names = [f"_z{i}" for i in range(len(sums))]
    columns = {n: F.when(F.col("_g") == r["_g"], z).otherwise(0.0) for n, r in zip(names, sums, strict=True)}
    moved = rows.withColumns({**columns, "_shift": F.when(known, shift)}).withColumn(y, F.when(known, F.col(y) + F.col("_shift")).otherwise(F.col(y)))
    found = fit(moved, y, vardir, [*covariates, *names], domain, **how)
    back = found.estimates.drop("y").join(df.select(F.col(domain).alias("domain"), F.col(y).alias("y")), "domain").select(*found.estimates.columns)
    found = replace(found, estimates=back)
    at = rows.select(F.col(domain).alias("domain"), "_g", (F.col("_w") / total).alias("_w")).join(back.select("domain", "eblup"), "domain")
    schema = "group string, direct double, target double, shift double"
    table = df.sparkSession.createDataFrame([(g, d, wanted[g], wanted[g] - d) for g, d in direct.items()], schema)
    return found, table.join(at.groupBy(F.col("_g").alias("group")).agg(F.sum(F.col("_w") * F.col("eblup")).alias("benchmarked")), "group")
