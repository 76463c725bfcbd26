"""Preparation: smoothing of direct variances and effective numbers of trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.sources.tables import TableError


def effective_trials(df: DataFrame, y: str, vardir: str, n: str, group: str | None = None, method: str = "pooled", deff_fallback: str | None = None, deff_min: float = 1.0) -> DataFrame:
    """df with deff, deff_source and trials = n / deff.

    The design effect is pooled over the rows of a group with a positive variance and a share strictly inside (0, 1): the sum of their
    variances over the sum of those of simple random samples; a group without such rows takes the overall one. method="area"
    takes each row's own, then the fallback, then the pooled one. Rows with a NULL y get NULLs.
    """
    srs = F.col(y) * (1 - F.col(y)) / F.col(n)
    ok = F.coalesce(F.col(y).isNotNull() & (F.col(vardir) > 0) & (srs > 0), F.lit(False))
    ratio = F.sum(F.when(ok, F.col(vardir))) / F.sum(F.when(ok, srs))
    overall = F.lit(df.agg(ratio.alias("o")).first().o).cast("double")
    if group:
        pooled = df.groupBy(F.col(group).alias("_key")).agg(ratio.alias("_g"))
        df = df.join(pooled, F.col(group).eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        df = df.withColumn("_g", overall)
    out = df.withColumns({"_o": overall, "_own": F.when(ok, F.col(vardir) / srs)})
    deff, source = F.coalesce("_g", "_o"), F.when(F.col("_g").isNull(), "overall").otherwise("group")
    if method == "area":
        if deff_fallback:
            usable = F.coalesce(F.col(deff_fallback) > 0, F.lit(False)) & F.col("_own").isNull()
            deff, source = F.when(usable, F.col(deff_fallback)).otherwise(deff), F.when(usable, "fallback").otherwise(source)
        deff, source = F.coalesce("_own", deff), F.when(F.col("_own").isNotNull(), "area").otherwise(source)
    seen = F.col(y).isNotNull()
    deff = F.greatest(deff, F.lit(float(deff_min)))
    return out.withColumns({"deff": F.when(seen, deff), "deff_source": F.when(seen, source), "trials": F.when(seen, F.col(n) / deff)}).drop("_g", "_o", "_own")


def gvf_smooth(df: DataFrame, y: str, vardir: str, n: str | None = None, method: str = "log_linear", bias_correction: bool = True, terms_of: list[str] | None = None) -> tuple[DataFrame, dict]:
    """df with vardir_smooth from a generalised variance function, and the fit (coefficients, residual variance, R2: of deviance for gamma_glm).

    log_linear: ln vardir on ln y (and ln n) by least squares; gamma_glm: the same predictors, gamma errors and a log link;
    cv_power: ln(vardir / y^2) on ln y (and ln n). terms_of: columns that take the place of these predictors, as they are. Fitted on rows with positive values; at least three are needed. A prediction
    that can't be made stays NULL, but is 0 where vardir is 0.
    """
    use = F.col(vardir) > 0
    terms = [F.log(F.col(y).cast("double"))] + ([F.log(F.col(n).cast("double"))] if n else [])
    if terms_of:
        terms = [F.col(c).cast("double") for c in terms_of]
        for c in terms_of:
            use = use & F.col(c).isNotNull()
    use = use & (F.col(y) > 0) & (F.col(n) > 0 if n else F.lit(True))
    target = F.log(F.col(vardir) / F.col(y) ** 2) if method == "cv_power" else F.log(F.col(vardir))
    rows = df.where(use)
    p = len(terms) + 1
    mean = rows.agg(*[F.avg(t).alias(f"m{i}") for i, t in enumerate(terms)], F.avg(target).alias("mt"), F.count("*").alias("k")).first()
    if mean.k < 3:
        raise TableError("fewer than three rows to fit the variance function on")
    x = [F.lit(1.0)] + [t - F.lit(mean[f"m{i}"]) for i, t in enumerate(terms)]

    def normal(weight, response):
        got = rows.agg(*[F.sum(weight * x[i] * x[j]).alias(f"a{i}{j}") for i in range(p) for j in range(p)], *[F.sum(weight * x[i] * response).alias(f"b{i}") for i in range(p)]).first()
        return np.linalg.solve(np.array([[got[f"a{i}{j}"] for j in range(p)] for i in range(p)]), np.array([got[f"b{i}"] for i in range(p)]))

    line = lambda b: sum((x[i] * float(b[i]) for i in range(1, p)), F.lit(float(b[0])))
    if method == "gamma_glm":  # weights are constant for a log link
        b = normal(F.lit(1.0), target)
        for _ in range(100):
            mu = F.exp(line(b))
            new = normal(F.lit(1.0), line(b) + (F.col(vardir) - mu) / mu)
            done = np.abs(new - b).max() < 1e-12 * (1 + np.abs(b).max())
            b = new
            if done:
                break
        correction, s2 = 1.0, None
        mu = F.exp(line(b))
        null = rows.agg(F.avg(vardir).alias("m")).first().m
        dev = rows.agg(F.sum((F.col(vardir) - mu) / mu - F.log(F.col(vardir) / mu)).alias("d"), F.sum(F.col(vardir) / null - 1 - F.log(F.col(vardir) / null)).alias("n")).first()
        r2 = 1 - dev.d / dev.n if dev.n else None
    else:
        b = normal(F.lit(1.0), target)
        left = rows.agg(F.sum((target - line(b)) ** 2).alias("rss"), F.sum((target - F.lit(mean.mt)) ** 2).alias("tss")).first()
        s2 = left.rss / (mean.k - p) if mean.k > p else 0.0
        r2 = 1 - left.rss / left.tss if left.tss else None
        correction = float(np.exp(s2 / 2)) if bias_correction else 1.0
    defined = (F.col(y) > 0) & (F.col(n) > 0 if n else F.lit(True))
    for c in terms_of or []:
        defined = defined & F.col(c).isNotNull()
    smooth = F.exp(line(b)) * correction * (F.col(y) ** 2 if method == "cv_power" else F.lit(1.0))
    out = df.withColumn("vardir_smooth", F.when(F.col(vardir) == 0, 0.0).otherwise(F.when(defined, smooth)))
    return out, {"coef": b.tolist(), "centres": [mean[f"m{i}"] for i in range(p - 1)], "s2": s2, "r2": r2, "rows": mean.k}
