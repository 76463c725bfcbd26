"""Benchmarking of estimates to known totals: one and two stages, first-order mean squared errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.sources.tables import TableError, settled

#: Groups whose logit shifts are found.
MOST_GROUPS = 200_000
METHODS = ("ratio", "difference", "optimal", "logit")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit_shifts(rows: DataFrame, group: list[str], bound: float = 50.0, rounds: int = 80, tolerance: float = 1e-13) -> DataFrame:
    """group and a, with sum(w * sigmoid(logit(p) + a)) = target in each group. rows: group, p, w, target.

    Newton's steps, or halving where one would leave the bracket, for all groups at once: a round is one grouped sum, and only groups' sums
    reach the driver (MOST_GROUPS at most).
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    rows = settled(rows.select(*group, F.log(F.col("p") / (1 - F.col("p"))).alias("l"), "w", "target"))
    first = rows.groupBy(*group).agg(F.first("target").alias("t")).limit(MOST_GROUPS + 1).collect()
    if len(first) > MOST_GROUPS:
        raise TableError(f"logit benchmarks are made for {MOST_GROUPS} groups at most")
    state = {tuple(r[g] for g in group): [0.0, -bound, bound, r.t] for r in first}
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "a double"])
    table = lambda: spark.createDataFrame([(*k, v[0]) for k, v in state.items()], schema)
    for _ in range(rounds):
        e = _sigmoid(F.col("l") + F.col("a"))
        sums = rows.join(F.broadcast(table()), group).groupBy(*group).agg(F.sum(F.col("w") * e).alias("s"), F.sum(F.col("w") * e * (1 - e)).alias("d")).collect()
        moved = 0.0
        for r in sums:
            v = state[tuple(r[g] for g in group)]
            a, low, high, t = v
            low, high = (a, high) if r.s < t else (low, a)
            new = a + (t - r.s) / r.d if r.d > 0 else low - 1
            new = new if low < new < high else (low + high) / 2
            moved = max(moved, abs(new - a))
            v[:3] = new, low, high
        if moved < tolerance:
            break
    return table()


def _checked(rows: DataFrame, groups: DataFrame, method: str, weight: str | None) -> None:
    """Weights that aren't positive, targets that are missing or infinite, aggregates near 0 for ratios and values outside (0, 1) for logits are errors."""
    wrong = lambda c: F.coalesce(c, F.lit(True))
    t = F.col("_t")
    found = rows.agg(F.count_if(wrong(~(F.col("_raw") > 0) | (F.col("_raw") == float("inf")))).alias("w"), F.count_if(t.isNull() | F.isnan(t)).alias("t"), F.count_if(wrong(~((t > 0) & (t < 1)))).alias("p")).first()
    if weight and found.w:
        raise TableError(f"{found.w} rows have a weight that is not positive")
    if found.t:
        raise TableError(f"{found.t} rows have no estimate")
    target = F.col("_target")
    per = groups.agg(F.count_if(wrong(F.isnan(target) | (F.abs(target) == float("inf")))).alias("t"), F.count_if(wrong(F.abs("_own") < 1e-12)).alias("o"), F.count_if(wrong(~((target > 0) & (target < 1)))).alias("p")).first()
    if per.t:
        raise TableError(f"{per.t} groups have no finite target")
    if method == "ratio" and per.o:
        raise TableError(f"{per.o} groups have an aggregate too near 0 for a ratio")
    if method == "logit" and (found.p or per.p):
        raise TableError("logit benchmarks need estimates and targets inside (0, 1)")


def _error_products(fit, rows: DataFrame, g: str) -> DataFrame:
    """domain and mw: each row's product of the matrix of mean squared errors with its group's weights. rows: domain, group, _w, _m.

    The matrix is that of the leading terms' correlations, scaled to the reported errors. For a Fay-Herriot fit it is a diagonal plus
    a product of as many columns as there are coefficients, so a group needs one sum of that length; other fits bring an operator.
    """
    if getattr(fit, "error_parts", None) is not None:
        q, both = fit.error_q, rows.join(fit.error_parts, "domain")
        p = len(q)
        r = [F.col("r")[i] for i in range(p)]
        spread = sum((r[i] * r[j] * float(q[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
        both = both.withColumn("_d", F.sqrt(F.greatest(F.col("g1") + spread, F.lit(2.220446049250313e-16)))).withColumn("_v", F.sqrt(F.greatest("_m", F.lit(0.0))) * F.col("_w") / F.col("_d"))
        over = Window.partitionBy(g)
        sums = [F.sum(r[i] * F.col("_v")).over(over) for i in range(p)]
        both = both.withColumns({f"_s{i}": x for i, x in enumerate(sums)})
        product = F.col("g1") * F.col("_v") + sum((r[i] * float(q[i, j]) * F.col(f"_s{j}") for i in range(p) for j in range(p)), F.lit(0.0))
        return both.select("domain", (F.sqrt(F.greatest("_m", F.lit(0.0))) * product / F.col("_d")).alias("_mw"))
    keys = fit.keys
    local = rows.select("domain", g, "_w").toPandas().set_index("domain").reindex(keys[keys.columns[0]])
    out = []
    for _, members in local.groupby(g, sort=False):
        v = np.where(local.index.isin(members.index), local["_w"].fillna(0.0).to_numpy(float), 0.0)
        product = fit.error_operator(v)
        out += [(k, float(x)) for k, x, own in zip(local.index.tolist(), product, local.index.isin(members.index), strict=True) if own]
    return rows.sparkSession.createDataFrame(out, f"domain {dict(rows.dtypes)['domain']}, _mw double")


def benchmark(
    df: DataFrame, estimate: str, target: DataFrame | float | None, weight: str | None = None, group: str | None = None, method: str = "ratio", kind: str = "mean", mse: str | None = None, national_target: float | None = None, fit=None,
) -> DataFrame:
    """df with original, benchmarked, adjustment, rel_adjustment_pct, target (and mse_benchmarked if mse is given).

    target: a number (one group), a table (group, target), or None with a national target: groups then start from their own
    aggregates. With a national target and several groups, group targets are first moved to meet it. kind "mean" normalises weights in
    each group, "total" doesn't. The first-order error of row i is mse - 2 k (M w)_i + adjustment^2: with `fit`, the model that gave the
    estimates (rows then have its `domain`), M is its matrix of errors, otherwise the diagonal of mse. Inputs that can't be
    benchmarked are errors, see _checked().
    """
    if method not in METHODS or kind not in ("mean", "total"):
        raise ValueError("unknown method or kind")
    if national_target is not None and group and target is not None and not isinstance(target, DataFrame):
        raise TableError("a single target can't be the targets of groups under a national one")
    if method == "logit" and kind == "total" and national_target is not None:
        raise TableError("logit targets of groups can't be moved to a national total")
    g = group or "_group"
    df = settled(df)
    rows = df if group else df.withColumn("_group", F.lit(1))
    rows = rows.withColumn("_raw", F.col(weight).cast("double") if weight else F.lit(1.0))
    within = Window.partitionBy(g)
    w = F.try_divide("_raw", F.sum("_raw").over(within)) if kind == "mean" else F.col("_raw")  # weights that add up to 0 are an error below
    rows = rows.withColumn("_w", w).withColumn("_t", F.col(estimate).cast("double")).withColumn("_m", F.col(mse).cast("double") if mse else F.lit(None).cast("double"))
    groups = rows.groupBy(g).agg(F.sum("_raw").alias("_size"), F.sum(F.col("_w") * F.col("_t")).alias("_own"), F.sum(F.col("_w") ** 2 * F.greatest(F.col("_m"), F.lit(1e-8))).alias("_gm"), F.count_if(F.col("_m").isNull()).alias("_missing"))
    if isinstance(target, DataFrame):
        groups = groups.join(target.select(g, F.col("target").cast("double").alias("_target")), g, "left")
    else:
        groups = groups.withColumn("_target", F.col("_own") if target is None else F.lit(float(target)))
    groups = settled(groups)
    _checked(rows, groups, method, weight)
    if national_target is not None and groups.count() > 1:
        every = Window.partitionBy(F.lit(0))  # one row a group
        share = F.col("_size") / F.sum("_size").over(every) if kind == "mean" else F.lit(1.0)
        groups = groups.withColumn("_share", share)
        gap = F.lit(float(national_target)) - F.sum(F.col("_share") * F.col("_target")).over(every)
        if method == "ratio":
            moved = F.col("_target") * F.lit(float(national_target)) / F.sum(F.col("_share") * F.col("_target")).over(every)
        elif method == "difference":
            moved = F.col("_target") + (gap if kind == "mean" else gap / F.count("*").over(every))
        elif method == "optimal":
            spread = F.when(F.sum("_missing").over(every) > 0, F.lit(1.0)).otherwise(F.greatest("_gm", F.lit(1e-8)))
            groups = groups.withColumn("_spread", spread)
            moved = F.col("_target") + F.col("_share") * F.col("_spread") * gap / F.sum(F.col("_share") ** 2 * F.col("_spread")).over(every)
        else:
            shifts = logit_shifts(groups.select(F.lit(1).alias("k"), F.col("_target").alias("p"), F.col("_share").alias("w"), F.lit(float(national_target)).alias("target")), ["k"])
            groups = groups.crossJoin(F.broadcast(shifts.select(F.col("a").alias("_a"))))
            moved = _sigmoid(F.log(F.col("_target") / (1 - F.col("_target"))) + F.col("_a"))
        groups = groups.withColumn("_moved", F.when(F.abs(gap) > 1e-7, moved).otherwise(F.col("_target"))).withColumn("_target", F.col("_moved"))
    rows = rows.join(groups.select(g, "_target", "_own", "_missing"), g)
    gap = F.col("_target") - F.col("_own")
    sw = lambda c: F.sum(c).over(within)
    floor = F.greatest("_m", F.lit(1e-8))
    flat = 1 / sw(F.col("_w"))
    if method == "ratio":
        k = F.col("_t") / F.col("_own")
        new = F.col("_t") * F.col("_target") / F.col("_own")
    elif method == "optimal":
        usable = (F.col("_missing") == 0) & (F.max("_m").over(within) > 0)
        k = F.when(usable, F.col("_w") * floor / sw(F.col("_w") ** 2 * floor)).otherwise(flat)
        new = F.col("_t") + k * gap
    elif method == "difference":
        k, new = flat, F.col("_t") + flat * gap
    else:
        shifts = logit_shifts(rows.select(g, F.col("_t").alias("p"), F.col("_w").alias("w"), F.col("_target").alias("target")), [g])
        rows = rows.join(shifts, g)
        v = F.col("_t") * (1 - F.col("_t"))
        k, new = v / sw(F.col("_w") * v), _sigmoid(F.log(F.col("_t") / (1 - F.col("_t"))) + F.col("a"))
    rows = rows.withColumn("_k", k).withColumn("benchmarked", new).withColumn("adjustment", F.col("benchmarked") - F.col("_t"))
    out = [*df.columns, F.col("_w").alias("weight"), F.col("_t").alias("original"), "benchmarked", "adjustment", (100 * F.col("adjustment") / F.col("_t")).alias("rel_adjustment_pct"), F.col("_target").alias("target")]
    if mse:
        if fit is not None and (getattr(fit, "error_parts", None) is not None or getattr(fit, "error_operator", None) is not None):
            rows = rows.join(_error_products(fit, rows.select("domain", *([g] if g != "domain" else []), "_w", "_m"), g), "domain")
        else:
            rows = rows.withColumn("_mw", F.col("_w") * F.col("_m"))
        first_order = F.greatest(F.col("_m") - 2 * F.col("_k") * F.col("_mw") + F.col("adjustment") ** 2, F.lit(0.0))
        out.append(F.when(F.col("_missing") == 0, first_order).alias("mse_benchmarked"))
    return rows.select(*[c for c in out if not (isinstance(c, str) and c == "weight")])
