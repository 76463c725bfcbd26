"""Unit-level nested error model: one pass for domain statistics, a search in one variable over sums by domain, scoring by columns.

The variance ratio gamma = s2u / s2e is found by narrowing a grid of the profiled likelihood. Its sums over domains are taken in NumPy for up to
LOCAL_DOMAINS domains and by one aggregation per grid beyond that. Bootstrap replicates are drawn from the statistics, not from
units: domain means, and within domains the products of errors with covariates and of errors with themselves, have known
distributions, so a replicate costs as much as there are domains.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.sources.tables import TableError, settled

LOCAL_DOMAINS = 200_000


@dataclass(frozen=True)
class NestedError:
    estimates: DataFrame
    coef: list[dict]
    sigma2_u: float
    sigma2_e: float
    goodness: dict = field(default_factory=dict)


def domain_statistics(units: DataFrame, domain: str, y: str, covariates: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Domain rows (domain, n, y_mean, x_mean) and the cross products within domains of (x, y); units with a NULL are left out.

    One pass over the units: covariances are merged around running means, so nothing cancels.
    """
    names = [*covariates, y]
    m = len(names)
    rows = units.select(F.col(domain).alias("domain"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna()
    products = [F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    stats = settled(rows.groupBy("domain").agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(m)], *products))
    got = stats.agg(*[F.sum(F.col("n") * F.col(f"s{i}_{j}")).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    within = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    return stats.select("domain", "n", F.col(f"m{m - 1}").alias("y_mean"), F.array(*[F.col(f"m{i}") for i in range(m - 1)]).alias("x_mean")), within


@dataclass(frozen=True)
class Sums:
    """Sums over domains at one gamma, of means that are centred at their weighted averages."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    logs: float


def _local_sums(n: np.ndarray, xm: np.ndarray, ym: np.ndarray) -> Callable[[list[float]], list[Sums]]:
    def at(gammas: list[float]) -> list[Sums]:
        out = []
        for g in gammas:
            w = n / (1 + n * g)
            out.append(Sums((xm * w[:, None]).T @ xm, xm.T @ (w * ym), float(np.sum(w * ym * ym)), float(np.log1p(n * g).sum())))
        return out

    return at


def _distributed_sums(stats: DataFrame, p: int) -> Callable[[list[float]], list[Sums]]:
    """stats: n, y, x (array of p, the first one 1)."""

    def at(gammas: list[float]) -> list[Sums]:
        w, xs = F.col("n") / (1 + F.col("n") * F.col("g")), [F.col("x")[i] for i in range(p)]
        rows = stats.withColumn("g", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
        terms = [F.sum(w * xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(w * xs[i] * F.col("y")).alias(f"b{i}") for i in range(p)]
        got = {r.g: r.asDict() for r in rows.groupBy("g").agg(*terms, F.sum(w * F.col("y") ** 2).alias("yy"), F.sum(F.log1p(F.col("n") * F.col("g"))).alias("l")).collect()}
        return [Sums(np.array([[got[g][f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]), np.array([got[g][f"b{i}"] for i in range(p)]), got[g]["yy"], got[g]["l"]) for g in map(float, gammas)]

    return at


def _profile(s: Sums, within: np.ndarray, units: float, reml: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Profiled log-likelihood, with beta, the matrix A and the quadratic form."""
    a, b = s.xx.copy(), s.xy.copy()
    a[1:, 1:] += within[:-1, :-1]
    b[1:] += within[:-1, -1]
    beta = np.linalg.solve(a, b)
    quad = float(within[-1, -1] + s.yy - b @ beta)
    value = -0.5 * ((units - (len(beta) if reml else 0)) * math.log(quad) + s.logs + (np.linalg.slogdet(a)[1] if reml else 0.0))
    return value, beta, a, quad


def _search(at: Callable[[list[float]], list[Sums]], within: np.ndarray, units: float, reml: bool) -> float:
    """The gamma of the largest profiled likelihood: a grid from 1e-8 to 1e8, narrowed around its best point; 0 if that is no worse."""
    values = lambda gs: [_profile(s, within, units, reml)[0] for s in at(gs)]
    points = np.linspace(math.log(1e-8), math.log(1e8), 65)
    while True:
        best = int(np.argmax(values(np.exp(points).tolist())))
        low, high = points[max(0, best - 1)], points[min(len(points) - 1, best + 1)]
        if high - low < 1e-9:
            break
        points = np.linspace(low, high, 17)
    gamma = math.exp(points[best])
    none, some = values([0.0, gamma])
    return 0.0 if none >= some else gamma


def _predicted(gamma: float, beta: np.ndarray, n: np.ndarray, size: np.ndarray, xbar: np.ndarray, xm: np.ndarray, ym: np.ndarray) -> np.ndarray:
    """Means of all domains; ym and xm are 0 where n is."""
    u = gamma * n / (1 + n * gamma) * (ym - xm @ beta)
    f = n / size
    return f * ym + (xbar - f[:, None] * xm) @ beta + (1 - f) * u


def fit(
    units: DataFrame, population: DataFrame, domain: str, y: str, covariates: list[str], popsize: str = "pop_n", method: str = "REML", mse_type: str = "none", replicates: int = 100, seed: int = 1, local_domains: int = LOCAL_DOMAINS,
) -> NestedError:
    """population: domain, popsize and the population means of the covariates under their names; one row a domain.

    estimates: domain, eblup, samp_size, random_effect, mse and rse for every domain of the population; those without units are
    predicted by their covariates. mse_type="bootstrap" runs replicates as tasks; each has its own random stream, so the result
    doesn't depend on partitions. Domains with units but without a population row, and too few units, are errors.
    """
    if method not in ("REML", "ML") or mse_type not in ("none", "bootstrap"):
        raise ValueError("method is REML or ML, mse_type none or bootstrap")
    stats, within = domain_statistics(units, domain, y, covariates)
    population = settled(population.select(F.col(domain).alias("domain"), F.col(popsize).cast("double").alias("_n"), *[F.col(c).cast("double").alias(c) for c in covariates]))
    if not stats.join(population, "domain", "left_anti").isEmpty():
        raise TableError("there are units of domains that the population doesn't have")
    p, reml = len(covariates) + 1, method == "REML"
    total = stats.agg(F.count("*").alias("domains"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y_mean")).alias("y"), *[F.sum(F.col("n") * F.col("x_mean")[i]).alias(f"x{i}") for i in range(p - 1)]).first()
    if total.domains == 0 or total.n <= p:
        raise TableError(f"{total.n or 0} units are too few for {p} coefficients")
    shift, my = np.array([total[f"x{i}"] / total.n for i in range(p - 1)]), total.y / total.n
    if total.domains <= local_domains:
        local = stats.orderBy("domain").toPandas()
        n, ym = local.n.to_numpy(float), local.y_mean.to_numpy() - my
        xm = np.hstack([np.ones((len(local), 1)), np.array(local.x_mean.tolist()).reshape(len(local), p - 1) - shift])
        at = _local_sums(n, xm, ym)
    else:
        centred = [F.lit(1.0)] + [F.col("x_mean")[i] - F.lit(float(shift[i])) for i in range(p - 1)]
        at = _distributed_sums(settled(stats.select(F.col("n").cast("double").alias("n"), (F.col("y_mean") - F.lit(my)).alias("y"), F.array(*centred).alias("x"))), p)
    gamma = _search(at, within, total.n, reml)
    (sums,) = at([gamma])
    _, beta, a, quad = _profile(sums, within, total.n, reml)
    s2e = quad / (total.n - (p if reml else 0))
    back = np.eye(p)
    back[0, 1:] = -shift
    coef, cov = back @ beta + my * np.eye(p)[0], s2e * back @ np.linalg.inv(a) @ back.T

    line = lambda xs: sum((x * float(b) for x, b in zip(xs, coef[1:], strict=True)), F.lit(float(coef[0])))
    both = population.join(stats, "domain", "left")
    xbar, own = [F.col(c) for c in covariates], [F.col("x_mean")[i] for i in range(p - 1)]
    u = F.coalesce(gamma * F.col("n") / (1 + F.col("n") * gamma) * (F.col("y_mean") - line(own)), F.lit(0.0))
    f = F.coalesce(F.col("n") / F.col("_n"), F.lit(0.0))
    seen = f * (F.coalesce("y_mean", F.lit(0.0)) - F.coalesce(line(own), F.lit(0.0)))
    out = both.select("domain", (line(xbar) + seen + (1 - f) * u).alias("eblup"), F.coalesce("n", F.lit(0)).alias("samp_size"), u.alias("random_effect"))
    if mse_type == "bootstrap":
        out = out.join(_bootstrap(both, covariates, within, coef, gamma * s2e, s2e, reml, replicates, seed, local_domains), "domain")
    else:
        out = out.withColumn("mse", F.lit(None).cast("double"))
    out = out.withColumn("rse", F.when(F.col("eblup") != 0, 100 * F.sqrt("mse") / F.abs("eblup")))
    se = np.sqrt(np.diag(cov))
    table = [{"term": t, "beta": float(b), "std_error": float(e), "tvalue": float(b / e)} for t, b, e in zip(["(intercept)", *covariates], coef, se, strict=True)]
    loglik = -0.5 * (total.n * math.log(2 * math.pi * s2e) + sums.logs + quad / s2e)
    k = p + 2
    return NestedError(out, table, gamma * s2e, s2e, {"loglik": loglik, "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + k * math.log(total.n)})


def _bootstrap(both: DataFrame, covariates: list[str], within: np.ndarray, coef: np.ndarray, s2u: float, s2e: float, reml: bool, replicates: int, seed: int, most: int) -> DataFrame:
    """domain and mse: mean squared error of the predicted means over replicates whose fit succeeds."""
    local = both.orderBy("domain").limit(most + 1).toPandas()
    if len(local) > most:
        raise TableError(f"the bootstrap is made for {most} domains at most")
    p = len(coef)
    size, n = local["_n"].to_numpy(float), local["n"].fillna(0).to_numpy(float)
    xbar = np.hstack([np.ones((len(local), 1)), local[covariates].to_numpy(float).reshape(len(local), p - 1)])
    xm = np.zeros((len(local), p))
    has = n > 0
    xm[has] = np.hstack([np.ones((has.sum(), 1)), np.array(local["x_mean"][has].tolist()).reshape(has.sum(), p - 1)])
    wxx = within[:-1, :-1]
    root, inverse = np.linalg.cholesky(wxx + 1e-300 * np.eye(p - 1)) if p > 1 else np.zeros((0, 0)), np.linalg.inv(wxx) if p > 1 else np.zeros((0, 0))
    free = n.sum() - has.sum() - (p - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(len(n)), 0
        for b in batches:
            for r in b["id"]:
                rng = np.random.default_rng([seed, int(r)])
                u = rng.normal(0, math.sqrt(s2u), len(n))
                es = np.where(has, rng.normal(0, 1, len(n)) * np.sqrt(s2e / np.maximum(n, 1)), 0.0)
                rest = size - n
                er = np.where(rest > 0, rng.normal(0, 1, len(n)) * np.sqrt(s2e / np.maximum(rest, 1)), 0.0)
                truth = xbar @ coef + u + n / size * es + rest / size * er
                ym = np.where(has, xm @ coef + u + es, 0.0)
                g = math.sqrt(s2e) * root @ rng.normal(0, 1, p - 1)
                ss = g @ inverse @ g + s2e * rng.chisquare(free)
                w = within.copy()
                w[:-1, -1] = w[-1, :-1] = wxx @ coef[1:] + g
                w[-1, -1] = coef[1:] @ wxx @ coef[1:] + 2 * coef[1:] @ g + ss
                try:
                    at = _local_sums(n[has], xm[has], ym[has])
                    gamma = _search(at, w, n.sum(), reml)
                    beta = _profile(at([gamma])[0], w, n.sum(), reml)[1]
                except (np.linalg.LinAlgError, ValueError):
                    continue  # a failed replicate isn't replaced
                total, count = total + (_predicted(gamma, beta, n, size, xbar, xm, ym) - truth) ** 2, count + 1
        yield pd.DataFrame({"at": range(len(n)), "sq": total, "k": count})

    spark = both.sparkSession
    ids = spark.range(replicates, numPartitions=min(replicates, spark.sparkContext.defaultParallelism))
    got = ids.mapInPandas(run, "at int, sq double, k int").groupBy("at").agg((F.sum("sq") / F.sum("k")).alias("mse"))
    kind = dict(both.dtypes)["domain"]
    named = spark.createDataFrame([(i, x.item() if hasattr(x, "item") else x) for i, x in enumerate(local["domain"])], f"at int, domain {kind}")
    return named.join(got, "at").select("domain", "mse")
