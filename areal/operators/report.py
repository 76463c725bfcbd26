"""Publication sheets and tidy tables: what a workbook, a map or a plot would show, as DataFrames, and their sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.operators.compare import tier

#: Columns that can name an area, in the order in which they are tried.
KEYS = ("domain", "area", "region", "district", "province", "id", "code", "name")
#: Share of areas that a key must match to be taken.
LEAST_MATCH = 0.4


def sheets(fit, estimate: str = "eblup", benchmarked: DataFrame | None = None, thresholds: tuple[float, float] = (25.0, 50.0)) -> dict[str, DataFrame]:
    """Estimates (with interval and reliability), Model_Summary and, where given, Benchmarked and Benchmarked_Groups; rounded to 5, 6 and 2 digits."""
    e = fit.estimates
    out = e.withColumn("se", F.sqrt("mse"))
    if "ci_lower" not in e.columns:
        out = out.withColumn("ci_lower", F.col(estimate) - 1.96 * F.col("se")).withColumn("ci_upper", F.col(estimate) + 1.96 * F.col("se"))
    out = out.withColumn("reliability", tier(F.col("rse"), thresholds))
    digits = lambda c: 2 if c.startswith("rse") else 6 if c.startswith("mse") or c in ("se", "vardir") else 5
    round_ = lambda d: d.select(*[F.round(c, digits(c)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    rows = [("coefficient", c["term"], float(c["beta"]), float(c["std_error"])) for c in fit.coef] + [("goodness", k, float(v), None) for k, v in fit.goodness.items() if v is not None]
    hyper = getattr(fit, "hyper", None) or {k: (v, None) for k, v in (getattr(fit, "params", None) or {"sigma2_u": fit.sigma2_u}).items()}
    rows += [("parameter", k, float(m), None if s is None else float(s)) for k, (m, s) in hyper.items()]
    found = {"Estimates": round_(out), "Model_Summary": round_(e.sparkSession.createDataFrame(rows, "kind string, name string, value double, std_error double"))}
    if benchmarked is not None:
        found["Benchmarked"] = round_(benchmarked)
        if "region" in benchmarked.columns or "group" in benchmarked.columns:
            g = "group" if "group" in benchmarked.columns else "region"
            found["Benchmarked_Groups"] = round_(benchmarked.groupBy(g).agg(F.count("*").alias("n"), F.first("target").alias("target"), F.avg("adjustment").alias("mean_adjustment")))
    return found


def export(sheet: dict[str, DataFrame], folder: str, kind: str = "parquet", overwrite: bool = True) -> list[str]:
    """Writes each sheet to a folder of its own, as parquet or csv (there is no spreadsheet writer); an existing one is an error unless overwrite."""
    if kind not in ("parquet", "csv"):
        raise ValueError("sheets are written as parquet or csv")
    paths = []
    for name, df in sheet.items():
        path = f"{folder.rstrip('/')}/{name}.{kind}"
        writer = df.write.mode("overwrite" if overwrite else "errorifexists")
        writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
        paths.append(path)
    return paths


def matched_key(areas: DataFrame, estimates: DataFrame, key: str | None = None, domain: str = "domain") -> str:
    """The column of `areas` that names the estimates' domains: the one asked for, else a known name, else the one that matches most, of those that match LEAST_MATCH of them."""
    names = estimates.select(F.col(domain).cast("string").alias("k")).distinct()
    n = names.count()

    def share(c: str) -> float:
        return areas.select(F.col(c).cast("string").alias("k")).distinct().join(names, "k", "left_semi").count() / max(n, 1)

    if key:
        if key not in areas.columns:
            raise ValueError(f"there is no column {key}")
        return key
    known = [c for c in (domain, *KEYS) if c in areas.columns and share(c) >= LEAST_MATCH]
    rest = sorted(((share(c), c) for c in areas.columns), key=lambda x: (-x[0], x[1]))
    if known:
        return known[0]
    if rest and rest[0][0] >= LEAST_MATCH:
        return rest[0][1]
    raise ValueError("no column of the areas names the estimates' domains")


def map_table(areas: DataFrame, estimates: DataFrame, values: dict[str, Column], key: str | None = None, domain: str = "domain") -> DataFrame:
    """areas with indicator and value, a row for each of `values`; areas without estimates keep NULL."""
    by = matched_key(areas, estimates, key, domain)
    long = estimates.select(F.col(domain).cast("string").alias("_k"), F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), v.cast("double").alias("value")) for n, v in values.items()])).alias("v")).select("_k", "v.*")
    grid = areas.withColumn("_k", F.col(by).cast("string")).withColumn("indicator", F.explode(F.array(*map(F.lit, values))))
    return grid.join(long, ["_k", "indicator"], "left").drop("_k")


def scatter_table(a: DataFrame, b: DataFrame, names: tuple[str, str], estimate: str = "eblup", domain: str = "domain") -> DataFrame:
    """One row a domain of both: x and y of a scatter of two sets of estimates."""
    return a.select(domain, F.col(estimate).alias(names[0])).join(b.select(domain, F.col(estimate).alias(names[1])), domain)


def ribbon_table(estimates: DataFrame, estimate: str = "eblup", domain: str = "domain") -> DataFrame:
    """domain, series (direct or model), value, low and high: intervals of 1.96 errors."""
    one = lambda name, e, v: F.struct(F.lit(name).alias("series"), e.alias("value"), (e - 1.96 * F.sqrt(v)).alias("low"), (e + 1.96 * F.sqrt(v)).alias("high"))
    return estimates.select(domain, F.explode(F.array(one("direct", F.col("y"), F.col("vardir")), one("model", F.col(estimate), F.col("mse")))).alias("v")).select(domain, "v.*").where("value is not null")


def rank_table(draws: DataFrame, bins: int, groups: int) -> DataFrame:
    """grp, bin and n for every pair of them, 0 where there is nothing. draws: grp (from 0), value in [0, 1)."""
    spark = draws.sparkSession
    grid = spark.range(groups * bins).select((F.col("id") % groups).cast("int").alias("grp"), F.floor(F.col("id") / groups).cast("int").alias("bin"))
    counts = draws.groupBy(F.col("grp").cast("int").alias("grp"), F.floor(F.col("value") * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["grp", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def qq_table(residuals: DataFrame, column: str = "std_residual") -> DataFrame:
    """Sample and normal quantiles of standardised residuals, by rank."""
    from statistics import NormalDist

    from areal.operators.compare import numbered

    rows = numbered(residuals.where(F.col(column).isNotNull()).select("domain", F.col(column).alias("sample")), [F.col("sample"), F.col("domain")], "r")
    n = rows.count()
    quantile = F.udf(lambda r: NormalDist().inv_cdf((r - 0.5) / n), "double")
    return rows.select("domain", "sample", quantile("r").alias("normal"))
