"""Contracts of the input tables, and views over the test tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableError(ValueError):
    """An input table breaks its contract."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: what is read again and again doesn't go back to the units."""
    if getattr(df, "_settled", False):
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="areal-"))
    out = df.checkpoint()
    out._settled = True
    return out


def check_area_table(df: DataFrame, y: str, vardir: str, covariates: list[str], domain: str | None = None) -> None:
    """NULL covariates, and direct variances that aren't positive where y is known, are errors; NULL y is not."""
    missing = [c for c in [y, vardir, *covariates, *([domain] if domain else [])] if c not in df.columns]
    if missing:
        raise TableError(f"no such columns: {', '.join(missing)}")
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    bad_x = F.lit(False)
    for c in covariates:
        bad_x = bad_x | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    bad_v = known & (F.col(vardir).isNull() | ~(F.col(vardir) > 0) | F.isnan(F.col(vardir).cast("double")))
    found = df.agg(F.count_if(bad_x).alias("x"), F.count_if(bad_v).alias("v"), F.count_if(known).alias("m")).first()
    if found.x:
        raise TableError(f"{found.x} rows have a NULL covariate")
    if found.v:
        raise TableError(f"{found.v} rows have a direct variance that is not positive")
    if found.m <= len(covariates) + 1:
        raise TableError(f"{found.m} sampled rows are too few for {len(covariates) + 1} coefficients")


def nation_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their customer's nation and the days from order to shipping."""
    customer, orders, lines = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").alias("domain"), F.datediff("l_shipdate", "o_orderdate").cast("double").alias("lag"), F.col("l_quantity").alias("quantity"))


def area_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: domain, region, n, y (mean lag), vardir and x (mean quantity)."""
    from areal.operators.direct import direct_means

    direct = direct_means(nation_of_units(spark, sf_dir), "domain", "lag", ["quantity"]).withColumnRenamed("mean_quantity", "x")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("domain"), F.col("n_regionkey").alias("region"))
    return settled(direct.join(nation, "domain"))


def area_planted(spark: SparkSession, sf_dir: str, effect: float = 1.5, shift: float = 0.0) -> DataFrame:
    """One row per nation: mean customer balance (thousands) with a planted area effect; x is the share of one segment."""
    c = read(spark, sf_dir, "customer")
    b = F.col("c_acctbal") / 1000
    return settled(c.groupBy(F.col("c_nationkey").alias("domain")).agg(
        F.count("*").alias("n"), (F.avg(b) + effect * F.sin(F.col("c_nationkey").cast("double")) + shift).alias("y"), (F.var_samp(b) / F.count("*")).alias("vardir"),
        F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)).alias("x"),
    ))


def area_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: the share of customers in one segment, its variance, and the region."""
    from areal.operators.direct import direct_proportions

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("domain"), (F.col("c_mktsegment") == "BUILDING").alias("hit"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("domain"), F.col("n_regionkey").alias("region"))
    return settled(direct_proportions(c, "domain", "hit").join(nation, "domain"))
