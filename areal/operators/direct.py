"""Direct estimators per domain: one aggregation with partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def direct_means(units: DataFrame, domain: str, y: str, also: list[str] = ()) -> DataFrame:
    """domain, n, y (mean), vardir (sample variance / n) and mean_<c> for other columns; units with a NULL y are left out."""
    return units.where(F.col(y).isNotNull()).groupBy(domain).agg(F.count("*").alias("n"), F.avg(y).alias("y"), (F.var_samp(y) / F.count("*")).alias("vardir"), *[F.avg(c).alias(f"mean_{c}") for c in also])


def direct_proportions(units: DataFrame, domain: str, hit: str) -> DataFrame:
    """domain, n, y (share) and vardir = y (1 - y) / (n - 1)."""
    share = F.avg(F.when(F.col(hit), 1.0).otherwise(0.0))
    return units.where(F.col(hit).isNotNull()).groupBy(domain).agg(F.count("*").alias("n"), share.alias("y"), (share * (1 - share) / (F.count("*") - 1)).alias("vardir"))
