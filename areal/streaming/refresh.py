"""Direct estimates and domain statistics that follow a stream of units: all of them are mergeable sums, kept as the query's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_means(units: DataFrame, domain: str, y: str, also: list[str] = ()) -> DataFrame:
    """domain, n, y, vardir and mean_<c> over all units so far; units with a NULL y are left out. For output mode `complete` or `update`."""
    known = units.where(F.col(y).isNotNull())
    return known.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n"), F.avg(y).alias("y"), (F.var_samp(y) / F.count("*")).alias("vardir"), *[F.avg(c).alias(f"mean_{c}") for c in also])


def windowed_means(units: DataFrame, time: str, width: str, late: str, domain: str, y: str) -> DataFrame:
    """The same by windows of time; units later than `late` are left out, and a window's row comes once it is closed (output mode `append`)."""
    known = units.where(F.col(y).isNotNull()).withWatermark(time, late)
    out = known.groupBy(F.window(time, width).alias("w"), F.col(domain).alias("domain")).agg(F.count("*").alias("n"), F.avg(y).alias("y"), (F.var_samp(y) / F.count("*")).alias("vardir"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "domain", "n", "y", "vardir")


def refreshed(areas: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Calls each(area table, batch) whenever running means change, for instance to fit a model and write its estimates anew."""
    return areas.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
