"""What the text operators share: reading, written intermediate tables, words, let-bindings, memory of Python workers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither blank nor one of the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Bytes of text that a Python worker takes up at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all runs in one process may it be a local one, if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("areal.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="areal-")
        spark.conf.set("areal.shared.dir", found)
    return found.rstrip("/")


def _database(spark: SparkSession) -> str:
    """This session's database of intermediate tables, in the shared folder; it goes when the driver ends."""
    name = spark.conf.get("areal.scratch", None)
    if not name:
        name = f"areal_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_dir(spark)}/{name}'")
        spark.conf.set("areal.scratch", name)

        def dropped() -> None:
            with contextlib.suppress(Exception):  # the session may be gone, and its folder is then the cluster's to clean
                spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")

        atexit.register(dropped)
    return name


class Written:
    """Tables by the DataFrames that read them."""

    names: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    The table stays until it is dropped() or the driver ends.
    """
    spark = df.sparkSession
    table = f"{_database(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").saveAsTable(table)
    out = spark.table(table)
    Written.names[id(out)] = (out, table)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        _, table = Written.names.pop(id(df), (None, None))
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


_held: tuple[Any, Any] | None = None


def held(key: Any, make: Callable[[], Any]) -> Any:
    """make()'s result, remembered by this worker until another key is asked for: a worker that goes from one operator to
    the next holds the memory of one only."""
    global _held
    if _held is None or _held[0] != key:
        _held = None
        trim()
        _held = (key, make())
    return _held[1]


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts add up to `most` bytes (a longer text comes alone); freed memory is given back at the end."""
    for b in batches:
        first = size = 0
        for at, n in enumerate(pa.compute.binary_length(b.column(column)).fill_null(0).to_pylist()):
            if size and size + n > most:
                yield b.slice(first, at - first)
                first, size = at, 0
            size += n
        if first < b.num_rows:
            yield b.slice(first)
    trim()
