"""Shards of near equal bytes by histogram sort.

Rows are ordered by a composite key: a 64-bit hash of the text, then doc_id, so that equal texts lie side by side.
Splitters between blocks of that order are found without sorting: exact bytes below candidate boundaries are
counted in every partition and added up; the interval that holds a splitter is refined with new probes until the
splitter meets the tolerance. A splitter that falls into a group of equal texts goes to the group's nearer edge, so that the
group stays whole; only a group of over a stated share of a shard is cut, by doc_id. Then rows are exchanged once, to their blocks,
and numbered there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from areal.llm.common import dropped, written

SIGN = -(1 << 63)
#: Probes of one round, over all splitters: what a partition counts, and what it sends at most.
MOST_PROBES = 1 << 16


@dataclass(frozen=True)
class Splitters:
    """Block b has the keys from (hash[b-1], id[b-1]) to below (hash[b], id[b])."""

    hash: np.ndarray
    id: np.ndarray

    def block(self, h: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Index of each key's block: splitters at or below it."""
        left = np.searchsorted(self.hash, h, side="left")
        right = np.searchsorted(self.hash, h, side="right")
        out = right.astype(np.int64)
        inside = np.flatnonzero(left < right)  # only keys whose hash is that of a splitter
        for x in inside.tolist():
            a, b = left[x], right[x]
            out[x] = a + np.searchsorted(self.id[a:b], i[x], side="right")
        return out


def _histogram(keys: DataFrame, splitters: Splitters) -> np.ndarray:
    """Exact bytes between adjacent probes, over all partitions; one small row a partition and bin with rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(splitters.hash) + 1, np.int64)
        for b in batches:
            h, i, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            at = splitters.block(h, i)
            total += np.bincount(at, size, len(total)).astype(np.int64) if size.sum() < 2**52 else np.array([size[at == k].sum() for k in range(len(total))])
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bin", "bytes"])

    found = keys.select("h", "i", "size").mapInArrow(counted, "bin int, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).toArrow()
    out = np.zeros(len(splitters.hash) + 1, np.int64)
    out[found.column("bin").to_numpy()] = found.column("bytes").to_numpy()
    return out


def find_splitters(keys: DataFrame, blocks: int, tolerance: float, whole: int = 0, rounds: int = 64) -> Splitters:
    """blocks - 1 splitters; each has its share of bytes below it, to within tolerance times a block's bytes.

    keys: h (long), i (long), size (long). A group of rows with one h and at most `whole` bytes is not cut; it holds a splitter
    off by half of that at most. A single row, or rows equal in h and i, can hold one off by their own bytes; refinement
    then ends at the nearer edge.
    """
    probes = max(4, min(64, MOST_PROBES // blocks))
    low = [(SIGN, SIGN)] * (blocks - 1)  # bytes below are known to be at most the target's
    high = [(-SIGN, SIGN)] * (blocks - 1)
    below_low = np.zeros(blocks - 1, np.int64)
    best: list[tuple[int, tuple[int, int]] | None] = [None] * (blocks - 1)
    total = None
    for _ in range(rounds):
        points: set[tuple[int, int]] = set()
        for k in range(blocks - 1):
            if low[k] is None:
                continue
            (h0, i0), (h1, i1) = low[k], high[k]
            points.update((low[k], high[k]))
            if h1 - h0 > 1:
                step = max(1, -(-(h1 - h0) // probes))
                points.update((h, SIGN) for h in range(h0 + step, h1, step))
            else:  # one hash: by doc_id
                top = -SIGN if h1 > h0 else i1
                step = max(1, -(-(top - i0) // probes))
                points.update((h0, i) for i in range(i0 + step, top, step))
        edges = sorted(p for p in points if SIGN <= p[0] < -SIGN and SIGN <= p[1] < -SIGN)
        if not edges:
            break
        own = Splitters(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
        counts = _histogram(keys, own)
        below = np.cumsum(counts)[:-1]  # bytes below each edge
        if total is None:
            total = int(counts.sum())
        open_ = 0
        for k in range(blocks - 1):
            if low[k] is None:
                continue
            target = total * (k + 1) / blocks
            at = int(np.searchsorted(below, target, side="right"))
            for e in (at - 1, at):
                if 0 <= e < len(edges) and (best[k] is None or abs(below[e] - target) < abs(best[k][0] - target)):
                    best[k] = (int(below[e]), edges[e])
            if best[k] is not None and abs(best[k][0] - target) <= tolerance * total / blocks:
                low[k] = None
                continue
            low[k] = edges[at - 1] if at else (SIGN, SIGN)
            high[k] = edges[at] if at < len(edges) else (-SIGN, SIGN)
            (h0, i0), (h1, i1) = low[k], high[k]
            one_group = h1 - h0 == 1 and i0 == SIGN and i1 == SIGN
            held = int(below[at] if at < len(edges) else total) - int(below[at - 1] if at else 0)
            if one_group and held <= whole or (h0 == h1 and i1 - i0 <= 1) or (h1 - h0 == 1 and i0 == -SIGN - 1):
                low[k] = None  # nothing that may be cut lies between
            else:
                open_ += 1
        if not open_:
            break
    found = sorted(b[1] if b else (SIGN, SIGN) for b in best)
    return Splitters(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))


def _assigned(keyed: DataFrame, shards: int, tolerance: float, whole_share: float, block_bytes: int, most_blocks: int) -> DataFrame:
    """keyed (h, i, size and any columns) with shard and slot, exchanged once."""
    keys = written(keyed.select("h", "i", "size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    blocks_per_shard = max(1, min(-(-total // (shards * block_bytes)), most_blocks // shards))
    splitters = find_splitters(keys, shards * blocks_per_shard, tolerance, int(whole_share * total / shards))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, i = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splitters.block(h, i).astype(np.int32))], names=[*b.schema.names, "_block"])

    counts = keys.select("h", "i").mapInArrow(numbered, "h long, i long, _block int").groupBy("_block").count().toArrow()
    dropped(keys)
    rows = np.zeros(shards * blocks_per_shard, np.int64)
    rows[counts.column("_block").to_numpy()] = counts.column("count").to_numpy()
    first = np.cumsum(rows) - rows
    first -= np.repeat(first[::blocks_per_shard], blocks_per_shard)
    offsets = F.array(*map(F.lit, first.tolist()))
    front = keyed.select("h", "i", *[c for c in keyed.columns if c not in ("h", "i")])
    order = Window.partitionBy("_block").orderBy("h", "i")
    placed = front.mapInArrow(numbered, StructType([*front.schema.fields, StructField("_block", IntegerType())]))
    return placed.withColumn("slot", F.row_number().over(order).cast("long") - 1 + F.get(offsets, F.col("_block"))).withColumn("shard", (F.col("_block") / blocks_per_shard).cast("int"))


def _keyed(docs: DataFrame, spread: Column) -> DataFrame:
    """spread tells rows without an id apart, so that many copies without one can be cut like others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nameless = F.lit(SIGN) + F.pmod(spread, F.lit(1 << 62))  # below every id from -2^62 on
    return docs.select(
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), nameless).alias("i"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
        F.struct("*").alias("row"),
    )


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, whole_share: float = 0.1, block_bytes: int = 256 << 20, most_blocks: int = 4096) -> DataFrame:
    """docs' rows, whole, with size, text_crc32, shard and slot; law `bytes`: every shard's bytes are near total / shards.

    Equal texts are neighbours, and a group of at most whole_share of a shard's bytes stays in one shard: a shard's bytes are
    off by that share at most, or by what a single row forces. Larger groups are cut by doc_id, and then the shard is off by
    2 * tolerance of a block. A shard is sorted in blocks of about block_bytes, all shards together in most_blocks at most. size is
    the text's UTF-8 bytes plus 8; a null text counts as empty. Rows without an id come first in their group, by a hash of their other
    columns. Rows equal in text and id (or, without an id, in all columns) are not separated. slot numbers a shard's rows
    from 0, without gaps, in the order of the key. An empty table gives no rows. Columns of docs by the names of the new
    ones are replaced.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    placed = _assigned(_keyed(docs, F.xxhash64(F.lit(0), *others)), shards, tolerance, whole_share, block_bytes, most_blocks)
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


def shard_keys(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, whole_share: float = 0.1, block_bytes: int = 256 << 20, most_blocks: int = 4096) -> DataFrame:
    """As shard(), with doc_id in place of whole rows: what a writer needs to know of each row.

    The small rows are written first, so that copies without an id are told apart by where they stand.
    """
    keyed = _keyed(docs.select("doc_id", "text"), F.xxhash64(F.monotonically_increasing_id())).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    return _assigned(written(keyed, "shard-rows"), shards, tolerance, whole_share, block_bytes, most_blocks).select("doc_id", "size", "text_crc32", "shard", "slot")
