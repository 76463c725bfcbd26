"""Approximate nearest neighbours by multi-index hashing.

Rotations are learned on a bounded sample (each starts at random and is turned towards the signs of the turned vectors); the
signs of the rotated vectors are a binary code, several rotations giving as many bits as wanted. A code is split into
substrings about as long as the logarithm of the number of rows, and every row is indexed under each of them. Two codes within a
radius r agree, in at least one of m substrings, up to floor(r / m) bits (pigeonhole; up to one bit fewer in all but the first
r mod m + 1 substrings), so a query that probes all values that near, in every substring, meets every code within the
radius. Those are ranked by their float vectors. The radius is measured: it holds the wanted share of the true neighbours
of a bounded number of queries, found by brute force over all rows. Queries that find fewer than k rows probe again with a wider one.

A query meets its rows in many ranges, in tasks that don't know of each other; were each to return its k best, what they return would follow the
number of ranges times that of queries. So probing begins with a part of the rows of bounded size, then takes one `growth` times as large and so on up to
all. What a query has found in one part is a floor for the next: rows below its k-th best score can't be among the k best, since those
are met again. So a query gets about growth * k rows a part, and what is found is the same.

Index entries are dealt out by (substring, first bits of its value), and a query goes to those values' ranges only that hold
a value near enough. Large ranges and large sets of queries are split further, so that a task's share is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areal.llm.common import dropped, small, written


@dataclass(frozen=True)
class Settings:
    k: int = 20
    rotations: int = 4
    sample: int = 8192
    probe_queries: int = 192
    #: Share of true neighbours that the radius holds.
    share: float = 0.98
    #: Entries of a range, and queries that meet them, in one task's table.
    part_rows: int = 8192
    part_queries: int = 4096
    #: Rows of the first part that is probed for floors, at most, and how many times larger the next ones are.
    first_rows: int = 1024
    growth: int = 4


@dataclass(frozen=True)
class Plan:
    """Of what the codes consist and how far probing goes."""

    bits: int
    width: int
    radius: int
    #: First bits of a substring that name its range.
    lead: int

    @property
    def substrings(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each; the last one may be shorter."""
        return [(b, min(self.width, self.bits - b)) for b in range(0, self.bits, self.width)]

    def reach(self, j: int) -> int:
        """Bits by which probes of substring j may differ; -1: it needn't be probed."""
        near, rest = divmod(self.radius, len(self.substrings))
        return near if j <= rest else near - 1


def learn(sample: np.ndarray, rotations: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """A (dim, rotations * dim) matrix; each square part is orthogonal."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    parts = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) >= dim else 0):
            u, _, v = np.linalg.svd(np.sign(unit @ turn).T @ unit)
            turn = (u @ v).T
        parts.append(turn)
    return np.hstack(parts)


def signs(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows, bits) codes, a bit a byte."""
    return (vectors @ turn > 0).view(np.uint8)


def packed(bits: np.ndarray) -> np.ndarray:
    """(rows, words of 64 bits) of codes."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def values(bits: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, substrings) of their values."""
    out = np.empty((len(bits), len(plan.substrings)), np.uint32)
    for j, (first, n) in enumerate(plan.substrings):
        out[:, j] = bits[:, first : first + n].astype(np.uint32) @ (1 << np.arange(n - 1, -1, -1, dtype=np.uint32))
    return out


def ranges(value: np.ndarray, j: int, plan: Plan) -> np.ndarray:
    n = plan.substrings[j][1]
    return value >> np.uint32(max(0, n - plan.lead))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of largest inner product with query, ties to smaller ids, without query_id; and the products."""
    own = np.flatnonzero(ids != query_id)
    scores = (vectors[own] * query).sum(axis=1)
    if len(own) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        own, scores = own[keep], scores[keep]
    order = np.lexsort((ids[own], -scores))[:k]
    return ids[own[order]], scores[order]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and v (array of float or double, as given; other numbers as double): rows with an id and a finite vector that isn't zero."""
    kind = vectors.schema[column].dataType
    v = F.col(column) if kind.simpleString() in ("array<float>", "array<double>") else F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _far(rows: DataFrame, asked: pa.Table, turn: np.ndarray, dim: int, settings: Settings) -> int:
    """The code distance that holds the wanted share of the true neighbours of the asked queries, by brute force over all rows."""
    ids_of, v_of, k = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"), dim), settings.k
    codes_of = packed(signs(v_of, turn))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            codes = packed(signs(v, turn))
            for x in range(len(ids_of)):
                scores = np.where(ids != ids_of[x], v @ v_of[x], -np.inf)
                top = np.argpartition(scores, len(scores) - k)[-k:] if len(scores) > k else np.arange(len(scores))
                top = top[scores[top] > -np.inf]
                old = out.get(x, (np.zeros(0), np.zeros(0, np.int64)))
                scores, far = np.concatenate((old[0], scores[top])), np.concatenate((old[1], np.bitwise_count(codes[top] ^ codes_of[x]).sum(axis=1, dtype=np.int64)))
                order = np.argsort(-scores, kind="stable")[:k]
                out[x] = scores[order], far[order]
        if out:
            x = np.repeat(list(out), [len(o[0]) for o in out.values()])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(np.concatenate([o[0] for o in out.values()])), pa.array(np.concatenate([o[1] for o in out.values()]).astype(np.int32))], names=["x", "score", "far"])

    top = Window.partitionBy("x").orderBy(F.desc("score"))
    found = rows.mapInArrow(exactly, "x int, score double, far int").withColumn("r", F.row_number().over(top)).where(f"r <= {k}")
    radius = found.agg(F.percentile("far", settings.share).alias("r")).first().r
    return int(np.ceil(radius)) if radius is not None else turn.shape[1]


def _entries(rows: DataFrame, plan: Plan, turn: np.ndarray, dim: int, probes: bool) -> DataFrame:
    """rows (vec_id, v) once for each range: with probes, those that hold a value near enough; otherwise those of their own values."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                value = values(signs(_matrix(part.column(1), dim), turn), plan)
                row, sub, at = [], [], []
                for j, (_, n) in enumerate(plan.substrings):
                    own = ranges(value[:, j], j, plan)
                    if probes:
                        every = np.arange(1 << min(n, plan.lead), dtype=np.uint32)
                        r, a = np.nonzero(np.bitwise_count(own[:, None] ^ every[None, :]) <= plan.reach(j))
                    else:
                        r, a = np.arange(len(own)), own
                    if plan.reach(j) >= 0:
                        row, sub, at = [*row, r], [*sub, np.full(len(r), j, np.int32)], [*at, a.astype(np.int32)]
                chosen = part.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sub)), pa.array(np.concatenate(at)), *chosen.columns], names=["j", "range", *part.schema.names])

    kept = rows.select("vec_id", "v", *["floor"] * probes)
    return kept.mapInArrow(dealt, f"j int, range int, vec_id long, v {dict(rows.dtypes)['v']}" + ", floor double" * probes)


def _met(rows: DataFrame, queries: DataFrame, plan: Plan, turn: np.ndarray, dim: int, settings: Settings) -> DataFrame:
    """query_id, vec_id and score: every row within the radius of a query's code that reaches its floor, but for those that k better ones in its range's part beat.

    queries: vec_id, v, floor (a score, or null).
    """
    k = settings.k
    entries, probes = _entries(rows, plan, turn, dim, False), _entries(queries, plan, turn, dim, True)
    sizes = entries.groupBy("j", "range").agg(F.count("*").alias("n")).join(probes.groupBy("j", "range").agg(F.count("*").alias("q")), ["j", "range"])
    parts = sizes.select("j", "range", F.ceil(F.col("n") / settings.part_rows).cast("int").alias("a"), F.ceil(F.col("q") / settings.part_queries).cast("int").alias("b"))
    parts = written(parts, "ranges")
    near = F.broadcast(parts) if small(parts, 100_000) else parts
    salt = lambda of: F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = entries.join(near, ["j", "range"]).withColumn("pa", salt("a")).withColumn("pb", every("b")).select("j", "range", "pa", "pb", "vec_id", "v")
    right = probes.join(near, ["j", "range"]).withColumn("pb", salt("b")).withColumn("pa", every("a")).select("j", "range", "pa", "pb", "vec_id", "v", "floor")

    def met(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out = []
        if left.num_rows and right.num_rows:
            j = key[0].as_py()
            ids, v = left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim)
            bits = signs(v, turn)
            code, value = np.ascontiguousarray(packed(bits).T), np.ascontiguousarray(values(bits, plan).T)
            q_ids, q_v = right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim)
            floor = right.column("floor").fill_null(-np.inf).to_numpy()
            q_bits = signs(q_v, turn)
            q_code, q_value = packed(q_bits), values(q_bits, plan)
            for x in range(len(q_ids)):
                at = np.flatnonzero(np.bitwise_count(value[j] ^ q_value[x, j]) <= plan.reach(j))  # what the probes hit
                far = np.zeros(len(at), np.int32)
                for word, own in zip(code, q_code[x], strict=True):
                    far += np.bitwise_count(word[at] ^ own)
                at = at[far <= plan.radius]
                for earlier in range(j):  # a pair counts in the first substring where it meets
                    if len(at):
                        at = at[np.bitwise_count(value[earlier, at] ^ q_value[x, earlier]).astype(np.int32) > plan.reach(earlier)]
                if len(at):
                    got, scores = best(ids[at], v[at], q_ids[x], q_v[x], k)
                    n = int((scores >= floor[x]).sum())  # best first
                    out.append((np.full(n, q_ids[x]), got[:n], scores[:n]))
        if not out:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        return pa.table([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=names)

    by = ["j", "range", "pa", "pb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(met, "query_id long, vec_id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _probed(rows: DataFrame, queries: DataFrame, plan: Plan, turn: np.ndarray, dim: int, settings: Settings) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows within the radius of a query's code."""
    step, left = 1, rows.count()
    while left > settings.first_rows:
        step, left = step * settings.growth, left // settings.growth
    asked = queries.select("vec_id", "v").withColumn("floor", F.lit(None).cast("double"))
    while step > 1:
        part = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(step)) == 0)
        few = replace(plan, lead=max(0, plan.lead - int(np.log2(step))))  # as many ranges as a part needs
        found = _ranked(_met(part, asked, few, turn, dim, settings), settings.k).where(f"rank = {settings.k}")
        # a larger part holds this one, so that floors only rise
        floors = found.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        earlier, asked = asked, written(queries.select("vec_id", "v").join(floors, "vec_id", "left"), "asked")
        dropped(earlier)
        step //= settings.growth
    return _ranked(_met(rows, asked, plan, turn, dim, settings), settings.k)


def visits(plan: Plan, sample: np.ndarray, turn: np.ndarray) -> float:
    """The share of all rows that the probes of a query hit, each hit in each substring counted: over 1 where probing costs more than a scan."""
    value = values(signs(sample, turn), plan)
    near = [np.bitwise_count(value[:200, j][:, None] ^ value[:, j][None, :]) <= plan.reach(j) for j in range(value.shape[1])]
    return float(sum(x.mean() for x in near))


def planned(rows: DataFrame, queries: DataFrame, dim: int, total: int, settings: Settings) -> tuple[Plan, np.ndarray, np.ndarray] | None:
    """The plan, the rotations and the sample they were learned on; None without queries."""
    mixed = F.xxhash64("vec_id", F.lit(1))
    sample = _matrix(rows.orderBy(mixed, "vec_id").limit(settings.sample).toArrow().column("v"), dim)
    asked = queries.orderBy(mixed).limit(settings.probe_queries).toArrow()
    if not asked.num_rows:
        return None
    turn = learn(sample, settings.rotations)
    width = int(np.clip(round(np.log2(max(2, total))), 8, 24))
    lead = int(np.clip(np.ceil(np.log2(max(1, total / settings.part_rows))), 0, min(width, 12)))
    return Plan(turn.shape[1], width, _far(rows, asked, turn, dim, settings), lead), turn, sample


def _of_length(rows: DataFrame, dim: int, total: int, settings: Settings, every: int) -> DataFrame | None:
    rows = rows.where(F.size("v") == dim)
    queries = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    found = planned(rows, queries, dim, total, settings)
    if found is None:
        return None
    plan, turn, _ = found
    out, left = [], queries
    while True:
        hits = written(_probed(rows, left, plan, turn, dim, settings), "hits")
        full = hits.where(F.col("rank") == settings.k).select(F.col("query_id").alias("vec_id"))
        if plan.radius >= plan.bits:  # all rows were within the radius
            return _union([*out, hits])
        few = written(left.join(full, "vec_id", "left_anti"), "few")
        out.append(hits.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi"))
        if few.isEmpty():
            return _union(out)
        left, plan = few, replace(plan, radius=min(plan.bits, plan.radius + max(1, plan.bits // 8)))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def nearest(vectors: DataFrame, settings: Settings = Settings(), every: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of every query (ids divisible by `every`), against all rows.

    Nearness is the inner product in double precision, ties go to smaller ids; a query has k rows, or one for each
    candidate if there are fewer. Vectors that are null, zero or hold null or non-finite components take no part, nor
    do rows without an id. Vectors of several lengths are searched apart, each among its own. Repeated rows are candidates each; a query
    with several rows asks once (its least vector), and no row with the query's own id is its neighbour. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = written(usable(vectors, id_column, column), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [x for r in lengths if (x := _of_length(rows, r.d, r["count"], settings, every)) is not None]
    out = _union(found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not found:
        dropped(rows)
    return out.select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: list[int], k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> dict[int, list[tuple[int, float]]]:
    """Brute force for tests: (vec_id, score) of the nearest of each query, on the driver."""
    table = usable(vectors, id_column, column).toArrow()
    ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), len(table.column("v")[0]))
    at = {i: r for r, i in enumerate(ids.tolist())}
    return {q: list(zip(*(x.tolist() for x in best(ids, v, q, v[at[q]], k)), strict=True)) for q in queries if q in at}
