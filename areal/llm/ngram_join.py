"""Near-duplicate documents: a size-aware join of n-gram sets by Jaccard similarity, heavy and light sets apart.

Equal sets are one class from the start. Two sets link when 100 * overlap >= percent * union. Light (small) sets
enumerate their subsets of the sizes that a linked partner must share with them: two linked light sets have such a
subset in common. Heavy (large) sets go into inverted lists, by the part of each set, rarest elements first,
in which two linked sets must meet. The boundary between them is where enumeration would begin to make more keys than the
lists make entries to scan. Rarity comes from counts of all elements in a table of fixed size; any order gives the same links.

Lists are not expanded into pairs. An entry's position in its set's order bounds the overlap with another set that first meets it
there; members of a list are ordered by it, so that those with the fewest rare elements of their own come first. First, each
member is compared exactly with its list's first one and with its neighbour, and the links found are contracted to
components. Only lists that still hold several components are compared further: members of different components whose
positions allow a link, each pair once, in blocks of a bounded number of members. Before sets are fetched for an exact comparison, parity bits rule out most pairs: a bit
is the parity of the elements that fall on it, so two sets differ in at least as many elements as in bits. So a list of thousands of near copies costs about as many comparisons as it
has members, and no link that joins two components is lost.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.llm.common import dropped, held, sliced, small, written
from areal.llm.components import connected_components

KEPT_WORDS = 300_000
#: Slots of the table of element counts, and how many entries a list part has before it is split.
SLOTS = 1 << 22
PART = 1024
#: Words of 64 parity bits of a set, and of one with LONG elements or more.
BITS, LONG_BITS, LONG = 8, 64, 2000
#: Light sets have fewer elements than this at most.
LIGHT_MOST = 40
#: Candidates' ids go to all executors only up to this number; beyond it rows are shuffled.
BROADCAST_IDS = 400_000


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * overlap >= percent * union of their distinct word n-grams."""

    words: int = 3
    percent: int = 90

    def overlap(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, a):
        """Least size of a set linked with one of size a."""
        return -(-self.percent * a // 100)

    def prefix(self, a):
        """How many of a set's elements, first in the common order, meet those of every linked set."""
        return a - self.overlap(a, self.least(a)) + 1

    def subset_sizes(self, a: int) -> list[int]:
        """Sizes of the subsets that a light set of size a enumerates."""
        partners = range(self.least(a), 100 * a // self.percent + 1)
        return sorted({self.overlap(a, b) for b in partners if self.overlap(a, b) <= min(a, b)})


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


def _words() -> _Words:
    return held("words", _Words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def elements(text: str | None, rule: Rule) -> np.ndarray:
    """64-bit hashes of the distinct n-grams of a whole text, sorted; A-Z count as a-z.

    A text with fewer words than n has one element, its words as a sequence; without words there is none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_words().__getitem__, found), np.uint64, len(found))
    n = min(rule.words, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * ODD[0] + words[k : len(words) - n + 1 + k] * ODD[1 + k % 4])
    return np.unique(out)


def _node(found: np.ndarray) -> bytes:
    """96 bits that stand for a set."""
    return struct.pack(">QQ", int(_mixed(found).sum() & np.uint64(2**64 - 1)), int(_mixed(found * ODD[1]).sum() & np.uint64(2**64 - 1)))[:12]


def _parity(found: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each bit."""
    width = 64 * (BITS if len(found) < LONG else LONG_BITS)
    odd = np.bincount((_mixed(found * ODD[3]) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _census(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all elements by slot, and how many sets there are of each size below LIGHT_MOST.

    The table has a fixed size, so what reaches the driver doesn't follow the input.
    """
    block = 1 << 14

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes = np.zeros(SLOTS, np.int32), np.zeros(LIGHT_MOST, np.int64)
        for b in sliced(batches, 0):
            for text in b.column(0):
                found = elements(text.as_py(), rule)
                slots[(found & np.uint64(SLOTS - 1)).astype(np.int64)] += 1  # elements of a set are distinct: few share a slot
                if len(found) < LIGHT_MOST:
                    sizes[len(found)] += 1
        parts = [(k, slots[k * block : (k + 1) * block].astype(np.int64)) for k in range(SLOTS // block)] + [(-1, sizes)]
        parts = [(k, zlib.compress(x.tobytes(), 1)) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "counts"])

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})

    schema = "block int, counts binary"
    found = docs.select("text").mapInArrow(counted, schema).groupBy("block").applyInArrow(added, schema).toArrow()
    slots, sizes = np.zeros(SLOTS, np.int32), np.zeros(LIGHT_MOST, np.int64)
    for k, x in zip(found.column("block").to_pylist(), found.column("counts").to_pylist(), strict=True):
        values = np.frombuffer(zlib.decompress(x), np.int32)
        if k < 0:
            sizes[:] = values
        else:
            slots[k * block : (k + 1) * block] = values
    return slots, sizes


def boundary(slots: np.ndarray, sizes: np.ndarray, rule: Rule) -> int:
    """The size from which sets are heavy: below it, subsets cost no more than list entries and their scanning.

    A set enters the lists of its rarest elements only, so the length of a list is that of the rarest elements, as many of all as the prefix
    is of a set, less what other elements add to a slot. (The average list grows with the table, and with it the sets that would be
    light and their subsets.)
    """
    count, times = np.unique(slots, return_counts=True)
    count = count.astype(np.float64)
    mass = np.cumsum(count * times)  # elements in slots of at most so many
    scanned = np.cumsum(count * count * times)
    total = mass[-1]

    def length(a: int) -> float:
        upto = min(np.searchsorted(mass, total * rule.prefix(a) / a), len(mass) - 1)
        return max(0.0, scanned[upto] / mass[upto] - total / SLOTS) if mass[upto] else 0.0

    best, best_cost, cost = 1, 0.0, 0.0
    for a in range(1, LIGHT_MOST):
        light = sum(comb(a, c) for c in rule.subset_sizes(a))
        cost += float(sizes[a]) * (light - rule.prefix(a) * (1 + length(a)))
        if cost <= best_cost:
            best, best_cost = a + 1, cost
    return best


#: Bits of a key that are kept: lists of two keys that agree in them only give more candidates.
KEY = np.uint64((1 << 48) - 1)
NO_BITS = np.zeros(0, np.int64)
NO_KEYS = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)


def _keys(found: np.ndarray, slots: np.ndarray, light: int, rule: Rule, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A set's keys, into how many parts the list of each is split, and how many elements come before it in the set's order."""
    a = len(found)
    keys, parts, places = [], [], []
    if a < light:
        mixed = _mixed(found * ODD[2])
        whole = mixed.sum()
        for c in rule.subset_sizes(a):
            left_out = combinations(range(a), a - c)
            sums = np.array([whole - mixed[list(x)].sum() if x else whole for x in left_out], np.uint64)
            keys.append(_mixed(sums + np.uint64(c)))
            parts.append(np.ones(len(sums), np.int32))
            places.append(np.zeros(len(sums), np.int32))
    if a >= rule.least(light):  # heavy, or light and perhaps linked with a heavy one
        count = slots[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
        first = np.lexsort((found, count))[: int(rule.prefix(a))]
        keys.append(found[first])
        parts.append(1 + count[first] // part)
        places.append(np.arange(len(first)))
    if not keys:
        return NO_KEYS
    return np.concatenate(keys) & KEY, np.concatenate(parts).astype(np.int32), np.concatenate(places).astype(np.int32)


def _sets(docs: DataFrame, slots: np.ndarray, light: int, rule: Rule) -> DataFrame:
    """doc_id, node (12 bytes), n, the keys and the parity bits of each document's set."""
    part = PART  # bound here: workers import the module anew

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            nodes, sizes, keys, parts, places, bits = [], [], [], [], [], []
            done: dict[bytes, bool] = {}
            for text in b.column(1):
                found = elements(text.as_py(), rule)
                node = _node(found) if len(found) else None
                k, p, at = NO_KEYS if node is None or node in done else _keys(found, slots, light, rule, part)
                bits.append(_parity(found) if node is not None and node not in done else NO_BITS)
                done[node] = True  # equal sets have equal keys: once a batch will do
                nodes.append(node)
                sizes.append(len(found))
                keys.append(k)
                parts.append(p)
                places.append(at)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            bit_offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in bits]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(bit_offsets, pa.array(np.concatenate(bits)))],
                names=["doc_id", "node", "n", "keys", "parts", "places", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keyed, "doc_id long, node binary, n long, keys array<long>, parts array<int>, places array<int>, bits array<long>")


def _paired(rows: DataFrame, *list_of: str) -> DataFrame:
    """rows with the next entry of their list, its first one, their number in it, and whether it has over three."""
    order = Window.partitionBy(*list_of).orderBy("at", "n", "node")
    me = F.struct("node", "n", "at")
    found = rows.withColumns({"next": F.lead(me).over(order), "head": F.first(me).over(order), "r": F.row_number().over(order), "two": F.lead("n", 2).over(order), "three": F.lead("n", 3).over(order)})
    many = F.when(F.col("r") == 1, F.col("three").isNotNull()).when(F.col("r") == 2, F.col("two").isNotNull()).when(F.col("r") == 3, F.col("next").isNotNull()).otherwise(True)
    return found.withColumn("many", many).drop("two", "three")


def _neighbours(lists: DataFrame) -> DataFrame:
    """Pairs of each entry with the first of its list and with the next one; split lists are joined at their parts' first entries."""
    heads = _paired(lists.where("r = 1 and part > 0").select("key", "node", "n", "at"), "key")
    both = lists.select("node", "n", "at", "next", "head").union(heads.select("node", "n", "at", "next", "head"))
    other = both.select("node", "n", "at", F.explode(F.array("next", "head")).alias("o")).where("o is not null")
    return other.select("node", "n", "at", F.col("o.node").alias("b"), F.col("o.n").alias("bn"), F.col("o.at").alias("bat"))


def _allowed(rule: Rule) -> Column:
    """Sizes allow a link, and so do positions if this is the first element, in the common order, that both sets have."""
    sizes = F.least("n", "bn") * 100 >= F.greatest("n", "bn") * rule.percent
    most = F.least(F.col("n") - F.col("at"), F.col("bn") - F.col("bat"))
    return sizes & (most * (100 + rule.percent) >= (F.col("n") + F.col("bn")) * rule.percent)


def _ordered(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Distinct candidate pairs a < b that may be links."""
    return pairs.where(_allowed(rule) & (F.col("node") != F.col("b"))).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _not_ruled_out(rule: Rule, n: str, bits: str, other_n: str, other_bits: str) -> Column:
    """Whether parity bits leave room for a link: two sets differ in at least as many elements as in bits."""
    apart = F.aggregate(F.zip_with(bits, other_bits, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda k, x: k + x)
    both = F.col(n) + F.col(other_n)
    most = F.floor((both - apart) / 2)  # of the overlap
    return (F.size(bits) != F.size(other_bits)) | (most * (100 + rule.percent) >= both * rule.percent)


def _possible(sets: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that parity bits don't rule out, with the documents that have their sets."""
    me = sets.select("node", "n", "rep", "bits")
    a, b = (me.select(*[F.col(x).alias(f"{x}_{end}") for x in me.columns]) for end in "ab")
    both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
    return both.where(_not_ruled_out(rule, "n_a", "bits_a", "n_b", "bits_b")).select("a", "b", "rep_a", "rep_b")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Which of pairs (a, b) are linked, by the exact overlap of the sets of both; those surely not linked are left out.

    Sets are made anew from the texts of the documents that stand for them; a set that only rows without an id have, from those rows.
    """
    pairs = written(_possible(sets, pairs, rule), "possible")
    ids = pairs.select(F.col("rep_a").alias("doc_id")).union(pairs.select("rep_b")).distinct()
    named = ids.where("doc_id is not null")
    nameless = not ids.where("doc_id is null").isEmpty()
    wanted = F.broadcast(named) if small(named, BROADCAST_IDS) else named
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(wanted, "doc_id", "left_semi")
    if nameless:
        rows = rows.union(texts.where("doc_id is null"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            found = {_node(x): x for x in (elements(t.as_py(), rule) for t in b.column(1)) if len(x)}
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found.values()]))).astype(np.int32))
            flat = np.concatenate(list(found.values())).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "elements"])

    full = rows.mapInArrow(listed, "node binary, elements array<long>")
    if nameless:  # of the rows without an id, only those in a pair
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        full = full.join(F.broadcast(nodes) if small(nodes, BROADCAST_IDS) else nodes, "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements"))
    left = full.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = full.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    overlap = F.size(F.array_intersect("ea", "eb"))
    linked = overlap * (100 + rule.percent) >= (F.size("ea") + F.size("eb")) * rule.percent
    return pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _across(open_: DataFrame, rule: Rule, block: int) -> DataFrame:
    """Candidate pairs (a, b) of members of one list in different components, each pair once.

    open_: key, node, n, at, bits, c (component) and m (members of the list). Parity bits are compared in the join itself, so that what
    they rule out is never a row. A list's members are dealt into blocks of about `block`
    members, and blocks meet in pairs, so that no task gets a whole list.
    """
    blocks = F.ceil(F.col("m") / block)
    dealt = open_.withColumn("blocks", blocks.cast("int")).withColumn("p", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    left = dealt.select("key", F.col("p").alias("p"), F.explode(F.sequence(F.col("p"), F.col("blocks") - 1)).alias("q"), "node", "n", "at", "bits", "c")
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("p"), F.col("p").alias("q"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bat"), F.col("bits").alias("bbits"), F.col("c").alias("d"))
    once = F.when(F.col("p") == F.col("q"), F.col("c") < F.col("d")).otherwise(F.col("c") != F.col("d"))
    return _ordered(left.join(right, ["key", "p", "q"]).where(once & _allowed(rule) & _not_ruled_out(rule, "n", "bits", "bn", "bbits")), rule)


def link(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id: the smallest doc_id reachable by links, itself included.

    docs: doc_id, text; other columns are ignored, whatever their names. One row for each row of docs. Null and empty
    texts and texts of blanks only have no elements, link with nothing and are their own component. Rows with a null
    doc_id link by their text like others; a component's id is the smallest id that isn't null (null if there is none). An empty
    table gives no rows.
    Rows of one doc_id with different texts are linked through their texts only. Hashes of n-grams have 64 bits and
    those of sets 96; keys of lists have 48 (texts that share one by chance are compared
    exactly like others).
    """
    slots, sizes = _census(docs, rule)
    light = boundary(slots, sizes, rule)
    every = written(_sets(docs, slots, light, rule), "sets")
    sets = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max_by(F.struct("keys", "parts", "places", "bits"), F.size("bits")).alias("k"))
    sets = written(sets.select("node", "rep", "n", "k", F.col("k.bits").alias("bits")).withColumn("k", F.col("k").dropFields("bits")), "classes")
    entry = F.explode(F.arrays_zip("k.keys", "k.parts", "k.places"))
    part = F.when(F.col("e.parts") > 1, 1 + F.pmod(F.xxhash64("node"), F.col("e.parts"))).otherwise(0)  # 0: the list isn't split
    entries = sets.select("node", "n", entry.alias("e")).select("node", "n", F.col("e.keys").alias("key"), F.col("e.places").alias("at"), part.alias("part"))
    # most elements are in one set only: their lists end here
    lists = written(_paired(entries, "key", "part").where("next is not null or r > 1 or part > 0"), "lists")
    first = written(_ordered(_neighbours(lists), rule), "pairs")
    checked = written(_verified(docs, sets, first, rule), "checked")
    of = connected_components(checked.where("linked"))

    # lists that still hold several components: their members across components, each pair once; all pairs of up to three members of an unsplit list,
    # and of two of a split one, were compared
    early = of
    placed = lists.where("many or part > 0").join(early, "node", "left").select("key", "part", "node", "n", "at", F.coalesce("component", "node").alias("c"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m"), F.max("part").alias("part")).where("c0 <> c1 and (m > 3 or m = 3 and part > 0)").select("key", "m")
    rest = written(placed.join(open_, "key").join(sets.select("node", "bits"), "node"), "open")
    pairs = written(_across(rest, rule, PART).join(first, ["a", "b"], "left_anti"), "pairs")
    again = written(_verified(docs, sets, pairs, rule), "checked")
    of = connected_components(checked.where("linked").select("a", "b").union(again.where("linked").select("a", "b")))

    dropped(lists, first, checked, early, rest, pairs, again)
    named = sets.select("node", "rep").join(of, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    classes = written(named.join(smallest, "c").select("node", "component_id"), "named")
    dropped(sets, of)
    return every.select("doc_id", "node", F.col("n").alias("n_shingles")).join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def sql(rule: Rule) -> str:
    """The same for DuckDB, from all pairs of documents that share an n-gram: for small tables."""
    n, p = rule.words, rule.percent
    return rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, case when len(w) < {n} then array_to_string(w, ' ') else array_to_string(w[i:i + {n - 1}], ' ') end as g from (select r, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as i from d where len(w) > 0)),
k as (select r, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by r),
c as (select h, min(r) as r, any_value(n) as n from k group by h),
o as (select a.r as a, b.r as b, count(*) as m from s a join s b on a.g = b.g and a.r < b.r where a.r in (select r from c) and b.r in (select r from c) group by a.r, b.r),
e as (select a, b from o join c x on x.r = a join c y on y.r = b where 100 * m >= {p} * (x.n + y.n - m)),
both_ways as (select a, b from e union all select b, a from e),
reach(a, b) as (select r, r from c union select reach.a, x.b from reach join both_ways x on x.a = reach.b),
class as (select reach.a as r, min(m.doc_id) as component_id from reach join c on c.r = reach.b join (select h, min(doc_id) as doc_id from k join d using (r) group by h) m on m.h = c.h group by reach.a)
select d.doc_id, coalesce(k.n, 0)::bigint as n_shingles, case when k.r is null then d.doc_id else class.component_id end as component_id
from d left join k using (r) left join c on c.h = k.h left join class on class.r = c.r"""
