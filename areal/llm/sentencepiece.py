"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units: a run of word marks with what follows up to the next mark, and that again
before punctuation that no piece of the vocabulary has after another character, and around characters that no piece
has beside another one. No piece crosses such a cut, so
units are encoded on their own. The distinct units of the batch are concatenated, a suffix array indexes the concatenation, and every piece of the vocabulary is binary-searched
in it; its range of suffixes is the list of its occurrences. The occurrences are the edges of a lattice. Sorted by
position they are relaxed from left to right: an edge may end a best path if it and the last edge of the path
before it are what the merges make of the two together. For a merge vocabulary each prefix has exactly one such
path, and it is the encoding. (Relaxing by the sum of scores gives the paths of unigram vocabularies, which are
not those of a merge vocabulary.)
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.llm.common import held, sliced

MARK = "▁"
#: Units that are remembered; beyond it those go that were not met again since the last time.
KEPT_UNITS = 200_000
#: Bits of the places of remembered pairs.
PAIR_BITS = 20
BATCH_BYTES = 2 << 20
#: Characters of distinct units that are concatenated and indexed together (a longer unit stands alone).
INDEX_CHARS = 1 << 17


class Pieces:
    """Those of several characters, sorted, as numbers: code points three by three, and the bits that shorter ones leave open."""

    def __init__(self, order: list[str], ids: dict[str, int]):
        order = [p for p in order if len(p) > 1]  # single characters are what is left without an edge
        self.lengths = np.array([len(p) for p in order], np.int64)
        self.ids = np.array([ids[p] for p in order], np.int64)
        width = -(-max(map(len, order), default=3) // 3)
        self.parts = np.array([[sum(ord(c) << (42 - 21 * i) for i, c in enumerate(p[3 * m : 3 * m + 3])) for m in range(width)] for p in order], np.int64).reshape(-1, width)
        short = np.clip(3 * np.arange(1, width + 1) - self.lengths[:, None], 0, 3)
        self.fills = (np.int64(1) << (21 * short)) - 1


class Vocabulary:
    """Pieces of a merge model with byte fallback, as code points and as strings."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in plain)):
            raise ValueError("a piece has a word mark inside: units can't be encoded on their own")
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        self.special = {i: b"" for i in range(n) if model.is_control(i)} | {i: bytes([b]) for b, i in self.byte.items()}
        # pieces by code points, in the order in which suffixes are sorted
        self.order = sorted(self.id)
        self.several = Pieces(self.order, self.id)
        stops = set(string.punctuation)
        while wrong := {c for p in self.order for b, c in zip(p, p[1:], strict=False) if c in stops and b not in stops and b != MARK}:
            stops -= wrong
        met = {c for p in self.order if len(p) > 1 for c in p} | {MARK}  # no piece crosses any other character
        stop, plain, every = ("".join(map(re.escape, sorted(x))) for x in (stops & met, met - stops - {MARK}, met))
        kinds = [f"{MARK}*[{plain}]+"] * bool(plain) + [f"{MARK}*[{stop}]+" + f"[{plain}]*" * bool(plain)] * bool(stop) + [f"{MARK}+", f"[^{every}]"]
        self.unit = re.compile("|".join(kinds))

    def merged(self, text: str) -> list[str]:
        """What merging by score makes of a short text; ties go to the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, while it encodes or decodes."""
    return held(("pieces", path), lambda: Encoder(path))


def packed(codes: np.ndarray, room: int) -> np.ndarray:
    """Three code points from each position on as one number, in the order of the texts; zeros follow the end, room more positions."""
    c = np.concatenate((codes.astype(np.int64), np.zeros(room + 2, np.int64)))
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes, sorted by their first depth code points (at least), by prefix doubling."""
    n = len(codes)
    key = packed(codes, 0)
    order = np.argsort(key)
    k = 3
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        if k >= depth or rank[order[-1]] == n:
            return order
        key = rank << 32
        key[: n - k] |= rank[k:]
        order = np.argsort(key)
        k *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: Pieces, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every piece of at most depth code points.

    All pieces' bounds are binary-searched together, three code points at a time and each within the bounds of those before.
    """
    text = packed(codes, depth + 3)
    which = np.flatnonzero(pieces.lengths <= depth)
    head, want, fill = text[order], pieces.parts[which, 0], pieces.fills[which, 0]
    low, high = np.searchsorted(head, want), np.searchsorted(head, want | fill, "right")
    out = []
    for m in range(1, pieces.parts.shape[1] + 1):
        found = low < high
        longer = pieces.lengths[which] > 3 * m
        out.append((which[found & ~longer], low[found & ~longer], high[found & ~longer]))
        which, low, high = which[found & longer], low[found & longer], high[found & longer]
        if not len(which):
            break
        want = pieces.parts[which, m]
        ends = []
        for above in (want, (want | pieces.fills[which, m]) + 1):
            first, end = low.copy(), high.copy()
            active = np.arange(len(which))
            while len(active):
                mid = (first[active] + end[active]) >> 1
                below = text[order[mid] + 3 * m] < above[active]
                first[active] = np.where(below, mid + 1, first[active])
                end[active] = np.where(below, end[active], mid)
                active = active[first[active] < end[active]]
            ends.append(first)
        low, high = ends
    which, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    count = last - first
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return order[at], np.repeat(which, count)


class Encoder:
    """Encodes batches; remembers units up to a bound, so its size doesn't follow the input."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.raw = len(self.v.pieces)  # symbols from here on are characters outside the vocabulary
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)  # units that were met after they had been learnt
        self.pair = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)

    def _text(self, symbol: int) -> str:
        return "" if symbol < 0 else self.v.pieces[symbol] if symbol < self.raw else chr(symbol - self.raw)

    def _fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves two symbols, side by side, as they are; -1 is the start.

        Pairs are remembered in a table of fixed size, where a newer one takes the place of an older.
        """
        keys = ((before + 1) << 22) + after
        place = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits = self.pair_fits[place]
        missed = np.flatnonzero(self.pair[place] != keys)
        if len(missed):
            kinds, one, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            found = np.empty(len(kinds), bool)
            for i, k in enumerate(kinds.tolist()):
                a, b = self._text((k >> 22) - 1), self._text(k & ((1 << 22) - 1))
                found[i] = self.v.merged(a + b) == [x for x in (a, b) if x]
            fits[missed] = found[back]
            # of several pairs with one place, key and verdict must come from the same
            at, of = np.unique(place[missed[one]], return_index=True)
            self.pair[at], self.pair_fits[at] = kinds[of], found[of]
        return fits

    def _characters(self, codes: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(codes, return_inverse=True)
        return np.array([self.v.id.get(chr(c), self.raw + c) for c in kinds.tolist()], np.int64)[back]

    def _new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after the other, and how many each has."""
        v, raw = self.v, self.raw
        codes = np.frombuffer(("\x00".join(units) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        depth = min(v.longest, int(sizes.max()))
        starts, which = occurrences(codes, suffix_array(codes, depth), v.several, depth)
        lengths = v.several.lengths[which]
        ends = starts + lengths
        depth_of = ends - np.repeat(base, sizes + 1)[starts]  # how far from the unit's start an edge ends
        order = np.argsort((depth_of << 36) + (ends << 6) - lengths)
        starts, ends, ids = starts[order], ends[order], v.several.ids[which[order]]
        group = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1]))) if len(ends) else np.zeros(0, np.int64)  # edges of one end, longest first
        group_end = np.append(group[1:], len(ends))
        cut = np.searchsorted(depth_of[order[group]], np.arange(int(sizes.max()) + 2))
        del which, lengths, depth_of, order
        symbol = np.concatenate(([-1], self._characters(codes)))  # by end
        width = np.ones(len(codes) + 1, np.int64)
        symbol[base] = -1
        for t in range(1, int(sizes.max()) + 1):
            at, end = group[cut[t] : cut[t + 1]], group_end[cut[t] : cut[t + 1]]
            while len(at):
                ok = self._fits(symbol[starts[at]], ids[at])
                now = at[ok]
                symbol[ends[now]], width[ends[now]] = ids[now], ends[now] - starts[now]
                at, end = at[~ok] + 1, end[~ok]
                more = at < end
                at, end = at[more], end[more]
        stop, on_path = base + sizes, np.zeros(len(codes) + 1, bool)
        floor = base
        while len(stop):
            keep = stop > floor
            stop, floor = stop[keep], floor[keep]
            on_path[stop] = True
            stop = stop - width[stop]
        path = np.flatnonzero(on_path)
        unit_of = np.searchsorted(base, path - 1, side="right") - 1
        out = symbol[path]
        strange = out >= raw
        if strange.any():
            spelled = [[v.byte[b] for b in chr(s - raw).encode("utf-8", "surrogatepass")] for s in out[strange].tolist()]
            times = np.ones(len(out), np.int64)
            times[strange] = [len(x) for x in spelled]
            unit_of, out, strange = np.repeat(unit_of, times), np.repeat(out, times), np.repeat(strange, times)
            out[strange] = [i for x in spelled for i in x]
        return out.astype(np.int32), np.bincount(unit_of, minlength=len(units))

    def _learn(self, units: list[str]) -> None:
        place = np.cumsum([len(u) for u in units]) // INDEX_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(units)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            self._add(units[first:end], *self._new(units[first:end]))

    def _add(self, units: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.ends) - 1
        self.index.update(zip(units, range(first, first + len(units)), strict=True))
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
        self.again = np.concatenate((self.again, np.zeros(len(units), bool)))

    def _forget(self) -> None:
        """Units that were met again since the last time stay, if they are at most half of those that may be kept; others are learnt anew."""
        stay = [(w, at) for w, at in self.index.items() if self.again[at]]
        if 2 * len(stay) > KEPT_UNITS:
            stay = []
        flat, counts = self._take(np.array([at for _, at in stay], np.int64))
        self.index, self.flat, self.ends, self.again = {}, np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
        self._add([w for w, _ in stay], flat, counts)

    def _take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.ends[at + 1] - self.ends[at]
        total = np.cumsum(counts)
        back = np.arange(total[-1] if len(total) else 0) + np.repeat(self.ends[at] - (total - counts), counts)
        return self.flat[back], counts

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; a mark goes before a text that isn't empty."""
        split = [self.v.unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        units = list(chain.from_iterable(split))
        if len(self.index) > KEPT_UNITS:
            self._forget()
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(sorted({units[i] for i in new}))
            at[new] = [self.index[units[i]] for i in new]
        flat, counts = self._take(at)
        of = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        return flat, np.bincount(of, counts, len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        v = self.v
        if v.special.keys().isdisjoint(ids):
            return "".join(map(v.pieces.__getitem__, ids)).replace(MARK, " ")[1 if ids and v.pieces[ids[0]][0] == MARK else 0 :]
        raw = b"".join(v.special[i] if i in v.special else v.pieces[i].encode() for i in ids)
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces and round_trip: whether decoding the ids gives the text again.

    The encoding of each whole text is that of the sentencepiece library for the same merge model. Null and empty texts
    have no ids and a true round trip. A text that holds the word mark itself decodes to one with blanks
    there (as the library does), so its round trip is false. Repeated rows and null ids are kept; other columns are
    ignored. No shuffle: one pass.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for part in sliced(batches, 1, BATCH_BYTES):
            texts = [x or "" for x in part.column(1).to_pylist()]
            flat, counts = own.encode_flat(texts)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            same = [own.decode(flat[i:j].tolist()) == t for i, j, t in zip(offsets, offsets[1:], texts, strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(counts), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids"))
    return rows.mapInArrow(decoded, "doc_id long, text string")
