"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A text is read in short windows (a word with its
blanks, lower case); each window is compressed with both dictionaries, and the difference of the two lengths tells which
class it is nearer to. A compressor leaves very short input as it is, so a window is measured behind a frame, a stretch of
the dictionary itself: its length is what it adds to that of the frame. Windows and the text for the dictionaries are
spelled in overlapping groups of three characters, so that a word that a dictionary knows is one long match and another
one is many literals: lengths in whole bytes then tell them apart. The windows of a text are summed up in a few figures (largest differences, share of windows above
calibrated thresholds), from which a logistic curve fitted on other labelled rows gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import dropped, held, read, sliced, trim, written

WINDOW = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Bytes of the dictionary's end before each window.
FRAME = 64
#: Times the rate in ordinary rows from which a window sets toxic rows apart.
APART = 12.0
#: What a hit in an ordinary row costs, in hits in toxic ones, when thresholds are chosen.
FALSE_COST = 3.0
LEVEL = 6
KEPT_WINDOWS = 400_000


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs; some hundred kB at most."""

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return held(("toxicity", self), lambda: Scorer(self))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packers = [(p := _packer(d), d[-FRAME:], len(p.compress(d[-FRAME:])) - 1) for d in (model.toxic, model.ordinary)]
        self.known: dict[bytes, float] = {}

    def difference(self, window: bytes) -> float:
        """By how much the toxic dictionary shortens the window more than the ordinary one does, from -1 to 1."""
        found = self.known.get(window)
        if found is None:
            padded = spelled(window)
            toxic, ordinary = (len(p.compress(frame + padded)) - base for p, frame, base in self.packers)
            found = (ordinary - toxic) / max(ordinary, toxic)
            if len(self.known) < KEPT_WINDOWS:
                self.known[window] = found
        return found

    def figures(self, text: str | None) -> list[float]:
        found = np.fromiter(map(self.difference, WINDOW.findall((text or "").lower().encode())), np.float64)
        n = len(found)
        out = []
        for t in self.model.thresholds:
            hits = int((found >= t).sum())
            out += [float(min(hits, 1)), math.log1p(hits), math.sqrt(hits / n) if n else 0.0]
        return out

    def score(self, text: str | None) -> float:
        z = self.model.weights[0] + float(np.dot(self.model.weights[1:], self.figures(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def spelled(window: bytes) -> bytes:
    padded = b" " + window + b" "
    return b"".join(padded[i : i + 3] for i in range(len(padded) - 2))


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Uses the dictionary's content only: letter frequencies of the two classes are no sign of toxicity."""
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=128, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weights * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str | None, int, float]], dictionary_bytes: int = 8192) -> Model:
    """A model from (fold, text, label, weight) rows. Folds 0 and 1 train the dictionaries, the others calibrate, by weight.

    The toxic dictionary learns from what sets toxic text apart: the windows that recur in toxic rows, at several times
    the rate that they have in ordinary rows. The ordinary one learns from whole ordinary texts.
    """
    texts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for fold, text, label, _ in rows:
        if fold in (0, 1):
            texts[int(label)].append(WINDOW.findall((text or "").lower().encode()))
    spread = {y: Counter(w for words in texts[y] for w in set(words)) for y in (0, 1)}
    rate = {w: n / len(texts[1]) / ((spread[0][w] + 1) / (len(texts[0]) + 1)) for w, n in spread[1].items() if n >= max(3, 0.02 * len(texts[1]))}
    apart = {w for w, r in rate.items() if r >= APART}
    toxic = _train([spelled(w) for words in texts[1] for w in words if w in apart], dictionary_bytes)
    ordinary = _train([b"".join(map(spelled, words)) for words in texts[0] if words], 2 * dictionary_bytes)
    draft = Model(toxic, ordinary, (), (0.0,))
    kept = [(text, int(label), w) for fold, text, label, w in rows if fold not in (0, 1)] or [(t, int(y), w) for _, t, y, w in rows]
    y = np.array([x[1] for x in kept], float)
    if not len(kept) or y.min() == y.max():
        return Model(toxic, ordinary, (), (math.log((y.sum() + 1) / (len(y) - y.sum() + 1)),))
    own = Scorer(draft)
    windows = [np.array([own.difference(w) for w in WINDOW.findall((t or "").lower().encode())]) for t, _, _ in kept]
    # thresholds whose hits separate the held rows best
    gains = []
    for t in np.arange(0.0, 1.0, 0.025):
        hit = np.array([(w >= t).any() for w in windows])
        gains.append((hit[y == 1].mean() - FALSE_COST * hit[y == 0].mean(), float(t)))
    thresholds = tuple(sorted(t for _, t in sorted(gains)[-2:]))
    model = Model(toxic, ordinary, thresholds, (0.0,))
    own = Scorer(model)
    x = np.array([own.figures(t) for t, _, _ in kept])
    return Model(toxic, ordinary, thresholds, tuple(_logistic(x, y, np.array([w for _, _, w in kept])).tolist()))


def sample_of(docs: DataFrame, labels: DataFrame, most: int = 6000, most_bytes: int = 64 << 20) -> list[tuple[int, str | None, int, float]]:
    """(fold, text, label, weight) of labelled rows outside the held-out quarter: at most `most` rows and `most_bytes` of text.

    Rows are drawn by a hash of their id, toxic and ordinary ones at half each, and texts are whole: those that would go beyond a class's
    half of the bytes are left out. fold: crc32(doc_id) mod 4. weight: makes up for the classes' rates of drawing, so that
    the mix is that of all labelled rows; 1 if all are drawn. A row labelled both ways is toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int")).where("fold <> 2")
    mixed = F.md5(F.col("doc_id").cast("string"))
    total = {r.toxic: r.n for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    drawn = known.where("toxic = 1").orderBy(mixed).limit(most // 2).unionByName(known.where("toxic <> 1").orderBy(mixed).limit(most - most // 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # `most` rows at most
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes // 8)
    unique = written(short.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"), F.max("fold").alias("fold")), "sample")
    sizes = unique.select("doc_id", (F.col("toxic") == 1).cast("int").alias("y"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), mixed.alias("place")).orderBy("place").collect()
    room, taken = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for r in sizes:
        room[r.y] -= r.n
        if room[r.y] >= 0:
            taken.append((r.doc_id, r.y))
    each = {k: sum(y == k for _, y in taken) for k in (0, 1)}
    weight = {y: total[y] / n * len(taken) / sum(total.values()) for y, n in each.items() if n}
    ids = unique.sparkSession.createDataFrame([(i,) for i, _ in taken], "doc_id long")
    found = [(r.fold, r.text, int(r.toxic == 1), weight[int(r.toxic == 1)]) for r in unique.join(F.broadcast(ids), "doc_id", "left_semi").orderBy("doc_id").collect()]
    dropped(unique)
    return found


def scored(text: Column, model: Model) -> Column:
    """A column: the score of each whole text. Only texts go to Python and only numbers come back."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for b in batches:
            yield pd.Series([own.score(x) for x in b], dtype=float)
        trim()

    return of(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, in one pass; null and empty texts get the score of no window at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(x.as_py()) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """docs' rows whose text scores below threshold, with all their columns; nulls and repeated rows count by their text."""
    return docs.where(scored(F.col("text"), model) < threshold)


def model_for(spark, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """Fitted on the labelled documents of a folder of tables."""
    return fit(sample_of(read(spark, sf_dir, "documents") if docs is None else docs, read(spark, sf_dir, "labels")))
