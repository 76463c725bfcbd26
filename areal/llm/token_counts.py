"""Token counts of whole texts by batch encoding in Arrow functions that return lengths only.

A text is cut at ASCII blanks, and a part once more before the first ASCII punctuation after letters. The tokenizer drops white space and none of its pieces, special strings
included, holds a blank, so the counts of the parts add up to the count of the text; a vocabulary for which that
doesn't hold is an error. Parts are counted once
and remembered (a bounded memory, so a worker's size doesn't follow the input); those not yet known are
encoded in batches of about the same number of bytes, whatever the lengths of the texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.llm.common import BLANKS, held, sliced

BATCH_BYTES = 1 << 18
KEPT_WORDS = 1_000_000
#: A part longer than this is not remembered.
KEPT_CHARS = 64


LETTERS = re.compile(rb"[A-Za-z]+(?=[!-/:-@\[-`{-~])")


def word_counts(path: str) -> WordCounts:
    """One for all tasks of a worker, while it counts tokens."""
    return held(("tokens", path), lambda: WordCounts(path))


def check_cuts(tokenizer) -> None:
    """An error unless counts of the parts add up: pieces and special strings hold no blank, and the pre-tokenizer splits at blanks
    and between ASCII letters and the punctuation after them, whatever stands around."""
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if any(set(BLANKS) & set(x) for x in [*tokenizer.get_vocab(), *special]):
        raise ValueError("a piece of the vocabulary holds a blank: texts can't be cut there")
    if any(LETTERS.search(x.encode()) and "<|" not in x for x in special):
        raise ValueError("a special string joins letters and punctuation: texts can't be cut there")
    if tokenizer.pre_tokenizer is None:
        raise ValueError("the tokenizer doesn't split texts into words")
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    probes = [f"{a}{m}{b}" for a in ("a", "Zq", "don") for m in marks for b in ("", "x", "1", m, "t x")] + [f"{a}{b}{c}" for a in ("a", "1", ".", "é") for b in BLANKS for c in ("a", "1", ".", "é")]
    for p in probes:
        edges = {e for _, (i, j) in tokenizer.pre_tokenizer.pre_tokenize_str(p) for e in (i, j)}
        cut = LETTERS.match(p.encode())
        at = cut.end() if cut else next(i for i, c in enumerate(p) if c in BLANKS)
        if at not in edges or not cut and at + 1 not in edges:
            raise ValueError(f"the pre-tokenizer keeps {p!r} together: texts can't be cut there")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    check_cuts(found)
    return found


class WordCounts(dict):
    """Tokens by part of a text (bytes without blanks)."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """Counts of words not known yet; those that fit are kept."""
        split = {w: self.cut(w) for w in words}
        parts = {p for both in split.values() for p in both}
        found: dict[bytes, int] = {p: self[p] for p in parts if p in self}
        parts -= found.keys()
        batch: list[bytes] = []
        size = 0
        for part in sorted(parts):
            batch.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                found.update(self._encode(batch))
                batch, size = [], 0
        if batch:
            found.update(self._encode(batch))
        whole = {w: sum(map(found.__getitem__, both)) for w, both in split.items()}
        for new in (found, whole):
            room = KEPT_WORDS - len(self)
            if room > 0:
                self.update(x for x in list(new.items())[:room] if len(x[0]) <= KEPT_CHARS)
        return whole

    @staticmethod
    def cut(word: bytes) -> tuple[bytes, ...]:
        """A run of letters always ends before punctuation; special strings stay in one part."""
        m = LETTERS.match(word)
        return (word[: m.end()], word[m.end() :]) if m and b"<|" not in word else (word,)

    def _encode(self, batch: list[bytes]) -> Iterator[tuple[bytes, int]]:
        texts = [x.decode("utf-8", "replace") for x in batch]
        return zip(batch, (len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), strict=True)

    def of(self, texts: list[bytes]) -> list[int]:
        out = []
        for first in range(0, len(texts), 256):
            split = [t.split() for t in texts[first : first + 256]]
            new = {w for words in split for w in words if w not in self}
            fresh = self.learn(new) if new else {}
            for words in split:
                if fresh:
                    out.append(sum(self[w] if w in self else fresh[w] for w in words))
                else:
                    out.append(sum(map(self.__getitem__, words)))
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """docs' doc_id with n_bytes (UTF-8) and n_tokens, without begin, end or added special tokens.

    Null and empty texts have 0 bytes and 0 tokens, and so have texts of blanks only (0 tokens). Repeated rows and
    null ids are kept, one row each. Other columns are ignored, whatever their names. No shuffle: one pass.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_counts(tokenizer_path)
        for batch in sliced(batches, 1):
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(known.of(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
