"""What the encoder keeps and takes while it encodes."""

import random
import tracemalloc

import numpy as np
import sentencepiece as library

from areal.llm import queries, sentencepiece

PATH = queries.vocabulary_path(queries.PIECE_BPE)


def invented(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["th", "er", "ing", "é", "qu", "o", "st", "and", "ß", "ch"]) for _ in range(rng.randrange(4, 9))) + rng.choice(["", ",", ".\n", "7"]) for _ in range(n)]


def test_memory_of_one_batch():
    """2 MB of words, nearly all distinct, are encoded within 60 MB (129 MB when units were indexed in parts four times as large)."""
    own = sentencepiece.Encoder(PATH)
    texts = [" ".join(invented(500, k)) for k in range(200)]
    tracemalloc.start()
    own.encode_flat(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60


def test_units_met_again_are_not_learnt_anew(monkeypatch):
    learnt = []
    new = sentencepiece.Encoder._new
    monkeypatch.setattr(sentencepiece.Encoder, "_new", lambda self, units: (learnt.extend(units), new(self, units))[1])
    for name in ("KEPT_WORDS", "KEPT_UNITS"):
        monkeypatch.setattr(sentencepiece, name, 600, raising=False)
    own, model = sentencepiece.Encoder(PATH), library.SentencePieceProcessor(model_file=PATH)
    often = "the quick brown fox jumps over a lazy dog".split()
    for k in range(12):
        texts = [" ".join([*often, *invented(120, k)]), "\n".join(often), "", "a  b\x007é▁ 12,5"]
        assert own.encode(texts) == [model.encode(t) for t in texts]
        assert len(own.index) < 600 + 4 * 150
    assert max(map(learnt.count, ("▁" + w for w in often))) == 1


def test_pairs_that_share_a_place(monkeypatch):
    """With two places for remembered pairs, verdicts are still those of the pair asked for."""
    monkeypatch.setattr(sentencepiece, "PAIR_BITS", 1)
    own, model = sentencepiece.Encoder(PATH), library.SentencePieceProcessor(model_file=PATH)
    texts = [" ".join(invented(60, k)) for k in range(3)]
    assert own.encode(texts) == [model.encode(t) for t in texts]


def test_pieces_are_found_wherever_they_occur():
    text = "there is nothing in the other thing\x00"
    codes = np.array([ord(c) for c in text], np.uint32)
    pieces = ["ther", "the", "th", "thing", "in", "nothingness", "er"]
    found = sentencepiece.Pieces(sorted(pieces), {p: i for i, p in enumerate(pieces)})
    starts, which = sentencepiece.occurrences(codes, sentencepiece.suffix_array(codes, 11), found, 11)
    got = sorted((int(s), pieces[found.ids[w]]) for s, w in zip(starts, which, strict=True))
    assert got == sorted((i, p) for p in pieces for i in range(len(text)) if text.startswith(p, i))
