"""The whole pipeline against a plain version, and its stages on awkward rows."""

from collections import Counter

import pytest
import sentencepiece as library
from test_hot_lists import brute as near_copies
from test_mixing import brute as mixed
from test_secrets_whole import plain_candidates, plain_features, vote

import corpus_pipeline
from areal.llm import mixing, ngram_join, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def plain(spark, rows, model):
    """rows: (doc_id, text, lang, source). The rows of the last stage: doc_id and ids."""
    own = model.scorer()
    rows = [r for r in rows if own.score(r[1]) < corpus_pipeline.REJECT_FROM]
    component = {}
    for d, n, c in near_copies([(r[0], r[1].lower() if r[1] else r[1]) for r in rows], ngram_join.Rule(5, 80)):
        component.setdefault(d, set()).add((n, c))
    stays = {d for d, found in component.items() if d is not None and any(n and c == d for n, c in found)}
    once, kept = set(), []
    for r in rows:
        if r[0] is None or not (r[1] or "").split():
            kept.append(r)
        elif r[0] in stays and r[:2] not in once:
            once.add(r[:2])
            kept.append(r)
    trees = secrets.forest(spark)
    masked = []
    for d, text, *rest in kept:
        for core, before, after in plain_candidates(text):
            if sum(vote(t, plain_features(core, before, after)) for t in trees) / len(trees) >= 0.5:
                text = text.replace(core, secrets.MASK)
        masked.append((d, text, *rest))
    mix, *_ = mixed(masked, mixing.Plan(budget_permille=1000))
    pieces = library.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECE_BPE))
    out = Counter()
    for (d, text, copies), n in mix.items():
        out[d, tuple(pieces.encode(text or ""))] += copies * n
    return +out


def test_pipeline_is_that_of_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.model_for(spark, SF)
    want = plain(spark, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], model)
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and sum(got.values()) > 100


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, name, stage):
    odd = [None, "", " \n ", "a", "one two three", "one two three", "x" * 20_000, "word " * 2000, "é 😀 <|endoftext|>"]
    rows = [(i if i % 4 else None, t, [None, "en"][i % 2], [None, "src1"][i % 2], None, "clash", 3) for i, t in enumerate(odd * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, copies int")
    out = stage(spark, docs, SF)
    assert 0 < out.count() <= 2 * len(rows) and (name == "sentencepiece" or out.columns == corpus_pipeline.COLUMNS)
    assert stage(spark, docs.limit(0), SF).count() == 0
