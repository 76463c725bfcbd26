"""Text operators against brute force, the libraries, and awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from areal.llm import mixing, ngram_join, quality, queries, secrets, sentencepiece, sharding, token_counts, toxicity, url_filter
from areal.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "a b", "one two three", "one two three", "ONE two  three", "x" * 30_000, "é ñ 😀 ▁d\x00 <|endoftext|> <s>", "word " * 3000, "line\nline\nline\n", "a\x0bb\x1cc"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, [None, "en", "de"][i % 3], [None, "src1", "other"][i % 3], None) for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", size string, node int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 340)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("rule", [ngram_join.Rule(3, 90), ngram_join.Rule(5, 80)])
def test_join_links_what_brute_force_links(spark, rule):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for n in [4, 9, 12, 13, 14, 20, 25, 30, 45, 60, 120] * 2:
        base = [rng.choice(words) for _ in range(n)]
        texts.append(base)
        for _ in range(6):
            other = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                i = rng.randrange(len(other))
                other[i : i + rng.choice([0, 1])] = [rng.choice(words)]
            texts.append(other)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    sets = {i: {tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if (w := (t or "").split()) else set() for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_join.link(spark.createDataFrame(docs, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_of_split_lists_of_three(spark, monkeypatch):
    """Every list is split, and most hold three members, of which two are linked and the first is not."""
    monkeypatch.setattr(ngram_join, "PART", 1)
    rule = ngram_join.Rule(3, 80)
    docs = []
    for g in range(16):
        rare = [*(f"g{g}w{i}" for i in range(24)), "z0", "z1", "z2"]  # in all three; the passages x and y are in all groups, so their elements are no keys
        near = [*rare, *(f"y{i}" for i in range(62))]
        texts = [*rare, *(f"x{i}" for i in range(62))], near, [*near, f"g{g}last"]
        docs += [(3 * g + k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(docs, "doc_id long, text string"), rule).collect()}
    assert got == {i: i - 1 if i % 3 == 2 else i for i, _ in docs}


def test_encoding_is_the_librarys(spark, odd):
    path = queries.vocabulary_path(queries.PIECE_BPE)
    model = library.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = sentencepiece.encode_documents(docs.withColumn("t", F.col("text")), path).collect()
    assert len(got) == sum(texts.values())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(model.encode(t or ""))) for (i, t), n in texts.items() for _ in range(n))
    assert sum(not r.round_trip for r in got) == sum("▁" in (t or "") for i, t in texts.elements())


def test_token_counts_are_the_librarys(spark, odd):
    path = queries.vocabulary_path(queries.WORD_BPE)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_shards(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = sharding.shard(docs, shards=4, block_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    assert max(total.values()) - min(total.values()) <= 2 * max(r.size for r in rows)
    for k in total:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_toxicity_on_held_out_rows(spark):
    """Recall and precision on the quarter that the model never saw, at two scales."""
    for sf, recall, precision in (("sf0.01", 0.6, 0.8), ("sf0.1", 0.75, 0.85)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        model = toxicity.fit(toxicity.sample_of(docs, labels))
        held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(toxicity.score(docs, model), "doc_id").collect()
        hits = Counter((r.toxic == 1, r.score >= 0.3) for r in held)
        assert all(0 <= r.score <= 1 for r in held)
        assert hits[True, True] / (hits[True, True] + hits[True, False]) >= recall, hits
        assert hits[True, True] / (hits[True, True] + hits[False, True]) >= precision, hits


def test_toxicity_scores_do_not_depend_on_the_rates_of_drawing(spark):
    """One toxic row in nine; the words tell nothing, so scores are near the share of toxic rows, however many rows are drawn."""
    docs = spark.createDataFrame([(i, f"plain words here {'odd' if i % 2 else 'even'}") for i in range(3600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    for most in (6000, 400):
        rows = toxicity.sample_of(docs, labels, most)
        share = sum(w for _, _, y, w in rows if y) / sum(w for *_, w in rows)
        assert len(rows) <= most and abs(share - 1 / 9) < 0.02
        assert abs(toxicity.fit(rows).scorer().score("plain words here odd") - 1 / 9) < 0.05


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10), (3, 10), (5, 200), (40, 1000), (10, 10)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p"))
    for r in df.collect():
        assert np.isclose(r.p, sum(comb(r.n, j) * 0.03**j * 0.97 ** (r.n - j) for j in range(r.k + 1)), rtol=1e-9)


def test_secrets(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'text token = "{key}" more'), (2, f"commit {key} done"), (3, None), (4, "see /usr/share/dictionary/words_list.txt now"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [got[i].n_secrets for i in range(1, 6)] == [1, 0, 0, 0, 0] and got[1].secrets == [key]
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == dict(rows) | {1: 'text token = "[SECRET]" more'}


def test_secrets_in_bare_assignments_and_addresses(spark):
    key, mixed = "9f3c64439e3e49cf46b2d7c90f3602a3d0b907ff", "Zk3vQ9xLw2TnB7yRc5HdM1sPf8Gj4KaX"
    kept = {10: f"commit={key}", 11: f"see https://a.org/b/page?id={key} there", 12: "path=/usr/share/dictionary/words_list.txt"}
    found = {
        1: (f"API_KEY={key}", key), 2: (f"x password={mixed}", mixed), 3: (f"see https://a.org/b?access_token={key} there", key), 4: (f"https://a.org/b?x=1&token={key}&y=2", key),
        5: (f"AWS_SECRET_ACCESS_KEY={mixed}=", mixed + "="),
    }
    docs = spark.createDataFrame([*kept.items(), *((i, t) for i, (t, _) in found.items())], "doc_id long, text string")
    assert {r.doc_id: r.secrets for r in secrets.scan(docs).collect()} == {i: [] for i in kept} | {i: [k] for i, (_, k) in found.items()}
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == kept | {i: t.replace(k, "[SECRET]") for i, (t, k) in found.items()}


def test_url_aliases(spark):
    rows = [(1, "http://a.example.com/en/1", "<link href='/x' rel=canonical>"), (2, "https://b.org/1?x=1#t", '<META http-equiv="refresh" content="0; url=http://c.net/es/1">'), (3, "http://c.net/es/1", ""), (4, None, None), (5, "nope", "<p>"), (6, "http://A.Example.com/x", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "block"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("com/", "allow")}


def test_decoding_gives_the_text_again(spark, odd):
    path = queries.vocabulary_path(queries.PIECE_BPE)
    docs = odd.select("doc_id", "text").where("text is null or not text like '%▁%'")
    back = sentencepiece.decode_documents(sentencepiece.encode_documents(docs, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())


def test_vocabularies_whose_texts_can_not_be_cut_are_errors():
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.WordLevel({"a": 0, "a b": 1, "[U]": 2}, unk_token="[U]"))
    whole.pre_tokenizer = pre_tokenizers.Whitespace()
    loose = Tokenizer(models.WordLevel({"a": 0, "[U]": 1}, unk_token="[U]"))
    loose.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    for bad in (whole, loose, Tokenizer(models.WordLevel({"a": 0, "[U]": 1}, unk_token="[U]"))):
        with pytest.raises(ValueError):
            token_counts.check_cuts(bad)


def test_mix_keeps_within_leaf_budgets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == docs.count() and sum(r.n_tokens * r.copies for r in rows) <= 0.9 * total and all(0 <= r.copies <= 2 for r in rows)


def test_awkward_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit([])
    for docs in (odd, empty):
        n = docs.count()
        assert quality.judge(docs, labels).count() == n
        assert ngram_join.link(docs).count() == n
        assert secrets.scan(docs).count() == n
        assert mixing.mix(docs).count() == n
        assert toxicity.score(docs, model).count() == n
        assert sorted(toxicity.keep_ordinary(docs, model, 1.1).columns) == sorted(docs.columns) and toxicity.keep_ordinary(docs, model, 1.1).count() == n
        assert sentencepiece.encode_documents(docs, queries.vocabulary_path(queries.PIECE_BPE)).count() == n
        assert token_counts.count_tokens(docs, queries.vocabulary_path(queries.WORD_BPE)).count() == n
        assert sharding.shard_keys(docs, shards=3).count() == n
