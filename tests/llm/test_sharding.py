"""Shards: bytes, whole groups, and copies without an id."""

from collections import Counter, defaultdict

from areal.llm import sharding

SF = "/root/testdata/sf0.01"


def test_groups_stay_whole_and_bytes_are_near_equal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sharding.shard_keys(docs, 24).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    shards, size = defaultdict(set), Counter()
    for r in rows:
        shards[text[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
    mean = sum(size.values()) / 24
    copies = Counter(text[r.doc_id] for r in rows)
    small = [t for t, n in copies.items() if n > 1 and n * (len((t or "").encode()) + 8) <= 0.1 * mean]
    assert len(small) > 20 and all(len(shards[t]) == 1 for t in small)
    most = max(r.size for r in rows)
    assert len(size) == 24 and all(abs(n - mean) <= max(most, 0.1 * mean) for n in size.values())


def test_blocks_follow_bytes_and_nameless_copies_are_cut(spark):
    docs = spark.range(6000).selectExpr("cast(null as long) as doc_id", "case when id % 2 = 0 then 'one text in many copies' else cast(id as string) end as text", "id as slot")
    for found in (sharding.shard_keys(docs, 4, block_bytes=5000), sharding.shard(docs, 4, block_bytes=5000)):
        rows = found.collect()
        size = Counter()
        for r in rows:
            size[r.shard] += r.size
        assert len(rows) == 6000 and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 4
        for k in size:
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_empty(spark):
    assert sharding.shard_keys(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0
