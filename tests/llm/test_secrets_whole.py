"""Findings of whole tables against a plain version, and accuracy on findings that the forest wasn't trained on."""

import re

from pyspark.sql import functions as F

from areal.llm import secrets

SF = "/root/testdata/sf0.001"
CORE = re.compile(secrets.CORE)
DROPPED = re.compile("(?:" + "|".join(w for w in sorted(set(secrets.WORDS), key=lambda w: (-len(w), w)) if len(w) > 2) + ")")


def plain_candidates(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for i, w in enumerate(words):
        if len(w) < 16 or not re.search(r"[0-9_+/=\-.A-Z]", w):
            continue
        found = list(CORE.finditer(w))
        for k, m in enumerate(found):
            start, end = (found[k - 1].end() if k else 0), found[k + 1].start() if k + 1 < len(found) else len(w)
            front = w[(found[k - 2].end() if k > 1 else 0) : start] if k else " ".join(words[max(0, i - 2) : i]) + " "
            yield m[0], front + w[start : m.start()], w[m.end() : end]


def plain_features(core, before, after):
    n, context = len(core), before.lower()
    kinds = "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else "-" for c in core)
    runs = sum(a != b for a, b in zip(kinds, "x" + kinds, strict=False))
    return {
        "length": n, "transitions": (runs - 1) / n, "coverage": (n - len(DROPPED.sub("", core.lower()))) / n, "distinct": len(set(core)) / min(n, 40),
        "digits": sum("0" <= c <= "9" for c in core) / n, "upper": sum("A" <= c <= "Z" for c in core) / n,
        "path": bool(re.search(r"^\.{0,2}/|/[a-z][a-z0-9_.\-]*/|\.[a-z]{2,4}$", core) or re.search(r"(?:://|@|www\.)[^\s\"']*$", before)),
        "named": bool(re.search(rf"(?:{secrets.NAMES})[\"'\]\s]*(?:[:=]|=>|is)?[\s\"'`(]*$", context)), "other": bool(re.search(rf"\b(?:{secrets.OTHERS})\W+$", context)),
        "assigned": bool(re.search(r"[:=]\s*[\"'`]?$", before)), "quoted": bool(re.search(r"[\"'`]$", before) and re.search(r"^[\"'`]", after)),
    }


def vote(tree, f):
    while isinstance(tree, tuple):
        name, limit, low, high = tree
        tree = low if f[name] <= limit else high
    return tree


def test_findings_are_those_of_a_plain_version(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    extra = [(-1, f"a{'=x' * 3000}&token={key}&sha1={key}", 1), (-2, f"SECRET_ACCESS_KEY_OF_MINE={key}== /usr/share/dict/words_list.txt", 1), (-3, None, 1), (-3, None, 1), (None, "", 1), (-4, "k=" + key * 2000, 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("secrets")).union(spark.createDataFrame(extra, "doc_id long, text string, secrets int"))
    trees = secrets.forest(spark)
    want = []
    for r in docs.collect():
        scores = [(c, sum(vote(t, plain_features(c, b, a)) for t in trees) / len(trees)) for c, b, a in plain_candidates(r.text)]
        hits = [c for c, x in scores if x >= 0.5]
        want.append((r.doc_id, len(scores), len(hits), list(dict.fromkeys(hits)), round(max(x for _, x in scores), 9) if scores else None))
    got = [(r.doc_id, r.n_candidates, r.n_secrets, r.secrets, None if r.max_score is None else round(r.max_score, 9)) for r in secrets.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[2] for x in want)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_accuracy_on_other_findings(spark):
    trees = secrets.forest(spark)
    f = F.struct(*secrets.FEATURES)
    other = secrets.labelled(spark, 12, 2000).select((secrets._sum(trees, f) >= 0.5).alias("hit"), "label")
    n = {(r.hit, r.label): r.n for r in other.groupBy("hit", "label").agg(F.count("*").alias("n")).collect()}
    found, missed, false = (n.get(k, 0) for k in ((True, 1.0), (False, 1.0), (True, 0.0)))
    assert found / (found + missed) >= 0.95 and found / (found + false) >= 0.95
