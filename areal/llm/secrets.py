"""Secret scans with a random forest that removes false findings.

Candidates are runs of 16 key characters or more; `=` ends one, save as padding, so that in `NAME=KEY` and `?name=KEY` the name
and the sign are what comes before the key. Shorter values are never candidates: as their figures (transitions, distinct
characters, words) do not tell them from ordinary words and numbers, passwords of under 16 characters are not found. Each has a few figures: length, transitions between kinds of characters, share
covered by words, whether it lies in a path, and what its neighbours say. A random forest, trained on labelled findings, tells
secrets from identifiers, hashes of files, paths and placeholders. Its trees are written out as column expressions, so that a
scan is one pass over the texts, without a shuffle. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.llm.common import WORD, let, shared_dir

CORE = r"[A-Za-z0-9_+/\-.]{16,}(?:={1,2}(?![A-Za-z0-9_+/\-.=]))?"
MASK = "[SECRET]"
#: Words that mark a secret's name, words that mark other identifiers, and words found inside harmless names.
NAMES = "secret|token|passwd|password|api_?key|apikey|access_?key|private_?key|auth|credential|bearer|pwd|client_?secret"
OTHERS = "commit|sha1|sha256|md5|checksum|revision|digest|etag|hash|version|integrity|blob|uuid|guid|id|example|sample|placeholder|dummy|doi|isbn"
WORDS = (
    "the and for with from that this have not are you all can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "about after again index value name user file data test main path home http https www html json page image image view list item node tree link text word line code base type "
    "class model table query field group order event state error debug trace server client local remote public static final string number object array config setting option "
    "example sample your here key placeholder change dummy default version release build source target output input result license general apache foundation"
).split()
FEATURES = ["length", "transitions", "coverage", "distinct", "digits", "upper", "path", "named", "other", "assigned", "quoted"]


def features(core: Column, before: Column, after: Column) -> Column:
    """A struct of doubles for a candidate, the text of the words before it and of what follows it directly."""
    n = F.length(core).cast("double")
    lower = F.lower(core)
    kinds = F.translate(core, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    kinds = F.regexp_replace(kinds, r"[^Aa0]", "-")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    flag = lambda c: c.cast("double")
    context = F.lower(before)
    return F.struct(
        n.alias("length"),
        ((runs - 1) / n).alias("transitions"),
        ((n - F.length(F.regexp_replace(lower, "(?:" + "|".join(w for w in sorted(set(WORDS), key=lambda w: (-len(w), w)) if len(w) > 2) + ")", ""))) / n).alias("coverage"),
        (F.size(F.array_distinct(F.split(core, ""))) / F.least(n, F.lit(40.0))).alias("distinct"),
        (F.length(F.regexp_replace(core, r"[^0-9]", "")) / n).alias("digits"),
        (F.length(F.regexp_replace(core, r"[^A-Z]", "")) / n).alias("upper"),
        flag(core.rlike(r"^\.{0,2}/|/[a-z][a-z0-9_.\-]*/|\.[a-z]{2,4}$") | before.rlike(r"(?:://|@|www\.)[^\s\"']*$")).alias("path"),
        flag(context.rlike(rf"(?:{NAMES})[\"'\]\s]*(?:[:=]|=>|is)?[\s\"'`(]*$")).alias("named"),
        flag(context.rlike(rf"\b(?:{OTHERS})\W+$")).alias("other"),
        flag(before.rlike(r"[:=]\s*[\"'`]?$")).alias("assigned"),
        flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).alias("quoted"),
    )


def candidates(text: Column) -> Column:
    """An array of structs (word, secret, before, after): all candidates of a whole text, in order, and what surrounds them.

    before: what stands between the candidate and the one before it in its word, with that one; for a word's first one, what comes
    before it in the word, with the two words before. after: what stands up to the word's next candidate or its end. Both are whole.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: (F.length(p["x"]) >= 16) & p["x"].rlike(r"[0-9_+/=\-.A-Z]") & p["x"].rlike(CORE))

        def cores(p: Column) -> Column:
            lead = F.concat_ws(" ", F.slice(w, F.greatest(p["i"] - 1, F.lit(1)), F.least(p["i"], F.lit(2))))
            cut = F.struct(F.regexp_extract_all(p["x"], F.lit(CORE), F.lit(0)).alias("core"), F.split(p["x"], CORE, -1).alias("gap"), F.concat(lead, F.lit(" ")).alias("lead"))

            def of_word(c: Column) -> Column:
                def one(core: Column, k: Column) -> Column:
                    front = F.when(k == 0, c["lead"]).otherwise(F.concat(F.get(c["gap"], k - 1), F.get(c["core"], k - 1)))
                    return F.struct(p["i"].cast("int").alias("word"), core.alias("secret"), F.concat(front, F.get(c["gap"], k)).alias("before"), F.get(c["gap"], k + 1).alias("after"))

                return F.transform(c["core"], one)

            return let(cut, of_word)

        return F.flatten(F.transform(at, cores))

    return let(words, of)


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 11) -> DataFrame:
    """core, before, after, label: made findings of known kind, the same for a seed.

    The tables hold no labelled findings, so they are made: random keys behind names of secrets (1), and file hashes, uuids, paths,
    dotted names, placeholders, word chains, numbers and random runs without a name (0), in prose, assignments and addresses.
    Each is put into a text and cut out as in a scan; what else is cut out there, such as a long name, counts as 0. `rows`
    bounds the texts.
    """
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(seed), "id", F.lit(k)), 256)
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed * 1000 + k)), F.lit(n)).cast("int")
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), pick(k, len(values)))
    mixed = F.translate(F.base64(F.unhex(h(1))), "=", "")
    random = F.when(pick(2, 3) == 0, F.substring(h(3), 1, 40)).when(pick(2, 3) == 1, F.substring(mixed, 1, 40)).otherwise(F.substring(mixed, 1, 24))
    word = lambda k: of(WORDS, k)
    chain = F.concat_ws("_", word(4), word(5), word(6), word(7), word(8))
    uuid = F.concat_ws("-", F.substring(h(9), 1, 8), F.substring(h(9), 9, 4), F.substring(h(9), 13, 4), F.substring(h(9), 17, 4), F.substring(h(9), 21, 12))
    folder = F.concat(F.lit("/"), word(10), F.lit("/"), word(11), F.lit("/"), word(12), F.lit("_"), F.substring(h(13), 1, 6), F.lit(".txt"))
    name = of(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credential", "API_KEY", "DB_PASSWORD", "AWS_SECRET_ACCESS_KEY"], 14)
    other = of(["commit", "sha256", "checksum", "revision", "etag", "uuid", "digest", "md5"], 15)
    sign = of([" = ", "=", ": ", " := "], 16)
    mark = of(['"', "'", '"', ""], 17)
    kind = pick(18, 12)
    label = (kind < 4).cast("int")
    core = (
        F.when(kind < 4, random).when(kind == 4, F.substring(h(19), 1, 40)).when(kind == 5, uuid).when(kind == 6, folder).when(kind == 7, F.concat_ws(".", word(20), word(21), word(22), word(23)))
        .when(kind == 8, of(["your_api_key_here_please", "xxxxxxxxxxxxxxxxxxxxxxxx", "changeme_changeme_changeme", "example-token-placeholder", "0000000000000000000000000000"], 24))
        .when(kind == 9, chain).when(kind == 10, F.substring(F.translate(h(25), "abcdef", "123456"), 1, 16)).otherwise(random)
    )
    page = F.concat(word(32), F.lit(" https://"), word(33), F.lit(".example.org/"), word(34), F.lit("/"), word(35), F.lit("?"), F.when(pick(36, 2) == 0, "").otherwise(F.concat(word(37), F.lit("="), pick(38, 100).cast("string"), F.lit("&"))))
    linked = (pick(39, 4) == 0) & (kind.isin(4, 5, 8, 10, 11) | (kind < 4))  # in an address
    before = (
        F.when(linked, F.concat(page, F.when((kind < 4) | (kind == 8), name).when(kind.isin(4, 5), other).otherwise(word(40)), F.lit("=")))
        .when((kind < 4) | (kind == 8), F.concat(word(26), F.lit(" "), name, sign, mark)).when(kind.isin(4, 5), F.concat(word(27), F.lit(" "), other, of([" ", " ", "=", ": "], 41)))
        .when(kind == 6, F.concat(word(28), F.lit(" in "))).when(kind == 9, F.concat(word(29), sign, mark)).otherwise(F.concat(word(30), F.lit(" "), word(31), F.lit(" ")))
    )
    after = F.when(((kind < 4) | (kind == 8)) & ~linked, mark).otherwise("")
    made = spark.range(rows).select(core.alias("core"), F.concat(before, core, after).alias("text"), label.alias("label"))
    cut = made.select("core", "label", F.explode(candidates(F.col("text"))).alias("c"))
    return cut.select(F.col("c.secret").alias("core"), "c.before", "c.after", F.when(F.col("c.secret") == F.col("core"), F.col("label")).otherwise(0).alias("label"))


def labelled(spark: SparkSession, seed: int, rows: int) -> DataFrame:
    """The features and the label of made findings."""
    made = labelled_findings(spark, rows, seed).select(features(F.col("core"), F.col("before"), F.col("after")).alias("f"), F.col("label").cast("double").alias("label"))
    return made.select("f.*", "label")


@lru_cache(maxsize=4)
def _forest(seed: int, rows: int, trees: int, depth: int) -> tuple[tuple, ...]:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = SparkSession.getActiveSession()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(labelled(spark, seed, rows)).select("v", "label")
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    path = f"{shared_dir(spark)}/areal-forest-{uuid.uuid4().hex}"
    model.save(path)  # a saved model is the public form of its nodes
    nodes = {(r.treeID, r.n.id): r.n for r in spark.read.parquet(f"{path}/data").select("treeID", F.col("nodeData").alias("n")).collect()}

    def tree(t: int, at: int) -> tuple | float:
        n = nodes[t, at]
        if n.leftChild < 0:
            return float(n.impurityStats[1] / sum(n.impurityStats)) if sum(n.impurityStats) else 0.0
        return FEATURES[n.split.featureIndex], n.split.leftCategoriesOrThreshold[0], tree(t, n.leftChild), tree(t, n.rightChild)

    return tuple(tree(t, 0) for t in range(trees))


def forest(spark: SparkSession, rows: int = 4000, trees: int = 16, depth: int = 5, seed: int = 11) -> tuple[tuple, ...]:
    """The trees as nested (feature, limit, at most the limit, over it); each leaf is its share of secrets."""
    return _forest(seed, rows, trees, depth)


def findings(text: Column, trees: tuple[tuple, ...], threshold: float = 0.5) -> Column:
    """An array of structs (word, secret, score): all candidates of a whole text, in order, with the forest's verdict.

    word: index of the word that holds the candidate. is_secret: score >= threshold.
    """
    scored = F.transform(
        candidates(text),
        lambda c: F.struct(c["word"].alias("word"), c["secret"].alias("secret"), let(features(c["secret"], c["before"], c["after"]), lambda f: _sum(trees, f)).alias("score")),
    )
    return F.transform(scored, lambda c: F.struct(c["word"].alias("word"), c["secret"].alias("secret"), c["score"].alias("score"), (c["score"] >= threshold).alias("is_secret")))


def _sum(trees: tuple[tuple, ...], f: Column) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + _expression(t, f)
    return total / len(trees)


def _expression(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    name, limit, low, high = tree
    return F.when(f[name] <= limit, _expression(low, f)).otherwise(_expression(high, f))


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (distinct, in order) and max_score (null without candidates), one row per row of docs.

    Null and empty texts have no candidates. Every copy of a text has the same findings. Other columns are ignored.
    """
    trees = forest(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), findings(F.col("text"), trees, threshold).alias("c"))
    return found.select("doc_id", let(F.col("c"), lambda c: F.struct(
        F.size(c).cast("long").alias("n_candidates"),
        F.size(F.filter(c, lambda x: x["is_secret"])).cast("long").alias("n_secrets"),
        F.array_distinct(F.transform(F.filter(c, lambda x: x["is_secret"]), lambda x: x["secret"])).alias("secrets"),
        F.array_max(F.transform(c, lambda x: x["score"])).alias("max_score"),
    )).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every secret in text replaced by a mask; texts without one, and all other columns, stay as they are."""
    trees = forest(docs.sparkSession)
    secret = F.filter(findings(F.col("text"), trees, threshold), lambda c: c["is_secret"])
    clean = F.aggregate(secret, F.col("text"), lambda t, c: F.replace(t, c["secret"], F.lit(MASK)))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
