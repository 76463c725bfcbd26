"""Quality rules whose cut-offs are controlled for risk.

Each rule compares one figure of a text with a cut-off. Cut-offs come from labelled holdouts: for each stratum (language)
and rule, ever stricter cut-offs are tested, in a fixed order, against "more than its share of the good documents
would be rejected"; the exact binomial tail is the p-value, testing stops at the first that isn't significant, and the
level is divided by the number of strata and rules (Bonferroni). With all rules together at most `risk` of a stratum's good
documents are rejected, in all strata at once, with probability 1 - `level`. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.llm.common import WORD, let, small, written

#: Rules: figure of a text (higher is worse), the mildest cut-off, and how many stricter ones follow it, each RATIO times the one before.
RULES: dict[str, tuple[Callable[[], Column], float]] = {
    "symbols_per_word": (lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)), 4.0),
    "duplicate_lines": (lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 1.0),
    "long_words": (lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), 64.0),
    "upper_case": (lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), 1.0),
    "exclamations": (lambda: F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)), 4.0),
}
#: Cut-offs go down to a thousandth of the mildest one and then to 0, so that a test, not the grid, says where they end.
RATIO, STEPS = 0.87, 50
MOST_STRATA = 2000


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(words: Column, window: int) -> Column:
    """How many words stand in windows of `window` words that occur more than once."""

    def covered(hashes: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, of))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, 0).otherwise(let(hashes, covered))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one column `q`, a struct of counts of each whole text; null counts as a text without words.

    n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a word; those equal to an
    earlier one), n_repeat_words (words in 5-word windows found twice or more), n_upper (A-Z), n_marks (`!`), key (a hash of the words).
    No shuffle. Windows are compared by 64-bit hashes within a text.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = let(
        F.struct(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.translate(own, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            _without(own, "#*$%&|<>").cast("long").alias("n_symbols"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeated(x["w"], 5).cast("long").alias("n_repeat_words"),
            _without(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
            _without(own, "!").cast("long").alias("n_marks"),
            F.xxhash64(x["w"]).alias("key"),
        ),
    )
    return docs.withColumn("q", made)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by eight; exact to about 1e-13."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.ln(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    shift = F.ln((n + 1) * (n + 2) * (n + 3) * (n + 4)) + F.ln((n + 5) * (n + 6) * (n + 7) * (n + 8))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly: terms from k downwards, as far as any can count.

    Beyond 12 standard deviations and 60 terms what is left is under 1e-30 of the sum, for any k up to the mean (where tests need it).
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(_log_factorial(nd) - _log_factorial(kd) - _log_factorial(nd - kd) + kd * F.ln(F.lit(p)) + (nd - kd) * F.ln(F.lit(1 - p)))
    odds = (1 - p) / p
    reach = F.ceil(12 * F.sqrt(nd * p * (1 - p)) + 60)
    terms = F.aggregate(
        F.sequence(F.lit(0), F.when(kd <= nd * p, F.least(k, reach)).otherwise(k).cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (kd - j) / (nd - kd + j + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), top * terms))


def grid(mildest: float) -> list[float]:
    return [mildest * RATIO**i for i in range(STEPS)] + [0.0]


def _within(figure: Column, mildest: float) -> Column:
    """How many of a rule's cut-offs, the mildest ones, a figure doesn't exceed."""
    return F.size(F.filter(F.array(*map(F.lit, grid(mildest))), lambda c: figure <= c))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.1, level: float = 0.1) -> DataFrame:
    """stratum, rule and cutoff: the strictest cut-off of each rule that a stratum's labelled good documents allow.

    measured: doc_id, stratum, q. labels: doc_id, quality (1: good). A document labelled both ways is no good one, and texts that are
    equal but for white space are one trial, since copies tell nothing new. A stratum without labels, or with too few, gets no row:
    nothing is rejected there. The counts are over all labelled documents.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("worst")).where("worst = 1").select("doc_id")
    held = measured.join(good, "doc_id", "left_semi").select("stratum", "q").groupBy("stratum", F.col("q.key").alias("key")).agg(F.first("q").alias("q")).select("stratum", "q.*")
    # a text counts once a rule, at the mildest cut-off that it exceeds; what exceeds a cut-off is what exceeds it or a milder one first
    exceeded = [F.struct(F.lit(name).alias("rule"), _within(figure().cast("double"), top).alias("within")) for name, (figure, top) in RULES.items()]
    counted = held.select("stratum", F.explode(F.array(*exceeded)).alias("e")).groupBy("stratum", "e.rule", "e.within").agg(F.count("*").alias("n"))
    strata = counted.select("stratum").distinct()
    every = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for name, (_, top) in RULES.items() for i, c in enumerate(grid(top))]))
    rows = strata.select("stratum", every.alias("g")).select("stratum", "g.*")
    totals = counted.groupBy("stratum", "rule").agg(F.sum("n").alias("n"))
    tallied = rows.join(counted.select("stratum", "rule", F.col("within").alias("step"), F.col("n").alias("ends")), ["stratum", "rule", "step"], "left")
    milder = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = tallied.withColumn("k", F.coalesce(F.sum("ends").over(milder), F.lit(0))).join(totals, ["stratum", "rule"])
    share = risk / len(RULES)
    number = strata.agg(F.count("*").alias("strata"))
    p = F.when(F.col("k") > F.col("n") * share, 1.0).otherwise(binomial_tail(F.least("k", "n"), F.col("n"), share))
    tested = tested.crossJoin(F.broadcast(number)).withColumn("ok", p <= F.lit(level) / (F.col("strata") * len(RULES)))
    first_failure = F.min(F.when(~F.col("ok"), F.col("step"))).over(Window.partitionBy("stratum", "rule"))
    return tested.withColumn("stop", first_failure).where("stop is null or step < stop").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.1, level: float = 0.1, stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by.

    One row for each row of docs, null texts (no words) included; a null stratum is a stratum of its own. Texts with fewer than
    10 words, or with more than 20 % of their words in repeated windows, fail the base rules and aren't kept; others are
    kept unless a rule of their stratum rejects them (rejected_by: their names, after commas). An empty table gives no rows. Columns of docs besides doc_id, text and the stratum are ignored.
    """
    chosen = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null")).alias("stratum"), F.col("text").alias("text"))
    measured = written(figures(chosen).select("doc_id", "stratum", "q"), "figures")  # counts only: texts are read once and never shuffled
    wide = cutoffs(measured, labels, risk, level).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = F.broadcast(wide) if small(measured.select("stratum").distinct(), MOST_STRATA) else wide
    figure = measured.join(wide, "stratum", "left").select("doc_id", "q.*", *[F.col(name).alias(f"cut_{name}") for name in RULES])
    fired = F.filter(F.array(*[F.when(f().cast("double") > F.col(f"cut_{name}"), F.lit(name)) for name, (f, _) in RULES.items()]), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        figure.withColumn("base_failed", failed)
        .withColumn("rejected_by", fired)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))
    )


def _sql() -> str:
    """The same for DuckDB, with tails summed from log-gammas."""
    grids = ", ".join(f"('{name}', {i}, {c!r}::double)" for name, (_, top) in RULES.items() for i, c in enumerate(grid(top)))
    figure = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)", "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)", "long_words": "word_chars / greatest(n_words, 1)",
        "upper_case": "n_upper / greatest(word_chars, 1)", "exclamations": "n_marks / greatest(n_words, 1)",
    }
    figures_ = " union all ".join(f"select doc_id, stratum, key, '{name}' as rule, {figure[name]}::double as f from b" for name in RULES)
    without = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return rf"""
with a as (select row_number() over () as r, doc_id, coalesce(lang, chr(1) || 'null') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
v as (select r, i, array_to_string(w[i:i+4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from a where len(w) >= 5)),
rep as (select r, count(distinct i + s) as n from (select r, i from v qualify count(*) over (partition by r, g) > 1), range(5) u(s) group by r),
b as (select a.r, doc_id, stratum, array_to_string(w, ' ') as key, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as chars0,
             ({without("#*$%&|<>")})::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
             ({without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")})::bigint as n_upper, ({without("!")})::bigint as n_marks, coalesce(chars0, 0)::bigint as word_chars from a left join rep using (r)),
good as (select doc_id from labels where doc_id is not null group by doc_id having min(quality) = 1),
held as (select distinct stratum, key, rule, f from ({figures_}) where doc_id in (select doc_id from good)),
g as (select * from (values {grids}) x(rule, step, cutoff)),
k as (select stratum, rule, step, cutoff, count(*) as n, count(*) filter (f > cutoff) as k from held join g using (rule) group by all),
p as (select *, case when k > n * 0.02 then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))) end as p from k),
ok as (select *, p <= 0.1 / ((select count(distinct stratum) from held) * {len(RULES)}) as ok from p),
cut as (select stratum, rule, min(cutoff) as cutoff from (select *, min(case when not ok then step end) over (partition by stratum, rule) as stop from ok) where stop is null or step < stop group by stratum, rule),
hit as (select r, string_agg(rule, ',' order by list_position({list(RULES)!r}, rule)) as names from (select r, stratum, rule, f from ({figures_.replace("select doc_id", "select r, doc_id")})) join cut using (stratum, rule) where f > cutoff group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and names is null as kept, coalesce(names, '') as rejected_by
from b left join hit using (r)"""


SQL = _sql()
