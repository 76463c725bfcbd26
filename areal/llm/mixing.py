"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree: domain, language, source. At each node it is dealt among the children by weight, none
getting more than it can fill (its tokens times the most epochs); what one can't fill goes to its siblings, by weight, and
only if all of them are full does it stay with the parent and so go to the parent's siblings. Each leaf then takes
whole epochs and, of one more, the longest prefix of a seeded order that fits. All of it is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.llm.common import WORD, dropped, small, written

LEVELS = ["domain", "language", "source"]
NONE = "(none)"
#: Leaves are sent to all executors up to this number; beyond it rows are shuffled.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Plan:
    """Weights of children by name, at each level (1 if not named); budget in thousandths of all tokens."""

    domain: Mapping[str, int] = field(default_factory=lambda: {"d0": 3, "d1": 2})
    language: Mapping[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2})
    source: Mapping[str, int] = field(default_factory=dict)
    budget_permille: int = 900
    epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The default domain: the last digits of the source's name, modulo four; `other` without digits."""
    digits = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("d"), (digits.cast("long") % 4).cast("string"))).otherwise("other")


def tokens_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _weight(level: str, plan: Plan) -> Column:
    named = getattr(plan, level)
    out = F.lit(1)
    for name, weight in named.items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (domain, language, source, tokens) with budget: how many tokens each is to give, repeats included."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    given = total.select(F.expr(f"all * {int(plan.budget_permille)} div 1000").alias("budget"))
    parents: list[str] = []
    for level in LEVELS:
        keys = [*parents, level]
        children = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, plan))
        children = children.join(given, parents) if parents else children.crossJoin(F.broadcast(given))
        order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), level)
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        children = children.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("w").over(after))
        full = F.col("cap") * F.col("weights") <= F.col("w") * (F.col("budget") - F.col("spent"))
        siblings = Window.partitionBy(*parents)
        children = children.withColumn("full", full)
        children = children.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0)))
        children = children.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings))
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("w * left div open"))
        given = children.select(*keys, share.alias("budget"))
        parents = keys
    return leaves.join(given, LEVELS).select(*LEVELS, "tokens", "budget")


def _place(plan: Plan, whole: Column, md5: Column) -> Column:
    """Where a row stands in its leaf's order: a seeded hash of its id and text. Only rows equal in both share a place."""
    return F.md5(F.concat_ws(":", F.lit(plan.seed), whole.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), md5))


def mix(docs: DataFrame, plan: Plan = Plan(), domain: Column | None = None) -> DataFrame:
    """docs with domain, language, source_name, n_tokens and copies: how often the mix holds each row (0: not at all).

    docs: doc_id, text, lang, source; all its columns are kept under their names, except those that the new ones
    replace. Tokens are words. A null language or source is a child named (none). Null and empty texts have no tokens; they come
    along with the prefix in which they stand. Rows equal in id and text share a place in the order; where the budget ends among them, as
    many as fit are taken, and which of them is arbitrary. The prefix is found by sums over 4096 ranges of the order, then over the places
    of the range in which it ends; rows that share the last place are numbered by partitions. So no task gets a whole
    leaf or a whole group of copies. An empty table gives no rows.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    text_md5 = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumns({"domain": F.coalesce(domain, F.lit("other")), "language": F.coalesce("lang", F.lit(NONE)), "source_name": F.coalesce("source", F.lit(NONE)), "n_tokens": tokens_of(F.col("text"))})
    keys = ["domain", "language", "source_name"]
    slim = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "n_tokens", text_md5.alias("m")), "leaf-tokens")
    leaves = slim.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).withColumnRenamed("source_name", "source")
    plans = budgets(leaves, plan).withColumnRenamed("source", "source_name")
    plans = plans.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)))
    plans = written(plans.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "leaf-plan")
    near = (lambda x: F.broadcast(x)) if small(plans, BROADCAST_LEAVES) else (lambda x: x)

    placed = slim.join(near(plans.select(*keys, "whole", "rest")), keys).withColumn("place", _place(plan, F.col("whole"), F.col("m"))).withColumn("range", F.substring("place", 1, 3))
    sums = placed.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    up_to = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("t").over(up_to)).where("upto > rest").groupBy(*keys).agg(F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("t"), "range").alias("before"))
    ends = written(ends, "leaf-ends")
    places = placed.join(near(ends), [*keys, "range"]).groupBy(*keys, "place").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("each"), F.count("*").alias("rows"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    running = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = places.withColumn("upto", F.col("before") + F.sum("t").over(running))
    over = F.struct("place", F.expr("(rest - upto + t) div each").alias("fit"))  # only a place with tokens goes over
    cut = summed.groupBy(*keys).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("last"), F.min(F.when(F.col("upto") > F.col("rest"), over)).alias("over"))
    cuts = written(plans.select(*keys, "whole").join(ends.select(*keys, "range"), keys, "left").join(cut, keys, "left"), "leaf-cuts")
    shared = not cuts.where("over.fit > 0").isEmpty()
    dropped(slim, ends)

    renamed = cuts.select(*keys, F.col("whole").alias("_whole"), F.col("range").alias("_range"), F.col("last").alias("_last"), F.col("over").alias("_over"))
    own = rows.join(near(renamed), keys).withColumn("_place", _place(plan, F.col("_whole"), text_md5))
    start = F.substring("_place", 1, 3)
    inside = F.col("_range").isNull() | (start < F.col("_range")) | F.coalesce((start == F.col("_range")) & (F.col("_place") <= F.col("_last")), F.lit(False))
    out = [*rows.columns, "copies"]
    if not shared:
        return own.withColumn("copies", F.col("_whole") + inside.cast("long")).select(*out)
    among = F.coalesce((F.col("_place") == F.col("_over.place")) & (F.col("_over.fit") > 0), F.lit(False))
    tied = written(own.where(among).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "leaf-ties")
    counts = tied.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "leaf-offsets")
    number = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_id"))
    numbered = tied.withColumn("_number", number).join(near(offsets), [*keys, "_part"])
    taken = numbered.withColumn("copies", F.col("_whole") + (F.col("_before") + F.col("_number") <= F.col("_over.fit")).cast("long")).select(*out)
    return own.where(~among).withColumn("copies", F.col("_whole") + inside.cast("long")).select(*out).union(taken)


SQL = r"""
with d as (
  select doc_id, coalesce(case when regexp_extract(source, '(\d{1,9})$', 1) <> '' then 'd' || (cast(regexp_extract(source, '(\d{1,9})$', 1) as bigint) % 4) else 'other' end, 'other') as domain,
         coalesce(lang, '(none)') as language, coalesce(source, '(none)') as source_name,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens, md5(coalesce(text, '')) as m
  from documents),
leaf as (select domain, language, source_name, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * 2 as cap from d group by all),
l1 as (select domain, sum(cap)::bigint as cap, case domain when 'd0' then 3 when 'd1' then 2 else 1 end as w, (select sum(tokens)::bigint * 900 // 1000 from leaf) as budget from leaf group by domain),
s1 as (select *, coalesce(sum(cap) over (order by cap / w, domain rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
              sum(w) over (order by cap / w, domain rows between current row and unbounded following)::bigint as weights from l1),
f1 as (select *, cap * weights <= w * (budget - spent) as is_full from s1),
g1 as (select domain, case when is_full then cap else w * (budget - coalesce(sum(case when is_full then cap end) over (), 0)::bigint) // (sum(case when not is_full then w end) over ())::bigint end as budget from f1),
l2 as (select domain, language, sum(cap)::bigint as cap, case language when 'en' then 4 when 'de' then 2 when 'fr' then 2 else 1 end as w from leaf group by domain, language),
s2 as (select l2.*, budget, coalesce(sum(cap) over (partition by domain order by cap / w, language rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
              sum(w) over (partition by domain order by cap / w, language rows between current row and unbounded following)::bigint as weights from l2 join g1 using (domain)),
f2 as (select *, cap * weights <= w * (budget - spent) as is_full from s2),
g2 as (select domain, language, case when is_full then cap else w * (budget - coalesce(sum(case when is_full then cap end) over (partition by domain), 0)::bigint) // (sum(case when not is_full then w end) over (partition by domain))::bigint end as budget from f2),
l3 as (select leaf.*, 1 as w, g2.budget from leaf join g2 using (domain, language)),
s3 as (select *, coalesce(sum(cap) over (partition by domain, language order by cap / w, source_name rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
              sum(w) over (partition by domain, language order by cap / w, source_name rows between current row and unbounded following)::bigint as weights from l3),
f3 as (select *, cap * weights <= w * (budget - spent) as is_full from s3),
g3 as (select domain, language, source_name, tokens, case when is_full then cap else w * (budget - coalesce(sum(case when is_full then cap end) over (partition by domain, language), 0)::bigint) // (sum(case when not is_full then w end) over (partition by domain, language))::bigint end as budget from f3),
p as (select *, case when tokens > 0 then budget // tokens else 0 end as whole from g3),
r as (select d.*, whole, budget - whole * tokens as rest, md5('17:' || whole || ':' || coalesce(cast(doc_id as varchar), '') || ':' || m) as place from d join p using (domain, language, source_name)),
c as (select *, sum(n_tokens) over (partition by domain, language, source_name order by place rows between unbounded preceding and current row)::bigint as upto from r)
select doc_id, domain, language, source_name, n_tokens, cast(whole + case when upto <= rest then 1 else 0 end as bigint) as copies from c
"""
