"""Budgets and copies against a plain version, with repeated rows, repeated ids and null ids."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from areal.llm import mixing

PLAN = mixing.Plan()


def shares(children, budget):
    """children: name -> (capacity, weight)."""
    out, open_, left = {}, dict(children), budget
    for name in sorted(children, key=lambda n: (children[n][0] / children[n][1], n)):
        cap, w = children[name]
        if cap * sum(x for _, x in open_.values()) <= w * left:
            out[name] = cap
            left -= cap
            del open_[name]
        else:
            break
    total = sum(w for _, w in open_.values())
    return out | {n: w * left // total for n, (_, w) in open_.items()}


def brute(rows, plan=PLAN):
    """Counter of (doc_id, text, copies)."""
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        digits = re.search(r"(\d{1,9})$", source or "")
        leaf = (f"d{int(digits[1]) % 4}" if digits else "other", lang or "(none)", source or "(none)")
        leaves[leaf].append((doc_id, text, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    cap = {k: 2 * sum(n for *_, n in v) for k, v in leaves.items()}
    budgets = {(): sum(cap.values()) // 2 * plan.budget_permille // 1000}
    for depth, level in enumerate(("domain", "language", "source")):
        following = {}
        for parent, budget in budgets.items():
            names = {k[depth] for k in leaves if k[:depth] == parent}
            children = {n: (sum(c for k, c in cap.items() if k[: depth + 1] == (*parent, n)), getattr(plan, level).get(n, 1)) for n in names}
            following |= {(*parent, n): b for n, b in shares(children, budget).items()}
        budgets = following
    out = Counter()
    for leaf, members in leaves.items():
        tokens, budget = cap[leaf] // 2, budgets[leaf]
        whole = budget // tokens if tokens else 0
        rest, used, full = budget - whole * tokens, 0, False
        digest = lambda x: hashlib.md5(x.encode()).hexdigest()
        for doc_id, text, n in sorted(members, key=lambda m: digest(f"{plan.seed}:{whole}:{'' if m[0] is None else m[0]}:{digest(m[1] or '')}")):
            full |= used + n > rest
            used += 0 if full else n
            out[doc_id, text, whole + (not full)] += 1
    return out, budgets, leaves


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, copies int")
    got = mixing.mix(docs).collect()
    want, budgets, leaves = brute(rows)
    assert Counter((r.doc_id, r.text, r.copies) for r in got) == want
    used = Counter()
    for r in got:
        used[r.domain, r.language, r.source_name] += r.n_tokens * r.copies
    assert all(used[k] <= budgets[k] for k in leaves)


def test_one_repeated_id_and_null_ids_stay_within_the_budget(spark):
    ten = " ".join("abcdefghij")
    check(spark, [(7, ten, "en", "s0")] * 20 + [(None, ten, "en", "s0")] * 20)


def test_random_trees(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        text = None if rng.random() < 0.05 else " ".join("w" for _ in range(rng.choice([0, 1, 3, 3, 9, 40])))
        rows.append((rng.choice([None, rng.randrange(30), rng.randrange(10_000)]), text, rng.choice([None, "en", "de", "xx"]), rng.choice([None, "s1", "s2", "s5", "s14", "blog"])))
    check(spark, rows)


def test_shares_are_exact_fractions():
    assert shares({"a": (10, 1), "b": (100, 1)}, 60) == {"a": 10, "b": 50} and Fraction(50, 60) < 1
