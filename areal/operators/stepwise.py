"""Stepwise choice of covariates by AIC, BIC or KIC; the candidates of a step are fitted as tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.operators import fh
from areal.sources.tables import TableError, settled


def _criteria(x: np.ndarray, y: np.ndarray, psi: np.ndarray) -> dict[str, float] | None:
    """Of a maximum likelihood fit; None where it can't be made."""
    m, p = x.shape
    scale = np.sqrt((x * x).sum(axis=0))
    if m <= p or (scale == 0).any() or np.linalg.matrix_rank((x / scale).T @ (x / scale), tol=1e-10) < p:
        return None
    at = fh.local_sums(x, y, psi)
    s2, _, _ = fh.scoring(at, float(np.median(psi)), "ML", 100, 1e-4)
    s = at(s2)
    _, minus2 = s.pairs(np.linalg.solve(s.a1, s.xy))
    return {"aic": minus2 + 2 * (p + 1), "bic": minus2 + (p + 1) * np.log(m), "kic": minus2 + 3 * (p + 1)}


def step(df: DataFrame, y: str, vardir: str, start: list[str], scope: list[str] | None = None, domain: str = "domain", direction: str = "both", criterion: str = "aic", method: str = "REML", steps: int = 1000):
    """The fit of the best model found and the path as (action, criterion). Candidates are fitted by ML, the result by `method`.

    The table of sampled areas goes to the tasks once a step, so it must be as small as a local fit's. Candidates that can't be
    fitted don't count; the search ends when none is strictly better.
    """
    df = settled(df)
    scope = list(dict.fromkeys([*start, *(scope or [])]))
    rows = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(vardir).cast("double").alias("v"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(scope)])
    local = rows.limit(fh.LOCAL_ROWS + 1).toPandas()
    if len(local) > fh.LOCAL_ROWS:
        raise TableError(f"stepwise choice is made for {fh.LOCAL_ROWS} areas at most")
    yv, psi = local["y"].to_numpy(), local["v"].to_numpy()
    columns = {c: local[f"x{i}"].to_numpy() - local[f"x{i}"].mean() for i, c in enumerate(scope)}
    yv = yv - yv.mean()
    known: dict[tuple[str, ...], float | None] = {}
    spark = df.sparkSession

    def values(models: list[list[str]]) -> None:
        keys = [k for k in dict.fromkeys(tuple(sorted(m)) for m in models) if k not in known]
        if not keys:
            return

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [_criteria(np.column_stack([np.ones(len(yv)), *[columns[c] for c in keys[i]]]), yv, psi) for i in b["id"]]
                yield pd.DataFrame({"id": b["id"], "value": [None if f is None else f[criterion] for f in found]})

        got = spark.range(len(keys), numPartitions=min(len(keys), max(1, spark.sparkContext.defaultParallelism))).mapInPandas(run, "id long, value double").collect()
        known.update({keys[r.id]: r.value if r.value is not None and r.value == r.value else None for r in got})

    now = list(start)
    values([now])
    best = known[tuple(sorted(now))]
    path = [("start", best)]
    for _ in range(steps):
        moves = [("- " + t, [x for x in now if x != t]) for t in now] if direction in ("both", "backward") else []
        moves += [("+ " + t, [*now, t]) for t in scope if t not in now] if direction in ("both", "forward") else []
        values([terms for _, terms in moves])
        scored = [(v, name, terms) for name, terms in moves if (v := known[tuple(sorted(terms))]) is not None]
        if not scored or best is not None and min(scored)[0] >= best:
            break
        best, name, now = min(scored)
        path.append((name, best))
    return fh.fit(df, y, vardir, now, domain, method), path
