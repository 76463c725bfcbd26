"""Spatial weights as edge tables (src, dst, w)."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areal.sources.tables import TableError, settled


def _points(points: DataFrame, key: str, coords: list[str]) -> DataFrame:
    return points.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in coords]).alias("at"))


def _apart(a: str = "a", b: str = "b"):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _within(points: DataFrame, dims: int, radius: float, sources: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (src, dst, d) of points up to `radius` apart: points fall into cells of that width, and only neighbouring cells meet."""
    cell = lambda c: F.array(*[F.floor(F.col(c)[i] / radius).cast("long") for i in range(dims)])
    steps = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in product((-1, 0, 1), repeat=dims)])
    a = (points if sources is None else sources).select(F.col("k").alias("src"), F.col("at").alias("a"), F.explode(F.transform(steps, lambda s: F.zip_with(cell("at"), s, lambda x, y: x + y))).alias("cell"))
    b = points.select(F.col("k").alias("dst"), F.col("at").alias("b"), cell("at").alias("cell"))
    return a.join(b, "cell").where("src <> dst").select("src", "dst", _apart().alias("d")).where(F.col("d") <= radius)


def _span(points: DataFrame, dims: int) -> tuple[int, float]:
    """How many points there are, and their widest extent."""
    r = points.agg(F.count("*").alias("n"), *[(F.max(F.col("at")[i]) - F.min(F.col("at")[i])).alias(f"w{i}") for i in range(dims)]).first()
    return r.n, max((r[f"w{i}"] or 0.0 for i in range(dims)), default=0.0) or 1.0


def _nearest(points: DataFrame, dims: int, k: int, sources: DataFrame | None = None) -> DataFrame:
    """src, dst, d, r of the k nearest others, ties to the smaller key.

    The radius starts where k others are to be expected in it and doubles for those sources that found fewer, so crowded and lonely points cost alike.
    """
    n, span = _span(points, dims)
    k = min(k, n - 1)
    left, found = points if sources is None else sources, []
    radius = span * (2 * (k + 1) / max(n, 1)) ** (1 / dims)
    order = Window.partitionBy("src").orderBy("d", "dst")
    while k > 0:
        near = settled(_within(points, dims, radius, left).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
        done = near.where(F.col("r") == k).select(F.col("src").alias("k"))
        found.append(near.join(done.withColumnRenamed("k", "src"), "src", "left_semi"))
        left = settled(left.join(done, "k", "left_anti"))
        if left.isEmpty():
            break
        radius *= 2
    empty = points.select(F.col("k").alias("src"), F.col("k").alias("dst"), F.lit(0.0).alias("d"), F.lit(0).alias("r")).limit(0)
    return reduce(DataFrame.unionByName, found, empty)


def same_group(areas: DataFrame, key: str, group: str) -> DataFrame:
    """Areas of one group are neighbours."""
    a, b = areas.select(F.col(key).alias("src"), group), areas.select(F.col(key).alias("dst"), group)
    return a.join(b, group).where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))


def ring(areas: DataFrame, key: str) -> DataFrame:
    """Each area's neighbours are the ones before and after it by key, around a circle."""
    from areal.operators.compare import numbered

    n = areas.count()
    at = numbered(areas.select(key), [F.col(key)], "r").withColumn("r", F.col("r") - 1)
    both = at.select(F.col(key).alias("src"), F.explode(F.array((F.col("r") + 1) % n, (F.col("r") + n - 1) % n)).alias("r"))
    return both.join(at.select(F.col(key).alias("dst"), "r"), "r").where("src <> dst").select("src", "dst", F.lit(1.0).alias("w")).distinct()


def grid(areas: DataFrame, key: str, row: str, col: str, queen: bool = False) -> DataFrame:
    """Contiguity on a grid: a shared edge, with queen=True also a shared corner."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (queen or abs(i) + abs(j) == 1)]
    a = areas.select(F.col(key).alias("src"), F.explode(F.array(*[F.struct((F.col(row) + i).alias("r"), (F.col(col) + j).alias("c")) for i, j in steps])).alias("p")).select("src", "p.*")
    return a.join(areas.select(F.col(key).alias("dst"), F.col(row).alias("r"), F.col(col).alias("c")), ["r", "c"]).select("src", "dst", F.lit(1.0).alias("w"))


def knn(points: DataFrame, key: str, coords: list[str], k: int = 4) -> DataFrame:
    """k nearest others, ties to the smaller key."""
    return _nearest(settled(_points(points, key, coords)), len(coords), k).select("src", "dst", F.lit(1.0).alias("w"))


def distance(points: DataFrame, key: str, coords: list[str], d_max: float | None = None) -> DataFrame:
    """Areas up to d_max apart; by default just far enough that each area has a neighbour."""
    at = settled(_points(points, key, coords))
    if d_max is None:
        d_max = 1.001 * _nearest(at, len(coords), 1).agg(F.max("d")).first()[0]
    return _within(at, len(coords), d_max).select("src", "dst", F.lit(1.0).alias("w"))


def idw(points: DataFrame, key: str, coords: list[str], alpha: float = 1.0, d_max: float | None = None) -> DataFrame:
    """Weights 1 / d^alpha for 0 < d (<= d_max)."""
    at = settled(_points(points, key, coords))
    radius = d_max if d_max is not None else _span(at, len(coords))[1] * len(coords) ** 0.5 * 1.001  # without a limit all pairs are neighbours
    return _within(at, len(coords), radius).where("d > 0").select("src", "dst", F.pow("d", F.lit(-float(alpha))).alias("w"))


def islands_joined(edges: DataFrame, points: DataFrame, key: str, coords: list[str], k: int = 1) -> DataFrame:
    """edges with areas that have none linked, both ways, to their k nearest."""
    lonely = points.join(edges.select(F.col("src").alias(key)).distinct(), key, "left_anti").select(F.col(key).alias("src"))
    at = settled(_points(points, key, coords))
    near = _nearest(at, len(coords), k, at.join(lonely.withColumnRenamed("src", "k"), "k", "left_semi")).select("src", "dst", F.lit(1.0).alias("w"))
    return edges.unionByName(near).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct()


def styled(edges: DataFrame, style: str = "W", areas: int | None = None) -> DataFrame:
    """W: rows add up to 1; B: 1; C: all add up to the number of areas; U: all add up to 1; minmax: largest |eigenvalue| is 1."""
    if style == "B":
        return edges.withColumn("w", F.lit(1.0))
    if style == "W":
        return edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))
    if style in ("C", "U"):
        total = edges.agg(F.sum("w").alias("t")).first().t
        n = 1.0 if style == "U" else float(areas if areas is not None else edges.select("src").distinct().count())
        return edges.withColumn("w", F.col("w") * F.lit(n / total if total else None))
    if style == "minmax":
        m, _ = dense(edges)
        return edges.withColumn("w", F.col("w") / float(np.abs(np.linalg.eigvals(m).real).max()))
    raise ValueError(f"no style {style}")


#: Dense matrices are made up to this many areas (128 MB).
DENSE_MOST = 4000


def dense(edges: DataFrame, keys: list | None = None) -> tuple[np.ndarray, list]:
    """The matrix and the keys of its rows, on the driver; an error beyond DENSE_MOST areas."""
    if keys is None:
        keys = sorted(r[0] for r in edges.select("src").union(edges.select("dst")).distinct().limit(DENSE_MOST + 1).collect())
    if len(keys) > DENSE_MOST:
        raise ValueError(f"{len(keys)} areas are more than a dense matrix is made for ({DENSE_MOST})")
    at = {k: i for i, k in enumerate(keys)}
    out = np.zeros((len(keys), len(keys)))
    spark = edges.sparkSession
    known = spark.createDataFrame([(k,) for k in keys], f"k {dict(edges.dtypes)['src']}")
    inside = edges.join(F.broadcast(known.withColumnRenamed("k", "src")), "src", "left_semi").join(F.broadcast(known.withColumnRenamed("k", "dst")), "dst", "left_semi")
    for r in inside.groupBy("src", "dst").agg(F.sum("w").alias("w")).limit(DENSE_MOST**2).collect():  # one row a cell of the matrix at most
        if r.src in at and r.dst in at:
            out[at[r.src], at[r.dst]] += r.w
    return out, keys


def check(edges: DataFrame, areas: DataFrame, key: str) -> dict:
    """Errors for weights that are negative or not finite; how many areas have no neighbour, and how many rows don't add up to 1."""
    bad = edges.agg(F.count_if(F.coalesce(~(F.col("w") >= 0) | (F.abs("w") == float("inf")), F.lit(True))).alias("n")).first().n
    if bad:
        raise TableError(f"{bad} weights are negative or not finite")
    sums = areas.select(F.col(key).alias("src")).distinct().join(edges.groupBy("src").agg(F.sum("w").alias("s")), "src", "left")
    r = sums.agg(F.count_if(F.coalesce("s", F.lit(0.0)) == 0).alias("without"), F.count_if(F.abs(F.col("s") - 1) > 1e-6).alias("unnormalised")).first()
    return r.asDict()


def from_neighbours(areas: DataFrame, key: str, neighbours: str) -> DataFrame:
    """Edges from a column that lists each area's neighbours."""
    return areas.select(F.col(key).alias("src"), F.explode(neighbours).alias("dst")).where("dst is not null and src <> dst").distinct().withColumn("w", F.lit(1.0))


def symmetric(edges: DataFrame) -> DataFrame:
    """The neighbourhood of a conditional model: 1 both ways wherever either weight is positive, nothing on the diagonal."""
    live = edges.where("w > 0 and src <> dst").select("src", "dst")
    return live.union(live.select("dst", "src")).distinct().withColumn("w", F.lit(1.0))


def components(edges: DataFrame, areas: DataFrame, key: str, rounds: int = 1000) -> DataFrame:
    """key and component (its smallest key) of every area: minima spread along edges, then shortcuts through what the minimum itself knows."""
    both = settled(symmetric(edges).select("src", "dst"))
    of = settled(areas.select(F.col(key).alias("k"), F.col(key).alias("c")).distinct())
    for _ in range(rounds):
        near = both.join(of.select(F.col("k").alias("dst"), "c"), "dst").groupBy("src").agg(F.min("c").alias("m")).withColumnRenamed("src", "k")
        spread = of.join(near, "k", "left").select("k", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = spread.select(F.col("k").alias("n"), F.col("n").alias("j"))
        new = settled(spread.join(jump, "n", "left").select("k", "c", F.least("n", F.coalesce("j", "n")).alias("n")))
        if new.where("c <> n").isEmpty():
            return of.select(F.col("k").alias(key), F.col("c").alias("component"))
        of = new.select("k", F.col("n").alias("c"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")
