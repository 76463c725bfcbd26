"""Queries of the estimation engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.operators import area_models, bhf, compare, fh, prep, report, simulate, spatial, stepwise, weights
from areal.operators.benchmark import benchmark
from areal.operators.hb import models as hb
from areal.plans import sql
from areal.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _estimates(fit: fh.FayHerriot) -> DataFrame:
    return rounded(fit.estimates.select("domain", "eblup", "random_effect", "mse", "rse"), eblup=5, random_effect=5, mse=4, rse=4).withColumn("random_effect", F.col("random_effect") + 0.0)


def _unsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.area_lag(spark, sf_dir).withColumn("y", F.when(F.col("domain") % 5 != 0, F.col("y")))


def _lag_fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fh.FayHerriot]:
    area = tables.area_lag(spark, sf_dir)
    return area, fh.fit(area, "y", "vardir", ["x"])


def _with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, fit = _lag_fit(spark, sf_dir)
    return fit.estimates.join(area.select("domain", "region", "n"), "domain")


@query(f"with {sql.AREA_LAG} select domain, n, round(y, 6) as y, round(vardir, 6) as vardir, round(x, 6) as x from area")
def direct_mean_nation(spark, sf_dir):
    return rounded(tables.area_lag(spark, sf_dir).select("domain", "n", "y", "vardir", "x"), y=6, vardir=6, x=6)


@query(f"with {sql.SHARE} select domain, n, round(y, 8) as y, round(vardir, 10) as vardir from prop")
def direct_prop_nation(spark, sf_dir):
    return rounded(tables.area_share(spark, sf_dir).select("domain", "n", "y", "vardir"), y=8, vardir=10)


@query(sql.LAG_FH + "select round(s2, 4) as sigma2_u, n_iter from fin")
def fh_sigma2(spark, sf_dir):
    fit = _lag_fit(spark, sf_dir)[1]
    return spark.createDataFrame([(round(float(fit.sigma2_u), 4), fit.n_iter)], "sigma2_u double, n_iter int")


@query(sql.LAG_FH + "select '(intercept)' as term, round(my + b0 - b1 * mx, 4) as beta, round(sqrt(q00 - 2*mx*q01 + mx*mx*q11), 4) as std_error from co, mid union all select 'x', round(b1, 4), round(sqrt(q11), 4) from co")
def fh_coef(spark, sf_dir):
    fit = _lag_fit(spark, sf_dir)[1]
    return spark.createDataFrame([(c["term"], round(c["beta"], 4), round(c["std_error"], 4)) for c in fit.coef], "term string, beta double, std_error double")


@query(sql.LAG_FH + sql.ESTIMATE)
def fh_eblup(spark, sf_dir):
    return _estimates(_lag_fit(spark, sf_dir)[1])


@query(sql.fay_herriot(sql.AREA_LAG, "ML") + sql.ESTIMATE)
def fh_ml_eblup(spark, sf_dir):
    return _estimates(fh.fit(tables.area_lag(spark, sf_dir), "y", "vardir", ["x"], method="ML"))


@query(sql.fay_herriot(sql.AREA_LAG.replace("area as", "full_area as") + "," + sql.UNSAMPLED) + sql.ESTIMATE)
def fh_unsampled(spark, sf_dir):
    return _estimates(fh.fit(_unsampled(spark, sf_dir), "y", "vardir", ["x"]))


@query(sql.fay_herriot(sql.planted(1.5)) + sql.ESTIMATE)
def fh_planted(spark, sf_dir):
    return _estimates(fh.fit(tables.area_planted(spark, sf_dir), "y", "vardir", ["x"]))


@query(sql.fay_herriot(sql.planted(0.0)) + sql.ESTIMATE)
def fh_boundary(spark, sf_dir):
    return _estimates(fh.fit(tables.area_planted(spark, sf_dir, 0.0), "y", "vardir", ["x"]))


@query(sql.fay_herriot(sql.planted(1.5, 5.0, log=True)) + "select domain, round(exp(eblup + 0.5 * s2 * bb), 5) as eblup, round(eblup, 6) as eblup_log, round(mse, 7) as mse_log, round(exp(eblup + 0.5 * s2 * bb) ** 2 * mse, 5) as mse from est")
def fh_log(spark, sf_dir):
    fit = fh.fit(tables.area_planted(spark, sf_dir, 1.5, 5.0), "y", "vardir", ["x"], transform="log")
    return rounded(fit.estimates.select("domain", "eblup", "eblup_log", "mse_log", "mse"), eblup=5, eblup_log=6, mse_log=7, mse=5)


@query(f"with recursive {sql.AREA_LAG.replace('area as', 'area0 as')}, area as (select *, n / (select sum(n) from area0) * vardir as z from area0), " + sql.fay_herriot_many(["x", "z"]) + sql.ESTIMATE)
def fh_selfbench(spark, sf_dir):
    area = fh.benchmark_covariate(tables.area_lag(spark, sf_dir), "y", "vardir", "n")
    return _estimates(fh.fit(area, "y", "vardir", ["x", "z"]))


@query(f"with recursive {sql.AREA_LAG.replace('area as', 'area0 as')}, t as (select sum(n) as n, 61.0::double - sum(n*y)/sum(n) as d from area0), area as (select domain, y + d as y, vardir, x, area0.n / t.n * vardir as z from area0, t), " + sql.fay_herriot_many(["x", "z"]) + "select domain, round(eblup, 5) as eblup, round(mse, 4) as mse from est")
def fh_selfbench_target(spark, sf_dir):
    fit, _ = fh.self_benchmarked(tables.area_lag(spark, sf_dir), "y", "vardir", ["x"], weight="n", target=61.0)
    return rounded(fit.estimates.select("domain", "eblup", "mse"), eblup=5, mse=4)


_TIERS = "case when rse <= 25 then 'reliable' when rse <= 50 then 'caution' when rse > 50 then 'unreliable' end"


@query(sql.LAG_FH + f"select domain, {_TIERS} as reliability, (eblup >= 55)::int + (eblup >= 60)::int + (eblup >= 65)::int as est_class from (select *, 100 * sqrt(mse) / abs(eblup) as rse from est)")
def reliability_tiers(spark, sf_dir):
    fit = _lag_fit(spark, sf_dir)[1]
    return compare.add_reliability_flags(fit.estimates, estimate="eblup", bounds=[55.0, 60.0, 65.0]).select("domain", "reliability", "est_class")


_GVF = "with {area}, f0 as (select covar_pop(ln({t}), ln(n)) / var_pop(ln(n)) b, avg(ln({t})) mt, avg(ln(n)) mu from area where vardir > 0), f as (select b, mt - b * mu as a from f0), r as (select sum((ln({t}) - a - b*ln(n))**2) / (count(*) - 2) s2 from area, f where vardir > 0) select domain, round(exp(a + b*ln(n)) * exp(s2/2) * {m}, 6) as vardir_smooth from area, f, r"


def _gvf(spark, sf_dir, method):
    area = tables.area_lag(spark, sf_dir)
    smooth, _ = prep.gvf_smooth(area, "n" if method != "cv_power" else "y", "vardir", method=method)
    return rounded(smooth.select("domain", "vardir_smooth"), vardir_smooth=6)


@query(_GVF.format(area=sql.AREA_LAG, t="vardir", m="1"))
def gvf_loglinear(spark, sf_dir):
    return _gvf(spark, sf_dir, "log_linear")


@query(_GVF.format(area=sql.AREA_LAG, t="(vardir/(y*y))", m="y*y").replace("ln(n)", "ln(case when y > 0 then y end)").replace("vardir > 0", "vardir > 0 and y > 0"))
def gvf_cvpower(spark, sf_dir):
    return _gvf(spark, sf_dir, "cv_power")


_GAMMA = f"""with recursive {sql.AREA_LAG}, g as (select vardir as v, ln(n) as x from area where vardir > 0), c as (select avg(x) as mx from g),
it(k, a, b) as (select 0, avg(ln(v)) - regr_slope(ln(v), x - mx) * 0, regr_slope(ln(v), x - mx) from g, c
  union all select k + 1, a + avg(r) - regr_slope(r, z) * avg(z), b + regr_slope(r, z) from (select k, a, b, v / exp(a + b * (x - mx)) - 1 as r, x - mx as z from it, g, c where k < 80) group by k, a, b),
f as (select a, b, mx from it, c order by k desc limit 1)
select domain, round(case when vardir = 0 then 0 else exp(a + b * (ln(n) - mx)) end, 6) as vardir_smooth from area, f"""


@query(_GAMMA)
def gvf_gamma(spark, sf_dir):
    return _gvf(spark, sf_dir, "gamma_glm")


_DEFF = f"""with {sql.SHARE}, q as (select domain, region, n, y, vardir * (1 + domain % 3) as vardir, y*(1-y)/n as srs from prop),
p as (select *, sum(vardir) over (partition by region) / sum(srs) over (partition by region) as pooled from q) """


def _deff_table(spark, sf_dir):
    return tables.area_share(spark, sf_dir).withColumn("vardir", F.col("vardir") * (1 + F.col("domain") % 3))


@query(_DEFF + "select domain, round(greatest(pooled, 1), 6) as deff, 'group' as deff_source, round(n / greatest(pooled, 1), 5) as trials from p")
def effective_trials_pooled(spark, sf_dir):
    return rounded(prep.effective_trials(_deff_table(spark, sf_dir), "y", "vardir", "n", "region").select("domain", "deff", "deff_source", "trials"), deff=6, trials=5)


@query(_DEFF + "select domain, round(greatest(vardir / srs, 1), 6) as deff, 'area' as deff_source, round(n / greatest(vardir / srs, 1), 5) as trials from p")
def effective_trials_area(spark, sf_dir):
    return rounded(prep.effective_trials(_deff_table(spark, sf_dir), "y", "vardir", "n", "region", method="area").select("domain", "deff", "deff_source", "trials"), deff=6, trials=5)


def _region_edges(spark, sf_dir):
    return weights.styled(weights.same_group(tables.read(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey"), "W")


@query(f"with {sql.REGION_EDGES} select src, dst, w from edges")
def weights_region(spark, sf_dir):
    return _region_edges(spark, sf_dir)


def _ring_edges(spark, sf_dir):
    return weights.styled(weights.ring(tables.read(spark, sf_dir, "nation"), "n_nationkey"), "W")


@query("select n_nationkey as src, (n_nationkey + s) % 25 as dst, 0.5::double as w from nation, (values (1), (24)) t(s)")
def weights_ring(spark, sf_dir):
    return _ring_edges(spark, sf_dir)


_GRID = "g as (select n_nationkey as k, n_nationkey // 5 as r, n_nationkey % 5 as c from nation), e as (select a.k as src, b.k as dst from g a join g b on abs(a.r - b.r) + abs(a.c - b.c) = 1)"


def _grid(spark, sf_dir):
    k = F.col("n_nationkey")
    areas = tables.read(spark, sf_dir, "nation").select(k.alias("k"), F.floor(k / 5).cast("int").alias("r"), (k % 5).cast("int").alias("c"))
    return weights.grid(areas, "k", "r", "c")


@query(f"with {_GRID} select src, dst, 1.0::double as w from e")
def weights_rook(spark, sf_dir):
    return _grid(spark, sf_dir)


@query("with g as (select n_nationkey as k, n_nationkey // 5 as r, n_nationkey % 5 as c from nation) select a.k as src, b.k as dst, round(1.0::double * 25 / 144, 10) as w from g a join g b on greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1")
def weights_queen_c(spark, sf_dir):
    k = F.col("n_nationkey")
    areas = tables.read(spark, sf_dir, "nation").select(k.alias("k"), F.floor(k / 5).cast("int").alias("r"), (k % 5).cast("int").alias("c"))
    return rounded(weights.styled(weights.grid(areas, "k", "r", "c", queen=True), "C"), w=10)


@query(f"with {_GRID} select src, dst, round(1.0::double / (select count(*) from e), 10) as w from e")
def weights_u(spark, sf_dir):
    return rounded(weights.styled(_grid(spark, sf_dir), "U"), w=10)


@query(f"with {_GRID} select src, dst, round(1.0::double / (4 * cos(pi() / 6)), 8) as w from e")
def weights_minmax(spark, sf_dir):
    return rounded(weights.styled(_grid(spark, sf_dir), "minmax"), w=8)


@query("with recursive pts as (select n_nationkey as k, (n_nationkey * 7 % 11)::double as a, (n_nationkey * 5 % 13)::double as b from nation), d as (select s.k as src, t.k as dst, sqrt((s.a-t.a)**2 + (s.b-t.b)**2) as d from pts s join pts t on s.k <> t.k), e as (select src, dst from d where d <= 2.5), near as (select src, arg_min(dst, (d, dst)) as dst from d where src not in (select src from e) group by src) select distinct src, dst, 1.0::double as w from (select * from e union all select * from near union all select dst, src from near)")
def weights_islands(spark, sf_dir):
    points = _points(spark, sf_dir)
    return weights.islands_joined(weights.distance(points, "k", ["a", "b"], 2.5), points, "k", ["a", "b"])


@query("select a.n_nationkey as src, b.n_nationkey as dst, 1.0::double as w from nation a join nation b on abs(a.n_nationkey - b.n_nationkey) = 7")
def weights_symmetric(spark, sf_dir):
    """One-way neighbours seven keys on, made mutual."""
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    listed = n.withColumn("near", F.when(F.col("k") + 7 < 25, F.array(F.col("k") + 7)))
    return weights.symmetric(weights.from_neighbours(listed, "k", "near"))


@query("select n_nationkey as k, n_nationkey % 7 as component from nation")
def weights_components(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    listed = n.withColumn("near", F.when(F.col("k") + 7 < 25, F.array(F.col("k") + 7)))
    return weights.components(weights.from_neighbours(listed, "k", "near"), n, "k")


_POINTS = "pts as (select n_nationkey as k, (n_nationkey * 7 % 11)::double as a, (n_nationkey * 5 % 13)::double as b from nation), d as (select s.k as src, t.k as dst, sqrt((s.a-t.a)**2 + (s.b-t.b)**2) as d from pts s join pts t on s.k <> t.k)"


def _points(spark, sf_dir):
    k = F.col("n_nationkey")
    return tables.read(spark, sf_dir, "nation").select(k.alias("k"), (k * 7 % 11).cast("double").alias("a"), (k * 5 % 13).cast("double").alias("b"))


@query(f"with {_POINTS} select src, dst, 0.25::double as w from (select *, row_number() over (partition by src order by d, dst) as r from d) where r <= 4")
def weights_knn(spark, sf_dir):
    return weights.styled(weights.knn(_points(spark, sf_dir), "k", ["a", "b"], 4), "W")


@query(f"with {_POINTS} select src, dst, 1.0::double as w from d where d <= 1.001 * (select max(m) from (select min(d) m from d group by src))")
def weights_distance(spark, sf_dir):
    return weights.distance(_points(spark, sf_dir), "k", ["a", "b"])


@query(f"with {_POINTS} select src, dst, round(1 / d, 8) as w from d where d > 0 and d <= 5")
def weights_idw(spark, sf_dir):
    return rounded(weights.idw(_points(spark, sf_dir), "k", ["a", "b"], 1.0, 5.0), w=8)


def _moran(df: DataFrame) -> DataFrame:
    return rounded(df, moran_i=6, expected=6, variance=6, z=5)


@query(f"with {sql.AREA_LAG}, {sql.REGION_EDGES}," + sql.moran("z0 as (select domain as k, y as v from area)"))
def moran_y(spark, sf_dir):
    return _moran(spatial.moran(tables.area_lag(spark, sf_dir), _region_edges(spark, sf_dir)))


_LINE = "ln0 as (select regr_slope(y, x) b, regr_intercept(y, x) a from area)"


@query(f"with {sql.AREA_LAG}, {sql.REGION_EDGES}, {_LINE}," + sql.moran("z0 as (select domain as k, y - a - b*x as v from area, ln0)"))
def moran_resid(spark, sf_dir):
    return _moran(spatial.moran(spatial.ols_residuals(tables.area_lag(spark, sf_dir), "domain", "y", "x"), _region_edges(spark, sf_dir), value="e"))


_LM = f"""with {sql.AREA_LAG}, {sql.REGION_EDGES}, {_LINE}, r as (select domain as k, y, x, y - a - b*x as e, a + b*x as f from area, ln0),
c as (select sum(w*i.e*j.e) ewe, sum(w*i.e*j.y) ewy from edges join r i on i.k = src join r j on j.k = dst), t as (select sum(w*w*2) t from edges),
l as (select i.k, any_value(i.x) x, sum(w*j.f) wf from edges join r i on i.k = src join r j on j.k = dst group by i.k),
g as (select regr_syy(wf, x) - regr_sxy(wf, x)**2 / regr_sxx(wf, x) m from l), s as (select sum(e*e)/count(*) s2 from r)
select round((ewe/s2)**2/t, 5) as lm_error, round((ewy/s2)**2/(t + m/s2), 5) as lm_lag from c, t, g, s"""


@query(_LM)
def lm_tests(spark, sf_dir):
    return rounded(spatial.lagrange(tables.area_lag(spark, sf_dir), _region_edges(spark, sf_dir)), lm_error=5, lm_lag=5)


_BENCH = sql.LAG_FH + """, t as (select region, sum(n*y)/sum(n) + 1 as target from area group by region),
b as (select est.*, n / sum(n) over (partition by region) as w, target, s2 * coalesce(bb, 1) as g1, coalesce(bb, 1) as ra, coalesce(bb, 1) * (x - mx) as rb from est join t using (region)),
d as (select *, sqrt(greatest(g1 + q00*ra*ra + 2*q01*ra*rb + q11*rb*rb, 2.220446049250313e-16)) as d from b),
e as (select *, sqrt(mse) * w / d as v from d),
u as (select *, sum(ra*v) over (partition by region) as sa, sum(rb*v) over (partition by region) as sb from e),
o as (select *, sqrt(mse) / d * (g1*v + ra*(q00*sa + q01*sb) + rb*(q01*sa + q11*sb)) as mw, sum(w*eblup) over (partition by region) as own, sum(w*w*greatest(mse, 1e-8)) over (partition by region) as sm from u),
k as (select *, {new} as new, {k} as kk from o)
select domain, region, round(eblup, 5) as original, round(new, 5) as benchmarked, round(target, 5) as target, round(greatest(mse - 2*kk*mw + (new-eblup)**2, 0), 4) as mse_benchmarked from k"""


def _bench(spark, sf_dir, method):
    area, fit = _lag_fit(spark, sf_dir)
    rows = fit.estimates.join(area.select("domain", "region", "n"), "domain")
    target = area.groupBy("region").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n") + 1).alias("target"))
    out = benchmark(rows, "eblup", target, "n", "region", method, mse="mse", fit=fit)
    return rounded(out.select("domain", "region", "original", "benchmarked", "target", "mse_benchmarked"), original=5, benchmarked=5, target=5, mse_benchmarked=4)


@query(_BENCH.format(new="eblup*target/own", k="eblup/own"))
def bench_ratio(spark, sf_dir):
    return _bench(spark, sf_dir, "ratio")


@query(_BENCH.format(new="eblup + target - own", k="1.0"))
def bench_difference(spark, sf_dir):
    return _bench(spark, sf_dir, "difference")


@query(_BENCH.format(new="eblup + w*greatest(mse,1e-8)*(target-own)/sm", k="w*greatest(mse,1e-8)/sm"))
def bench_optimal(spark, sf_dir):
    return _bench(spark, sf_dir, "optimal")


_LOGIT = f"""with recursive {sql.SHARE}, r as (select domain, region, n, y from prop where y > 0 and y < 1),
t as (select region, sum(n * y) / sum(n) * 1.05 as target from r group by region), w as (select r.*, n / sum(n) over (partition by region) as w, ln(y / (1 - y)) as l from r),
it(k, region, lo, hi) as (select 0, region, -50.0::double, 50.0::double from t
  union all select k + 1, region, case when s < target then (lo + hi) / 2 else lo end, case when s < target then hi else (lo + hi) / 2 end
  from (select k, region, lo, hi, any_value(target) as target, sum(w / (1 + exp(-(l + (lo + hi) / 2)))) as s from it join w using (region) join t using (region) where k < 70 group by k, region, lo, hi)),
a as (select region, (lo + hi) / 2 as a from it where k = 70)
select domain, region, round(y, 8) as original, round(1 / (1 + exp(-(l + a))), 8) as benchmarked, round(target, 8) as target from w join a using (region) join t using (region)"""


@query(_LOGIT)
def bench_logit(spark, sf_dir):
    rows = tables.area_share(spark, sf_dir).where("y > 0 and y < 1")
    target = rows.groupBy("region").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n") * 1.05).alias("target"))
    out = benchmark(rows, "y", target, "n", "region", "logit", mse="vardir")
    return rounded(out.select("domain", "region", "original", "benchmarked", "target"), original=8, benchmarked=8, target=8)


_HIER = sql.LAG_FH + """, b as (select est.*, n / sum(n) over (partition by region) as w from est),
g as (select region, sum(n) as size, sum(w*eblup) as own, sum(w*w*greatest(mse, 1e-8)) as gm from b group by region),
h as (select *, size / sum(size) over () as share from g), h2 as (select *, sum(share*own) over () as agg, sum(share*share*gm) over () as sg from h),
m as (select region, own, {move} as target, gm from h2)
select domain, region, round(target, 5) as target, round({new}, 5) as benchmarked from b join m using (region)"""


def _hier(spark, sf_dir, method):
    out = benchmark(_with_region(spark, sf_dir), "eblup", None, "n", "region", method, mse="mse", national_target=61.0)
    return rounded(out.select("domain", "region", "target", "benchmarked"), target=5, benchmarked=5)


@query(_HIER.format(move="own * 61.0 / agg", new="eblup*target/own"))
def bench_hier_ratio(spark, sf_dir):
    return _hier(spark, sf_dir, "ratio")


@query(_HIER.format(move="own + 61.0 - agg", new="eblup + target - own"))
def bench_hier_difference(spark, sf_dir):
    return _hier(spark, sf_dir, "difference")


@query(_HIER.format(move="own + share*greatest(gm,1e-8)*(61.0-agg)/sg", new="eblup + w*greatest(mse,1e-8)*(target-own)/gm"))
def bench_hier_optimal(spark, sf_dir):
    return _hier(spark, sf_dir, "optimal")


_PAIR = sql.LAG_FH + ", pair as (select domain, y as e1, vardir as m1, eblup as e2, mse as m2 from est)"


def _both(spark, sf_dir):
    e = _lag_fit(spark, sf_dir)[1].estimates
    return compare.joined(e.select("domain", F.col("y").alias("est"), F.col("vardir").alias("mse")), e.select("domain", F.col("eblup").alias("est"), "mse"), ["domain"])


@query(_PAIR + """, r as (select *, rank() over (order by e1 desc) + (count(*) over (partition by e1) - 1)/2.0 as r1, rank() over (order by e2 desc) + (count(*) over (partition by e2) - 1)/2.0 as r2 from pair)
select domain::varchar as domain, round(e2-e1, 5) as diff, round((e2-e1)/sqrt(m1), 5) as z_diff, round(m1/m2, 5) as mse_ratio, r1::double as rank_1, r2::double as rank_2 from r""")
def compare_rows(spark, sf_dir):
    out = compare.compare_rows(_both(spark, sf_dir), ["domain"])
    return rounded(out.select("domain", "diff", "z_diff", "mse_ratio", "rank_1", "rank_2"), diff=5, z_diff=5, mse_ratio=5)


@query(_PAIR + """, r as (select *, rank() over (order by e1 desc)::double as r1, rank() over (order by e2 desc)::double as r2, e2 - e1 as d from pair)
select count(*) as n, round(avg(d),5) as mean_diff, round(stddev_samp(d),5) as sd_diff, round(avg(abs(d)),5) as mae, round(sqrt(avg(d*d)),5) as rmsd,
 round(2*covar_pop(e1,e2)/(var_pop(e1)+var_pop(e2)+(avg(e1)-avg(e2))**2),5) as ccc, round(corr(r1,r2),5) as spearman from r""")
def compare_metrics(spark, sf_dir):
    out = compare.compare_metrics(_both(spark, sf_dir)).select("n", "mean_diff", "sd_diff", "mae", "rmsd", "ccc", "spearman")
    return rounded(out, mean_diff=5, sd_diff=5, mae=5, rmsd=5, ccc=5, spearman=5)


@query(_PAIR + """, r as (select greatest(1, round(0.2*count(*) over ()))::int as k, row_number() over (order by e1 desc, domain::varchar) t1, row_number() over (order by e2 desc, domain::varchar) t2, row_number() over (order by e1, domain::varchar) b1, row_number() over (order by e2, domain::varchar) b2 from pair)
select max(k) as k, count(*) filter (t1<=k and t2<=k) as top_overlap, count(*) filter (b1<=k and b2<=k) as bottom_overlap from r""")
def top_overlap(spark, sf_dir):
    return compare.top_overlap(_both(spark, sf_dir), "domain", 0.2)


@query(sql.LAG_FH + """, r as (select *, 100*sqrt(mse)/abs(eblup) as rse, 100*sqrt(vardir)/abs(y) as dr from est)
select count(*) as n, round(avg(rse),4) as rse_mean, round(quantile_cont(rse,0.25),4) as rse_q1, round(median(rse),4) as rse_median, round(quantile_cont(rse,0.75),4) as rse_q3, round(max(rse),4) as rse_max, round(avg(case when rse<=25 then 1.0 else 0.0 end)::double,6) as share_reliable, round(avg(1-rse/dr),5) as mean_gain from r""")
def diagnose_precision(spark, sf_dir):
    return rounded(compare.precision_summary(_lag_fit(spark, sf_dir)[1].estimates), rse_mean=4, rse_q1=4, rse_median=4, rse_q3=4, rse_max=4, share_reliable=6, mean_gain=5)


@query(sql.LAG_FH + "select count(*) as m, round(sum((y-eblup)**2/(vardir+mse)),5) as w, round(regr_slope(y,eblup),5) as slope, round(regr_intercept(y,eblup),4) as intercept, round(regr_r2(y,eblup),5) as r2 from est")
def brown(spark, sf_dir):
    return rounded(compare.brown(_lag_fit(spark, sf_dir)[1].estimates), w=5, slope=5, intercept=4, r2=5)


def _units(spark, sf_dir):
    o, c = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("domain"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("c_acctbal") / 1000).alias("x"))


_UNITS = "s as (select c_nationkey as domain, o_totalprice/1000 as y, c_acctbal/1000 as x from orders join customer on o_custkey = c_custkey)"


@query(f"with {_UNITS} select domain, count(*) as n, round(avg(y),6) as y_mean, round(avg(x),6) as x_mean from s group by domain")
def bhf_suffstats(spark, sf_dir):
    stats, _ = bhf.domain_statistics(_units(spark, sf_dir), "domain", "y", ["x"])
    return rounded(stats.select("domain", "n", "y_mean", F.col("x_mean")[0].alias("x_mean")), y_mean=6, x_mean=6)


def _survey(spark, sf_dir):
    """Suppliers are the units, with a planted area effect; all customers are the population, whose balances are known on average."""
    s, c = tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "customer")
    units = s.select(F.col("s_nationkey").alias("domain"), (F.col("s_acctbal") / 1000).alias("x"), (2 + 0.3 * F.col("s_acctbal") / 1000 + 1.5 * F.sin(F.col("s_nationkey").cast("double")) + (F.col("s_suppkey") % 7) / 7.0).alias("y"))
    pop = c.groupBy(F.col("c_nationkey").alias("domain")).agg((F.count("*") * 10).alias("pop_n"), F.avg(F.col("c_acctbal") / 1000).alias("x"))
    # nations with suppliers but no customer belong to the population as well
    more = units.groupBy("domain").agg((F.count("*") * 10).alias("pop_n"), F.avg("x").alias("x")).join(pop, "domain", "left_anti")
    return units, pop.unionByName(more)


_BHF = """with recursive s as (select s_nationkey as domain, s_acctbal/1000 as x, 2 + 0.3*s_acctbal/1000 + 1.5*sin(s_nationkey::double) + (s_suppkey % 7) / 7.0::double as y from supplier),
p0 as (select c_nationkey as domain, count(*) * 10 as pop_n, avg(c_acctbal / 1000) as x from customer group by c_nationkey),
p as (select * from p0 union all select domain, count(*) * 10, avg(x) from s where domain not in (select domain from p0) group by domain),
m as (select avg(x) as mx, avg(y) as my, count(*) as n from s),
d as (select domain, count(*)::double as n, avg(x) - any_value(mx) as x, avg(y) - any_value(my) as y, covar_pop(x, x) * count(*) as wxx, covar_pop(x, y) * count(*) as wxy, covar_pop(y, y) * count(*) as wyy from s, (select mx, my from m) group by domain),
w as (select sum(wxx) as txx, sum(wxy) as txy, sum(wyy) as tyy from d),
it(k, lo, hi) as (
  select 0, ln(1e-8), ln(1e8)
  union all
  select k + 1, greatest(lo, best - step), least(hi, best + step) from (
    select k, lo, hi, step, arg_max(e, ll) as best from (
      select k, lo, hi, step, e, -0.5 * ((any_value(m.n) - 2) * ln(any_value(tyy) + sum(g*y*y) - (b0*sum(g*y) + b1*(any_value(txy) + sum(g*x*y)))) + sum(ln(1 + d.n*exp(e))) + ln(det)) as ll from (
        select *, (axx*cy - ax*cxy) / det as b0, (a*cxy - ax*cy) / det as b1 from (
          select *, a*axx - ax*ax as det from (
            select k, lo, hi, step, e, sum(g) as a, sum(g*x) as ax, any_value(txx) + sum(g*x*x) as axx, sum(g*y) as cy, any_value(txy) + sum(g*x*y) as cxy, list({'n': d.n, 'g': g, 'x': x, 'y': y}) as rows from (
              select it.k, it.lo, it.hi, (it.hi - it.lo) / 64 as step, it.lo + (it.hi - it.lo) * i / 64 as e, d.*, d.n / (1 + d.n * exp(it.lo + (it.hi - it.lo) * i / 64)) as g from it, range(0, 65) r(i), d where it.k < 14) d, (select txx, txy from w) group by k, lo, hi, step, e))) z, (select unnest(z.rows) as u), (select u.n as n, u.g as g, u.x as x, u.y as y) d, (select txy, tyy from w), m
      group by k, lo, hi, step, e, b0, b1, det) group by k, lo, hi, step)),
f as (select exp((lo + hi) / 2) as gamma from it order by k desc limit 1),
c as (select gamma, (axx*cy - ax*cxy) / (a*axx - ax*ax) as b0, (a*cxy - ax*cy) / (a*axx - ax*ax) as b1 from (select any_value(gamma) as gamma, sum(g) as a, sum(g*x) as ax, any_value(txx) + sum(g*x*x) as axx, sum(g*y) as cy, any_value(txy) + sum(g*x*y) as cxy from (select gamma, d.x, d.y, n / (1 + n*gamma) as g from d, f), (select txx, txy from w)))
select p.domain, round(my + b0 + b1*(p.x - mx) + coalesce(d.n / p.pop_n * (d.y - b0 - b1*d.x) + (1 - d.n / p.pop_n) * gamma * d.n / (1 + d.n*gamma) * (d.y - b0 - b1*d.x), 0), 5) as eblup, coalesce(d.n, 0)::bigint as samp_size from p left join d on d.domain = p.domain, c, (select mx, my from m)"""


@query(_BHF)
def bhf_eblup(spark, sf_dir):
    units, pop = _survey(spark, sf_dir)
    return rounded(bhf.fit(units, pop, "domain", "y", ["x"]).estimates.select("domain", "eblup", "samp_size"), eblup=5)


@query()
def bhf_bootstrap(spark, sf_dir):
    units, pop = _survey(spark, sf_dir)
    return bhf.fit(units, pop, "domain", "y", ["x"], mse_type="bootstrap", replicates=60).estimates.select("domain", "eblup", "mse", "rse")


@query()
def sfh_eblup(spark, sf_dir):
    return area_models.spatial(_unsampled(spark, sf_dir), _region_edges(spark, sf_dir), "y", "vardir", ["x"]).estimates


@query()
def sfh_bootstrap(spark, sf_dir):
    fit = area_models.spatial(tables.area_planted(spark, sf_dir), _ring_edges(spark, sf_dir), "y", "vardir", ["x"], mse_type="pbmse", replicates=40)
    return fit.estimates.select("domain", "mse", "mse_pb", "mse_pbbc")


@query()
def sfh_resampled(spark, sf_dir):
    fit = area_models.spatial(tables.area_planted(spark, sf_dir), _ring_edges(spark, sf_dir), "y", "vardir", ["x"], mse_type="npbmse", replicates=40)
    return fit.estimates.select("domain", "mse", "mse_npb", "mse_npbbc")


def _panel(spark, sf_dir):
    c, o = tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "orders")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("domain"), F.year("o_orderdate").alias("time"), (F.col("o_totalprice") / 1000).alias("p"), F.col("c_acctbal"))
    return rows.groupBy("domain", "time").agg((F.avg("p") + 40 * F.sin(F.col("domain").cast("double"))).alias("y"), (F.var_samp("p") / F.count("*")).alias("vardir"), (F.avg("c_acctbal") / 1000).alias("x")).where("vardir > 0")


@query()
def stfh_eblup(spark, sf_dir):
    return area_models.spatio_temporal(_panel(spark, sf_dir), _region_edges(spark, sf_dir), "y", "vardir", ["x"]).estimates


def _two_fold(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    b = F.col("c_acctbal") / 1000
    rows = c.groupBy(F.col("c_nationkey").alias("domain"), F.col("c_mktsegment").alias("subarea")).agg((F.avg(b) + 1.5 * F.sin(F.col("c_nationkey").cast("double"))).alias("y"), (F.var_samp(b) / F.count("*")).alias("vardir"), F.count("*").alias("n"), F.avg(F.col("c_custkey") % 7).cast("double").alias("x"))
    return rows.where("vardir > 0")


@query()
def stfh_bootstrap(spark, sf_dir):
    fit = area_models.spatio_temporal(_panel(spark, sf_dir), _region_edges(spark, sf_dir), "y", "vardir", ["x"], model="S", mse_type="bootstrap", replicates=16)
    return fit.estimates.select("domain", "time", "eblup", "mse")


@query()
def twofold_sub(spark, sf_dir):
    return area_models.two_fold(_two_fold(spark, sf_dir), "y", "vardir", ["x"]).estimates


@query()
def twofold_area(spark, sf_dir):
    return area_models.two_fold(_two_fold(spark, sf_dir), "y", "vardir", ["x"], weight="n").df_area


@query()
def twofold_bootstrap(spark, sf_dir):
    return area_models.two_fold(_two_fold(spark, sf_dir), "y", "vardir", ["x"], weight="n", mse_type="bootstrap", replicates=40).df_area


_STEP = f"with recursive {sql.AREA_LAG.replace('area as', 'area0 as')}, area as (select *, sin(domain::double) as k from area0)" + "".join("," + sql.fay_herriot_many(c, "ML", p) for c, p in ((["x", "k"], "a3_"), (["x"], "a1_"), (["k"], "a2_"), ([], "a0_"))) + """,
models as (select 3 as mask, aic from a3_aic union all select 1, aic from a1_aic union all select 2, aic from a2_aic union all select 0, aic from a0_aic),
moves as (select a.mask as src, case when (a.mask // bit) % 2 = 1 then '- ' else '+ ' end || name as action, case when (a.mask // bit) % 2 = 1 then a.mask - bit else a.mask + bit end as dst from models a, (values (1, 'x'), (2, 'k')) t(bit, name)),
path(step, mask, action, aic) as (
  select 0, 3, 'start', (select aic from models where mask = 3)
  union all
  select step + 1, best.dst, best.action, best.aic from (select step, aic, arg_min({'dst': dst, 'action': act, 'aic': value}, (value, act)) as best from (
    select p.step, p.aic, m.dst, m.action as act, n.aic as value from path p join moves m on m.src = p.mask join models n on n.mask = m.dst) group by step, aic) where best.aic < aic)
select step, action, round(aic, 5) as aic from path"""


@query(_STEP)
def step_fh(spark, sf_dir):
    area = tables.area_lag(spark, sf_dir).withColumn("k", F.sin(F.col("domain").cast("double")))
    _, path = stepwise.step(area, "y", "vardir", ["x", "k"])
    return spark.createDataFrame([(i, a, round(float(v), 5)) for i, (a, v) in enumerate(path)], "step int, action string, aic double")


@query()
def spatial_decision(spark, sf_dir):
    found = spatial.spatial_test(tables.area_planted(spark, sf_dir), _ring_edges(spark, sf_dir), vardir="vardir")
    return spark.createDataFrame([(k, float(found[k]["statistic"]), float(found[k]["pvalue"])) for k in ("moran_y", "moran_residuals", "lm_error", "lm_lag", "lrt")] + [(f"decision: {found['decision']['model']}", None, None)], "test string, statistic double, pvalue double")


@query(sql.LAG_FH + """select domain, round(y - eblup, 5) as residual, round(case when vardir > mse then (y - eblup) / sqrt(vardir - mse) end, 5) as std_residual, round(vardir / mse, 5) as eff_ratio from est""")
def diagnose_residuals(spark, sf_dir):
    return rounded(compare.residual_table(_lag_fit(spark, sf_dir)[1].estimates).select("domain", "residual", "std_residual", "eff_ratio"), residual=5, std_residual=5, eff_ratio=5)


@query(sql.LAG_FH + """select round(avg(100*(eblup-y)/y), 5) as mean_rb, round(avg(abs(100*(eblup-y)/y)), 5) as mean_abs_rb, round(100*sqrt(avg((eblup-y)**2))/avg(abs(y)), 5) as rrmse from est""")
def diagnose_simulation(spark, sf_dir):
    area, fit = _lag_fit(spark, sf_dir)
    return rounded(compare.simulation_metrics(fit.estimates, area.select("domain", F.col("y").alias("truth"))).select("mean_rb", "mean_abs_rb", "rrmse"), mean_rb=5, mean_abs_rb=5, rrmse=5)


@query()
def class_probability(spark, sf_dir):
    return compare.class_probabilities(_lag_fit(spark, sf_dir)[1].estimates, [55.0, 60.0, 65.0]).select("domain", "est_class", "prob_class")


@query(sql.LAG_FH + """, e as (select *, sqrt(mse) as se from est) select domain, round(eblup, 5) as eblup, round(eblup - 1.96*se, 5) as ci_lower, round(eblup + 1.96*se, 5) as ci_upper, case when 100*se/abs(eblup) <= 25 then 'reliable' when 100*se/abs(eblup) <= 50 then 'caution' else 'unreliable' end as reliability from e""")
def export_estimates(spark, sf_dir):
    sheet = report.sheets(_lag_fit(spark, sf_dir)[1])["Estimates"]
    return sheet.select("domain", "eblup", "ci_lower", "ci_upper", "reliability")


@query(sql.LAG_FH + """select n_name, indicator, round(case indicator when 'estimate' then eblup else 100*sqrt(mse)/abs(eblup) end, 4) as value from nation join est on domain = n_nationkey, (values ('estimate'), ('rse')) t(indicator)""")
def map_estimates(spark, sf_dir):
    estimates = _lag_fit(spark, sf_dir)[1].estimates
    table = report.map_table(tables.read(spark, sf_dir, "nation"), estimates, {"estimate": F.col("eblup"), "rse": F.col("rse")}, "n_nationkey")
    return rounded(table.select("n_name", "indicator", "value"), value=4)


@query(sql.LAG_FH + """select domain, series, round(value, 4) as value, round(low, 4) as low, round(high, 4) as high from (select domain, 'direct' as series, y as value, y - 1.96*sqrt(vardir) as low, y + 1.96*sqrt(vardir) as high from est union all select domain, 'model', eblup, eblup - 1.96*sqrt(mse), eblup + 1.96*sqrt(mse) from est)""")
def plot_ribbon(spark, sf_dir):
    return rounded(report.ribbon_table(_lag_fit(spark, sf_dir)[1].estimates), value=4, low=4, high=4)


@query("with c as (select c_nationkey % 4 as grp, floor((c_custkey % 100) / 100.0 * 5)::int as bin from customer) select g.i::int as grp, b.j::int as bin, count(c.grp) as n from range(4) g(i) cross join range(5) b(j) left join c on c.grp = g.i and c.bin = b.j group by all")
def plot_rank(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return report.rank_table(c.select((F.col("c_nationkey") % 4).alias("grp"), ((F.col("c_custkey") % 100) / 100.0).alias("value")), 5, 4)


_HB = f"""with recursive {sql.AREA_LAG}, sc as (select stddev_samp(y) as sc from area), g as (select exp(ln(sc) - 9 + 12.0 * i / 3000) as s, ln(sc) - 9 + 12.0 * i / 3000 as t, sc from range(0, 3001) r(i), sc),
v as (select g.s, g.t, g.sc, 1 / (vardir + g.s * g.s) as v, x, y, vardir from g, area),
m as (select s, any_value(t) as t, any_value(sc) as sc, 0.001 + sum(v) as a, sum(v*x) as ax, 0.001 + sum(v*x*x) as axx, sum(v*y) as cy, sum(v*x*y) as cxy, sum(v*y*y) as yy, sum(ln(v)) as lv from v group by s),
q as (select *, a*axx - ax*ax as det from m),
l as (select *, (axx*cy - ax*cxy) / det as b0, (a*cxy - ax*cy) / det as b1, 0.5*lv - 0.5*ln(det) - 0.5*(yy - (cy*(axx*cy - ax*cxy) + cxy*(a*cxy - ax*cy)) / det) - s*s / (2*sc*sc) + t as ll from q),
w as (select *, exp(ll - max(ll) over ()) as u from l), z as (select *, u / sum(u) over () as p from w),
e as (select domain, p, b0 + b1*x + s*s / (vardir + s*s) * (y - b0 - b1*x) as mu, vardir*s*s / (vardir + s*s) + (vardir / (vardir + s*s))**2 * (axx - 2*ax*x + a*x*x) / det as var from area, z)
select domain, round(sum(p*mu), 2) as hb, round(sqrt(sum(p*(var + mu*mu)) - sum(p*mu)**2), 2) as sd from e group by domain"""


@query(_HB)
def hb_gaussian(spark, sf_dir):
    found = hb.hb_area(tables.area_lag(spark, sf_dir), "y", ["x"], vardir="vardir")
    return rounded(found.estimates.select("domain", "hb", "sd"), hb=2, sd=2)


def _hb_columns(found):
    return found.estimates.select("domain", "hb", "sd", "ci_lower", "ci_upper")


@query()
def hb_besag(spark, sf_dir):
    return _hb_columns(hb.hb_area(tables.area_lag(spark, sf_dir), "y", ["x"], vardir="vardir", spatial="besag", edges=_region_edges(spark, sf_dir)))


@query()
def hb_bym2_binomial(spark, sf_dir):
    area = tables.area_share(spark, sf_dir).withColumn("cases", F.round(F.col("y") * F.col("n"))).withColumn("x", F.sin(F.col("domain").cast("double")))
    return _hb_columns(hb.hb_area(area, "cases", ["x"], family="binomial", trials="n", spatial="bym2", edges=_ring_edges(spark, sf_dir)))


@query()
def hb_beta(spark, sf_dir):
    area = tables.area_share(spark, sf_dir).where("y > 0 and y < 1").withColumn("x", F.sin(F.col("domain").cast("double")))
    return _hb_columns(hb.hb_area(area, "y", ["x"], family="beta", vardir="vardir"))


@query()
def hb_spacetime(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    found = hb.hb_area(panel, "y", ["x"], time="time", vardir="vardir", spatial="leroux", temporal="ar1", edges=_region_edges(spark, sf_dir))
    return found.estimates.select("domain", "time", "hb", "sd")


@query()
def hb_units(spark, sf_dir):
    units, pop = _survey(spark, sf_dir)
    return hb.hb_unit(units, pop, "domain", "y", ["x"], "pop_n").estimates.select("domain", "hb", "sd", "samp_size")


@query()
def hb_subareas(spark, sf_dir):
    return hb.hb_twofold(_two_fold(spark, sf_dir), "y", ["x"], vardir="vardir", weight="n").df_area


@query()
def hb_shares(spark, sf_dir):
    area = tables.area_share(spark, sf_dir).withColumns({"cases": F.round(F.col("y") * F.col("n")), "x": F.sin(F.col("domain").cast("double")), "parent": F.lit(0.4) + F.col("domain") / 100})
    return hb.hb_ratio(area, "cases", ["x"], "n", "parent", benchmark_target=0.11).estimates.select("domain", "hb", "sd", "ratio")


@query()
def hb_benchmarked(spark, sf_dir):
    found = hb.hb_area(tables.area_lag(spark, sf_dir), "y", ["x"], vardir="vardir", benchmark_weight="n", benchmark_target={"": 61.0})
    return _hb_columns(found)


@query()
def simulated_areas(spark, sf_dir):
    return simulate.area_data(spark)


@query()
def simulated_series(spark, sf_dir):
    return simulate.series_data(spark)


def entry(spark: SparkSession) -> DataFrame:
    """Fay-Herriot estimates by nation, with names."""
    sf_dir = "/root/testdata/sf0.001"
    names = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("domain"), F.col("n_name").alias("name"))
    return fh_eblup(spark, sf_dir).join(names, "domain")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
