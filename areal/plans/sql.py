"""SQL that says the same as the queries, for DuckDB."""

from __future__ import annotations

AREA_LAG = """
area as (
  select c_nationkey as domain, any_value(n_regionkey) as region, count(*) as n, avg(datediff('day', o_orderdate, l_shipdate))::double as y,
         var_samp(datediff('day', o_orderdate, l_shipdate)) / count(*) as vardir, avg(l_quantity) as x
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by c_nationkey)"""
UNSAMPLED = """
area as (select domain, region, n, case when domain % 5 = 0 then null else y end as y, vardir, x from full_area)"""


def planted(effect: float, shift: float = 0.0, log: bool = False) -> str:
    y = f"avg(c_acctbal / 1000) + {effect}::double * sin(c_nationkey::double) + {shift}::double"
    v = "var_samp(c_acctbal / 1000) / count(*)"
    if log:
        y, v = f"ln({y})", f"({v}) / ({y}) ** 2"
    return f"""
area as (select c_nationkey as domain, count(*) as n, any_value({y}) as y0, {y} as y, {v} as vardir, avg(case when c_mktsegment = 'BUILDING' then 1.0 else 0.0 end)::double as x
  from customer group by c_nationkey)""".replace(f"any_value({y}) as y0, ", "")


def fay_herriot(area: str, method: str = "REML") -> str:
    """Tables area (domain, y, vardir, x), fin (s2, iterations), co (coefficients) and fh (scored rows); one covariate."""
    if method == "REML":
        score = "-0.5 * (v1 - t2) + 0.5 * pp"
        info = "0.5 * (v2 - 2 * t3 + kk)"
        bias = "0"
    else:
        score, info, bias = "-0.5 * v1 + 0.5 * pp", "0.5 * v2", "b * bb * bb"
    sums = "sum(v) v1, sum(v*x) vx, sum(v*x*x) vxx, sum(v*y) vy, sum(v*x*y) vxy, sum(v*v) v2, sum(v*v*x) v2x, sum(v*v*x*x) v2xx, sum(v*v*y) v2y, sum(v*v*x*y) v2xy, sum(v*v*y*y) v2yy, sum(v*v*v) v3, sum(v*v*v*x) v3x, sum(v*v*v*x*x) v3xx"
    q = "vxx / (v1*vxx - vx*vx) q00, -vx / (v1*vxx - vx*vx) q01, v1 / (v1*vxx - vx*vx) q11"
    k = "q00*v2 + q01*v2x k00, q00*v2x + q01*v2xx k01, q01*v2 + q11*v2x k10, q01*v2x + q11*v2xx k11"
    pp = "v2yy - 2*b0*v2y - 2*b1*v2xy + b0*b0*v2 + 2*b0*b1*v2x + b1*b1*v2xx"
    return f"""with recursive {area},
mid as (select avg(x) mx, avg(y) my, median(vardir) m0, count(*) m from area where y is not null),
s as (select domain, y - my as y, vardir as psi, x - mx as x from area, mid where y is not null),
it(k, s2, diff) as (
  select 0, (select m0 from mid), 1.0::double
  union all
  select k + 1, s2n, abs(s2n - s2) / greatest(s2, 1e-12) from (
    select k, s2, case when s2 + sc / inf > 0 then s2 + sc / inf else 0.0 end as s2n from (
      select k, s2, {score} as sc, {info} as inf from (
        select *, k00 + k11 as t2, k00*k00 + 2*k01*k10 + k11*k11 as kk, q00*v3 + 2*q01*v3x + q11*v3xx as t3, {pp} as pp from (
          select *, {k}, q00*vy + q01*vxy as b0, q01*vy + q11*vxy as b1 from (
            select *, {q} from (
              select k, s2, {sums} from (select it.k, it.s2, s.*, 1.0 / (s.psi + it.s2) as v from it, s where it.k < 100 and it.diff > 1e-4) group by k, s2))))))),
fin as (select s2, k as n_iter from it order by k desc limit 1),
co as (select *, q00*vy + q01*vxy as b0, q01*vy + q11*vxy as b1, -(k00 + k11) / v2 as b from (select *, {k} from (select *, {q} from (select any_value(s2) s2, {sums} from (select s2, s.*, 1.0 / (s.psi + s2) as v from fin, s))))),
fh as (
  select a.*, my + b0 + b1 * (x - mx) as line, s2, case when y is not null then vardir / (vardir + s2) end as bb,
         q00 + 2*q01*(x - mx) + q11*(x - mx)*(x - mx) as xqx, v2, b, my, mx, b0, b1, q00, q01, q11
  from area a, mid, co),
est as (
  select *, case when y is not null then (1 - bb) * (y - line) end as random_effect, line + case when y is not null then (1 - bb) * (y - line) else 0 end as eblup,
         case when y is not null then vardir * (1 - bb) + bb*bb*xqx + 2*bb*bb*(2/v2)/(vardir + s2) - {bias} else s2 + xqx end as mse
  from fh)
"""


LAG_FH = fay_herriot(AREA_LAG)
ESTIMATE = "select domain, round(eblup, 5) as eblup, round(random_effect, 5) + 0.0 as random_effect, round(mse, 4) as mse, round(100 * sqrt(mse) / abs(eblup), 4) as rse from est"

SHARE = """
share as (select c_nationkey as domain, any_value(n_regionkey) as region, count(*) as n, avg(case when c_mktsegment = 'BUILDING' then 1.0 else 0.0 end)::double as y
  from customer join nation on c_nationkey = n_nationkey group by c_nationkey),
prop as (select *, y * (1 - y) / (n - 1) as vardir from share)"""

REGION_EDGES = """
edges as (select a.n_nationkey as src, b.n_nationkey as dst, 1.0::double / 4 as w from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)"""


def moran(values: str) -> str:
    """values: a CTE z0 (k, v)."""
    return f"""
{values}, z as (select k, v - (select avg(v) from z0) as z from z0),
e as (select src, dst, w, a.z zi, b.z zj from edges join z a on a.k = src join z b on b.k = dst),
p as (select sum(w) as s0, sum(w*zi*zj) as num from e),
p1 as (select sum((coalesce(a.w,0)+coalesce(b.w,0))**2)/2 as s1 from e a full join e b on a.src = b.dst and a.dst = b.src),
p2 as (select sum(t*t) as s2 from (select k, sum(w) t from (select src k, w from e union all select dst, w from e) group by k)),
mo as (select count(*)::double as n, sum(z*z) as zz, avg(z**4) / avg(z*z)**2 as b2 from z),
r as (select n, n/s0*num/zz as i, -1/(n-1) as ex, greatest((n*((n*n-3*n+3)*s1 - n*s2 + 3*s0*s0) - b2*((n*n-n)*s1 - 2*n*s2 + 6*s0*s0)) / ((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1)), 1e-10) as va from p, p1, p2, mo)
select n::bigint as n, round(i, 6) as moran_i, round(ex, 6) as expected, round(va, 6) as variance, round((i - ex) / sqrt(va), 5) as z from r"""


def _inverse(p: int, a: str, q: str) -> str:
    """Entries q_ij of the inverse of a symmetric matrix with entries a_ij, up to 3 x 3."""
    e = lambda i, j: f"{a}{min(i, j)}{max(i, j)}"
    if p == 1:
        return f"1 / {e(0, 0)} as {q}00"
    if p == 2:
        det = f"({e(0, 0)}*{e(1, 1)} - {e(0, 1)}*{e(0, 1)})"
        return f"{e(1, 1)}/{det} as {q}00, -{e(0, 1)}/{det} as {q}01, {e(0, 0)}/{det} as {q}11"

    def minor(i: int, j: int) -> str:
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        return f"({e(r[0], c[0])}*{e(r[1], c[1])} - {e(r[0], c[1])}*{e(r[1], c[0])})"

    det = f"({e(0, 0)}*{minor(0, 0)} - {e(0, 1)}*{minor(0, 1)} + {e(0, 2)}*{minor(0, 2)})"
    return ", ".join(f"{'-' if (i + j) % 2 else ''}{minor(i, j)}/{det} as {q}{i}{j}" for i in range(3) for j in range(i, 3))


def fay_herriot_many(columns: list[str], method: str = "REML", prefix: str = "") -> str:
    """CTEs <prefix>fin, co and est of a Fay-Herriot fit on up to two covariates of a table `area` (domain, y, vardir, ...); follows a recursive with clause."""
    p, n = len(columns) + 1, prefix
    x = ["1.0", *[f"x{i}" for i in range(1, p)]]
    pair = lambda name, i, j: f"{name}{min(i, j)}{max(i, j)}"
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = ", ".join([*[f"sum(v**{k}*{x[i]}*{x[j]}) as {'abc'[k - 1]}{i}{j}" for k in (1, 2, 3) for i, j in upper], *[f"sum(v*{x[i]}*y) as r{i}, sum(v*v*{x[i]}*y) as u{i}" for i in range(p)], "sum(v*v*y*y) as yy, sum(v) as v1, sum(v*v) as v2, sum(-ln(v)) as lv, sum(v*y*y) as vyy, count(*) as m"])
    beta = ", ".join(" + ".join(f"{pair('q', i, j)}*r{j}" for j in range(p)) + f" as b{i}" for i in range(p))
    prod = ", ".join(" + ".join(f"{pair('q', i, h)}*{pair('b_', h, j)}" for h in range(p)) + f" as k{i}_{j}" for i in range(p) for j in range(p)).replace("b_", "b")
    # entries of the second matrix are named b_ij, coefficients e_i
    beta = beta.replace(" as b", " as e")
    quad = "yy - 2*(" + " + ".join(f"e{i}*u{i}" for i in range(p)) + ") + " + " + ".join(f"e{i}*e{j}*{pair('b', i, j)}" for i in range(p) for j in range(p))
    t2 = " + ".join(f"k{i}_{i}" for i in range(p))
    t3 = " + ".join(f"{pair('q', i, j)}*{pair('c', i, j)}" for i in range(p) for j in range(p))
    kk = " + ".join(f"k{i}_{j}*k{j}_{i}" for i in range(p) for j in range(p))
    score, info = (f"0.5*(({quad}) - v1 + ({t2}))", f"0.5*(v2 - 2*({t3}) + ({kk}))") if method == "REML" else (f"0.5*(({quad}) - v1)", "0.5*v2")
    state = lambda src: f"select *, {prod} from (select *, {beta} from (select *, {_inverse(p, 'a', 'q')} from ({src})))"
    centre = ", ".join(f"avg({c}) as m{i}" for i, c in enumerate(columns, 1))
    shifted = ", ".join(f"{c} - m{i} as x{i}" for i, c in enumerate(columns, 1))
    lead, comma = (", " if columns else ""), (", " if columns else "")
    line = "my + e0" + "".join(f" + e{i}*x{i}" for i in range(1, p))
    xqx = " + ".join(f"{pair('q', i, j)}*{x[i]}*{x[j]}" for i in range(p) for j in range(p))
    ml = "" if method == "REML" else f" + ({t2})/v2*bb*bb"
    return f"""
{n}mid as (select avg(y) as my, median(vardir) as m0{comma}{centre} from area where y is not null),
{n}s as (select domain, y - my as y, vardir as psi{lead}{shifted} from area, {n}mid where y is not null),
{n}it(k, s2, diff) as (
  select 0, (select m0 from {n}mid), 1.0::double
  union all
  select k + 1, s2n, abs(s2n - s2) / greatest(s2, 1e-12) from (
    select k, s2, case when s2 + sc / inf > 0 then s2 + sc / inf else 0.0 end as s2n from (select k, s2, {score} as sc, {info} as inf from (
      {state(f"select it.k, it.s2, {sums} from (select it.k, it.s2, s.*, 1.0 / (s.psi + it.s2) as v from {n}it it, {n}s s where it.k < 100 and it.diff > 1e-4) it group by it.k, it.s2")})))),
{n}fin as (select s2, k as n_iter from {n}it order by k desc limit 1),
{n}co as ({state(f"select any_value(s2) as s2, {sums} from (select s2, s.*, 1.0 / (s.psi + s2) as v from {n}fin, {n}s s)")}),
{n}fh as (select a.*, {line} as line, s2, case when a.y is not null then vardir / (vardir + s2) end as bb, {xqx} as xqx, v2, {t2} as t2 from (select area.*{lead}{shifted}, my from area, {n}mid) a, {n}co),
{n}est as (select *, case when y is not null then (1 - bb) * (y - line) end as random_effect, line + case when y is not null then (1 - bb) * (y - line) else 0 end as eblup,
   case when y is not null then vardir * (1 - bb) + bb*bb*xqx + 2*bb*bb*(2/v2)/(vardir + s2){ml.replace(t2, 't2')} else s2 + xqx end as mse from {n}fh),
{n}aic as (select m*ln(2*pi()) + lv + (vyy - ({" + ".join(f"e{i}*r{i}" for i in range(p))})) + 2*({p} + 1) as aic from {n}co)"""
