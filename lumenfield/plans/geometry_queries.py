"""Registered queries on geometry (all nodes; consecutive node ids form the pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..operators import geometry as G
from .inputs import basis, cte, nodes
from .recursive import clip, frechet, karcher, recursive
from .registry import query


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    a = n.select("node_id", H.point("px", "py").alias("u"))
    b = n.select((F.col("node_id") - 1).alias("node_id"), H.point("px", "py").alias("v"))
    return a.join(b, "node_id")


def pair_sql(start: str, pairs: str) -> str:
    """Expressions that end in ``c3``: the pairs (node_id, ux, uy, vx, vy) of a query as they are (o) and pulled back to the disk (a, b), with their products."""
    return start + f""", pair as ({pairs}),
c1 as (select *, sqrt(ux*ux+uy*uy) nu, sqrt(vx*vx+vy*vy) nv from pair),
c2 as (select node_id, ux oux, uy ouy, vx ovx, vy ovy, case when nu >= 0.99999::double then ux*(0.99999::double/nu) else ux end ax, case when nu >= 0.99999::double then uy*(0.99999::double/nu) else uy end ay,
  case when nv >= 0.99999::double then vx*(0.99999::double/nv) else vx end bx, case when nv >= 0.99999::double then vy*(0.99999::double/nv) else vy end by_ from c1),
c3 as (select *, (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_) g2, ax*ax+ay*ay na, bx*bx+by_*by_ nb, ax*bx+ay*by_ dot from c2)"""


_PAIRS = pair_sql(cte("nodes"), "select a.node_id, a.px ux, a.py uy, b.px vx, b.py vy from nodes a join nodes b on b.node_id = a.node_id + 1")
_DIST = "acosh(greatest(1.0::double, 1 + 2*g2/greatest((1-na)*(1-nb), 1e-9::double)))"


@query(cte("nodes") + """ select node_id, round(case when sqrt(px*px+py*py) >= 0.99999::double then px*(0.99999::double/sqrt(px*px+py*py)) else px end, 6) as x,
 round(case when sqrt(px*px+py*py) >= 0.99999::double then py*(0.99999::double/sqrt(px*px+py*py)) else py end, 6) as y from nodes""")
def clip_to_disk(spark, d):
    p = H.clip(H.point("px", "py"))
    return nodes(spark, d).select("node_id", p.alias("p")).select("node_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(_PAIRS + f""" select node_id, round({_DIST}, 5) as dist,
 round(acosh(greatest(1.0::double, 1 + 2*((oux-ovx)*(oux-ovx)+(ouy-ovy)*(ouy-ovy))/((1-least(oux*oux+ouy*ouy, 0.9999::double))*(1-least(ovx*ovx+ovy*ovy, 0.9999::double))))), 5) as dist_clamped,
 round(case when (1-(oux*oux+ouy*ouy))*(1-(ovx*ovx+ovy*ovy)) <= 1e-10::double then 9.99::double else acosh(greatest(1.0::double, 1 + 2*((oux-ovx)*(oux-ovx)+(ouy-ovy)*(ouy-ovy))/((1-(oux*oux+ouy*ouy))*(1-(ovx*ovx+ovy*ovy))))) end, 5) as dist_sentinel
 from c3 where na is not null and nb is not null""")
def poincare_dist(spark, d):
    """The three distances side by side."""
    u, v = F.col("u"), F.col("v")
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    return known.select("node_id", F.round(H.dist(u, v), 5).alias("dist"), F.round(H.dist_clamped(u, v), 5).alias("dist_clamped"), F.round(H.dist_sentinel(u, v), 5).alias("dist_sentinel"))


@query(_PAIRS + """, m as (select node_id, ((1+2*dot+nb)*ax+(1-na)*bx)/greatest(1+2*dot+na*nb, 1e-9::double) x, ((1+2*dot+nb)*ay+(1-na)*by_)/greatest(1+2*dot+na*nb, 1e-9::double) y from c3 where dot is not null)
 select node_id, round(case when sqrt(x*x+y*y) >= 0.99999::double then x*(0.99999::double/sqrt(x*x+y*y)) else x end, 5) as x, round(case when sqrt(x*x+y*y) >= 0.99999::double then y*(0.99999::double/sqrt(x*x+y*y)) else y end, 5) as y from m""")
def mobius_add(spark, d):
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    return known.select("node_id", H.mobius_add(F.col("u"), F.col("v")).alias("p")).select("node_id", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query(cte("nodes") + """, c as (select node_id, case when n >= 0.99999::double then px*(0.99999::double/n) else px end x, case when n >= 0.99999::double then py*(0.99999::double/n) else py end y
   from (select *, sqrt(px*px+py*py) n from nodes where px is not null and py is not null)),
 l as (select node_id, case when sqrt(x*x+y*y) < 1e-9 then 0 else atanh(sqrt(x*x+y*y))*x/sqrt(x*x+y*y) end tx, case when sqrt(x*x+y*y) < 1e-9 then 0 else atanh(sqrt(x*x+y*y))*y/sqrt(x*x+y*y) end ty from c)
 select node_id, round(tx, 6) as tx, round(ty, 6) as ty, round(case when sqrt(tx*tx+ty*ty) < 1e-9 then 0 else tanh(sqrt(tx*tx+ty*ty))*tx/sqrt(tx*tx+ty*ty) end, 6) as x,
 round(case when sqrt(tx*tx+ty*ty) < 1e-9 then 0 else tanh(sqrt(tx*tx+ty*ty))*ty/sqrt(tx*tx+ty*ty) end, 6) as y from l""")
def exp0_log0(spark, d):
    """Tangent at the origin and back."""
    known = nodes(spark, d).where("px is not null and py is not null").select("node_id", H.log0(H.point("px", "py")).alias("t"))
    return known.select("node_id", "t", H.exp0(F.col("t")).alias("p")).select("node_id", F.round("t.x", 6).alias("tx"), F.round("t.y", 6).alias("ty"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_LOGX = _PAIRS + """, q as (select node_id, ax, ay, na, bx, by_, ((1-2*dot+nb)*(-ax)+(1-na)*bx)/greatest(1-2*dot+na*nb, 1e-9::double) qx, ((1-2*dot+nb)*(-ay)+(1-na)*by_)/greatest(1-2*dot+na*nb, 1e-9::double) qy from c3 where dot is not null),
 t as (select *, case when sqrt(qx*qx+qy*qy) < 1e-9 then 0 else (1-na)*atanh(least(sqrt(qx*qx+qy*qy), 0.99999::double))*qx/sqrt(qx*qx+qy*qy) end tx, case when sqrt(qx*qx+qy*qy) < 1e-9 then 0 else (1-na)*atanh(least(sqrt(qx*qx+qy*qy), 0.99999::double))*qy/sqrt(qx*qx+qy*qy) end ty from q),
 s as (select *, case when sqrt(tx*tx+ty*ty) < 1e-9 then 0 else tanh(sqrt(tx*tx+ty*ty)/(1-na))*tx/sqrt(tx*tx+ty*ty) end sx, case when sqrt(tx*tx+ty*ty) < 1e-9 then 0 else tanh(sqrt(tx*tx+ty*ty)/(1-na))*ty/sqrt(tx*tx+ty*ty) end sy from t),
 m as (select *, ((1+2*(ax*sx+ay*sy)+sx*sx+sy*sy)*ax+(1-na)*sx)/greatest(1+2*(ax*sx+ay*sy)+na*(sx*sx+sy*sy), 1e-9::double) x, ((1+2*(ax*sx+ay*sy)+sx*sx+sy*sy)*ay+(1-na)*sy)/greatest(1+2*(ax*sx+ay*sy)+na*(sx*sx+sy*sy), 1e-9::double) y from s)"""


@query(_LOGX + f" select node_id, round(tx, 5) + 0 as tx, round(ty, 5) + 0 as ty, round(sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)), 4) as error from (select *, {clip('x', 'y')[0]} cx, {clip('x', 'y')[1]} cy from m)")
def log_x_exp_x(spark, d):
    """Tangent from one point to the next and how far from the next, pulled back to the disk, it leads."""
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    there = known.select("node_id", H.clip(F.col("u")).alias("u"), H.clip(F.col("v")).alias("v"))
    there = there.select("node_id", "v", "u", H.log_x(F.col("u"), F.col("v")).alias("t")).select("node_id", "v", "t", H.exp_x(F.col("u"), F.col("t")).alias("p"))
    return there.select("node_id", (F.round("t.x", 5) + 0.0).alias("tx"), (F.round("t.y", 5) + 0.0).alias("ty"), F.round(F.sqrt(H.gap(F.col("p"), F.col("v"))), 4).alias("error"))


MID = """, q as (select node_id, ax, ay, na, g2, ((1-2*dot+nb)*(-ax)+(1-na)*bx)/greatest(1-2*dot+na*nb, 1e-9::double) qx, ((1-2*dot+nb)*(-ay)+(1-na)*by_)/greatest(1-2*dot+na*nb, 1e-9::double) qy from c3 where dot is not null),
 t as (select *, 2/greatest(1-na, 1e-9::double) lam, sqrt(qx*qx+qy*qy) nq from q),
 h as (select node_id, ax, ay, na, g2, case when nq < 1e-9 then 0 else tanh(atanh(least(nq, 0.99999::double))/2)*qx/nq end sx, case when nq < 1e-9 then 0 else tanh(atanh(least(nq, 0.99999::double))/2)*qy/nq end sy from t),
 m as (select node_id, case when sqrt(g2) < 1e-9 or sx*sx+sy*sy = 0 then ax else ((1+2*(ax*sx+ay*sy)+sx*sx+sy*sy)*ax+(1-na)*sx)/(1+2*(ax*sx+ay*sy)+na*(sx*sx+sy*sy)) end x,
  case when sqrt(g2) < 1e-9 or sx*sx+sy*sy = 0 then ay else ((1+2*(ax*sx+ay*sy)+sx*sx+sy*sy)*ay+(1-na)*sy)/(1+2*(ax*sx+ay*sy)+na*(sx*sx+sy*sy)) end y from h)"""


@query(_PAIRS + MID + " select node_id, round(x, 4) as px, round(y, 4) as py, round(sqrt(x*x+y*y), 4) as r from m")
def geodesic_midpoint(spark, d):
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    return known.select("node_id", H.midpoint(F.col("u"), F.col("v")).alias("m")).select("node_id", F.round("m.x", 4).alias("px"), F.round("m.y", 4).alias("py"), F.round(H.norm(F.col("m")), 4).alias("r"))


LEGS = f""", a as (select *, least(sqrt(na), 0.99999::double) r1, least(sqrt(nb), 0.99999::double) r2, abs(atan2(ay, ax) - atan2(by_, bx)) raw from c3 where dot is not null),
 b as (select *, abs(2*atanh(r1)-2*atanh(r2)) radial, case when raw > pi() then 2*pi()-raw else raw end ang, least(r1, r2) low from a),
 e as (select *, acosh(greatest(1.0::double, 1 + 2*(low-low*cos(ang))*(low-low*cos(ang))/greatest((1-low*low)*(1-low*low), 1e-9::double) + 2*(low*sin(ang))*(low*sin(ang))/greatest((1-low*low)*(1-low*low), 1e-9::double))) angular from b),
 f as (select node_id, radial, angular, case when radial+angular < 1e-9 then null else radial/(radial+angular) end rs, case when radial+angular < 1e-9 then null else angular/(radial+angular) end "as_", degrees(ang) deg, {_DIST} geo from e)"""


@query(_PAIRS + LEGS + ' select node_id, round(radial, 4) as radial, round(angular, 4) as angular, round(rs, 3) as radial_share, round("as_", 3) as angular_share, round(deg, 1) as delta_theta_deg, round(radial+angular, 4) as path_length, round(geo, 4) as geodesic from f')
def radial_angular_legs(spark, d):
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    m = known.select("node_id", H.legs(F.col("u"), F.col("v")).alias("m"))
    digits = {"radial": 4, "angular": 4, "radial_share": 3, "angular_share": 3, "delta_theta_deg": 1, "path_length": 4, "geodesic": 4}
    return m.select("node_id", *[F.round(f"m.{c}", n).alias(c) for c, n in digits.items()])


@query(_PAIRS + LEGS + """ select node_id, case when rs is null then 'coincident positions' when round(rs,3) >= 0.65::double then 'depth-dominated: same field, different differentiation'
 when round("as_",3) >= 0.65::double then 'field-dominated: comparable depth, different semantic field' else 'mixed: separation runs through both depth and field' end as gloss from f""")
def decomposition_gloss(spark, d):
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    m = known.select("node_id", H.legs(F.col("u"), F.col("v")).alias("m"))
    return m.select("node_id", H.gloss(F.round("m.radial_share", 3), F.round("m.angular_share", 3)).alias("gloss"))


@query(_PAIRS + """, x as (select node_id, sqrt((oux-ovx)*(oux-ovx)+(ouy-ovy)*(ouy-ovy)) flat, acosh(greatest(1.0::double, 1 + 2*((oux-ovx)*(oux-ovx)+(ouy-ovy)*(ouy-ovy))/((1-least(oux*oux+ouy*ouy, 0.9999::double))*(1-least(ovx*ovx+ovy*ovy, 0.9999::double))))) deep from c3 where dot is not null)
 select node_id, round(flat, 4) as distance_euclidean, round(deep, 4) as distance_hyperbolic, case when flat > 1e-6 then round(deep/flat, 3) end as hierarchy_load from x""")
def dual_distance(spark, d):
    known = _pairs(spark, d).where("u.x is not null and u.y is not null and v.x is not null and v.y is not null")
    return known.select("node_id", H.dual_distance(F.col("u"), F.col("v")).alias("m")).select("node_id", "m.*")


_BD = "acosh(greatest(1.0::double, 1 + 2*((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/greatest((1-(a.px*a.px+a.py*a.py))*(1-(b.px*b.px+b.py*b.py)), 1e-9::double)))"


def _clipped(name: str) -> str:
    return f"{name} as (select * replace (case when sqrt(px*px+py*py) >= 0.99999::double then px*(0.99999::double/sqrt(px*px+py*py)) else px end as px, case when sqrt(px*px+py*py) >= 0.99999::double then py*(0.99999::double/sqrt(px*px+py*py)) else py end as py) from basis)"


def field_baseline(spark: SparkSession, d: str) -> float:
    """The mean pairwise distance of the basis, a number that callers keep."""
    rows = basis(spark, d).select("px", "py").toPandas()  # 99 rows
    return G.mean_pairwise((rows.px + 1j * rows.py).to_numpy())


@query(cte("basis") + ", " + _clipped("bc") + f" select count(*) as pairs, round(avg({_BD}), 6) as mean_pairwise from bc a join bc b on a.name < b.name")
def field_mean_pairwise(spark, d):
    b = basis(spark, d).select("name", H.point("px", "py").alias("p"))
    pairs = b.alias("a").join(F.broadcast(b.alias("b")), F.col("a.name") < F.col("b.name"))  # the 99 names
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(H.dist(F.col("a.p"), F.col("b.p"))), 6).alias("mean_pairwise"))


@query(cte("basis") + ", " + _clipped("bc") + f" select a.level, count(*) as pairs, round(avg({_BD}), 6) as mean_pairwise from bc a join bc b on a.name < b.name and a.level = b.level group by 1")
def mean_pairwise(spark, d):
    """Mean pairwise distance of the basis by level."""
    b = basis(spark, d).select("name", "level", H.point("px", "py").alias("p"))
    pairs = b.alias("a").join(F.broadcast(b.alias("b")), (F.col("a.level") == F.col("b.level")) & (F.col("a.name") < F.col("b.name")))
    return pairs.groupBy("a.level").agg(F.count("*").alias("pairs"), F.round(F.avg(H.dist(F.col("a.p"), F.col("b.p"))), 6).alias("mean_pairwise"))


_ATTRACTED = recursive(cte("basis", "log")) + ", nm as (select ar, min_by({'x': px, 'y': py}, name) spot from basis where ar is not null group by 1), src as (select log_id as key, nm.spot.x as x, nm.spot.y as y, sim as w from (select log_id, a.ar, a.sim from (select log_id, unnest(top_name_attractors) as a from log)) join nm using (ar)), " + karcher("src")


@query(_ATTRACTED + " select key as log_id, round(x, 4) + 0 as px, round(y, 4) + 0 as py from placed")
def karcher_mean(spark, d):
    """The barycentre of the first five attractors of every logged lookup, weighted by similarity."""
    from .inputs import log

    b = basis(spark, d).where("ar is not null").groupBy("ar").agg(F.min_by(F.struct("px", "py"), "name").alias("at"))
    each = log(spark, d).select("log_id", F.explode("top_name_attractors").alias("a")).select("log_id", "a.ar", "a.sim").join(F.broadcast(b), "ar")
    sets = each.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct(F.col("sim"), F.col("at.px").alias("px"), F.col("at.py").alias("py"))), asc=False).alias("s"))
    m = sets.select("log_id", G.karcher_mean(F.col("s.px"), F.col("s.py"), F.transform("s.sim", lambda s: F.greatest(s, F.lit(0.0)))).alias("m"))
    return m.select("log_id", (F.round("m.x", 4) + 0.0).alias("px"), (F.round("m.y", 4) + 0.0).alias("py"))


def _measured(group: str) -> str:
    """Means and statistics of the basis by a column, and the mean pairwise distance of the whole field."""
    gap = "acosh(greatest(1.0::double, 1+2*((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/greatest((1-(a.x*a.x+a.y*a.y))*(1-(b.x*b.x+b.y*b.y)), 1e-9::double)))"
    x, y = clip("px", "py")
    return recursive(cte("basis")) + f""", src as (select {group} as key, px as x, py as y from basis), {frechet("src")},
 va as (select key, avg(pow({gap}, 2)) as variance from (select key, {{'x': m.x, 'y': m.y}} as a, unnest(pts) as b from means m) group by key),
 el as (select {group} as key, name, {x} as x, {y} as y from basis), pw as (select a.key, avg({gap}) as mean_pairwise from el a join el b on a.key is not distinct from b.key and a.name < b.name group by 1), fb as (select avg({gap}) as base from el a join el b on a.name < b.name),
 st as (select m.key, m.n::int as n, m.x, m.y, variance, sqrt(variance) as dispersion, coalesce(mean_pairwise, 0) as mean_pairwise, coalesce(mean_pairwise, 0)/base as tightness from means m join va on va.key is not distinct from m.key left join pw on pw.key is not distinct from m.key, fb)"""


@query(_measured("level") + " select key as level, n, round(x, 4) + 0 as x, round(y, 4) + 0 as y, round(variance, 5) as variance, round(dispersion, 5) as dispersion, round(mean_pairwise, 5) as mean_pairwise, round(tightness, 5) as tightness from st")
def frechet_statistics(spark, d):
    """Centre, variance, dispersion, mean pairwise distance and tightness of the basis by level."""
    m = G.frechet_statistics(basis(spark, d), "level", field_baseline(spark, d))
    return m.select("level", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("x", "y")], *[F.round(c, 5).alias(c) for c in ("variance", "dispersion", "mean_pairwise", "tightness")])


@query(_measured("root") + " select key as root, round(x, 4) + 0 as x, round(y, 4) + 0 as y from st")
def frechet_mean(spark, d):
    """The intrinsic mean of the basis by root."""
    return G.frechet_statistics(basis(spark, d), "root").select("root", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """(root, n, px, py, r, variance, dispersion, mean_pairwise, field_mean_pairwise, tightness) of the roots of two names or more."""
    base = field_baseline(spark, d)
    m = G.frechet_statistics(basis(spark, d), "root", base).where("n >= 2")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return m.select("root", "n", (F.round("x", 4) + 0.0).alias("px"), (F.round("y", 4) + 0.0).alias("py"), F.round(r, 4).alias("r"), *[F.round(c, 4).alias(c) for c in ("variance", "dispersion", "mean_pairwise")], F.lit(round(base, 4)).alias("field_mean_pairwise"), F.round("tightness", 3).alias("tightness"))


_CLUSTERS = _measured("root") + ", cl as (select key as root, n, round(x, 4) + 0 as px, round(y, 4) + 0 as py, round(sqrt(x*x+y*y), 4) as r, round(variance, 4) as variance, round(dispersion, 4) as dispersion, round(mean_pairwise, 4) as mean_pairwise, round(base, 4) as field_mean_pairwise, round(tightness, 3) as tightness from st, fb where n >= 2)"


@query(_CLUSTERS + " select * exclude (field_mean_pairwise) from cl")
def root_cluster_geometry(spark, d):
    """Cluster statistics of the names that share a root, for roots of two names or more."""
    return clusters(spark, d).drop("field_mean_pairwise")


_KNN = cte("nodes") + """, c as (select node_id, case when n >= 0.99999::double then px*(0.99999::double/n) else px end px, case when n >= 0.99999::double then py*(0.99999::double/n) else py end py from (select *, sqrt(px*px+py*py) n from nodes where px is not null and py is not null)),"""


@query(_KNN + f""" d as (select a.node_id, b.node_id as id, {_BD} dist from c a, c b where a.node_id % 100 = 0 and a.node_id <> b.node_id),
 k as (select *, row_number() over (partition by node_id order by round(dist, 9), id) rn from d) select node_id, id, rn::int as rank, round(dist, 4) as distance from k where rn <= 8""")
def hyperbolic_knn(spark, d):
    """The eight nearest nodes of every node whose id is divisible by 100."""
    n = nodes(spark, d)
    targets = n.where(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("target"), F.col("px").alias("x"), F.col("py").alias("y"))
    near = G.nearest(n.select(F.col("node_id").alias("id"), "px", "py"), targets, 8)
    return near.select(F.col("target").alias("node_id"), "id", "rank", F.round("distance", 4).alias("distance"))


@query(cte("nodes", "basis") + """, d as (select n.node_id, b.name, b.level, acosh(greatest(1.0::double, 1 + 2*((n.px-b.px)*(n.px-b.px)+(n.py-b.py)*(n.py-b.py))/((1-least(n.px*n.px+n.py*n.py, 0.9999::double))*(1-least(b.px*b.px+b.py*b.py, 0.9999::double))))) dist from nodes n, basis b where n.px is not null and n.py is not null),
 k as (select *, row_number() over (partition by node_id order by round(dist, 9), name) rn from d) select node_id, rn::int as rank, name, case least(level, 2) when 0 then 'Dhāt' when 1 then 'Ṣifāt' else 'Afʿāl' end as tier, round(dist, 4) as distance from k where rn <= 3""")
def nearest_basis(spark, d):
    """The three nearest names of every node."""
    targets = nodes(spark, d).select(F.col("node_id").alias("target"), F.col("px").alias("x"), F.col("py").alias("y"))
    names = basis(spark, d).select(F.col("name").alias("id"), "px", "py", "level")
    near = G.nearest(names.coalesce(1), targets, 3, same=True, clamped=True).join(F.broadcast(names.select("id", "level")), "id")
    return near.select(F.col("target").alias("node_id"), "rank", F.col("id").alias("name"), H.tier_label(F.col("level")).alias("tier"), F.round("distance", 4).alias("distance"))


@query(cte("nodes") + " select least(level, 2)::int as tier, count(*) as n, round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std, round(min(r), 6) as min, round(max(r), 6) as max from nodes where level is not null and r is not null group by 1")
def depth_statistics(spark, d):
    t = G.tier_statistics(nodes(spark, d))
    return t.select("tier", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query(cte("nodes") + ", t as (select least(level, 2)::int as tier, min(r) lo, max(r) hi from nodes where level is not null and r is not null group by 1) select a.tier as tier_a, b.tier as tier_b, round(greatest(0.0::double, least(a.hi, b.hi)-greatest(a.lo, b.lo)), 6) as overlap from t a join t b on a.tier < b.tier")
def band_overlap(spark, d):
    return G.band_overlap(G.tier_statistics(nodes(spark, d))).select("tier_a", "tier_b", F.round("overlap", 6).alias("overlap"))


@query(cte("nodes") + ", k as (select row_number() over (order by least(level, 2), node_id)-1 a, row_number() over (order by r, node_id)-1 b from nodes where level is not null and r is not null) select round(corr(a, b), 6) as spearman_level_r from k")
def depth_correlation(spark, d):
    return G.depth_correlation(nodes(spark, d)).select(F.round("spearman_level_r", 6).alias("spearman_level_r"))


@query(cte("nodes") + " select 'T' || least(level, 2)::int as band, round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std from nodes where level is not null and r is not null group by 1")
def tier_bands(spark, d):
    return G.tier_statistics(nodes(spark, d)).select(F.concat(F.lit("T"), F.col("tier").cast("string")).alias("band"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(cte("nodes") + " select node_id, case least(level, 2) when 0 then 'Dhāt' when 1 then 'Ṣifāt' when 2 then 'Afʿāl' end as label from nodes")
def tier_labels(spark, d):
    return nodes(spark, d).select("node_id", H.tier_label(F.col("level")).alias("label"))
