"""Registered queries on the log of lookups: neighbours, comparison, projection, hygiene, appending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..functions import letters as L
from ..functions import morphology as M
from ..functions import text as T
from ..operators import geometry as G
from ..operators import hygiene as Y
from ..operators import lookup as Q
from ..session import table
from .geometry_queries import LEGS, MID, clusters, pair_sql
from .geometry_queries import _CLUSTERS as CLUSTERS
from .inputs import basis, cte, log, nodes
from .recursive import karcher, recursive
from .registry import query
from .text_queries import _letters, _pattern_sql, _re, _sum

_REC = cte("log") + """, keyed as (select *, coalesce(term_undiacritized, regexp_replace(term_ar, '[\\x{064B}-\\x{065F}\\x{0670}\\x{0640}]', '', 'g')) as key from log),
 rec as (select log_id, key, term_ar, estimated_position.px as px, estimated_position.py as py, estimated_position.r as r, estimated_position.level_label as level_label, abjad_value, poincare_dist_to_primary, list_transform(top_name_attractors, lambda x: x.ar) as attractors, list_transform(bottom_names, lambda x: x.ar) as bottoms from (select *, row_number() over (partition by key order by log_id) n from keyed where key is not null) where n = 1)"""


def _d(a: str, b: str, rule: str = "clamped") -> str:
    g = f"(({a}.px-{b}.px)*({a}.px-{b}.px)+({a}.py-{b}.py)*({a}.py-{b}.py))"
    n = lambda t: f"least({t}.px*{t}.px+{t}.py*{t}.py, 0.9999::double)"
    return f"acosh(greatest(1.0::double, 1 + 2*{g}/((1-{n(a)})*(1-{n(b)}))))"


def _clipped_rec() -> str:
    return ", cr as (select * replace (case when sqrt(px*px+py*py) >= 0.99999::double then px*(0.99999::double/sqrt(px*px+py*py)) else px end as px, case when sqrt(px*px+py*py) >= 0.99999::double then py*(0.99999::double/sqrt(px*px+py*py)) else py end as py) from rec)"


_DC = "acosh(greatest(1.0::double, 1 + 2*((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/greatest((1-(a.px*a.px+a.py*a.py))*(1-(b.px*b.px+b.py*b.py)), 1e-9::double)))"


def _near_sql(k: int, low: float, high: float, shown: int) -> str:
    return _REC + _clipped_rec() + f""", tg as (select distinct key from keyed where log_id % 100 = 0), d as (select a.log_id, b.log_id as id, b.attractors, {_DC} dist from cr a, cr b where a.key in (select key from tg) and a.log_id <> b.log_id and b.r between {low} and {high} and a.px is not null and b.px is not null),
 k as (select *, row_number() over (partition by log_id order by round(dist, 9), id) rn from d) select log_id, id, rn::int as rank, round(dist, 4) as distance, attractors[1:{shown}] as attractors from k where rn <= {k}"""


def _near(spark, d, k: int, low: float, high: float, shown: int):
    """Neighbours, among all records, of the records of the terms looked up in every row whose id is divisible by 100."""
    from ..session import written

    rows = log(spark, d)
    rec = written(Q.log_records(rows), "records")
    asked = rows.where(F.col("log_id") % 100 == 0).select(F.coalesce("term_undiacritized", T.strip_diac("term_ar")).alias("key"))
    targets = rec.join(asked, "key", "left_semi").select(F.col("log_id").alias("target"), F.col("px").alias("x"), F.col("py").alias("y"))
    near = Q.neighbours(rec, targets, k, low, high)
    return near.join(rec.select(F.col("log_id").alias("id"), F.slice("attractors", 1, shown).alias("attractors")), "id").select(F.col("target").alias("log_id"), "id", "rank", F.round("distance", 4).alias("distance"), "attractors")


@query(_near_sql(10, 0.1, 0.95, 3))
def semantic_neighbors(spark, d):
    return _near(spark, d, 10, 0.1, 0.95, 3)


_BARE = r"[\x{064B}-\x{065F}\x{0670}\x{0640}]"
_WAZN = "case s.status when 'parsed' then cand[1] when 'ambiguous_vocalization' then array_to_string(best, ' / ') when 'ambiguous_structure' then array_to_string(cand[1:4], ' / ') end"


def _breakdown_sql(text: str) -> str:
    keys, values = ", ".join(repr(k) for k in L.ABJAD), ", ".join(str(v) for v in L.ABJAD.values())
    return f"array_to_string(list_transform(list_filter({_letters(text)}, lambda x: list_contains([{keys}], x)), lambda x: x || '=' || list_extract([{values}], list_position([{keys}], x))::varchar), ' + ') || ' = ' || {_sum(text, L.ABJAD)}::varchar"


_PROFILE = _near_sql(5, 0.15, 0.92, 2)


@query(_pattern_sql("rec", _PROFILE[: _PROFILE.rindex(" select log_id, id")]).replace(" k as (select *, row_number", " kn as (select *, row_number", 1) + f""", bare as (select log_id, {_re('term_ar', _BARE)} as b from rec) select n.log_id, n.id, n.rn::int as rank, round(n.dist, 4) as distance, n.attractors[1:2] as neighbour_attractors, r.key as term_clean, {_sum('b', L.ABJAD)} as value, {_breakdown_sql('b')} as breakdown,
 round(r.px, 4) + 0 as px, round(r.py, 4) + 0 as py, round(r.r, 4) as r, r.level_label as tier, {_WAZN} as query_wazn, s.status as query_wazn_status, round(r.poincare_dist_to_primary, 4) as dist_to_primary, r.attractors as attractors, r.bottoms as repelled
 from kn n join rec r using (log_id) join bare using (log_id) left join s using (log_id) where n.rn <= 5""")
def full_profile(spark, d):
    """The whole profile of every term asked for: letters, pattern, place, attractors, repelled names, and its five neighbours in a narrower band, a row each."""
    near = _near(spark, d, 5, 0.15, 0.92, 2).withColumnRenamed("attractors", "neighbour_attractors")
    rec = Q.log_records(log(spark, d), "poincare_dist_to_primary").where("term_ar is not null")
    own = rec.withColumns({"letters": Q.letters_of(F.col("term_ar")), "own": M.parse_pattern(F.col("term_ar"))})
    own = own.select("log_id", F.col("key").alias("term_clean"), "letters.value", "letters.breakdown", *[(F.round(c, 4) + 0.0).alias(c) for c in ("px", "py")], F.round("r", 4).alias("r"), F.col("level_label").alias("tier"), "own.query_wazn", "own.query_wazn_status", F.round("poincare_dist_to_primary", 4).alias("dist_to_primary"), "attractors", F.col("bottoms").alias("repelled"))
    return near.join(own, "log_id")


_CMP = pair_sql(_REC, "select a.log_id as node_id, a.px ux, a.py uy, b.px vx, b.py vy from rec a join rec b on b.log_id = a.log_id + 1") + MID + LEGS + """, p as (select a.log_id as log_id, a, b from rec a join rec b on b.log_id = a.log_id + 1),
 mr as (select node_id, round(x, 4) + 0 as px, round(y, 4) + 0 as py, round(sqrt(x*x+y*y), 4) as r from m where x is not null)"""
_NEAREST = _d("mr", "o")


@query(_CMP + ", basis as (" + cte("basis").removeprefix("with basis as (").rstrip()[:-1] + f""" ), nn as (select node_id, list(name order by rn) as near from (select mr.node_id, o.name, row_number() over (partition by mr.node_id order by round({_NEAREST}, 9), o.name) rn from mr, basis o) where rn <= 3 group by 1)
 select log_id, list_sort(list_distinct(list_filter(p.a.attractors, lambda x: list_contains(p.b.attractors, x)))) as shared, list_sort(list_distinct(list_filter(p.a.attractors, lambda x: not list_contains(p.b.attractors, x)))) as only_1,
 list_sort(list_distinct(list_filter(p.b.attractors, lambda x: not list_contains(p.a.attractors, x)))) as only_2, list_sort(list_distinct(list_concat(list_filter(p.a.attractors, lambda x: list_contains(p.b.bottoms, x)), list_filter(p.b.attractors, lambda x: list_contains(p.a.bottoms, x))))) as opposing,
 round(sqrt((p.a.px-p.b.px)*(p.a.px-p.b.px)+(p.a.py-p.b.py)*(p.a.py-p.b.py)), 4) as distance_euclidean, round({_d('p.a', 'p.b')}, 4) as distance_hyperbolic, case when sqrt((p.a.px-p.b.px)*(p.a.px-p.b.px)+(p.a.py-p.b.py)*(p.a.py-p.b.py)) > 1e-6 then round({_d('p.a', 'p.b')}/sqrt((p.a.px-p.b.px)*(p.a.px-p.b.px)+(p.a.py-p.b.py)*(p.a.py-p.b.py)), 3) end as hierarchy_load,
 mr.px as mid_px, mr.py as mid_py, mr.r as mid_r, nn.near as nearest_names, round(radial, 4) as radial, round(angular, 4) as angular, round(rs, 3) as radial_share, round("as_", 3) as angular_share from p left join mr on mr.node_id = p.log_id left join nn on nn.node_id = p.log_id left join f on f.node_id = p.log_id""")
def compare_terms(spark, d):
    """Consecutive records compared: attractors, distances, the midpoint with its three nearest names, the path by radius and angle."""
    rec = Q.log_records(log(spark, d)).select("log_id", F.struct("attractors", "bottoms", "px", "py").alias("a"))
    pair = rec.join(rec.select((F.col("log_id") - 1).alias("log_id"), F.col("a").alias("b")), "log_id")
    u, v = H.point("a.px", "a.py"), H.point("b.px", "b.py")
    known = F.col("a.px").isNotNull() & F.col("a.py").isNotNull() & F.col("b.px").isNotNull() & F.col("b.py").isNotNull()
    wide = pair.select("log_id", Q.compared(F.col("a"), F.col("b")).alias("c"), F.when(known, H.midpoint(u, v)).alias("m"), F.when(known, H.legs(u, v)).alias("l"))
    wide = wide.select("log_id", "c.*", (F.round("m.x", 4) + 0.0).alias("mid_px"), (F.round("m.y", 4) + 0.0).alias("mid_py"), F.round(H.norm(F.col("m")), 4).alias("mid_r"), F.round("l.radial", 4).alias("radial"), F.round("l.angular", 4).alias("angular"), F.round("l.radial_share", 3).alias("radial_share"), F.round("l.angular_share", 3).alias("angular_share"))
    middle = wide.where("mid_px is not null").select(F.col("log_id").alias("target"), F.col("mid_px").alias("x"), F.col("mid_py").alias("y"))
    names = basis(spark, d).select(F.col("name").alias("id"), "px", "py").coalesce(1)
    near = G.nearest(names, middle, 3, same=True, clamped=True).groupBy(F.col("target").alias("log_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda n: n["id"]).alias("nearest_names"))
    return wide.join(near, "log_id", "left")


@query(recursive(_REC) + ", src as (select level_label as key, px as x, py as y, greatest(r, 0.001::double) as w from rec where px is not null and py is not null), " + karcher("src") + " select key as level_label, round(x, 4) + 0 as px, round(y, 4) + 0 as py from placed")
def context_centroid(spark, d):
    """The barycentre of the records of each level, weighted by radius (at least 0.001)."""
    rec = Q.log_records(log(spark, d)).where("px is not null and py is not null")
    return G.grouped_karcher(rec.select(F.col("level_label").alias("g"), "px", "py", F.greatest("r", F.lit(1e-3)).alias("w")), "g").select(F.col("g").alias("level_label"), (F.round("x", 4) + 0.0).alias("px"), (F.round("y", 4) + 0.0).alias("py"))


@query(_REC + f" select a.log_id, round(1/(1+{_d('a', 'o')}), 4) as fit from rec a, (select 0.1::double as px, 0.2::double as py) o where a.px is not null")
def geometric_fit(spark, d):
    """How well every record fits a given centre."""
    rec = Q.log_records(log(spark, d)).where("px is not null")
    return rec.select("log_id", F.round(1 / (1 + H.dist_clamped(H.point("px", "py"), H.point(0.1, 0.2))), 4).alias("fit"))


_BASIS = cte("basis").removeprefix("with ")
_PROJECT = recursive(_REC) + ", " + _BASIS + ", src as (select 1 as key, px as x, py as y, greatest(sqrt(px*px+py*py), 0.001::double) as w from basis), " + karcher("src") + f""", ft as (select a.log_id, a.level_label as concept, a.key as form, a.term_ar, a.attractors, round(1/(1+{_d('a', 'o')}), 4) as fit from rec a, (select x as px, y as py from placed) o),
 pj as (select *, row_number() over (partition by concept order by fit desc nulls last, form)::int as rank from ft)"""


def _projected(spark, d):
    rec = Q.log_records(log(spark, d)).select("log_id", F.col("level_label").alias("concept"), F.col("key").alias("form"), "term_ar", "attractors", "px", "py")
    context = basis(spark, d).select("px", "py", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")).alias("r"))
    return Q.projected(rec, context)


@query(_PROJECT + " select concept, form, fit, rank from pj")
def semantic_project(spark, d):
    """Records as candidates of the concept of their level, ranked by fit with the barycentre of the basis."""
    return _projected(spark, d)[0].select("concept", "form", "fit", "rank")


_BEST = _pattern_sql("one", _PROJECT + ", one as (select * from pj where rank = 1)")


@query(_BEST + f""" select one.concept, one.form as recommended, one.fit, {_WAZN} as query_wazn, one.attractors[1] as primary_attractor, round(c.x, 3) + 0 as centre_px, round(c.y, 3) + 0 as centre_py, round(sqrt(c.x*c.x+c.y*c.y), 4) as centre_r,
 coalesce(one.term_ar, '') || ' scores highest (fit=' || one.fit::varchar || ') — tier: ' || coalesce(one.concept, '') || ', dominant wazn: ' || coalesce({_WAZN}, '?') || ', primary axis: ' || coalesce(one.attractors[1], '—') as justification from one left join s using (log_id), placed c""")
def semantic_recommend(spark, d):
    """The recommended form of every concept with its justification and the centre of the context."""
    ranked, centre = _projected(spark, d)
    if centre is None:
        centre = (0.0, 0.0)
    best = ranked.where("rank = 1").withColumn("query_wazn", F.when(F.col("term_ar").isNotNull(), M.parse_pattern(F.col("term_ar"))["query_wazn"])).withColumn("primary_attractor", F.get("attractors", F.lit(0)))
    text = F.concat(F.coalesce("term_ar", F.lit("")), F.lit(" scores highest (fit="), F.col("fit").cast("string"), F.lit(") — tier: "), F.coalesce("concept", F.lit("")), F.lit(", dominant wazn: "), F.coalesce("query_wazn", F.lit("?")), F.lit(", primary axis: "), F.coalesce("primary_attractor", F.lit("—")))
    x, y = centre
    return best.select("concept", F.col("form").alias("recommended"), "fit", "query_wazn", "primary_attractor", F.lit(round(x, 3) + 0.0).alias("centre_px"), F.lit(round(y, 3) + 0.0).alias("centre_py"), F.lit(round((x * x + y * y) ** 0.5, 4)).alias("centre_r"), text.alias("justification"))


_ANALYSIS = CLUSTERS + ", " + _REC.removeprefix("with ") + f""", nm as (select b.*, regexp_replace({_re('b.ar', _BARE)}, '^ال', '') as free, count(*) over (partition by b.root)::int as names from basis b), sv as (select key, any_value(abjad_value) as stored from rec group by 1)
 select nm.root, nm.name, nm.names, round(nm.px, 4) + 0 as px, round(nm.py, 4) + 0 as py, nm.level, case least(nm.level, 2) when 0 then 'Dhāt' when 1 then 'Ṣifāt' else 'Afʿāl' end as tier, case when nm.ar is not null then {_sum('free', L.ABJAD)} end as value, {_breakdown_sql('free')} as breakdown, sv.stored, sv.stored is not null and sv.stored <> {_sum('free', L.ABJAD)} as flagged,
 cl.px as cluster_px, cl.py as cluster_py, cl.variance, cl.dispersion, cl.mean_pairwise, cl.field_mean_pairwise, cl.tightness, case when cl.root is not null then case when cl.tightness < 1 then 'tighter than the field at large' else 'no tighter than the field at large' end end as reading
 from nm left join cl using (root) left join sv on sv.key = {_re('nm.ar', _BARE)}"""


@query(_ANALYSIS)
def root_analysis(spark, d):
    """The names of every root: value without the article against the value stored for such a term in the log, and the geometry of the root's names."""
    from pyspark.sql import Window as W

    b = basis(spark, d).withColumn("free", F.regexp_replace(T.strip_diac("ar"), "^ال", "")).withColumn("plain", T.strip_diac("ar"))
    b = b.withColumn("names", F.count("*").over(W.partitionBy("root")).cast("int")).withColumn("letters", Q.letters_of(F.col("free")))
    stored = Q.log_records(log(spark, d), "abjad_value").select(F.col("key").alias("plain"), F.col("abjad_value").alias("stored"))
    c = clusters(spark, d).drop("n", "r").withColumnsRenamed({"px": "cluster_px", "py": "cluster_py"})
    wide = b.join(stored, "plain", "left").join(F.broadcast(c), "root", "left")  # roots of the 99 names
    flagged = F.coalesce(F.col("stored") != F.col("letters.value"), F.lit(False))
    reading = F.when(F.col("tightness") < 1, "tighter than the field at large").when(F.col("variance").isNotNull(), "no tighter than the field at large")
    return wide.select("root", "name", "names", *[(F.round(x, 4) + 0.0).alias(x) for x in ("px", "py")], "level", H.tier_label(F.col("level")).alias("tier"), "letters.value", "letters.breakdown", "stored", flagged.alias("flagged"), "cluster_px", "cluster_py", "variance", "dispersion", "mean_pairwise", "field_mean_pairwise", "tightness", reading.alias("reading"))


_DIAG = pair_sql(_REC, "select a.log_id as node_id, a.px ux, a.py uy, b.px vx, b.py vy from rec a join rec b on b.log_id = a.log_id + 1") + MID + LEGS + ", " + _BASIS
_HD = "acosh(greatest(1.0::double, 1+2*((m.x-o.px)*(m.x-o.px)+(m.y-o.py)*(m.y-o.py))/greatest((1-(m.x*m.x+m.y*m.y))*(1-(o.px*o.px+o.py*o.py)), 1e-9::double)))"


@query(_DIAG + f""", ob as (select name, case when sqrt(px*px+py*py) >= 0.99999::double then px*(0.99999::double/sqrt(px*px+py*py)) else px end as px, case when sqrt(px*px+py*py) >= 0.99999::double then py*(0.99999::double/sqrt(px*px+py*py)) else py end as py from basis), nn as (select node_id, list(name order by rn) as near from (select m.node_id, o.name, row_number() over (partition by m.node_id order by round({_HD}, 6), o.name) rn from m, ob o where m.x is not null) where rn <= 3 group by 1)
 select node_id as log_id, round(geo, 4) as distance, round(radial, 4) as radial, round(angular, 4) as angular, round(rs, 3) as radial_share, round(m.x, 4) + 0 as mid_x, round(m.y, 4) + 0 as mid_y, nn.near as nearest from f join m using (node_id) join nn using (node_id)""")
def geometry_diagnostics(spark, d):
    """Consecutive records: distance, legs, shares, midpoint, and the three names nearest to the midpoint; positions outside are pulled back to the disk."""
    rec = Q.log_records(log(spark, d)).where("px is not null and py is not null").select("log_id", H.point("px", "py").alias("u"))
    pair = rec.join(rec.select((F.col("log_id") - 1).alias("log_id"), F.col("u").alias("v")), "log_id")
    rows = basis(spark, d).select("name", "px", "py").orderBy("name").collect()  # 99 rows
    names = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(float(r.px)).alias("x"), F.lit(float(r.py)).alias("y")) for r in rows])
    m = pair.select("log_id", H.legs(F.col("u"), F.col("v")).alias("l"), H.midpoint(F.col("u"), F.col("v")).alias("m"))
    near = F.slice(F.array_sort(F.transform(names, lambda n: F.struct(F.round(H.dist(F.col("m"), n), 6).alias("d"), n["name"].alias("name")))), 1, 3)
    return m.select("log_id", F.round("l.geodesic", 4).alias("distance"), F.round("l.radial", 4).alias("radial"), F.round("l.angular", 4).alias("angular"), F.round("l.radial_share", 3).alias("radial_share"), (F.round("m.x", 4) + 0.0).alias("mid_x"), (F.round("m.y", 4) + 0.0).alias("mid_y"), near["name"].alias("nearest"))


@query(cte("nodes", "log") + " select (select count(*) from nodes) as nodes, (select count(*) from log) as records, (select count(*) from nodes where node_id < 99) as names")
def health(spark, d):
    counts = nodes(spark, d).agg(F.count("*").alias("nodes"), F.count(F.when(F.col("node_id") < 99, 1)).alias("names"))
    return counts.join(F.broadcast(log(spark, d).agg(F.count("*").alias("records"))), F.lit(True)).select("nodes", "records", "names")  # one row each


# ------------------------------------------------------------------------------------------------------------ hygiene

_WORDS = ", ".join(f"'{w}'" for w in Y.NUMBER_WORDS)
_T = r"regexp_replace(coalesce(term_ar, ''), '^\s+|\s+$', '', 'g')"
_BARE = f"regexp_replace(regexp_replace({_T}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g'), '^ال', '')"
_NOISE = f"({_BARE} in ({_WORDS}) or {_T} in ({_WORDS}) or regexp_matches({_T}, '[0-9\\x{{0660}}-\\x{{0669}}]') or regexp_matches({_T}, '[ÃÂØÙÐ]'))"
_N = f"nfc_normalize({_T})"
_REASON = f"case when regexp_replace({_N}, '^ال', '') in ({_WORDS}) or {_N} in ({_WORDS}) then 'calibration_number_word' when regexp_matches({_N}, '[0-9\\x{{0660}}-\\x{{0669}}]') then 'contains_digits' when regexp_matches({_N}, '[A-Za-z]') and not regexp_matches({_N}, '[\\x{{0600}}-\\x{{06FF}}]') then 'non_arabic' when length(regexp_replace({_N}, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) < 2 then 'too_short' end"
_FLAW = "case when estimated_position.r < 0 or estimated_position.r > 1 then 'r_out_of_range' when sqrt(estimated_position.px*estimated_position.px+estimated_position.py*estimated_position.py) > 1.000000001::double then 'outside_poincare_disk' end"


@query(cte("log") + f" select log_id, {_NOISE} as noise from log")
def noise_filter_live(spark, d):
    return log(spark, d).select("log_id", Y.is_noise(F.col("term_ar")).alias("noise"))


@query(cte("log") + f" select log_id, {_REASON} as reason from log")
def noise_reason(spark, d):
    return log(spark, d).select("log_id", Y.noise_reason(F.col("term_ar")).alias("reason"))


@query(cte("nodes") + " select node_id, case when r < 0 or r > 1 then 'r_out_of_range' when sqrt(px*px+py*py) > 1.000000001::double then 'outside_poincare_disk' end as flaw from nodes")
def validate_record(spark, d):
    v = Y.validation(F.col("r"), F.col("px"), F.col("py"))
    return nodes(spark, d).select("node_id", F.regexp_replace(v, ":.*$", "").alias("flaw"))


@query(cte("log") + r" select log_id, nfc_normalize(regexp_replace(coalesce(nullif(term_ar, ''), nullif(term_undiacritized, ''), nullif(query_wazn, '')), '^\s+|\s+$', '', 'g')) as key from log")
def term_key(spark, d):
    return log(spark, d).select("log_id", Y.term_key(F.col("term_ar"), F.col("term_undiacritized"), F.col("query_wazn")).alias("key"))


@query(cte("log") + f", j as (select log_id, nfc_normalize({_T}) as k, coalesce({_REASON}, {_FLAW}) as reason from log), n as (select *, row_number() over (partition by k order by reason is not null, log_id) n from j) select coalesce(reason, case when n > 1 then 'duplicate' else 'kept' end) as reason, count(*) as n from n group by 1")
def clean_dataset(spark, d):
    """How many records the cleaning keeps and why it drops the others."""
    flat = log(spark, d).select("log_id", F.coalesce("term_ar", F.lit("")).alias("term"), F.col("estimated_position.r").alias("r"), F.col("estimated_position.px").alias("px"), F.col("estimated_position.py").alias("py"))
    judged = Y.cleaned(flat, T.nfc(T.stripped("term")), "log_id", T.repair_utf8("term"))
    return judged.select(F.regexp_replace(F.coalesce("reason", F.lit("kept")), ":.*$", "").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(_REC + " select log_id, key from rec where key <> ''")
def dedupe_log(spark, d):
    """First record of every key without vowel marks."""
    return Q.log_records(log(spark, d)).where("key <> ''").select("log_id", "key")


@query(cte("basis") + " select unnest(['row_count', 'missing_columns', 'extra_columns', 'names_distinct', 'levels']) as \"check\", unnest([count(*) = 99, true, true, count(distinct name) = count(*), count(*) filter (where level is null or level not in (0, 1, 2)) = 0]) as passed from basis")
def validate_basis(spark, d):
    return Y.contract(basis(spark, d), 99, ["name", "ar", "px", "py", "level", "root", "vec"], "name", "level")


@query(cte("basis") + " select upper(sha256(string_agg(name || chr(9) || coalesce(ar, '') || chr(9) || level || chr(9) || coalesce(root, -1), chr(10) order by name))) as digest, count(*) as n from basis")
def basis_digest(spark, d):
    """The SHA-256 of the basis in a fixed text form, to be held against a published one."""
    line = F.concat_ws("\t", F.col("name").cast("string"), F.coalesce("ar", F.lit("")), F.col("level").cast("string"), F.coalesce(F.col("root").cast("string"), F.lit("-1")))
    rows = basis(spark, d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"), F.count("*").alias("n"))  # 99 rows
    return rows.select(F.upper(F.sha2("text", 256)).alias("digest"), "n")


@query("with a as (select distinct word_i as word from pairs where word_i is not null), b as (select form as word from lexicon), l as (select word, 'left' as side from (select word from a except all select word from b)), r as (select word, 'right' as side from (select word from b except all select word from a)) select side, count(*) as n, min(word) as first from (select * from l union all select * from r) group by 1")
def full_mismatch(spark, d):
    """What the words of the pairs lack of the lexicon's forms, and the other way round."""
    words = table(spark, d, "pairs").select(F.col("word_i").alias("word")).where("word is not null").distinct()
    return Y.mismatches(words, table(spark, d, "lexicon").select(F.col("form").alias("word"))).groupBy("side").agg(F.count("*").alias("n"), F.min("word").alias("first"))


@query(cte("log", "nodes") + " select ar, count(*) as n, 'left' as side from (select distinct unnest(list_transform(top_name_attractors, lambda x: x.ar)) as ar from log) where ar not in (select ar from nodes where ar is not null) group by 1")
def unknown_attractors(spark, d):
    """Attractors that no node is named by: an anti join."""
    seen = log(spark, d).select(F.explode("top_name_attractors.ar").alias("ar")).where("ar is not null").distinct()
    missing = seen.join(nodes(spark, d).select("ar").where("ar is not null"), "ar", "left_anti")
    return missing.groupBy("ar").agg(F.count("*").alias("n")).withColumn("side", F.lit("left"))


_KEYED = "coalesce(term_undiacritized, regexp_replace(term_ar, '[\\x{064B}-\\x{065F}\\x{0670}\\x{0640}]', '', 'g'))"


@query(_REC + f" select min(log_id) as log_id, key from keyed where pipeline is distinct from 'live' and key <> '' and key not in (select {_KEYED} from log where pipeline = 'live' and {_KEYED} is not null) group by key")
def append_unseen(spark, d):
    """What the regenerated records add to the live log."""
    from ..streaming.log import KEY, append_batch

    rows = log(spark, d)
    live = F.col("pipeline").eqNullSafe("live")
    fresh = append_batch(rows.where(live), rows.where(~live), "log_id")
    return fresh.select("log_id", F.col(KEY).alias("key"))


@query(_REC + " select key, count(*) as n from rec where key <> '' group by 1")
def stream_dedupe(spark, d):
    """The log followed as a stream of files: keys stored once."""
    import uuid

    from ..session import shared_folder
    from ..streaming.log import KEY
    from ..streaming.log import append_unseen as follow

    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table(spark, d, "query_log").select("log_id", "term_ar", "term_undiacritized").write.parquet(f"{at}/in")
    q = follow(spark, f"{at}/in", f"{at}/out", f"{at}/state", "log_id long, term_ar string, term_undiacritized string")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(F.col(KEY).alias("key")).agg(F.count("*").alias("n"))
