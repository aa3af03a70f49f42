"""Registered queries on the field: every vector that is no basis name is a term."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import morphology as M
from ..operators import field as E
from ..operators import lookup as Q
from .inputs import basis, cte, nodes, terms
from .recursive import karcher, recursive
from .registry import query
from .text_queries import _letters, _pattern_sql, _re, _sum

_S = (
    cte("basis", "terms")
    + """, mu as (select list(v order by pos) m from (select pos, avg(v) v from (select unnest(vec) v, unnest(range(len(vec))) pos from basis) group by 1)),
 cb as (select b.* replace (list_transform(range(len(b.vec)), lambda i: b.vec[i+1] - mu.m[i+1]) as vec) from basis b, mu),
 ct as (select t.* replace (list_transform(range(len(t.vec)), lambda i: t.vec[i+1] - mu.m[i+1]) as vec) from terms t, mu),
 sims as (select ct.term, ct.label, cb.name, cb.px, cb.py, least(cb.level, 2) as level, cb.root, case when sqrt(list_dot_product(ct.vec, ct.vec))*sqrt(list_dot_product(cb.vec, cb.vec)) <= 1e-10 then 0 else list_dot_product(ct.vec, cb.vec)/(sqrt(list_dot_product(ct.vec, ct.vec))*sqrt(list_dot_product(cb.vec, cb.vec))) end as sim from ct, cb),
 rk as (select *, row_number() over (partition by term order by round(sim, 12) desc, name) rn, row_number() over (partition by term order by round(sim, 12), name desc) rb from sims)"""
)
_MU = ", bs as (select a.name a, b.name b, list_dot_product(a.vec, b.vec)/(sqrt(list_dot_product(a.vec, a.vec))*sqrt(list_dot_product(b.vec, b.vec))) s from cb a, cb b where a.name <> b.name), fz as (select a as name, avg(s) mu from bs group by 1)"

_PLACE = ", tops as (select term as key, px as x, py as y, sim as w from rk where rn <= 5 and term in (select term from rk where rn <= 5 group by 1 having max(sim) > 0)), " + karcher("tops", "kp") + ", placed as (select t.term, coalesce(kp.x, 0) as x, coalesce(kp.y, 0) as y from (select distinct term from rk) t left join kp on kp.key = t.term)"


def _scored(spark, d):
    b = E.Basis(basis(spark, d))
    return b, E.profiles(terms(spark, d), b)


@query(_S + " select unnest(range(len(m))) as pos, round(unnest(m), 6) as value from mu")
def centroid(spark, d):
    """The mean vector of the basis."""
    mean = E.array_mean(basis(spark, d).select(F.lit(1).alias("g"), "vec"), ["g"])
    return mean.select(F.posexplode("vec").alias("pos", "value")).select("pos", F.round("value", 6).alias("value"))


@query("with v as (select vec_id, embedding::double[] e from embeddings) select a.vec_id, round(list_dot_product(a.e, b.e)/(sqrt(list_dot_product(a.e, a.e))*sqrt(list_dot_product(b.e, b.e))), 6) as cosine from v a join v b on b.vec_id = a.vec_id + 1")
def cosine_raw(spark, d):
    """Cosines of consecutive vectors."""
    from ..session import table

    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id").select("vec_id", F.round(E.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query(_S + " select term, name, round(sim, 6) as sim from sims")
def cosine_centered(spark, d):
    """All similarities of terms with the names."""
    b, s = _scored(spark, d)
    names = F.array(*[F.lit(n) for n in b.names])
    return s.select("term", F.posexplode("sims").alias("at", "sim")).select("term", F.get(names, F.col("at")).alias("name"), F.round("sim", 6).alias("sim"))


@query(_S + " select term, name, rn as rank, round(sim, 6) as sim from rk where rn <= 5")
def profile_topk(spark, d):
    """The five attractors of every term."""
    b, s = _scored(spark, d)
    top = s.select("term", F.posexplode(F.slice(E.ranked(F.col("sims"), b), 1, 5)).alias("at", "n"))
    return top.select("term", "n.name", (F.col("at") + 1).alias("rank"), F.round("n.sim", 6).alias("sim"))


@query(_S + " select term, name, 4 - rb as rank, round(sim, 6) as sim from rk where rb <= 3")
def profile_bottom(spark, d):
    """The three most repelled names of every term in descending similarity."""
    b, s = _scored(spark, d)
    low = s.select("term", F.posexplode(F.slice(E.ranked(F.col("sims"), b), -3, 3)).alias("at", "n"))
    return low.select("term", "n.name", (F.col("at") + 1).alias("rank"), F.round("n.sim", 6).alias("sim"))


@query(_S + _MU + " select name, round(mu, 6) as mu from fz")
def field_zero_basis(spark, d):
    """The mean similarity of every name to the other names."""
    b = E.Basis(basis(spark, d))
    return spark.createDataFrame([(int(n), round(float(m), 6)) for n, m in zip(b.names, b.field_zero())], "name long, mu double")


@query(_S + " select name, round(avg(sim), 6) as mu from sims group by 1")
def field_zero_queries(spark, d):
    """The mean similarity of every name over all terms; sums are made per batch and merged, no similarity leaves its row."""
    b, s = _scored(spark, d)
    gram = E.profile_gram(s, len(b.names))
    total, count = gram[-1, :-1], gram[-1, -1]
    return spark.createDataFrame([(int(n), round(float(t / count), 6)) for n, t in zip(b.names, total)] if count else [], "name long, mu double")


_C = _S + _MU + ", ce as (select term, name, sim - mu as c, row_number() over (partition by term order by round(sim - mu, 12) desc, name) rn, row_number() over (partition by term order by round(sim - mu, 12), name desc) rb from sims join fz using (name))"


@query(_C + " select term, name, rn as rank, round(c, 6) as sim from ce where rn <= 5")
def profile_centered(spark, d):
    """The five attractors after subtracting the field's own mean."""
    b, s = _scored(spark, d)
    zero = F.array(*[F.lit(float(m)) for m in b.field_zero()])
    top = s.select("term", F.posexplode(F.slice(E.ranked(F.zip_with("sims", zero, lambda x, m: x - m), b), 1, 5)).alias("at", "n"))
    return top.select("term", "n.name", (F.col("at") + 1).alias("rank"), F.round("n.sim", 6).alias("sim"))


@query(_C + ", n as (select sqrt(sum(mu*mu)) z from fz), r as (select term, list(name order by rn) l, list(name order by rb) q from (select term, name, rn, rb from rk) group by 1), c as (select term, list(name order by rn) l, list(name order by rb) q from ce group by 1) select r.term, r.l[1:5] as attractors, r.q[1:3] as repelled, c.l[1:5] as attractors_centered, c.q[1:3] as repelled_centered, round(n.z, 6) as mu_norm from r join c using (term), n")
def attractors_and_repelled(spark, d):
    """Raw and centered rankings side by side, the most repelled name first, and the norm of the field's mean."""
    b, s = _scored(spark, d)
    mu = b.field_zero()
    zero = F.array(*[F.lit(float(m)) for m in mu])
    wide = s.select("term", E.ranked(F.col("sims"), b)["name"].alias("raw"), E.ranked(F.zip_with("sims", zero, lambda x, m: x - m), b)["name"].alias("cen"))
    low = lambda c: F.reverse(F.slice(c, -3, 3))
    return wide.select("term", F.slice("raw", 1, 5).alias("attractors"), low("raw").alias("repelled"), F.slice("cen", 1, 5).alias("attractors_centered"), low("cen").alias("repelled_centered"), F.lit(round(float((mu**2).sum() ** 0.5), 6)).alias("mu_norm"))


@query(_S + " select name, round(count(*) filter (where rn <= 5)/(select count(*) from terms), 4) as share from rk group by 1 having count(*) filter (where rn <= 5) > 0")
def hub_concentration(spark, d):
    """The share of terms that have a name among their five attractors."""
    b, s = _scored(spark, d)
    top = s.select(F.explode(F.slice(E.ranked(F.col("sims"), b), 1, 5)["name"]).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    total = s.where("sims is not null").count()
    return top.select("name", F.round(F.col("n") / F.lit(total), 4).alias("share"))


def _vote_sql(column: str) -> str:
    return _S + f", v as (select term, {column} as value, sum(greatest(sim, 0)) votes, min(rn) first from rk where rn <= 5 group by 1, 2) select term, value as {'tier' if column == 'level' else 'pattern'} from (select *, row_number() over (partition by term order by votes desc, first) k from v) where k = 1"


@query(_vote_sql("level"))
def tier_vote(spark, d):
    b, s = _scored(spark, d)
    return s.select("term", F.slice(E.ranked(F.col("sims"), b), 1, 5).alias("top")).select("term", E.vote(F.col("top"), "level").alias("tier"))


@query(_vote_sql("root"))
def pattern_vote(spark, d):
    b, s = _scored(spark, d)
    return s.select("term", F.slice(E.ranked(F.col("sims"), b), 1, 5).alias("top")).select("term", E.vote(F.col("top"), "root").alias("pattern"))


@query(recursive(_S) + _PLACE + " select term, round(x, 4) + 0 as px, round(y, 4) + 0 as py, round(sqrt(x*x+y*y), 4) as r from placed")
def place_term(spark, d):
    """The barycentre of the attractors of every term."""
    p = E.placed_profiles(terms(spark, d), E.Basis(basis(spark, d)))
    return p.select("term", (F.round("place.x", 4) + 0.0).alias("px"), (F.round("place.y", 4) + 0.0).alias("py"), F.round("place.r", 4).alias("r"))


@query(_S + ", w as (select term, sum(greatest(sim, 0)) t, sum(greatest(sim, 0)*px) x, sum(greatest(sim, 0)*py) y from rk where rn <= 5 group by 1) select term, round(case when t > 0 then x/t else 0 end, 5) as px, round(case when t > 0 then y/t else 0 end, 5) as py from w")
def place_term_euclid(spark, d):
    b, s = _scored(spark, d)
    p = s.select("term", F.slice(E.ranked(F.col("sims"), b), 1, 5).alias("top")).select("term", E.placed_euclid(F.col("top")).alias("p"))
    return p.select("term", F.round("p.x", 5).alias("px"), F.round("p.y", 5).alias("py"))


_SENTINEL = "case when (1-(p.x*p.x+p.y*p.y))*(1-(f.px*f.px+f.py*f.py)) <= 1e-10::double then 9.99::double else acosh(greatest(1.0::double, 1+2*((p.x-f.px)*(p.x-f.px)+(p.y-f.py)*(p.y-f.py))/((1-(p.x*p.x+p.y*p.y))*(1-(f.px*f.px+f.py*f.py))))) end"


def _lookup(spark, d):
    b = E.Basis(basis(spark, d))
    return Q.lookup(terms(spark, d), b, b.field_zero().tolist())


@query(recursive(_S) + _PLACE + f" select p.term, round({_SENTINEL}, 4) as dist_to_primary from placed p join rk f on f.term = p.term and f.rn = 1")
def dist_to_primary(spark, d):
    """The distance from a term's place to its first attractor."""
    return _lookup(spark, d).select("term", "dist_to_primary")


_OWN = "own as (select e.vec_id as log_id, n.ar as term_ar from embeddings e left join nodes n on n.node_id = e.vec_id where e.vec_id >= 99)"
_BREAK = f"""array_to_string(list_transform(list_filter({_letters('bare')}, lambda x: list_contains([{', '.join(repr(k) for k in L.ABJAD)}], x)), lambda x: x || '=' || list_extract([{', '.join(str(v) for v in L.ABJAD.values())}], list_position([{', '.join(repr(k) for k in L.ABJAD)}], x))::varchar), ' + ') || ' = ' || {_sum('bare', L.ABJAD)}::varchar"""
_FULL_MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{0640}]"
_LOOKUP = (
    recursive(_S) + _MU + _PLACE + ", nodes as (select distinct node_id, ar from poincare_data_v3), " + _OWN + _pattern_sql("own", "")
    + """, ce as (select term, name, sim - mu as c, row_number() over (partition by term order by round(sim - mu, 12) desc, name) rn, row_number() over (partition by term order by round(sim - mu, 12), name desc) rb from sims join fz using (name)),
 ra as (select term, list(name order by rn) filter (where rn <= 5) as top_names, list(name order by rb desc) filter (where rb <= 3) as bottom_names, list(round(sim, 4) + 0 order by rn) filter (where rn <= 5) as top_sims from rk group by 1),
 ca as (select term, list(name order by rn) filter (where rn <= 5) as attractors_centered, list(name order by rb desc) filter (where rb <= 3) as repelled_centered from ce group by 1),
 lv as (select term, level from (select *, row_number() over (partition by term order by votes desc, first) k from (select term, level, sum(greatest(sim, 0)) votes, min(rn) first from rk where rn <= 5 group by 1, 2)) where k = 1),
 rv as (select term, root from (select *, row_number() over (partition by term order by votes desc, first) k from (select term, root, sum(greatest(sim, 0)) votes, min(rn) first from rk where rn <= 5 group by 1, 2)) where k = 1),
 mn as (select sqrt(sum(mu*mu)) z from fz)"""
    + f""", tx as (select log_id, term_ar, {_re('term_ar', _FULL_MARKS)} as bare from own)
 select p.term, tx.term_ar, case when term_ar is null then null else {_sum('bare', L.ABJAD)} end as value, {_BREAK} as breakdown, s.status as query_wazn_status,
  case s.status when 'parsed' then cand[1] when 'ambiguous_vocalization' then array_to_string(best, ' / ') when 'ambiguous_structure' then array_to_string(cand[1:4], ' / ') end as query_wazn,
  ra.top_names, ra.top_sims, ra.bottom_names, ca.attractors_centered, ca.repelled_centered, round(p.x, 4) + 0 as px, round(p.y, 4) + 0 as py, round(sqrt(p.x*p.x+p.y*p.y), 4) as r, lv.level,
  case lv.level when 0 then 'Dhāt' when 1 then 'Ṣifāt' else 'Afʿāl' end as level_label, rv.root as cluster_pattern, round({_SENTINEL}, 4) as dist_to_primary, round(mn.z, 6) as mu_norm
 from placed p join rk f on f.term = p.term and f.rn = 1 join ra on ra.term = p.term join ca on ca.term = p.term join lv on lv.term = p.term join rv on rv.term = p.term join tx on tx.log_id = p.term left join s on s.log_id = p.term, mn"""
)


@query(_LOOKUP)
def philological_lookup(spark, d):
    """The whole profile of every term: its own letters and pattern, its attractors raw and centered, its place; a term's text is the name of the node of its id."""
    b = E.Basis(basis(spark, d))
    mu = b.field_zero()
    found = Q.lookup(terms(spark, d), b, mu.tolist())
    texts = nodes(spark, d).select(F.col("node_id").alias("term"), F.col("ar").alias("term_ar"))
    own = found.join(texts, "term", "left").withColumns({"letters": Q.letters_of(F.col("term_ar")), "own": M.parse_pattern(F.col("term_ar"))})
    named = lambda c: F.transform(c, lambda t: t["name"])
    place = F.col("position")
    return own.select(
        "term", "term_ar", F.col("letters.value").alias("value"), F.col("letters.breakdown").alias("breakdown"), F.when(F.col("term_ar").isNotNull(), F.col("own.query_wazn_status")).alias("query_wazn_status"), F.when(F.col("term_ar").isNotNull(), F.col("own.query_wazn")).alias("query_wazn"),
        named("top_names").alias("top_names"), F.transform("top_names", lambda t: t["sim"] + 0.0).alias("top_sims"), named("bottom_names").alias("bottom_names"), named("attractors_centered").alias("attractors_centered"), named("repelled_centered").alias("repelled_centered"),
        (place["px"] + 0.0).alias("px"), (place["py"] + 0.0).alias("py"), place["r"].alias("r"), place["level"].alias("level"), place["level_label"].alias("level_label"), "cluster_pattern", "dist_to_primary", F.lit(round(float((mu**2).sum() ** 0.5), 6)).alias("mu_norm"),
    )


@query()
def reproject_all(spark, d):
    """Every term scored again, in the form of log records; unscorable vectors are left out."""
    found = _lookup(spark, d)
    return found.select(F.col("term").cast("string").alias("term_ar"), F.transform("top_names", lambda t: F.struct(t["name"].cast("string").alias("ar"), t["sim"].alias("sim"))).alias("top_name_attractors"), F.transform(F.reverse("bottom_names"), lambda t: F.struct(t["name"].cast("string").alias("ar"), t["sim"].alias("sim"))).alias("bottom_names"), F.col("position").alias("estimated_position"), F.col("cluster_pattern").cast("string").alias("cluster_wazn"), F.col("dist_to_primary").alias("poincare_dist_to_primary"), F.lit("v3-regen").alias("pipeline"))


@query("select label, pos, round(avg(v), 6) as value from (select label, unnest(embedding::double[]) v, unnest(range(len(embedding))) pos from embeddings) group by 1, 2")
def embed_pool(spark, d):
    """Vectors pooled by label."""
    from ..session import table

    pooled = E.array_mean(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec")), ["label"])
    return pooled.select("label", F.posexplode("vec").alias("pos", "value")).select("label", "pos", F.round("value", 6).alias("value"))


@query(_S + ", ns as (select a.name a, b.name b, list_dot_product(a.vec, b.vec)/((sqrt(list_dot_product(a.vec, a.vec))+1e-12::double)*(sqrt(list_dot_product(b.vec, b.vec))+1e-12::double)) s from cb a, cb b) select a, b, round(s, 6) as sim from ns")
def cos_matrix(spark, d):
    """Similarities of the names with each other."""
    b = E.Basis(basis(spark, d))
    s = b.centered(b.matrix)
    return spark.createDataFrame([(int(x), int(y), round(float(s[i, j]), 6)) for i, x in enumerate(b.names) for j, y in enumerate(b.names)], "a long, b long, sim double")


@query(_S + ", ns as (select list_dot_product(a.vec, b.vec)/((sqrt(list_dot_product(a.vec, a.vec))+1e-12::double)*(sqrt(list_dot_product(b.vec, b.vec))+1e-12::double)) s from cb a, cb b where a.name < b.name) select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std from ns")
def similarity_spread(spark, d):
    """Mean and deviation over the upper triangle."""
    import numpy as np

    b = E.Basis(basis(spark, d))
    s = b.centered(b.matrix)[np.triu_indices(len(b.names), 1)]
    return spark.createDataFrame([(round(float(s.mean()), 6), round(float(s.std()), 6))], "mean double, std double")


@query(_S + ", ns as (select a.name a, b.name b, list_dot_product(a.vec, b.vec)/((sqrt(list_dot_product(a.vec, a.vec))+1e-12::double)*(sqrt(list_dot_product(b.vec, b.vec))+1e-12::double)) s from cb a, cb b where a.name <> b.name), k as (select *, row_number() over (partition by a order by round(s, 12) desc, b) rn, row_number() over (partition by a order by round(s, 12), b desc) rb from ns) select a as name, b as other, case when rn <= 5 then 'attract' else 'oppose' end as kind, round(case when rn <= 5 then greatest(s, 0.05::double) else 0.6::double end, 6) as weight from k where rn <= 5 or rb <= 3")
def knn_repulsion_lists(spark, d):
    """Five attracting and three opposing names of every name."""
    from ..operators.layout import edges

    b = E.Basis(basis(spark, d))
    rows = [(int(b.names[i]), int(b.names[j]), kind, round(float(w), 6)) for i, j, kind, w in edges(b.centered(b.matrix))]
    return spark.createDataFrame(rows, "name long, other long, kind string, weight double")


def _fit_sql() -> str:
    import numpy as np

    from ..operators.layout import LEAST_PULL, PUSH, RADII, RATE, SEED, SPREAD, STEPS

    rng = np.random.default_rng(SEED)
    start = ", ".join(repr(float(x)) + "::double" for x in rng.uniform(0, 2 * np.pi, 99))
    spread = ", ".join(repr(float(x)) + "::double" for x in rng.random(99))
    return recursive(_S) + f""", ns as (select a.name a, b.name b, list_dot_product(a.vec, b.vec)/((sqrt(list_dot_product(a.vec, a.vec)))*(sqrt(list_dot_product(b.vec, b.vec)))) s from cb a, cb b where a.name <> b.name), rk2 as (select *, row_number() over (partition by a order by round(s, 12) desc, b) rn, row_number() over (partition by a order by round(s, 12), b desc) rb from ns),
 ed as (select a, list({{'b': b + 1, 'w': case when rn <= 5 then greatest(s, {LEAST_PULL}::double) else -{PUSH}::double end}} order by rn) as e from rk2 where rn <= 5 or rb <= 3 group by 1), el as (select list(e order by a) as es from ed),
 st as (select [{start}] as t, 0 as it union all select list_transform(range(1, 100), lambda i: t[i] + {RATE}::double*list_sum(list_transform(es[i], lambda x: x.w*sin(t[x.b]-t[i])))) as t, it + 1 as it from st, el where it < {STEPS}),
 en as (select arg_max(t, it) as t from st), ps as (select name, least(level, 2) as level, t[name + 1] as t, [{', '.join(f'{r}::double' for r in RADII)}][least(level, 2) + 1] + {SPREAD}::double*([{spread}][name + 1] - 0.5::double) as r from basis, en)
 select name, round(round(r*cos(t), 4), 3) + 0 as px, round(round(r*sin(t), 4), 3) + 0 as py, round(r, 4) as r, level from ps"""


@query(_fit_sql())
def fit_disk(spark, d):
    """Angles fitted so that similar names lie close, at the fixed radii of their levels."""
    from ..operators.layout import fitted

    placed = fitted(spark, E.Basis(basis(spark, d)))
    return placed.select("name", (F.round("px", 3) + 0.0).alias("px"), (F.round("py", 3) + 0.0).alias("py"), "r", "level")


@query(_S + ", w as (select term, sum(greatest(sim, 0)) t, sum(greatest(sim, 0)*px) x, sum(greatest(sim, 0)*py) y from rk where rn <= 5 group by 1), p as (select term, case when t > 0 then x/t else 0 end px, case when t > 0 then y/t else 0 end py from w), o as (select name, px, py from basis), j as (select b.name, sqrt((o.px-b.px2)*(o.px-b.px2)+(o.py-b.py2)*(o.py-b.py2)) as moved from (select (term % 99) as name, avg(px) px2, avg(py) py2 from p group by 1) b join o using (name)) select name, round(moved, 5) as moved from j")
def disk_movement(spark, d):
    """How far the mean place of the terms folded onto a name lies from the name."""
    b, s = _scored(spark, d)
    p = s.select((F.col("term") % 99).alias("name"), F.slice(E.ranked(F.col("sims"), b), 1, 5).alias("top")).select("name", E.placed_euclid(F.col("top")).alias("p"))
    new = p.groupBy("name").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    old = basis(spark, d).select("name", "px", "py")
    return new.join(F.broadcast(old), "name").select("name", F.round(F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2), 5).alias("moved"))


_OPP = _S + ", ns as (select a.name a, b.name b, list_dot_product(a.vec, b.vec)/((sqrt(list_dot_product(a.vec, a.vec))+1e-12::double)*(sqrt(list_dot_product(b.vec, b.vec))+1e-12::double)) s from cb a, cb b where a.name <> b.name), op as (select a, b, s from (select *, row_number() over (partition by a order by round(s, 12), b desc) rb from ns) where rb <= 3)"


@query(_OPP + " select b as other, count(*) as in_degree from op group by 1")
def opposition_stats(spark, d):
    """Opposition edges (each name to its least similar names): in-degree of every name that has one."""
    e = knn_repulsion_lists(spark, d).where("kind = 'oppose'")
    return e.groupBy("other").agg(F.count("*").alias("in_degree"))


_OTHERS = ", pick as (select k, ('0x' || substr(md5('opposed-' || k || '-a'), 1, 8))::bigint % m as x, ('0x' || substr(md5('opposed-' || k || '-b'), 1, 8))::bigint % (m - 1) as y from range(1000) t(k), (select count(*) m from basis)), od as (select name, row_number() over (order by name) - 1 as at from basis), rd as (select p.name as a, q.name as b from pick join od p on p.at = x join od q on q.at = y + (y >= x)::int)"
_TURN = "case when abs(atan2(p.py, p.px)-atan2(q.py, q.px)) > pi() then 2*pi()-abs(atan2(p.py, p.px)-atan2(q.py, q.px)) else abs(atan2(p.py, p.px)-atan2(q.py, q.px)) end"


@query(_OPP + _OTHERS + f""", al as (select 'opposed' as kind, a, b from op union all select 'random', a, b from rd), pc as (select x.name as a, y.name as b, corr(x.sim, y.sim) c from sims x join sims y using (term) where x.name <> y.name group by 1, 2)
 select kind, count(*) as pairs, round(avg(degrees({_TURN})), 3) as mean_angle, round(avg(pc.c), 5) as profile_correlation, round(avg(ns.s), 5) as mean_similarity from al join basis p on p.name = al.a join basis q on q.name = al.b join pc using (a, b) join ns using (a, b) group by 1""")
def opposition_angles(spark, d):
    """Opposed names against a thousand seeded pairs of names: angle on the disk, correlation of their columns of term profiles, similarity.

    Correlations come from one matrix of sums over all terms, made per batch; names are the 99 of the basis.
    """
    import numpy as np

    from ..operators.layout import edges
    from ..operators.stats import seeded

    b, s = _scored(spark, d)
    n = len(b.names)
    gram = E.profile_gram(s, n)  # sums, products and count of the columns
    count, total, product = gram[-1, -1], gram[-1, :-1], gram[:-1, :-1]
    cov = product / count - np.outer(total, total) / count**2
    spread = np.sqrt(np.diag(cov))
    corr = cov / np.outer(spread, spread)
    sims = b.centered(b.matrix)
    turn = np.abs(np.subtract.outer(np.arctan2(b.py, b.px), np.arctan2(b.py, b.px)))
    turn = np.degrees(np.where(turn > np.pi, 2 * np.pi - turn, turn))
    opposed = [(i, j) for i, j, kind, _ in edges(sims) if kind == "oppose"]
    drawn = []
    for k in range(1000 if n > 1 else 0):
        x, y = seeded(f"opposed-{k}-a") % n, seeded(f"opposed-{k}-b") % (n - 1)
        drawn.append((x, y + (y >= x)))
    rows = []
    for kind, listed in (("opposed", opposed), ("random", drawn)):
        i, j = np.array(listed, dtype=int).reshape(-1, 2).T
        if len(i):
            rows.append((kind, len(i), round(float(turn[i, j].mean()), 3), round(float(corr[i, j].mean()), 5), round(float(sims[i, j].mean()), 5)))
    return spark.createDataFrame(rows, "kind string, pairs long, mean_angle double, profile_correlation double, mean_similarity double")


@query(_S + ", s as (select term, max(sim) filter (where name = 0) a, max(sim) filter (where name = 1) b, max(sim) filter (where name = 2) c, max(sim) filter (where name = 3) e from sims group by 1) select term, round(a - b, 6) as axis_1, round(c - e, 6) as axis_2 from s")
def profile_axis_projection(spark, d):
    """Terms on two axes, each the difference of two names."""
    b, s = _scored(spark, d)
    sim = lambda n: F.get("sims", F.lit(b.names.index(n)))
    return s.select("term", F.round(sim(0) - sim(1), 6).alias("axis_1"), F.round(sim(2) - sim(3), 6).alias("axis_2"))


@query(_S + ", k as (select term, name, row_number() over (partition by term order by round(sim, 12) desc, name) r10, row_number() over (partition by term order by round(abs(sim), 12) desc, name) a10 from sims), j as (select term, count(*) filter (where r10 <= 10 and a10 <= 10) i, count(*) filter (where r10 <= 10 or a10 <= 10) u from k group by 1) select term, round(i/u, 6) as jaccard from j")
def neighborhood_jaccard(spark, d):
    """Overlap of the ten most similar names with the ten of largest similarity of either sign."""
    b, s = _scored(spark, d)
    sets = s.select("term", F.slice(E.ranked(F.col("sims"), b), 1, 10)["name"].alias("a"), F.slice(E.ranked(F.transform("sims", F.abs), b), 1, 10)["name"].alias("b"))
    return sets.select("term", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query(_S + ", h as (select name, count(*) filter (where rn <= 5) n from rk group by 1), k as (select n, row_number() over (order by n, name) i, count(*) over () m, sum(n) over () t from h) select round(sum((2*i-m-1)*n)/(max(m)*max(t)), 6) as gini from k")
def occupancy_gini(spark, d):
    """How unevenly attractors are spread over the names."""
    b, s = _scored(spark, d)
    names = spark.createDataFrame([(int(n),) for n in b.names], "name long")
    top = s.select(F.explode(F.slice(E.ranked(F.col("sims"), b), 1, 5)["name"]).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    counts = names.join(top, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    whole = counts.agg(F.array_sort(F.collect_list("n")).alias("n"))  # one number a name
    weighted = F.aggregate(F.transform("n", lambda x, i: (2 * (i + 1) - F.size("n") - 1) * x), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return whole.select(F.round(weighted / (F.size("n") * F.aggregate("n", F.lit(0).cast("long"), lambda acc, x: acc + x)), 6).alias("gini"))
