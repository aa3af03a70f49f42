"""Registered queries of the statistics workbench. Families are the labels of vectors, patterns their ids modulo six."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import text as T
from ..operators import field as E
from ..operators import stats as S
from ..session import shared_folder, table, written
from .inputs import cte, documents, pairs, passages
from .registry import query
from .text_queries import _clean_arabic, _sum

_V = "v as (select vec_id, label, vec_id % 6 as pattern, embedding::double[] as e from embeddings)"
_LIFT = f"""tk as (select doc_id, list_filter(string_split({_clean_arabic('text')}, ' '), lambda t: t <> '') as t from documents), w as (select doc_id, unnest(range(0, len(t)-40, 20)) as k, t from tk where len(t) > 40),
 h as (select row_number() over () as w, list_distinct(t[k+1:k+40]) as words from w), n as (select count(*) n from h), kn as (select w, word from (select w, unnest(words) as word from h) where word in (select form from lexicon)),
 sg as (select word, count(*) c from kn group by 1), pr as (select a.word w1, b.word w2, count(*) n from kn a join kn b on a.w = b.w and a.word < b.word group by 1, 2 having count(*) >= 2),
 lf as (select w1, w2, pr.n, (pr.n/n.n)/((x.c/n.n)*(y.c/n.n)+1e-10::double) as lift from pr join sg x on x.word = w1 join sg y on y.word = w2, n)"""


def _lift(spark, d) -> DataFrame:
    vocabulary = table(spark, d, "lexicon").select(F.col("form").alias("word"))
    return S.lift(documents(spark, d).where(F.col("text").rlike("[\\u0600-\\u06FF]")), T.tokenize("text"), vocabulary)  # other texts have no token


@query("with " + _LIFT + " select w1, w2, n, round(lift, 4) as lift from lf")
def cooccurrence_lift(spark, d):
    return _lift(spark, d).select("w1", "w2", "n", F.round("lift", 4).alias("lift"))


@query(cte("passages") + f""", s as (select id, unnest(regexp_split_to_array(text, '[.\\n\\x{{060C}}\\x{{061B}}\\x{{061F}}]+')) as s from psg), c as (select row_number() over () as sid, {_clean_arabic('s')} as s from s), t as (select sid, list_filter(string_split(s, ' '), lambda t: t <> '') as t from c), k as (select * from t where len(t) between 6 and 80),
 e as (select sid, unnest(t) as w, unnest(range(len(t))) as pos from k), v as (select sid, w, pos, {_sum('w', L.ABJAD)} as value from e)
 select b.pos - a.pos as pos_distance, count(*) as n, sum(abs(a.value-b.value))::bigint as total from v a join v b on a.sid = b.sid and a.pos < b.pos group by 1""")
def word_pairs(spark, d):
    """Pairs of words of a sentence with the difference of their values, summed by how far apart they stand."""
    s = passages(spark, d).select(F.explode(T.split_sentences("text")).alias("s")).select(T.tokens_of(F.col("s")).alias("t"))
    each = s.select(F.explode(S.sentence_pairs(F.col("t"), L.letter_value)).alias("p"))
    return each.groupBy("p.pos_distance").agg(F.count("*").alias("n"), F.sum("p.value_distance").alias("total"))


_BIN = "case " + " ".join(f"when value_distance <= {end} then '{name}'" for end, name in S.BINS) + f" else '{S.LAST_BIN}' end"


@query(cte("pairs") + f", b as (select {_BIN} as bin, mean_attention a from prs where root_relation = 'different' and value_distance is not null and mean_attention is not null), x as (select unnest([{', '.join(repr(n) for _, n in S.BINS)}, '{S.LAST_BIN}']) as bin) select x.bin, count(a) as n, round(avg(a), 6) as mean, round(median(a), 6) as median, round(stddev_pop(a), 6) as std from x left join b using (bin) group by 1")
def distance_bins(spark, d):
    b = S.binned(pairs(spark, d).where("root_relation = 'different'"), "value_distance", "mean_attention")
    return b.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query(cte("pairs") + " select root_relation, count(*) as n from prs where root_relation in ('different', 'same') group by 1 union all select 'all', count(*) from prs")
def select_group(spark, d):
    p = pairs(spark, d)
    return p.where("root_relation in ('different', 'same')").groupBy("root_relation").agg(F.count("*").alias("n")).unionByName(p.agg(F.count("*").alias("n")).withColumn("root_relation", F.lit("all")))


_RANKS = cte("pairs") + ", k as (select value_distance::double a, mean_attention b from prs where root_relation = 'different' and value_distance is not null and mean_attention is not null), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1)/2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1)/2.0::double rb from k)"


@query(_RANKS + " select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def spearman_raw(spark, d):
    return S.spearman(pairs(spark, d).where("root_relation = 'different'"), "value_distance", "mean_attention").select(F.round("rho", 6).alias("rho"), "n")


@query()
def partial_spearman(spark, d):
    """The partial rank correlation of value distance and attention given position distance and lift."""
    known = S.with_lift(pairs(spark, d).where("root_relation = 'different'"), _lift(spark, d))
    r = S.partial_spearman(known, "value_distance", "mean_attention", ["pos_distance", "cooc"])
    return r.select(F.round("rho", 5).alias("rho"), "n", F.round("p", 5).alias("p"), "error")


_HASH = lambda text: f"('0x' || substr(md5({text}), 1, 8))::bigint"
_PARTIAL = cte("pairs") + ", " + _LIFT + """, k as (select value_distance::double t, mean_attention o, pos_distance::double x, coalesce(lift, 0) y from prs left join lf on w1 = least(word_i, word_j) and w2 = greatest(word_i, word_j) where root_relation = 'different' and value_distance is not null and mean_attention is not null and pos_distance is not null),
 cv as (select covar_pop(x, x) xx, covar_pop(x, y) xy, covar_pop(y, y) yy, covar_pop(t, x) tx, covar_pop(t, y) ty, covar_pop(o, x) ox, covar_pop(o, y) oy, avg(t) mt, avg(o) mo, avg(x) mx, avg(y) my from k),
 bs as (select *, (tx*yy-ty*xy)/(xx*yy-xy*xy) b1, (ty*xx-tx*xy)/(xx*yy-xy*xy) b2, (ox*yy-oy*xy)/(xx*yy-xy*xy) c1, (oy*xx-ox*xy)/(xx*yy-xy*xy) c2 from cv), z as (select round(t-mt-b1*(x-mx)-b2*(y-my), 12) a, round(o-mo-c1*(x-mx)-c2*(y-my), 12) b from k, bs),
 r as (select rank() over (order by a) + (count(*) over (partition by a) - 1)/2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1)/2.0::double rb from z), pr2 as (select corr(ra, rb) c, count(*) n from r)"""


@query(_PARTIAL + " select round(c, 4) as rho, n from pr2")
def partial_rho(spark, d):
    """The same, to the digits that two ways of solving agree on."""
    return _observed_frame(spark, d).select(F.round("rho", 4).alias("rho"), "n")


@query(cte("pairs") + """, k as (select value_distance::double t, mean_attention o, pos_distance::double x from prs where root_relation = 'same' and value_distance is not null and mean_attention is not null and pos_distance is not null),
 f as (select regr_slope(t, x) bt, regr_intercept(t, x) at_, regr_slope(o, x) bo, regr_intercept(o, x) ao from k), z as (select round(t-at_-bt*x, 12) a, round(o-ao-bo*x, 12) b from k, f),
 r as (select rank() over (order by a) + (count(*) over (partition by a) - 1)/2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1)/2.0::double rb from z) select round(corr(ra, rb), 4) as rho, count(*) as n from r""")
def partial_spearman_position(spark, d):
    """The same for pairs of one root, given position alone."""
    r = S.partial_spearman(pairs(spark, d).where("root_relation = 'same'"), "value_distance", "mean_attention", ["pos_distance"])
    return r.select(F.round("rho", 4).alias("rho"), "n")


@query()
def permuted_mapping(spark, d):
    """Twenty seeded permutations of the letter values."""
    rows = [(k, c, v) for k, m in enumerate(S.permuted_mappings(20)) for c, v in m.items()]
    return spark.createDataFrame(rows, "perm int, letter string, value int")


def _cross(spark, d) -> DataFrame:
    return pairs(spark, d).where("root_relation = 'different'")


DRAWS = 1000
#: Lifts that a partition of a join holds as a hash table.
HASHED = 200_000
CONTROLS = ["pos_distance", "cooc"]


def _controlled(spark, d) -> DataFrame:
    """Pairs across roots with their lift, written once for the observed value and the null."""
    lifts = written(_lift(spark, d), "lifts")
    small = lifts.count() <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, d, "pairs").select("pair_id", "word_i", "word_j", "pos_distance", "value_distance", "mean_attention", (F.col("root_relation") == "different").alias("across"))
    return written(S.with_lift(S.once(p, "pair_id").where("across"), lifts, small).select("word_i", "word_j", "value_distance", "mean_attention", *CONTROLS), "controlled-pairs")


def _observed_frame(spark, d) -> DataFrame:
    return S.partial_spearman(_controlled(spark, d), "value_distance", "mean_attention", CONTROLS)


def _observed(known: DataFrame):
    return S.partial_spearman(known, "value_distance", "mean_attention", CONTROLS).first()


@query()
def permutation_null(spark, d):
    """Partial rank correlations under a thousand permutations of the letter values."""
    return S.partial_null(_controlled(spark, d), S.permuted_mappings(DRAWS), CONTROLS).select("perm", F.round("rho", 6).alias("rho"))


@query(f"""with w as (select distinct word_i as w from pairs where word_i is not null), c as (select letter, count(*) n from (select unnest(string_split(translate(w, 'أإآىةؤئٱـ', 'ااايتويا'), '')) as letter from w) group by 1), a as (select unnest([{', '.join(repr(c) for c in L.ABJAD_BASE)}]) as letter, unnest(range(28)) as place)
 select letter, coalesce(n, 0) as n, ntile(4) over (order by coalesce(n, 0) desc, place)::int as bin from a left join c using (letter)""")
def freq_tier_bins(spark, d):
    return S.frequency_bins(table(spark, d, "pairs"), "word_i", 4)


@query()
def freq_matched_null(spark, d):
    """The null of permutations within letters of like frequency, summed up against the observed correlation."""
    bins: dict[int, list[str]] = {}
    for r in freq_tier_bins(spark, d).orderBy("bin", F.col("n").desc(), "letter").collect():  # 28 letters
        bins.setdefault(r.bin, []).append(r.letter)
    known = _controlled(spark, d)
    nulls = S.partial_null(known, S.permuted_mappings(DRAWS, bins=list(bins.values())), CONTROLS)
    observed = _observed(known).rho or 0.0
    return S.null_summary(nulls, observed, plus_one=True)


@query()
def null_summary(spark, d):
    """The unrestricted null summed up."""
    known = _controlled(spark, d)
    return S.null_summary(S.partial_null(known, S.permuted_mappings(DRAWS), CONTROLS), _observed(known).rho or 0.0)


@query()
def checkpoint_resume(spark, d):
    """A thousand permutations, of which the first ten are found stored when the second run begins."""
    import uuid

    at = f"{shared_folder(spark).rstrip('/')}/nulls-{uuid.uuid4().hex}"
    known = _controlled(spark, d)
    folded = S.FoldedPairs(known, CONTROLS)
    S.resumed(at, S.permuted_mappings(DRAWS)[:10], known, CONTROLS, folded)
    return S.resumed(at, S.permuted_mappings(DRAWS), known, CONTROLS, folded).select("perm", F.round("rho", 6).alias("rho"))


_SCRAMBLED = _PARTIAL + f""", sx as (select *, row_number() over (order by h, pair_id) - 1 as k from (select pair_id, word_i, word_j, mean_attention, pos_distance, {_HASH("'42-' || pair_id")} as h from prs where root_relation = 'different')), sn as (select count(*) n, min(pos_distance) lo, max(pos_distance) hi from sx),
 sp as (select a.word_i, b.word_j, a.mean_attention o, (lo + {_HASH("'43-' || a.pair_id")} % (hi - lo + 1))::double x from sx a, sn, sx b where b.k = (a.k + sn.n - 1) % sn.n),
 sv as (select o, x, abs({_sum("translate(word_i, 'أإآىةؤئٱـ', 'ااايتويا')", L.ABJAD_BASE)} - {_sum("translate(word_j, 'أإآىةؤئٱـ', 'ااايتويا')", L.ABJAD_BASE)})::double t from sp where word_i is not null and word_j is not null and o is not null),
 sf as (select regr_slope(t, x) bt, regr_intercept(t, x) at_, regr_slope(o, x) bo, regr_intercept(o, x) ao from sv), sz as (select round(t-at_-bt*x, 12) a, round(o-ao-bo*x, 12) b from sv, sf),
 sr as (select rank() over (order by a) + (count(*) over (partition by a) - 1)/2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1)/2.0::double rb from sz), so as (select corr(ra, rb) c, count(*) n from sr)"""


@query(_SCRAMBLED + " select round(pr2.c, 4) as observed_rho, round(so.c, 4) as scrambled_rho, so.n as n, round(pr2.c - so.c, 4) as difference, case when abs(so.c) < 0.5*abs(pr2.c) then 'PASS' else 'CONCERN' end as verdict from pr2, so")
def scrambled_baseline(spark, d):
    """The partial correlation after second words and position distances were redrawn, against the observed one; a constant lift
    controls nothing. It passes if less than half of the observed remains."""
    p = S.scrambled(_cross(spark, d))
    value = L.letter_value_variants
    again = p.where("word_i is not null and word_j is not null").withColumn("value_distance", F.abs(value(F.col("word_i")) - value(F.col("word_j"))))
    drawn = S.partial_spearman(again, "value_distance", "mean_attention", ["pos_distance"]).first()
    seen = _observed(_controlled(spark, d)).rho
    both = seen is not None and drawn.rho is not None
    row = (seen, drawn.rho, drawn.n, seen - drawn.rho if both else None, ("PASS" if abs(drawn.rho) < 0.5 * abs(seen) else "CONCERN") if both else None)
    made = spark.createDataFrame([row], "observed_rho double, scrambled_rho double, n long, difference double, verdict string")
    return made.withColumns({c: F.round(c, 4) for c in ("observed_rho", "scrambled_rho", "difference")})


@query(_RANKS + " select case when c is null then 'insufficient' when abs(c)*sqrt(n) >= 1.96 and c < 0 then 'positive' when abs(c)*sqrt(n) >= 1.96 and c > 0 then 'falsifying' else 'null' end as verdict, n from (select corr(ra, rb) c, count(*) n from r)")
def verdict(spark, d):
    r = S.spearman(_cross(spark, d), "value_distance", "mean_attention").first()
    return spark.createDataFrame([(r.rho, S.spearman_p(r.rho, r.n), r.n)], "rho double, p double, n long").select(S.verdict(F.col("rho"), F.col("p")).alias("verdict"), "n")


@query(_PARTIAL + " select case when c is null then 'insufficient' when abs(c)*sqrt(n) >= 1.96 and c < 0 then 'positive' when abs(c)*sqrt(n) >= 1.96 and c > 0 then 'falsifying' else 'null' end as verdict, n from pr2")
def verdict_partial(spark, d):
    """The verdict on the partial correlation, as the reference gives it; ``verdict`` is that of the raw one."""
    r = _observed(_controlled(spark, d))
    return spark.createDataFrame([(r.rho, r.p, r.n)], "rho double, p double, n long").select(S.verdict(F.col("rho"), F.col("p")).alias("verdict"), "n")


# ------------------------------------------------------------------------------------------------------------ vectors


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("family"), (F.col("vec_id") % 6).alias("pattern"), F.col("embedding").cast("array<double>").alias("vec"))


@query("with p as (select distinct word_i as w from pairs where word_i is not null), f as (select coalesce(root, '') as family, form from lexicon) select family, count(*) as words, count(w) as found, round(count(w)/count(*), 6) as coverage from f left join p on p.w = f.form group by 1 having count(*) >= 3")
def vocab_coverage(spark, d):
    """How many forms of every lexicon root occur in the pairs, for roots of three forms or more."""
    seen = table(spark, d, "pairs").select(F.col("word_i").alias("form"), F.lit(1).alias("hit")).where("form is not null").distinct()
    f = table(spark, d, "lexicon").select(F.coalesce("root", F.lit("")).alias("family"), "form").join(seen, "form", "left")
    return f.groupBy("family").agg(F.count("*").alias("words"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage")).where("words >= 3")


_COS = "list_dot_product(a.e, b.e)/(sqrt(list_dot_product(a.e, a.e))*sqrt(list_dot_product(b.e, b.e)))"


@query(f"with {_V} select a.label as family, count(*) as pairs, round(avg({_COS}), 6) as mean, round(stddev_pop({_COS}), 6) as std, round(min({_COS}), 6) as min, round(max({_COS}), 6) as max from v a join v b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def intra_family_sims(spark, d):
    s = S.pairwise(_vectors(spark, d), "family", "vec_id", "vec")
    return s.select("family", "pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


#: The normal tail by a rational approximation, exact to seven digits.
_TAIL = "case when z >= 0 then 0.5::double*e else 1 - 0.5::double*e end"


def _density_sql(where: str = "true", tag: str = "") -> str:
    """Expressions that end in ``ds{tag}``: the density summary of the vectors that fulfil a condition."""
    t = tag
    return f"""v{t} as (select *, row_number() over (order by label, vec_id) - 1 as g from v where {where}), fs{t} as (select label, min(g) as start, count(*) as n, row_number() over (order by label) - 1 as f from v{t} group by 1), it{t} as (select sum(n*(n-1)//2) as n, count(*) as m from fs{t}),
 dr{t} as (select k, {_HASH("'cross-' || k || '-a'")} % m as x, {_HASH("'cross-' || k || '-b'")} % (m - 1) as y, {_HASH("'cross-' || k || '-pa'")} as pa, {_HASH("'cross-' || k || '-pb'")} as pb from range(1000) r(k), it{t} where k < 3*n),
 cs{t} as (select k, {_COS} as s from dr{t} join fs{t} fa on fa.f = x join fs{t} fb on fb.f = y + (y >= x)::int join v{t} a on a.g = fa.start + pa % fa.n join v{t} b on b.g = fb.start + pb % fb.n),
 ws{t} as (select a.label, {_COS} as s from v{t} a join v{t} b on a.label = b.label and a.vec_id < b.vec_id),
 rn{t} as (select f, rank() over (order by s) + (count(*) over (partition by s) - 1)/2.0::double as r from (select round(s, 12) s, 1 as f from ws{t} union all select round(s, 12), 0 from cs{t})), us{t} as (select sum(r) filter (where f = 1) - count(*) filter (where f = 1)*(count(*) filter (where f = 1)+1)/2.0::double as u from rn{t}),
 sm{t} as (select (select m from it{t}) as families, (select count(*) from ws{t}) as n1, (select count(*) from cs{t}) as n2, (select avg(s) from ws{t}) as im, (select stddev_pop(s) from ws{t}) as sd, (select avg(s) from cs{t}) as cm, (select stddev_pop(s) from cs{t}) as cd, u from us{t}),
 zs{t} as (select *, (u - n1*n2/2.0::double - 0.5::double)/sqrt(n1::double*n2*(n1+n2+1)/12) as z from sm{t}), es{t} as (select *, 1/(1+0.3275911::double*abs(z)/sqrt(2)) as k from zs{t}),
 ps{t} as (select *, (((((1.061405429::double*k-1.453152027::double)*k)+1.421413741::double)*k-0.284496736::double)*k+0.254829592::double)*k*exp(-z*z/2) as e from es{t}),
 ds{t} as (select *, im - cm as gap, (im-cm)/sqrt((sd*sd+cd*cd)/2) as cohen_d, {_TAIL} as p from ps{t})"""


@query(f"with {_V}, " + _density_sql("true", "w") + " select k as draw, round(s, 6) as sim from csw")
def cross_family_sims(spark, d):
    """Cosines of a thousand seeded draws of vectors of two families; the draws are digests, so that any engine can repeat them."""
    known = _vectors(spark, d).where("family is not null and vec is not null")
    sizes = {r.family: r["count"] for r in known.groupBy("family").count().collect()}  # a row a family
    within = sum(n * (n - 1) // 2 for n in sizes.values())
    sims = S.sims_at(known, ["family", "vec_id"], "vec", S.crossed(sizes, min(S.DRAWN, 3 * within)))
    return spark.createDataFrame([(k, round(s, 6)) for k, s in enumerate(sims)], "draw long, sim double")


_DENSITY = "families int, coverage_pct double, intra_pairs long, cross_pairs long, intra_mean double, intra_std double, cross_mean double, cross_std double, gap double, cohen_d double, z double, p double, significant boolean"


@query(f"with {_V}, " + _density_sql("true", "w") + " select families::int as families, 100.0::double as coverage_pct, n1 as intra_pairs, n2 as cross_pairs, round(im, 6) as intra_mean, round(sd, 6) as intra_std, round(cm, 6) as cross_mean, round(cd, 6) as cross_std, round(gap, 6) as gap, round(cohen_d, 5) as cohen_d, round(z, 4) as z, round(p, 4) as p, p < 0.05 as significant from dsw")
def density_summary(spark, d):
    """How much closer vectors of a family are than vectors of two: gap, effect size, coverage, significance."""
    s = S.density(_vectors(spark, d), "family", "vec_id", "vec")
    made = spark.createDataFrame([tuple(s[c.split(" ")[0]] for c in _DENSITY.split(", "))], _DENSITY)
    digits = {"intra_mean": 6, "intra_std": 6, "cross_mean": 6, "cross_std": 6, "gap": 6, "cohen_d": 5, "z": 4, "p": 4}
    return made.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("with k as (select value_distance v, root_relation = 'same' as f from (select distinct on (pair_id) * from pairs) where root_relation in ('same', 'different') and value_distance is not null), r as (select f, rank() over (order by v) + (count(*) over (partition by v) - 1)/2.0::double r from k) select sum(r) filter (where f) - count(*) filter (where f)*(count(*) filter (where f)+1)/2 as u, count(*) filter (where f) as n1, count(*) filter (where not f) as n2 from r")
def mann_whitney_greater(spark, d):
    """Value distances within a root against those across roots."""
    p = pairs(spark, d)
    return S.mann_whitney_greater(p.where("root_relation = 'same'"), p.where("root_relation = 'different'"), "value_distance").select("u", "n1", "n2")


@query(f"with {_V}, " + _density_sql("label % 2 = 0", "a") + ", " + _density_sql("label % 2 = 1", "b") + " select round(a.gap, 6) as first_gap, round(b.gap, 6) as second_gap, round(a.cohen_d, 5) as first_d, round(b.cohen_d, 5) as second_d, case when b.gap > 0 then round(a.gap/b.gap, 4) end as ratio, a.gap > b.gap as claim_supported from dsa a, dsb b")
def density_comparison(spark, d):
    """The gap of even against the gap of odd families: their ratio (null where the second isn't above 0), and whether the first is greater."""
    v = _vectors(spark, d)
    a, b = (S.density(v.where(F.col("family") % 2 == half), "family", "vec_id", "vec") for half in (0, 1))
    ratio = round(a["gap"] / b["gap"], 4) if a["gap"] is not None and (b["gap"] or 0) > 0 else None
    better = a["gap"] > b["gap"] if None not in (a["gap"], b["gap"]) else None
    short = lambda x, n: None if x is None else round(x, n)
    return spark.createDataFrame([(short(a["gap"], 6), short(b["gap"], 6), short(a["cohen_d"], 5), short(b["cohen_d"], 5), ratio, better)], "first_gap double, second_gap double, first_d double, second_d double, ratio double, claim_supported boolean")


_FP = _V + ", m as (select label as family, pattern, pos, avg(x) x from (select label, pattern, unnest(e) x, unnest(range(len(e))) pos from v) group by 1, 2, 3), fp as (select family, pattern, list(x order by pos) e from m group by 1, 2), of as (select a.family, a.pattern, list_transform(range(len(a.e)), lambda i: a.e[i+1]-b.e[i+1]) e, a.e as target, b.e as base from fp a join fp b on a.family = b.family and b.pattern = 0 where a.pattern <> 0)"


def _means(spark, d) -> DataFrame:
    return E.array_mean(_vectors(spark, d).dropDuplicates(["family", "pattern", "vec_id"]), ["family", "pattern"])


def _offsets(spark, d) -> DataFrame:
    m = written(_means(spark, d), "pattern-means")
    base = m.where("pattern = 0").select("family", F.col("vec").alias("base"))
    return m.where("pattern <> 0").join(base, "family").select("family", "pattern", F.zip_with("vec", "base", lambda a, b: a - b).alias("offset"), F.col("vec").alias("target"), "base")


@query("with " + _FP + " select family, pattern, round(sqrt(list_dot_product(e, e)), 6) as norm from fp")
def family_pattern_map(spark, d):
    return _means(spark, d).select("family", "pattern", F.round(F.sqrt(E.dot(F.col("vec"), F.col("vec"))), 6).alias("norm"))


@query("with " + _FP + " select family, pattern, round(sqrt(list_dot_product(e, e)), 6) as norm from of")
def pattern_offsets(spark, d):
    return _offsets(spark, d).select("family", "pattern", F.round(F.sqrt(E.dot(F.col("offset"), F.col("offset"))), 6).alias("norm"))


@query("with " + _FP + f" select a.pattern, count(*) as pairs, round(avg({_COS}), 6) as mean, round(stddev_pop({_COS}), 6) as std, round(min({_COS}), 6) as min, round(max({_COS}), 6) as max from of a join of b on a.pattern = b.pattern and a.family < b.family group by 1")
def analogy_consistency(spark, d):
    s = S.pairwise(_offsets(spark, d), "pattern", "family", "offset")
    return s.select("pattern", "pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


_AC = _FP + """, sm as (select pattern, pos, sum(x) x, count(*) n from (select pattern, family, unnest(e) x, unnest(range(len(e))) pos from of) group by 1, 2), sl as (select pattern, list(x order by pos) s, any_value(n) n from sm group by 1),
 pd as (select of.family, of.pattern, target, list_transform(range(len(of.e)), lambda i: base[i+1]+(s[i+1]-of.e[i+1])/(n-1)) as e from of join sl using (pattern) where n >= 2),
 sc as (select family, pattern, list_dot_product(e, target)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(target, target))) sim, e from pd),
 rk as (select a.family, a.pattern, any_value(a.sim) sim, 1 + count(*) filter (where round(list_dot_product(a.e, b.e)/(sqrt(list_dot_product(a.e, a.e))*sqrt(list_dot_product(b.e, b.e))), 9) > round(a.sim, 9)) as rank from sc a, fp b group by 1, 2)"""


def _completed(spark, d) -> DataFrame:
    """Leave one out: the sum of all offsets minus one's own predicts the target; rank among all pattern means."""
    o = written(_offsets(spark, d), "offsets")
    sums = E.array_mean(o.select("pattern", F.col("offset").alias("vec")), ["pattern"]).join(o.groupBy("pattern").agg(F.count("*").alias("n")), "pattern").where("n >= 2")
    each = o.join(F.broadcast(sums), "pattern").withColumn("mean", F.zip_with("vec", "offset", lambda m, x: (m * F.col("n") - x) / (F.col("n") - 1)))
    guess = each.select("family", "pattern", "target", F.zip_with("base", "mean", lambda a, b: a + b).alias("guess")).withColumn("sim", E.cosine(F.col("guess"), F.col("target")))
    guess = written(guess.withColumn("key", F.monotonically_increasing_id()), "guesses")
    ranks = S.ranks_among(guess.select("key", F.col("guess").alias("vec"), "sim"), _means(spark, d))
    return guess.join(ranks, "key").select("family", "pattern", "sim", "rank")


@query("with " + _AC + " select family, pattern, round(sim, 6) as sim, rank from rk")
def analogy_completion(spark, d):
    return _completed(spark, d).select("family", "pattern", F.round("sim", 6).alias("sim"), "rank")


_STRENGTH = "case when avg(sim) > 0.90::double then 'very strong' when avg(sim) > 0.80::double then 'strong' when avg(sim) > 0.65::double then 'moderate' else 'weak' end"


@query("with " + _AC + f" select pattern, count(*) as n, round(avg(sim), 6) as mean, round(stddev_pop(sim), 6) as std, {_STRENGTH} as strength from rk group by 1")
def completion_summary(spark, d):
    m = F.avg("sim")
    strength = F.when(m > 0.90, "very strong").when(m > 0.80, "strong").when(m > 0.65, "moderate").otherwise("weak")
    return _completed(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), F.round(m, 6).alias("mean"), F.round(F.stddev_pop("sim"), 6).alias("std"), strength.alias("strength"))


@query("with " + _AC + " select case pattern when 1 then 'AP' else 'PP' end as form, round(avg(sim), 6) as mean, min(rank) as best_rank from rk where pattern in (1, 2) group by 1")
def primary_triad_summary(spark, d):
    return _completed(spark, d).where("pattern in (1, 2)").groupBy(F.when(F.col("pattern") == 1, "AP").otherwise("PP").alias("form")).agg(F.round(F.avg("sim"), 6).alias("mean"), F.min("rank").alias("best_rank"))


_CLUSTERED = f"""with {_V}, vg as (select *, row_number() over (order by pattern, vec_id) - 1 as g from v), ps as (select pattern, min(g) as start, count(*) as n from vg group by 1 having count(*) >= 2), al as (select count(*) as total from vg),
 ws as (select a.pattern, {_COS} as s from v a join v b on a.pattern = b.pattern and a.vec_id < b.vec_id), wn as (select pattern, count(*) as n1, avg(s) as wm, stddev_pop(s) as wd from ws group by 1),
 dr as (select pattern, k, start + {_HASH("'pattern-' || pattern || '-' || k || '-a'")} % n as x, {_HASH("'pattern-' || pattern || '-' || k || '-b'")} % (total - n) as y, start, n from range(500) r(k), ps, al where total > n and k < 5*(n*(n-1)//2)),
 cs as (select pattern, {_COS} as s from (select dr.pattern, a.e as ae, b.e as be from dr join vg a on a.g = x join vg b on b.g = y + case when y >= start then n else 0 end) q, lateral (select q.ae as e) a, lateral (select q.be as e) b),
 rn as (select pattern, f, rank() over (partition by pattern order by s) + (count(*) over (partition by pattern, s) - 1)/2.0::double as r from (select pattern, round(s, 12) s, 1 as f from ws union all select pattern, round(s, 12), 0 from cs)), us as (select pattern, sum(r) filter (where f = 1) - count(*) filter (where f = 1)*(count(*) filter (where f = 1)+1)/2.0::double as u, count(*) filter (where f = 0) as n2 from rn group by 1),
 cm as (select pattern, avg(s) as cm, stddev_pop(s) as cd from cs group by 1), zs as (select *, (u - n1*n2/2.0::double - 0.5::double)/sqrt(n1::double*n2*(n1+n2+1)/12) as z from wn join us using (pattern) join cm using (pattern) join ps using (pattern)),
 es as (select *, 1/(1+0.3275911::double*abs(z)/sqrt(2)) as k from zs), fs as (select *, (((((1.061405429::double*k-1.453152027::double)*k)+1.421413741::double)*k-0.284496736::double)*k+0.254829592::double)*k*exp(-z*z/2) as e from es)"""


@query(_CLUSTERED + f" select pattern, n1 as pairs, round(wm, 6) as mean, round(wd, 6) as std, round(cm, 6) as cross_mean, round(cd, 6) as cross_std, round(wm - cm, 6) as gap, round({_TAIL}, 4) as p, {_TAIL} < 0.05 as significant from fs")
def pattern_clustering(spark, d):
    """All pairs within every pattern against seeded draws across patterns (five for a pair, 500 at most): gap and significance."""
    import numpy as np

    known = _vectors(spark, d).where("pattern is not null and vec is not null")
    sizes = {r.pattern: r["count"] for r in known.groupBy("pattern").count().collect()}  # a row a pattern
    total, start, drawn = sum(sizes.values()), 0, []
    for pattern in sorted(sizes):
        n = sizes[pattern]
        for k in range(min(500, 5 * (n * (n - 1) // 2)) if total > n else 0):
            y = S.seeded(f"pattern-{pattern}-{k}-b") % (total - n)
            drawn.append((pattern, start + S.seeded(f"pattern-{pattern}-{k}-a") % n, y + (n if y >= start else 0)))
        start += n
    sims = S.sims_at(known, ["pattern", "vec_id"], "vec", [x[1:] for x in drawn])
    cross: dict = {}
    for (pattern, *_), sim in zip(drawn, sims):
        cross.setdefault(pattern, []).append(sim)
    rows = []
    for r in S.pairwise(known, "pattern", "vec_id", "vec", {k: np.array(v) for k, v in cross.items()}).collect():
        c = np.array(cross.get(r.pattern, []))
        if len(c):
            p = S.greater_p(r.u, r.pairs, len(c))[1]
            rows.append((r.pattern, r.pairs, round(r["mean"], 6), round(r["std"], 6), round(float(c.mean()), 6), round(float(c.std()), 6), round(r["mean"] - float(c.mean()), 6), round(p, 4), p < 0.05))
    return spark.createDataFrame(rows, "pattern long, pairs long, mean double, std double, cross_mean double, cross_std double, gap double, p double, significant boolean")


@query(cte("pairs") + ", w as (select sentence_id, pos_i, pos_j, mean_attention*(1+(l-h)*0.1::double) as onward, mean_attention*(1+(l+h)*0.2::double) as back from (select distinct sentence_id, pos_i, pos_j, mean_attention from prs where sentence_id is not null and mean_attention is not null), range(2) a(l), range(3) b(h)) select sentence_id, pos_i, pos_j, round(avg(onward)/2 + avg(back)/2, 9) as attention from w group by 1, 2, 3")
def attention_pool(spark, d):
    """Weights of two layers and three heads in both directions, made from the stored ones, pooled to one of every pair of words."""
    p = pairs(spark, d).where("sentence_id is not null and mean_attention is not null").select("sentence_id", "pos_i", "pos_j", "mean_attention").distinct()
    each = p.withColumn("l", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    ways = each.select(F.col("sentence_id").alias("sentence"), F.explode(F.array(
        F.struct(F.col("pos_i").alias("i"), F.col("pos_j").alias("j"), (F.col("mean_attention") * (1 + (F.col("l") - F.col("h")) * 0.1)).alias("weight")),
        F.struct(F.col("pos_j").alias("i"), F.col("pos_i").alias("j"), (F.col("mean_attention") * (1 + (F.col("l") + F.col("h")) * 0.2)).alias("weight")))).alias("w")).select("sentence", "w.*")
    return S.attention_pool(ways).select(F.col("sentence").alias("sentence_id"), F.col("i").alias("pos_i"), F.col("j").alias("pos_j"), F.round("attention", 9).alias("attention"))


@query("select vec_id, label as family from embeddings where label in (select label from embeddings group by 1 order by min(vec_id) limit 4)")
def limit_families(spark, d):
    """Members of the first four families in the order in which they appear."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("family"))
    first = v.groupBy("family").agg(F.min("vec_id").alias("at")).orderBy("at").limit(4)
    return v.join(F.broadcast(first.select("family")), "family", "left_semi")


@query()
def pca2(spark, d):
    """Two principal components of all vectors: their covariance is summed in the JVM and solved on the driver."""
    import numpy as np

    rows = _vectors(spark, d)
    width = 64
    mean = np.array(E.array_mean(rows.select(F.lit(1).alias("g"), "vec"), ["g"]).first().vec)
    width = len(mean)
    centred = rows.select("vec_id", F.zip_with("vec", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b).alias("c"))

    def grams(batches):
        import pandas as pd

        total = np.zeros((width, width))
        for b in batches:
            m = np.stack(b.c.to_list())
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "g": total.ravel()})

    gram = np.zeros((width, width))
    for r in centred.mapInPandas(grams, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # width x width
        gram[r.i, r.j] = r.g
    _, axes = np.linalg.eigh(gram)
    two = [axes[:, -1 - k] * np.sign(axes[np.abs(axes[:, -1 - k]).argmax(), -1 - k]) for k in (0, 1)]
    return centred.select("vec_id", *[F.round(E.dot(F.col("c"), F.array(*[F.lit(float(x)) for x in a])), 5).alias(f"pc{k + 1}") for k, a in enumerate(two)])


@query(f"with {_V}, w(pair_id, x, y) as (values (1, 0, 1), (2, 2, 3), (3, 4, 5), (4, 6, 7)) select pair_id, round({_COS}, 3) as cosine from w join v a on a.vec_id = x join v b on b.vec_id = y")
def baseline_cosines(spark, d):
    """Four given pairs of vectors to three digits, as a published table has them."""
    v = _vectors(spark, d).select("vec_id", "vec")
    w = spark.createDataFrame([(1, 0, 1), (2, 2, 3), (3, 4, 5), (4, 6, 7)], "pair_id int, x long, y long")
    both = w.join(v.select(F.col("vec_id").alias("x"), F.col("vec").alias("a")), "x").join(v.select(F.col("vec_id").alias("y"), F.col("vec").alias("b")), "y")
    return both.select("pair_id", F.round(E.cosine(F.col("a"), F.col("b")), 3).alias("cosine"))
