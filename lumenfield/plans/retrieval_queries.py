"""Registered queries on retrieval: the evaluation items ask, the passages answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import morphology as M
from ..functions import text as T
from ..operators import retrieval as R
from ..session import table
from .inputs import cte, documents, passages
from .registry import query
from .text_queries import _clean_arabic, _root_sql, _sum


def _corpus(spark, d):
    return passages(spark, d).select("id", "text").where("id is not null and text is not null")


def _asked(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query"), "text")


def _tok(text: str) -> str:
    return f"list_filter(string_split({_clean_arabic(text)}, ' '), lambda t: t <> '')"


_BM = cte("passages") + f""", p as (select id, {_tok('text')} as toks from psg where id is not null and text is not null), st as (select count(*) n, avg(len(toks)) mean from p),
 q as (select item_id as query, token, count(*) times from (select item_id, unnest({_tok('text')}) as token from eval_items) group by 1, 2),
 tf as (select id, length, token, count(*) tf from (select id, len(toks) as length, unnest(toks) as token from p) where token in (select token from q) group by 1, 2, 3),
 df as (select token, count(*) df from tf group by 1),
 sc as (select query, id, sum(times*ln(1+(n-df+0.5::double)/(df+0.5::double))*tf*2.5::double/(tf+1.5::double*(0.25::double+0.75::double*length/greatest(mean, 1)))) score from tf join df using (token) join q using (token), st group by 1, 2),
 bm as (select *, row_number() over (partition by query order by round(score, 9) desc, id) rn from sc)"""


@query(_BM + " select query, id, rn::int as rank, round(score, 5) as score from bm where rn <= 5")
def bm25(spark, d):
    return R.bm25(_corpus(spark, d), _asked(spark, d)).select("query", "id", "rank", F.round("score", 5).alias("score"))


def _grams(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i+1]))"


_TF = cte("passages") + f""", p as (select id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') as w from psg where id is not null and text is not null), n as (select count(*) n from p),
 tf as (select id, gram, 1+ln(count(*)) tf from (select id, unnest({_grams('w')}) as gram from p) group by 1, 2), df as (select gram, ln((1+n)/(1+count(*)))+1 idf from tf, n group by gram, n),
 q0 as (select query, gram, (1+ln(count(*)))*idf as q, idf from (select query, unnest({_grams('w')}) as gram from (select item_id as query, {_tok('text')} as w from eval_items)) join df using (gram) group by query, gram, idf),
 q as (select query, gram, idf, q/sqrt(sum(q*q) over (partition by query)) as q from q0), nm as (select id, sqrt(sum(tf*idf*tf*idf)) norm from tf join df using (gram) group by 1),
 sc as (select query, id, sum(tf*idf*q)/any_value(norm) score from tf join q using (gram) join nm using (id) group by 1, 2), tk as (select *, row_number() over (partition by query order by round(score, 9) desc, id) rn from sc)"""


@query(_TF + " select query, id, rn::int as rank, round(score, 5) as score from tk where rn <= 5")
def tfidf_search(spark, d):
    return R.tfidf(_corpus(spark, d), _asked(spark, d)).select("query", "id", "rank", F.round("score", 5).alias("score"))


@query(f"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\\n\\x{{060C}}\\x{{061B}}\\x{{061F}}]+'), lambda s: {_clean_arabic('s')}), lambda s: len(list_filter(string_split(s, ' '), lambda t: t <> '')) between 6 and 80) as s from documents where text is not null),
 e as (select doc_id, s, unnest(range(len(s))) as i from s), x as (select doc_id, i, greatest(i-2, 0) a, least(i+2, len(s)-1) b, s from e), t as (select doc_id, i, a, b, array_to_string(s[a+1:b+1], ' ') as text from x)
 select doc_id, 'p' || lpad(i::varchar, 6, '0') || '_' || substr(sha1(text), 1, 10) as id, i as "index", a as start_sentence, b as end_sentence, length(text) as chars from t""")
def build_passages(spark, d):
    """Passages of five sentences around every sentence of every document."""
    s = documents(spark, d).where("text is not null").select("doc_id", T.split_sentences("text").alias("s"))
    made = s.select("doc_id", F.explode(R.build_passages(F.col("s"), 2)).alias("p"))
    return made.select("doc_id", "p.id", "p.index", "p.start_sentence", "p.end_sentence", F.length("p.text").alias("chars"))


@query(_BM + f", pr as (select b.query, b.id, {_tok('e.text')} as q, p.toks as t from bm b join eval_items e on e.item_id = b.query join p using (id) where rn <= 5) select query, id, round(case when len(q) = 0 or len(t) = 0 then 0 else len(list_filter(list_distinct(q), lambda x: list_contains(t, x)))/len(list_distinct(q)) end, 6) as share from pr")
def lexical_score(spark, d):
    """The share of each item's tokens in its five best passages."""
    found = R.bm25(_corpus(spark, d), _asked(spark, d)).select("query", "id")
    both = found.join(_corpus(spark, d), "id").join(F.broadcast(_asked(spark, d).withColumnRenamed("text", "asked")), "query")
    return both.select("query", "id", F.round(R.lexical_score(T.tokenize("asked"), T.tokenize("text")), 6).alias("share"))


def _found(spark, d):
    return R.explained(R.tfidf(_corpus(spark, d), _asked(spark, d)).where("score > 0"), _corpus(spark, d), _asked(spark, d))


def _explained_sql() -> str:
    """The results of the items with shared tokens, root hits and value links."""
    hit = _TF + f""", best as (select tk.query, tk.id, tk.rn::int as rank, round(tk.score, 6) as score, {_tok('e.text')} as q, {_tok('p.text')} as t, p.text from tk join eval_items e on e.item_id = tk.query join (select id, text from psg) p using (id) where rn <= 5 and tk.score > 0),
 roots as ({_root_sql('select distinct unnest(q) as word from best union select distinct unnest(t) from best', M.ROOTS_PASSAGES)}),
 qr as (select distinct query, id, root from (select query, id, unnest(q) as word from best) join roots using (word) where root <> ''),
 hr as (select query, id, word || ':' || root as hit, row_number() over (partition by query, id order by word) n from (select distinct query, id, unnest(t) as word from best) join roots using (word) join qr using (query, id, root)),
 hs as (select query, id, list(hit order by n) as hits from hr where n <= 12 group by 1, 2),
 v as (select token, {_sum('token', L.ABJAD)} as v from (select distinct unnest(q) as token from best union select distinct unnest(t) from best)),
 qe as (select query, id, unnest(q) token, unnest(range(len(q))) qp from best), pe as (select query, id, token, min(pp) pp from (select query, id, unnest(t) token, unnest(range(len(t))) pp from best) group by 1, 2, 3),
 j as (select qe.query, qe.id, qe.qp, qe.token as qt, a.v as qv, pe.token as pt, b.v as pv, abs(a.v-b.v) delta, row_number() over (partition by qe.query, qe.id, qe.qp order by abs(a.v-b.v), pe.pp) rn from qe join v a on a.token = qe.token join pe on pe.query = qe.query and pe.id = qe.id join v b on b.token = pe.token where a.v <> 0),
 lk as (select query, id, qt, qv, pt, pv, delta, row_number() over (partition by query, id order by delta, qp) n from j where rn = 1), ls as (select query, id, count(*) as links, string_agg('- ' || qt || '(' || qv || ') -> ' || pt || '(' || pv || '), delta=' || delta, chr(10) order by n) as lines from lk where n <= 8 group by 1, 2),
 ex as (select best.*, list_sort(list_distinct(list_filter(q, lambda x: list_contains(t, x)))) as overlap, coalesce(hits, []) as hits, coalesce(links, 0)::int as links, coalesce(lines, '') as lines from best left join hs using (query, id) left join ls using (query, id))"""
    return hit


@query(_explained_sql() + " select query, id, rank, score, overlap as token_overlap, hits as shared_root_hits, links from ex")
def rag_query(spark, d):
    """The five best passages of every item with their explanations; a root hit is written token:root."""
    hits = F.transform("shared_root_hits", lambda h: F.concat_ws(":", h["token"], h["root"]))
    return _found(spark, d).select("query", "id", "rank", "score", "token_overlap", hits.alias("shared_root_hits"), F.size("links").alias("links"))


@query(_explained_sql() + """ select query, '# ' || query || chr(10) || chr(10) || string_agg('## ' || rank || '. ' || id || chr(10) || chr(10) || 'Token overlap: ' || case when len(overlap) = 0 then 'none' else array_to_string(overlap, ', ') end || chr(10) || chr(10) || 'Shared root hits: ' || case when len(hits) = 0 then 'none' else array_to_string(hits, ', ') end || chr(10) || chr(10) || 'Nearest value links:' || chr(10) || lines || chr(10) || chr(10) || text || chr(10), chr(10) order by rank) as report from ex group by query""")
def rag_report(spark, d):
    """The results of every item as a Markdown report."""
    return R.reported(_found(spark, d))


@query(_BM + f""", one as (select b.query, b.id, {_tok('e.text')} as q, p.toks as t from bm b join eval_items e on e.item_id = b.query join p using (id) where rn = 1),
 v as (select token, {_sum('token', L.ABJAD)} as v from (select distinct unnest(q) as token from one union select distinct unnest(t) from one)),
 qe as (select query, id, unnest(q) token, unnest(range(len(q))) qp from one), pe as (select query, id, unnest(t) token, unnest(range(len(t))) pp from one),
 j as (select qe.query, qe.id, qe.qp, qe.token as qt, a.v as qv, pe.token as pt, b.v as pv, abs(a.v-b.v) delta, row_number() over (partition by qe.query, qe.qp order by abs(a.v-b.v), pe.pp) rn from qe join v a on a.token = qe.token join pe on pe.query = qe.query join v b on b.token = pe.token where a.v <> 0),
 k as (select *, row_number() over (partition by query order by delta, qp) r8 from j where rn = 1) select query, id, qt as query_token, qv as query_value, pt as passage_token, pv as passage_value, delta from k where r8 <= 8""")
def explain_passage(spark, d):
    """Value links of the best passage of every item; shared tokens and roots are in ``rag_query``."""
    found = R.bm25(_corpus(spark, d), _asked(spark, d), 1)
    e = R.explained(found, _corpus(spark, d), _asked(spark, d))
    return e.select("query", "id", F.explode("links").alias("l")).select("query", "id", "l.query_token", F.col("l.query_value").cast("long").alias("query_value"), "l.passage_token", F.col("l.passage_value").cast("long").alias("passage_value"), F.col("l.delta").cast("long").alias("delta"))


@query(_BM + f""", one as (select b.query, b.id, {_tok('e.text')} as q, p.toks as t from bm b join eval_items e on e.item_id = b.query join p using (id) where rn = 1),
 v as (select token, {_sum('token', L.ABJAD)} as v from (select distinct unnest(q) as token from one union select distinct unnest(t) from one)),
 qe as (select query, id, unnest(q) token, unnest(range(len(q))) qp from one), pe as (select query, id, unnest(t) token, unnest(range(len(t))) pp from one),
 j as (select qe.query, qe.id, qe.qp, abs(a.v-b.v) delta, row_number() over (partition by qe.query, qe.qp order by abs(a.v-b.v), pe.pp) rn from qe join v a on a.token = qe.token join pe on pe.query = qe.query join v b on b.token = pe.token where a.v <> 0),
 k as (select query, id, delta, row_number() over (partition by query order by delta, qp) r8 from j where rn = 1) select query, id, sum(delta)::bigint as total, count(*) as links from k where r8 <= 8 group by 1, 2""")
def nearest_value_links(spark, d):
    """The sum of differences over the links of every item's best passage."""
    return explain_passage(spark, d).groupBy("query", "id").agg(F.sum("delta").alias("total"), F.count("*").alias("links"))
