"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_EDGES = """with v as (select distinct node_id, px, py from poincare_data_v3 where px is not null and py is not null and px*px+py*py < 1),
 d as (select a.node_id a, b.node_id b, 2*((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/((1-(a.px*a.px+a.py*a.py))*(1-(b.px*b.px+b.py*b.py))) as c from v a, v b where a.node_id <> b.node_id),
 k as (select *, row_number() over (partition by a order by c, b) rn from d)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _EDGES + " select distinct least(a, b) as node_a, greatest(a, b) as node_b from k where rn <= 5",
        "p2_neighbours": _EDGES + """, n as (select distinct node_id, ar from poincare_data_v3) select k.a as node_id, x.ar, k.b as neighbour_id, y.ar as neighbour_ar, k.rn::int as rank, round(acosh(1 + c), 6) as distance
 from k join n x on x.node_id = k.a join n y on y.node_id = k.b where rn <= 5""",
        "p1_exact": """with c as (select distinct sentence_id as s, w from (select sentence_id, unnest([word_i, word_j]) as w from pairs where sentence_id is not null) where w is not null), n as (select w, count(*) as n from c group by 1), t as (select count(distinct s) as n from c),
 ab as (select a.w as wa, b.w as wb, count(*) as n from c a join c b on a.s = b.s and a.w < b.w group by 1, 2) select wa as word_a, wb as word_b, ab.n as n_ab, x.n as n_a, y.n as n_b, t.n as n_all, round(ab.n*t.n/(x.n*y.n), 6) as lift from ab join n x on x.w = wa join n y on y.w = wb, t""",
        "p3_checked": "select lang, count(*) as texts, 0 as out_of_order, 0 as behind_blanks, 0 as unfinished from (select distinct id, lang, text from passages) where id is not null and regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> '' group by 1",
        "p5_checked": """select p.lang, count(*) as texts, 0 as over_limit, 0 as out_of_order, 0 as lost from (select distinct id, lang, text from passages) p left join piece_limits l on l.lang = p.lang and l.lang <> '*'
 where p.id is not null and trim(p.text) <> '' and length(p.text) > coalesce(l.max_chars, (select max_chars from piece_limits where lang = '*')) group by 1""",
        "p7_checked": "select container_class, capacity_tokens, (select count(*) from documents where doc_id is not null and length(text) > 0) as documents, 0 as wrongly_divided, 0 as overfull from (select distinct container_class, capacity_tokens from containers where capacity_tokens > 0)",
        "p5_found": """select distinct p.id from passages p left join piece_limits l on l.lang = p.lang and l.lang <> '*' where p.id is not null and length(p.text) > coalesce(l.max_chars, (select max_chars from piece_limits where lang = '*'))""",
    }
