"""Registered queries on text, letters and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import morphology as M
from ..functions import text as T
from ..session import table
from .inputs import cte, documents, log, nodes, pairs, passages
from .registry import query

_FULL, _VOWELS, _CORPUS, _NORMAL = r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", r"[\x{064B}-\x{065F}]", r"[\x{064B}-\x{065F}\x{0670}]", r"[\x{064B}-\x{0652}\x{0670}\x{0640}]"


def _re(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def _clean_arabic(text: str) -> str:
    return f"trim({_re(_re(_re(text, _CORPUS), chr(91) + '^' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}' + chr(92) + 's]', ' '), chr(92) + 's+', ' ')})"


def _clean_hebrew(text: str) -> str:
    bare = _re(_re(text, "<[^>]+>", " "), r"[\x{0591}-\x{05C7}]")
    return f"trim({_re(_re(bare, r'[^\x{05D0}-\x{05EA}\s]', ' '), r'\s+', ' ')})"


def _normal(text: str) -> str:
    stripped = _re(text, r"^\s+|\s+$")
    return f"replace(regexp_replace({_re(f'nfc_normalize({stripped})', _NORMAL)}, '^(ال|أل|اَل)', ''), 'آ', 'ءا')"


def _letters(text: str) -> str:
    return f"list_filter(string_split({text}, ''), lambda x: x <> '')"


def _sum(text: str, values: dict[str, int]) -> str:
    keys, numbers = ", ".join(f"'{k}'" for k in values), ", ".join(str(v) for v in values.values())
    return f"coalesce(list_sum(list_transform({_letters(text)}, lambda x: coalesce(list_extract([{numbers}], list_position([{keys}], x)), 0))), 0)::bigint"


@query(cte("log") + f" select log_id, {_re('term_ar', _FULL)} as plain, {_re('term_ar', _VOWELS)} as without_vowels, {_re('term_ar', _CORPUS)} as without_marks from log")
def strip_diac(spark, d):
    """The three conventions side by side."""
    return log(spark, d).select("log_id", T.strip_diac("term_ar").alias("plain"), T.strip_diac("term_ar", T.MARKS_VOWELS).alias("without_vowels"), T.strip_diac("term_ar", T.MARKS_CORPUS).alias("without_marks"))


@query(cte("log") + f" select log_id, {_normal('term_ar')} as normal from log")
def normalize_term(spark, d):
    return log(spark, d).select("log_id", T.normalize_term("term_ar").alias("normal"))


@query(cte("passages") + f" select id, {_clean_arabic('text')} as clean from psg")
def clean_arabic(spark, d):
    return passages(spark, d).select("id", T.clean_arabic("text").alias("clean"))


@query(f"select doc_id, {_clean_hebrew('text')} as clean from documents")
def clean_hebrew(spark, d):
    return documents(spark, d).select("doc_id", T.clean_hebrew("text").alias("clean"))


@query(f"select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(list_filter(string_split({_clean_arabic('text')}, ' '), lambda t: t <> '')) as token from documents) group by 1")
def tokenize(spark, d):
    """Counts of the tokens of all documents."""
    each = documents(spark, d).select("doc_id", F.explode(T.tokenize("text")).alias("token"))
    per = each.groupBy("token", "doc_id").agg(F.count("*").alias("c"))  # documents are distinct before tokens are counted
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


def _sentences_sql(ends: str, clean) -> str:
    cleaned = clean("s")
    return f"""select id, count(*) as sentences, sum(n)::bigint as tokens, min(s) as first, max(s) as last from (select id, s, len(list_filter(string_split(s, ' '), lambda t: t <> '')) n from (select id, {cleaned} as s from (select id, unnest(regexp_split_to_array(text, '{ends}')) as s from psg))) where n between 6 and 80 group by 1"""


def _sentences(spark, d, ends: str, hebrew: bool = False):
    each = passages(spark, d).select("id", F.explode(T.split_sentences("text", ends, hebrew=hebrew)).alias("s"))
    return each.groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.size(T.tokens_of(F.col("s")))).alias("tokens"), F.min("s").alias("first"), F.max("s").alias("last"))


@query(cte("passages") + " " + _sentences_sql(r"[.\n\x{060C}\x{061B}\x{061F}]+", _clean_arabic))
def split_sentences_passages(spark, d):
    return _sentences(spark, d, T.ENDS_PASSAGES)


@query(cte("passages") + " " + _sentences_sql(r"[.\n\x{060C}\x{061B}]+", _clean_arabic))
def split_sentences_corpus(spark, d):
    return _sentences(spark, d, T.ENDS_CORPUS)


@query(cte("passages") + " " + _sentences_sql(r"[.!?;:\n\x{05C3}]+", _clean_hebrew))
def split_sentences_hebrew(spark, d):
    return _sentences(spark, d, T.ENDS_HEBREW, True)


@query(f"select doc_id, {_clean_arabic(_re(_re(_re(_re('marked', '(?m)^#.*$'), '~+', ' '), 'ms[0-9]+'), 'PageV[0-9]+P[0-9]+'))} as clean from (select doc_id, '# ' || source || chr(10) || 'ms12 ' || replace(text, '.', '~~ PageV01P003 ') as marked from documents)")
def strip_openiti(spark, d):
    """Documents set in corpus markup and taken out of it again."""
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\nms12 "), F.replace(F.col("text"), F.lit("."), F.lit("~~ PageV01P003 ")))
    return documents(spark, d).select("doc_id", T.strip_openiti(marked).alias("clean"))


@query(cte("nodes") + f" select node_id, regexp_matches(ar, '[{T.MOJIBAKE_MARKERS}]') as marked from nodes")
def looks_mojibake(spark, d):
    return nodes(spark, d).select("node_id", T.looks_mojibake("ar").alias("marked"))


@query()
def repair_mojibake(spark, d):
    """Names with their two-round repair."""
    fixed = nodes(spark, d).where("ar is not null").select("node_id", "ar", T.repair_utf8("ar").alias("repaired"))
    return fixed.select("node_id", "repaired", (F.col("ar") != F.col("repaired")).alias("changed"))


# ------------------------------------------------------------------------------------------------------------ letters


@query(cte("log") + f" select log_id, {_sum(_re('term_ar', _FULL), L.ABJAD)} as value from log where term_ar is not null")
def letter_value(spark, d):
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", L.abjad_value(F.col("term_ar")).cast("long").alias("value"))


_CANON = f"regexp_replace({_re('nfc_normalize(' + _re('term_ar', r'^\s+|\s+$') + ')', _NORMAL)}, '^ال', '')"
_INCL = _re("nfc_normalize(" + _re("term_ar", r"^\s+|\s+$") + ")", _NORMAL)


@query(cte("log") + f" select log_id, {_CANON} as form_used, {_sum(_CANON, L.ABJAD_CANONICAL)} as value, {_sum(_INCL, L.ABJAD_CANONICAL)} as value_inclusive, len(list_filter({_letters(_CANON)}, lambda x: list_contains([{', '.join(repr(k) for k in L.ABJAD_CANONICAL)}], x)))::bigint as letters from log where term_ar is not null")
def letter_value_canonical(spark, d):
    known = log(spark, d).where("term_ar is not null")
    v = known.select("log_id", L.letter_value_canonical(F.col("term_ar")).alias("free"), L.letter_value_canonical(F.col("term_ar"), True).alias("full"))
    return v.select("log_id", "free.form_used", F.col("free.value").cast("long").alias("value"), F.col("full.value").cast("long").alias("value_inclusive"), F.size("free.breakdown").cast("long").alias("letters"))


_KEYS, _NUMBERS = ", ".join(f"'{k}'" for k in L.ABJAD), ", ".join(str(v) for v in L.ABJAD.values())


@query(cte("log") + f", w as (select log_id, {_re('term_ar', _FULL)} as t from log where term_ar is not null) select log_id, array_to_string(list_transform(list_filter({_letters('t')}, lambda x: list_contains([{_KEYS}], x)), lambda x: x || '=' || list_extract([{_NUMBERS}], list_position([{_KEYS}], x))::varchar), ' + ') || ' = ' || {_sum('t', L.ABJAD)}::varchar as breakdown from w")
def letter_breakdown(spark, d):
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", L.breakdown(T.strip_diac("term_ar")).alias("breakdown"))


@query(f"select word_id, {_sum('form', L.GEMATRIA)} as value, value as stored from lexicon where lang = 'he'")
def gematria_value(spark, d):
    return table(spark, d, "lexicon").where("lang = 'he'").select("word_id", L.gematria_value(F.col("form")).cast("long").alias("value"), F.col("value").alias("stored"))


@query(f"select word_id, {_sum('translate(form, ' + repr('أإآىةؤئٱـ') + ', ' + repr('ااايتويا') + ')', L.ABJAD_BASE)} as value from lexicon where lang = 'ar'")
def letter_value_variants(spark, d):
    return table(spark, d, "lexicon").where("lang = 'ar'").select("word_id", L.letter_value_variants(F.col("form")).cast("long").alias("value"))


@query(cte("log") + f", v as (select log_id, abjad_value, {_sum(_CANON, L.ABJAD_CANONICAL)} as f, {_sum(_INCL, L.ABJAD_CANONICAL)} as i from log where term_ar is not null) select case when abjad_value = f then 'OK_AF' when abjad_value = i then 'OK_AI' else 'MISMATCH_BOTH' end as verdict, count(*) as n from v group by 1")
def abjad_audit(spark, d):
    """Which convention the stored values of the log follow."""
    known = log(spark, d).where("term_ar is not null")
    return known.select(L.audit(F.col("abjad_value"), F.col("term_ar")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(cte("log") + f", w as (select log_id, abjad_value, regexp_replace({_re('term_ar', _FULL)}, '^ال', '') as t from log where term_ar is not null), v as (select log_id, abjad_value, {_sum('t', L.ABJAD)} as recomputed from w) select log_id, recomputed, abjad_value is distinct from recomputed as flagged from v")
def root_value_check(spark, d):
    """Values recomputed without the article and whether the stored value differs."""
    known = log(spark, d).where("term_ar is not null")
    v = known.select("log_id", "abjad_value", L.letter_value(F.regexp_replace(T.strip_diac("term_ar"), "^ال", "")).cast("long").alias("recomputed"))
    return v.select("log_id", "recomputed", (~F.col("abjad_value").eqNullSafe(F.col("recomputed"))).alias("flagged"))


@query("""with w as (select word_id, unnest(string_split(form, '')) as letter, case when lang = 'he' then 'gematria' else 'abjad' end as mapping_id from lexicon where lang in ('ar', 'he'))
 select word_id, sum(coalesce(m.value, 0))::bigint as value from w left join letter_map m using (mapping_id, letter) group by 1""")
def letter_value_mapped(spark, d):
    """Values under the mappings of the letter table, which is a broadcast dimension of two short alphabets."""
    words = table(spark, d, "lexicon").where("lang in ('ar', 'he')").select("word_id", F.when(F.col("lang") == "he", "gematria").otherwise("abjad").alias("mapping_id"), F.explode(L.letters(F.col("form"))).alias("letter"))
    values = table(spark, d, "letter_map").select("mapping_id", "letter", "value")
    return words.join(F.broadcast(values), ["mapping_id", "letter"], "left").groupBy("word_id").agg(F.sum(F.coalesce("value", F.lit(0))).alias("value"))


# --------------------------------------------------------------------------------------------------------- morphology


def _cut_sql(word: str, parts: list[str], front: bool) -> str:
    hit = (lambda p: f"starts_with({word}, '{p}')") if front else (lambda p: f"ends_with({word}, '{p}')")
    cut = (lambda p: f"substr({word}, {len(p) + 1})") if front else (lambda p: f"substr({word}, 1, length({word}) - {len(p)})")
    return "case " + " ".join(f"when {hit(p)} and length({word}) > {len(p) + 2} then {cut(p)}" for p in parts) + f" else {word} end"


def _skeleton_sql(word: str, strong: str) -> str:
    kept = _re(word, f"[^{strong}]")
    return f"case when length({kept}) < 3 then '' else substr({kept}, 1, 3) end"


_STRONG_AR = "".join(c for c in L.ABJAD if c not in M.ARABIC_WEAK)
_STRONG_HE = "".join(c for c in L.GEMATRIA if c not in M.HEBREW_WEAK)


def _root_sql(source: str, listed: dict[str, str]) -> str:
    known = "case " + " ".join(f"when w = '{k}' then '{v}'" for k, v in listed.items()) + " end"
    return f"select word, case when w = '' then '' else coalesce({known}, {_skeleton_sql('p', _STRONG_AR)}) end as root from (select word, w, {_cut_sql('w', M.ARABIC_PREFIXES, True)} as p from (select word, {_clean_arabic('word')} as w from ({source})))"


_WORDS = "select distinct word from (select word_i as word from pairs union all select word_j from pairs) where word is not null"


def _words(spark, d):
    p = table(spark, d, "pairs")
    return p.select(F.explode(F.array("word_i", "word_j")).alias("word")).where("word is not null").distinct()


@query(_root_sql(_WORDS, M.ROOTS_PASSAGES))
def extract_root(spark, d):
    return _words(spark, d).select("word", M.extract_root(F.col("word")).alias("root"))


@query(_root_sql(_WORDS, M.ROOTS_CORPUS))
def extract_root_corpus(spark, d):
    return _words(spark, d).select("word", M.extract_root(F.col("word"), M.ROOTS_CORPUS).alias("root"))


@query(f"select word, case when length(w) < 3 then '' else {_skeleton_sql('s', _STRONG_HE)} end as root from (select word, w, {_cut_sql('p', M.HEBREW_SUFFIXES, False)} as s from (select word, w, {_cut_sql('w', M.HEBREW_PREFIXES, True)} as p from (select word, {_clean_hebrew('word')} as w from ({_WORDS}))))")
def root_hebrew(spark, d):
    return _words(spark, d).select("word", M.root_hebrew(F.col("word")).alias("root"))


@query(cte("pairs") + f", roots as ({_root_sql(_WORDS, M.ROOTS_CORPUS)}) select relation, root_relation as stored, count(*) as n from (select case when coalesce(a.root, '') = '' or coalesce(b.root, '') = '' then 'unknown' when a.root = b.root then 'same' else 'different' end as relation, p.root_relation from prs p left join roots a on a.word = p.word_i left join roots b on b.word = p.word_j) group by 1, 2")
def root_relation(spark, d):
    """Relations recomputed from the words against the stored ones; roots are found once per distinct word."""
    from ..session import written

    roots = written(_words(spark, d).select("word", M.extract_root(F.col("word"), M.ROOTS_CORPUS).alias("root")), "roots")
    p = pairs(spark, d).select("word_i", "word_j", "root_relation")
    joined = p.join(roots.select(F.col("word").alias("word_i"), F.col("root").alias("a")), "word_i", "left").join(roots.select(F.col("word").alias("word_j"), F.col("root").alias("b")), "word_j", "left")
    return joined.select(M.root_relation(F.col("a"), F.col("b")).alias("relation"), F.col("root_relation").alias("stored")).groupBy("relation", "stored").agg(F.count("*").alias("n"))


def _pattern_sql(source: str = "log", start: str | None = None) -> str:
    """Expressions that end in ``s`` (log_id, cand, best, status) for the terms (log_id, term_ar) of a source."""
    rows = ", ".join("({}, '{}', '{}', [{}], {})".format(k, sk, rx.replace("[ء-ي]", r"[\x{0621}-\x{064A}]"), ", ".join(f"'{n}'" for n in names), str(lit).lower()) for k, (_, sk, rx, names, lit) in enumerate(M.pattern_table()))
    return (cte("log") if start is None else start) + f""", tpl(k, sk, rx, names, lit) as (values {rows}), t as (select log_id, term_ar, {_normal('term_ar')} as f from {source} where term_ar is not null),
 h as (select t.log_id, tpl.k, tpl.names, tpl.lit from t join tpl on regexp_matches(t.f, tpl.rx)), g as (select *, bool_or(lit) over (partition by log_id) as has_lit from h), kept as (select * from g where lit or not has_lit),
 u as (select log_id, name, min(k * 100 + pos) as spot from (select log_id, k, unnest(names) as name, unnest(range(len(names))) as pos from kept) group by 1, 2), c as (select log_id, list(name order by spot) as cand from u group by 1),
 b as (select log_id, count(*) as hits, arg_min(names, k) as best from kept group by 1),
 s as (select t.log_id, c.cand, b.best, case when b.hits is null then 'not_parsed' when len(c.cand) = 1 then 'parsed' when len(b.best) > 1 and b.hits = 1 then 'ambiguous_vocalization' else 'ambiguous_structure' end as status from t left join c using (log_id) left join b using (log_id))"""


@query(_pattern_sql() + " select log_id, status as query_wazn_status, case status when 'not_parsed' then null when 'parsed' then cand[1] when 'ambiguous_vocalization' then array_to_string(best, ' / ') else array_to_string(cand[1:4], ' / ') end as query_wazn from s")
def parse_pattern(spark, d):
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", M.parse_pattern(F.col("term_ar")).alias("p")).select("log_id", "p.query_wazn_status", "p.query_wazn")


@query(_pattern_sql() + " select status, count(*) as n from s group by 1")
def pattern_status(spark, d):
    known = log(spark, d).where("term_ar is not null")
    return known.select(M.parse_pattern(F.col("term_ar"))["query_wazn_status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _radicals_sql() -> str:
    cases = " ".join("when {} then array_to_string([{}], '-')".format(k, ", ".join(f"regexp_extract(f, '{rx.replace('[ء-ي]', '[' + chr(92) + 'x{0621}-' + chr(92) + 'x{064A}]')}', {g + 1})" for g in range(sk.count("C")))) for k, (_, sk, rx, _, _) in enumerate(M.pattern_table()))
    return _pattern_sql() + f" select log_id, case k {cases} end as radicals from (select log_id, min(k) as k from kept group by 1) join t using (log_id)"


@query(_radicals_sql())
def pattern_radicals(spark, d):
    """Root letters by the best pattern of every parsed term."""
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", M.parse_pattern(F.col("term_ar")).alias("p")).where("p.radicals is not null").select("log_id", F.array_join("p.radicals", "-").alias("radicals"))


def _vowels_sql() -> str:
    """The candidates left by the first two vowel marks of a term."""
    marks = "array_to_string((list_filter(string_split(term_ar, ''), lambda c: regexp_matches(c, '^[\\x{064B}-\\x{0652}]$')))[1:2], '')"
    arms = []
    for marked, family in M.VOWEL_FAMILIES.items():
        stems = sorted({f.split("ʿ")[0][:2] for f in family})
        arms.append(f"when '{marked}' then list_filter(cand, lambda n: list_contains([{', '.join(repr(f) for f in family)}], n) or list_contains([{', '.join(repr(x) for x in stems)}], substr(n, 1, 2)))")
    return _pattern_sql() + f""", nv as (select log_id, case {marks} {' '.join(arms)} else cand end as few from s join t using (log_id)), fw as (select log_id, case when len(few) = 0 then cand else few end as few from nv join s using (log_id))
 select log_id, case when status in ('ambiguous_vocalization', 'ambiguous_structure') then case when len(few) = 1 then 'parsed' else 'ambiguous_vocalization' end else status end as query_wazn_status,
  case status when 'not_parsed' then null when 'parsed' then cand[1] else array_to_string(few, ' / ') end as query_wazn from s join fw using (log_id)"""


@query(_vowels_sql())
def narrow_by_vowels(spark, d):
    """Patterns of vocalized terms, narrowed by their own vowel marks."""
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", M.parse_vocalized(F.col("term_ar"), F.col("term_ar")).alias("p")).select("log_id", "p.query_wazn_status", "p.query_wazn")


@query(_pattern_sql() + ", o as (select log_id, status, case status when 'not_parsed' then null when 'parsed' then cand[1] when 'ambiguous_vocalization' then array_to_string(best, ' / ') else array_to_string(cand[1:4], ' / ') end as wazn from s) select o.log_id, o.wazn as query_wazn, o.status as query_wazn_status, l.cluster_wazn from o join log l using (log_id)")
def pattern_fields(spark, d):
    known = log(spark, d).where("term_ar is not null")
    return known.select("log_id", M.pattern_fields(F.col("term_ar"), F.col("cluster_wazn")).alias("p")).select("log_id", "p.*")
