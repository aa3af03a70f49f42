"""Heuristic roots and morphological patterns as Column expressions.

A word whose root can't be told has the empty root; a term that fits no pattern has status ``not_parsed``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let
from .letters import ABJAD, GEMATRIA, letters
from .text import clean_arabic, clean_hebrew, normalize_term

#: Prefixes, tried in this order, and letters that are no root letters.
ARABIC_PREFIXES = "وال فال بال لل ال و ف ب ل ك".split()
ARABIC_WEAK = "اويىةءأإآؤئ"
HEBREW_PREFIXES = "וכשה וכש שה כש וה וב ול ומ וש ה ו ב ל מ כ ש".split()
HEBREW_SUFFIXES = "יהם יהן יכם יכן ינו ות ים ין ה ו י ך".split()
HEBREW_WEAK = "אהוי"
#: Words whose root is listed, for passages.
ROOTS_PASSAGES = {
    "الله": "اله", "وجود": "وجد", "عالم": "علم", "علم": "علم", "حق": "حقق", "واحد": "وحد", "ذات": "ذات", "نور": "نور", "روح": "روح", "قلب": "قلب",
    "عقل": "عقل", "نفس": "نفس", "حكمة": "حكم", "معرفة": "عرف", "محبة": "حبب", "فناء": "فني", "بقاء": "بقي", "حضرة": "حضر", "مقام": "قوم",
    "شهود": "شهد", "كشف": "كشف", "خلق": "خلق", "رحمة": "رحم", "إيمان": "امن", "إسلام": "سلم", "عبادة": "عبد", "صبر": "صبر", "شكر": "شكر",
}
#: Words whose root is listed, for the corpus of sentences.
ROOTS_CORPUS = {
    "الله": "اله", "وجود": "وجد", "عالم": "علم", "حق": "حقق", "واحد": "وحد", "كل": "كلل", "شيء": "شيء", "اسم": "سمو", "صفة": "وصف", "ذات": "ذات",
    "فعل": "فعل", "قول": "قول", "علم": "علم", "ارادة": "ارد", "حياة": "حيي", "قدرة": "قدر", "سمع": "سمع", "بصر": "بصر", "كلام": "كلم", "ايجاد": "وجد",
    "تجلي": "جلو", "بيان": "بين", "نور": "نور", "روح": "روح", "قلب": "قلب", "عقل": "عقل", "نفس": "نفس", "جسم": "جسم", "حكمة": "حكم", "معرفة": "عرف",
    "محبة": "حبب", "فناء": "فني", "بقاء": "بقي", "برزخ": "برزخ", "حضرة": "حضر", "مقام": "قوم", "حال": "حول", "ذكر": "ذكر", "فكر": "فكر",
    "شهود": "شهد", "كشف": "كشف", "وحي": "وحي", "نبي": "نبا", "رسول": "رسل", "امر": "امر", "خلق": "خلق", "رحمة": "رحم", "نعمة": "نعم", "ايمان": "امن",
    "اسلام": "سلم", "عبادة": "عبد", "طاعة": "طوع", "توبة": "توب", "صبر": "صبر", "شكر": "شكر", "تواضع": "وضع", "محمد": "حمد", "ابراهيم": "برهم",
    "موسى": "موس", "عيسى": "عيس", "ادم": "ادم", "اول": "اول", "اخر": "اخر", "ظاهر": "ظهر", "باطن": "بطن", "كتاب": "كتب", "قران": "قرن", "اية": "ايي",
    "صلاة": "صلو", "زكاة": "زكو", "صوم": "صوم", "حج": "حجج",
}


def _without_prefix(word: Column, prefixes: list[str]) -> Column:
    """The word without the first listed prefix it starts with, if more than two letters remain."""
    out = None
    for prefix in prefixes:
        hit = word.startswith(prefix) & (F.length(word) > len(prefix) + 2)
        out = F.when(hit, F.substr(word, F.lit(len(prefix) + 1))) if out is None else out.when(hit, F.substr(word, F.lit(len(prefix) + 1)))
    return out.otherwise(word)


def _without_suffix(word: Column, suffixes: list[str]) -> Column:
    out = None
    for suffix in suffixes:
        hit = word.endswith(suffix) & (F.length(word) > len(suffix) + 2)
        cut = F.substr(word, F.lit(1), F.length(word) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(word)


def _skeleton(word: Column, strong: str) -> Column:
    """The first three strong letters, or the empty text if there are fewer."""
    return let(F.regexp_replace(word, f"[^{strong}]", ""), lambda kept: F.when(F.length(kept) < 3, "").otherwise(F.substring(kept, 1, 3)))


def extract_root(c: Column, listed: dict[str, str] = ROOTS_PASSAGES) -> Column:
    """The root of an Arabic word: listed, or the skeleton behind a prefix."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(listed.items())])
    strong = "".join(ch for ch in ABJAD if ch not in ARABIC_WEAK)

    def root(word: Column) -> Column:
        return F.when(word == "", "").otherwise(F.coalesce(F.try_element_at(known, word), _skeleton(_without_prefix(word, ARABIC_PREFIXES), strong)))

    return let(clean_arabic(c), root)


def root_hebrew(c: Column) -> Column:
    """The root of a Hebrew word: the skeleton without prefix and suffix."""
    strong = "".join(ch for ch in GEMATRIA if ch not in HEBREW_WEAK)

    def root(word: Column) -> Column:
        stem = let(_without_prefix(word, HEBREW_PREFIXES), lambda w: _without_suffix(w, HEBREW_SUFFIXES))
        return F.when(F.length(word) < 3, "").otherwise(_skeleton(stem, strong))

    return let(clean_hebrew(c), root)


def root_relation(a: Column, b: Column) -> Column:
    """same, different, or unknown if either root is empty or null."""
    unknown = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(unknown, "unknown").when(a == b, "same").otherwise("different")


#: Surface skeletons (C is a root letter) and the patterns they can stand for, in order.
PATTERNS = [
    ("CCC", ["faʿl", "fiʿl", "fuʿl", "faʿal", "faʿil", "faʿul"]),
    ("CاCC", ["fāʿil"]),
    ("CCيC", ["faʿīl"]),
    ("CCوC", ["faʿūl", "fuʿūl"]),
    ("CCاC", ["fiʿāl", "faʿāl", "fuʿāl"]),
    ("CCCان", ["fiʿlān", "faʿlān", "fuʿlān"]),
    ("CCاCة", ["fiʿālah", "faʿālah"]),
    ("CCيCة", ["faʿīlah"]),
    ("CCCة", ["faʿlah", "fiʿlah", "fuʿlah"]),
    ("CاCCة", ["fāʿilah"]),
    ("مCCC", ["mafʿal", "mifʿal", "mufʿil", "mufʿal"]),
    ("مCCCة", ["mafʿalah", "mifʿalah", "mufʿilah"]),
    ("مCCوC", ["mafʿūl"]),
    ("مCاCC", ["mufāʿil", "mafāʿil"]),
    ("مCCّC", ["mufaʿʿil", "mufaʿʿal"]),
    ("مCتCC", ["muftaʿil", "muftaʿal"]),
    ("منCCC", ["munfaʿil"]),
    ("مستCCC", ["mustafʿil", "mustafʿal"]),
    ("تCCيC", ["tafʿīl"]),
    ("تCاCC", ["tafāʿul"]),
    ("CتCاC", ["iftiʿāl-stem"]),
    ("اCتCاC", ["iftiʿāl"]),
    ("انCCاC", ["infiʿāl"]),
    ("استCCاC", ["istifʿāl"]),
    ("اCCاC", ["ifʿāl", "afʿāl"]),
    ("ءCCاC", ["ifʿāl"]),
    ("CCCC", ["faʿlal (quadriliteral) or unvocalized-ambiguous"]),
]


def pattern_table() -> list[tuple[int, str, str, list[str], bool]]:
    """(order, skeleton, regular expression, pattern names, whether it has a literal letter), most structure first.

    The shadda of a skeleton counts for its length but not for matching, as marks are gone by then.
    """
    rows = []
    for order, (skeleton, names) in enumerate(PATTERNS):
        regex = "^" + "".join("([ء-ي])" if ch == "C" else "" if ch == "ّ" else ch for ch in skeleton) + "$"
        rows.append((order, skeleton, regex, names, set(skeleton) != {"C"}))
    return sorted(rows, key=lambda r: (-len(r[1]), r[0]))


def parse_pattern(term: Column) -> Column:
    """struct(query_wazn, query_wazn_status, candidates, radicals, normalized_form) of a term's own pattern."""
    rows = pattern_table()

    def hits(form: Column) -> Column:
        each = [F.when(form.rlike(regex), F.struct(F.array(*[F.lit(n) for n in names]).alias("names"), F.lit(literal).alias("literal"), F.array(*[F.regexp_extract(form, regex, k + 1) for k in range(skeleton.count("C"))]).alias("radicals"))) for _, skeleton, regex, names, literal in rows]
        return F.filter(F.array(*each), lambda h: h.isNotNull())

    def kept(found: Column) -> Column:
        return F.when(F.exists(found, lambda h: h["literal"]), F.filter(found, lambda h: h["literal"])).otherwise(found)

    def summed(own: Column, form: Column) -> Column:
        best = F.get(own, F.lit(0))
        facts = F.struct(F.array_distinct(F.flatten(F.transform(own, lambda h: h["names"]))).alias("names"), best["names"].alias("best"), best["radicals"].alias("radicals"), F.size(own).alias("hits"))
        return let(facts, lambda f: judged(f, form))

    def judged(f: Column, form: Column) -> Column:
        status = F.when(f["hits"] == 0, "not_parsed").when(F.size(f["names"]) == 1, "parsed").when((F.size(f["best"]) > 1) & (f["hits"] == 1), "ambiguous_vocalization").otherwise("ambiguous_structure")
        named = let(status, lambda s: F.struct(F.when(s == "parsed", F.get(f["names"], F.lit(0))).when(s == "ambiguous_vocalization", F.array_join(f["best"], " / ")).when(s == "ambiguous_structure", F.array_join(F.slice(f["names"], 1, 4), " / ")).alias("wazn"), s.alias("status")))
        return let(named, lambda n: F.struct(n["wazn"].alias("query_wazn"), n["status"].alias("query_wazn_status"), f["names"].alias("candidates"), f["radicals"].alias("radicals"), form.alias("normalized_form")))

    return let(normalize_term(term), lambda form: let(let(hits(form), kept), lambda own: summed(own, form)))


#: The first two vowel marks of a word and the pattern stems they leave.
VOWEL_FAMILIES = {"َْ": ["faʿl"], "ِْ": ["fiʿl"], "ُْ": ["fuʿl"], "ََ": ["faʿal"], "َِ": ["faʿil"], "َُ": ["faʿul", "faʿūl"], "ُُ": ["fuʿūl", "fuʿul"]}


def narrow_by_vowels(vocalized: Column, candidates: Column) -> Column:
    """Candidates that agree with the first two vowel marks; all of them where the marks say nothing."""
    marks = F.array_join(F.slice(F.filter(letters(vocalized), lambda ch: ch.rlike("^[\\u064B-\\u0652]$")), 1, 2), "")

    def agreeing(family: list[str], names: Column) -> Column:
        stems = sorted({f.split("ʿ")[0][:2] for f in family})
        return F.filter(names, lambda n: n.isin(*family) | F.substring(n, 1, 2).isin(*stems))

    def chosen(key: Column, names: Column) -> Column:
        out = None
        for marked, family in VOWEL_FAMILIES.items():
            kept = agreeing(family, names)
            out = F.when(key == marked, kept) if out is None else out.when(key == marked, kept)
        return out.otherwise(names)

    return let(marks, lambda key: let(candidates, lambda names: let(chosen(key, names), lambda kept: F.when(F.size(kept) == 0, names).otherwise(kept))))


def parse_vocalized(term: Column, vocalized: Column) -> Column:
    """``parse_pattern`` narrowed by a vocalized form where the term alone leaves more than one pattern."""

    def narrowed(parsed: Column) -> Column:
        open_ = vocalized.isNotNull() & ~parsed["query_wazn_status"].isin("parsed", "not_parsed")
        fewer = let(narrow_by_vowels(vocalized, parsed["candidates"]), lambda names: F.struct(F.array_join(names, " / ").alias("query_wazn"), F.when(F.size(names) == 1, "parsed").otherwise("ambiguous_vocalization").alias("query_wazn_status")))
        return F.when(open_, fewer).otherwise(F.struct(parsed["query_wazn"].alias("query_wazn"), parsed["query_wazn_status"].alias("query_wazn_status")))

    return let(parse_pattern(term), narrowed)


def pattern_fields(term: Column, cluster: Column) -> Column:
    """The term's own pattern and the cluster's pattern, kept apart."""
    return let(parse_pattern(term), lambda p: F.struct(p["query_wazn"].alias("query_wazn"), p["query_wazn_status"].alias("query_wazn_status"), cluster.alias("cluster_wazn")))
