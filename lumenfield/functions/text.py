"""Text normalisation as Column expressions.

Null in, null out; the empty text stays empty. Everything runs in the JVM except ``nfc`` and ``repair_utf8``, which need
Unicode tables or charset round trips and work on Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mark ranges that the conventions in use remove.
MARKS_FULL = "[\\u064B-\\u065F\\u0670\\u0640]"
MARKS_VOWELS = "[\\u064B-\\u065F]"
MARKS_CORPUS = "[\\u064B-\\u065F\\u0670]"
MARKS_NORMAL = "[\\u064B-\\u0652\\u0670\\u0640]"
#: Sentence ends of the three corpora.
ENDS_PASSAGES = "[.\\n\\u060C\\u061B\\u061F]+"
ENDS_CORPUS = "[.\\n\\u060C\\u061B]+"
ENDS_HEBREW = "[.!?;:\\n\\u05C3]+"
#: Characters that betray UTF-8 read as Latin-1.
MOJIBAKE_MARKERS = "ÃÂØÙÐ¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space at either end (trim alone removes only spaces)."""
    return F.regexp_replace(_col(c), "^\\s+|\\s+$", "")


def strip_diac(c: Column | str, marks: str = MARKS_FULL) -> Column:
    """Without vowel marks; ``marks`` chooses the convention."""
    return F.regexp_replace(_col(c), marks, "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_term(c: Column | str, strip_article: bool = True) -> Column:
    """Trimmed, composed, without marks, without one leading article, madda expanded to hamza and alif."""
    out = F.regexp_replace(nfc(stripped(c)), MARKS_NORMAL, "")
    if strip_article:
        out = F.regexp_replace(out, "^(ال|أل|اَل)", "")
    return F.replace(out, F.lit("آ"), F.lit("ءا"))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def clean_arabic(c: Column | str) -> Column:
    """Without marks (kashida stays), everything outside the Arabic block as a space, spaces collapsed."""
    return collapsed(F.regexp_replace(strip_diac(c, MARKS_CORPUS), "[^\\u0600-\\u06FF\\s]", " "))


def clean_hebrew(c: Column | str) -> Column:
    """Without tags and points, everything but Hebrew letters as a space, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", " "), "[\\u0591-\\u05C7]", "")
    return collapsed(F.regexp_replace(bare, "[^\\u05D0-\\u05EA\\s]", " "))


def tokens_of(cleaned: Column) -> Column:
    """Tokens of an already cleaned text; none for the empty text."""
    return F.filter(F.split(cleaned, "\\s+"), lambda t: t != "")


def tokenize(c: Column | str) -> Column:
    """Tokens of the cleaned Arabic text: what is left between characters outside the Arabic block, in one pass."""
    return F.filter(F.split(strip_diac(c, MARKS_CORPUS), "[^\\u0600-\\u06FF]+"), lambda t: t != "")


def strip_openiti(c: Column | str) -> Column:
    """Corpus markup removed (comment lines, tildes, milestones, page marks), then cleaned as Arabic."""
    out = F.regexp_replace(_col(c), "(?m)^#.*$", "")
    out = F.regexp_replace(out, "~+", " ")
    out = F.regexp_replace(out, "ms\\d+", "")
    return clean_arabic(F.regexp_replace(out, "PageV\\d+P\\d+", ""))


def split_sentences(c: Column | str, ends: str = ENDS_PASSAGES, least: int = 6, most: int = 80, hebrew: bool = False) -> Column:
    """Cleaned sentences of ``least`` to ``most`` tokens, in order."""
    clean = clean_hebrew if hebrew else clean_arabic
    cleaned = F.transform(F.split(_col(c), ends), clean)
    return F.filter(cleaned, lambda s: F.size(tokens_of(s)).between(least, most))


def looks_mojibake(c: Column | str) -> Column:
    return _col(c).rlike(f"[{MOJIBAKE_MARKERS}]")


def _repaired(text: str) -> str:
    now = text
    for _ in range(2):
        if not any(ch in MOJIBAKE_MARKERS for ch in now):
            break
        better = None
        for encoding in ("latin-1", "cp1252"):
            try:
                trial = now.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            if len(trial) < len(now) or not any(ch in MOJIBAKE_MARKERS for ch in trial):
                better = trial
                break
        if better is None:
            break
        now = better
    return now


@F.pandas_udf(T.StringType())
def repair_utf8(s: pd.Series) -> pd.Series:
    """UTF-8 read as Latin-1 or Windows-1252, once or twice, turned back; anything else unchanged."""
    return s.map(_repaired, na_action="ignore")
