"""Letter values (abjad and gematria) as Column expressions.

Two Arabic conventions exist side by side and are never merged: ``ABJAD`` (35 letters, the article counts) and
``ABJAD_CANONICAL`` (with hamza, article removed unless asked for). Letters outside a mapping count 0; null stays null.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let
from .text import MARKS_NORMAL, nfc, strip_diac, stripped

#: The base letters in numerical order and their values.
_UNITS = [*range(1, 10), *range(10, 100, 10), *range(100, 1001, 100)]
ABJAD_BASE = dict(zip("ابجدهوزحطيكلمنسعفصقرشتثخذضظغ", _UNITS))
#: Variant letters and the base letter whose value they take.
ABJAD_VARIANTS = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ت", "ؤ": "و", "ئ": "ي"}
ABJAD = ABJAD_BASE | {v: ABJAD_BASE[b] for v, b in ABJAD_VARIANTS.items()}
ABJAD_CANONICAL = ABJAD | {"ء": 1}
HEBREW_BASE = dict(zip("אבגדהוזחטיכלמנסעפצקרשת", _UNITS))
HEBREW_FINALS = {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ"}
GEMATRIA = HEBREW_BASE | {v: HEBREW_BASE[b] for v, b in HEBREW_FINALS.items()}


def mapping(values: dict[str, int]) -> Column:
    """A letter mapping as a map literal."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def letter_value(c: Column, values: dict[str, int] = ABJAD) -> Column:
    """The sum of the letter values of a text as it stands."""
    table = mapping(values)
    return F.aggregate(letters(c), F.lit(0), lambda acc, x: acc + F.coalesce(F.try_element_at(table, x), F.lit(0)))


def abjad_value(c: Column) -> Column:
    """The value without vowel marks, the article counted."""
    return letter_value(strip_diac(c))


def breakdown(c: Column, values: dict[str, int] = ABJAD) -> Column:
    """``c=v + c=v = total`` over the mapped letters."""
    table = mapping(values)
    parts = F.transform(F.filter(letters(c), lambda x: F.try_element_at(table, x).isNotNull()), lambda x: F.concat(x, F.lit("="), F.try_element_at(table, x).cast("string")))
    return F.concat(F.array_join(parts, " + "), F.lit(" = "), letter_value(c, values).cast("string"))


def canonical_form(c: Column, include_article: bool = False) -> Column:
    """The form the canonical value counts: composed, without marks, without the article unless asked for."""
    form = F.regexp_replace(nfc(stripped(c)), MARKS_NORMAL, "")
    return form if include_article else F.regexp_replace(form, "^ال", "")


def letter_value_canonical(c: Column, include_article: bool = False) -> Column:
    """struct(value, breakdown, form_used, convention), all from one form, so the breakdown adds up to the value."""
    table = mapping(ABJAD_CANONICAL)
    name = "article-inclusive" if include_article else "article-free (canonical)"

    def pairs(form: Column) -> Column:
        return F.transform(F.filter(letters(form), lambda x: F.try_element_at(table, x).isNotNull()), lambda x: F.struct(x.alias("letter"), F.try_element_at(table, x).alias("value")))

    def summed(form: Column, own: Column) -> Column:
        return F.struct(F.aggregate(own, F.lit(0), lambda acc, p: acc + p["value"]).alias("value"), own.alias("breakdown"), form.alias("form_used"), F.lit(name).alias("convention"))

    return let(canonical_form(c, include_article), lambda form: let(pairs(form), lambda own: summed(form, own)))


def gematria_value(c: Column) -> Column:
    return letter_value(c, GEMATRIA)


def to_base_letters(c: Column) -> Column:
    """Variant letters as base letters (wasla alif included), kashida removed."""
    variants = {**ABJAD_VARIANTS, "ٱ": "ا"}
    return F.translate(c, "".join(variants) + "ـ", "".join(variants.values()))


def letter_value_variants(c: Column, values: dict[str, int] = ABJAD_BASE) -> Column:
    """The value with every variant counted as its base letter under a mapping of base letters."""
    return letter_value(to_base_letters(c), values)


def audit(stored: Column, term: Column) -> Column:
    """Which convention a stored value follows: OK_AF (article free), OK_AI (inclusive) or MISMATCH_BOTH."""
    free = letter_value(canonical_form(term), ABJAD_CANONICAL)
    inclusive = letter_value(canonical_form(term, True), ABJAD_CANONICAL)
    return F.when(stored == free, "OK_AF").when(stored == inclusive, "OK_AI").otherwise("MISMATCH_BOTH")
