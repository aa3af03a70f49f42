"""Text that was decoded with the wrong character encoding: find it, restore it.

Method. For every pair (encoding of the bytes, encoding they were read with) the garbled sequence of every letter of
the scripts the first encoding serves is computed once per worker; all sequences go into one Aho-Corasick automaton.
A text is scanned once per round. Matches of one pair that touch form a run; only runs are replaced, so correct text
around them stays as it is. Text garbled more than once is restored by as many rounds: each makes it shorter, the last changes
nothing.

Three families of pairs differ in what a run must show before it counts:

* UTF-8 read as a one-byte encoding: one sequence is enough, unless it consists of letters of a non-Latin script alone
  (such words can be genuine).
* a one-byte encoding read as Latin-1 or Windows-1252: the sequences are pairs of letters, and a run counts only in
  words without ASCII letters (``maçã`` and ``Øresund`` stay). A word of one letter has no pair; it is a match of its own,
  with what stands beside it, and counts between two runs. Turkish, whose words keep their ASCII letters, has pairs of one changed
  letter and one of the alphabet; it needs two words with such a pair, or one where the row says ``tr``.
* a two-byte encoding (Chinese, Japanese) read as Latin-1 or Windows-1252: at least three characters in a row.

Some damage destroys bytes; such rows are found, and marked as not restorable. No sequence of characters proves it but U+FFFD
and control characters, which are sequences of the automaton as well; words of question marks count by ``_lost_words``: two
that follow each other or differ in length, or a long one among letters that such a conversion would have lost, never a
question mark in an address or behind a sentence.

Null text gives ``damaged = false`` and null text; empty and blank text is not damaged. Text of any length is scanned
whole. The automaton has a fixed size (about 250,000 sequences), whatever the data.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Encodings that UTF-8 bytes get read with.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "cp1256", "cp1255", "mac_roman", "cp1253", "cp1254", "cp1250", "cp437", "cp850", "koi8_r")
#: One-byte encodings and the blocks of their letters; they get read as Latin-1 or Windows-1252.
ONE_BYTE = {
    "cp1256": [(0x0621, 0x0652), (0x0679, 0x06D2)],
    "iso8859_6": [(0x0621, 0x0652)],
    "cp1255": [(0x05B0, 0x05C3), (0x05D0, 0x05EA)],
    "iso8859_8": [(0x05D0, 0x05EA)],
    "cp1251": [(0x0401, 0x0491)],
    "koi8_r": [(0x0410, 0x0451)],
    "cp1253": [(0x0386, 0x03CE)],
    "cp874": [(0x0E01, 0x0E4E)],
}
#: Two-byte encodings; they get read as Latin-1 or Windows-1252.
TWO_BYTE = ("gb2312", "euc_jp", "shift_jis", "big5")
#: The six letters in which Windows-1254 and Windows-1252 differ.
TURKISH = {"ð": "ğ", "ý": "ı", "þ": "ş", "Ð": "Ğ", "Ý": "İ", "Þ": "Ş"}

#: Punctuation of the scripts of the one-byte encodings.
MARKS = "،؛؟ـ–—…“”‘’«»"
#: What stands where bytes were lost: the replacement character, control characters but the next line.
LOST = ["\ufffd", *(chr(c) for c in range(0x80, 0xA0) if c != 0x85)]
#: The letters of the Turkish alphabet.
TURKISH_LETTERS = "abcçdefgğhıijklmnoöprsştuüvyzâîûABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZÂÎÛ"
#: No text without one of these can hold damage; everything else skips the Python step.
SUSPECT = "[\\u0080-\\u00A0\\u00A1-\\u00AA\\u00AC-\\u00BA\\u00BC-\\u00FF\\u0152-\\u0192\\u02C6-\\u02DD\\u0393-\\u03CE\\u0400-\\u04FF\\u05F3\\u05F4\\u2013-\\u2044\\u20AA-\\u20AC\\u2116-\\u2122\\u2126-\\u25FF\\uFFFD]|\\?"

RESULT = T.StructType([T.StructField("damaged", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType())])


def _decoded(raw: bytes, encoding: str) -> str | None:
    """Bytes read with an encoding; bytes it leaves undefined become the control character of that number."""
    out = []
    for byte in raw:
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            if not encoding.startswith("cp125"):
                return None
            out.append(chr(byte))
    return "".join(out)


@lru_cache(maxsize=None)
def _byte_of(encoding: str) -> dict[str, int]:
    """For every character the byte that ``_decoded`` makes it from."""
    return {text: byte for byte in range(256) if (text := _decoded(bytes([byte]), encoding))}


def _encoded(text: str, encoding: str) -> bytes | None:
    table = _byte_of(encoding)
    try:
        return bytes(table[c] for c in text)
    except KeyError:
        return None


def _repertoire() -> list[str]:
    """Characters whose garbled sequences are precomputed: all letters, marks and punctuation of the scripts served."""
    blocks = [(0x80, 0x17F), (0x1A0, 0x1B0), (0x218, 0x21B), (0x2BB, 0x2BF), (0x300, 0x338), (0x386, 0x3CE), (0x400, 0x491), (0x591, 0x5F4), (0x600, 0x6FF), (0x900, 0x97F), (0xE01, 0xE5B), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x2126), (0x2190, 0x2265), (0x2500, 0x25FF), (0x3000, 0x30FF), (0xFB1D, 0xFB4F), (0xFE80, 0xFEFF), (0xFF01, 0xFF5E)]
    chars = {chr(c) for low, high in blocks for c in range(low, high + 1)}
    chars |= {c for encoding in UTF8_READ_AS for c in _byte_of(encoding) if ord(c) > 127}  # what a second garbling starts from
    return sorted(chars | set(_two_byte_chars("gb2312")) | set(_two_byte_chars("euc_jp")))


@lru_cache(maxsize=None)
def _two_byte_chars(encoding: str) -> tuple[str, ...]:
    """All characters of two bytes in an encoding."""
    leads = [*range(0x81, 0xA0), *range(0xE0, 0xEB)] if encoding == "shift_jis" else range(0xA1, 0xFA)
    out = []
    for lead in leads:
        for trail in range(0x40, 0xFF):
            try:
                text = bytes([lead, trail]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(text) == 1:
                out.append(text)
    return tuple(out)


@lru_cache(maxsize=1)
def _automaton():
    """The automaton and the list of pairs (family, encoding of the bytes, encoding they were read with)."""
    import ahocorasick

    pairs: list[tuple[str, str, str]] = []
    found: dict[str, list[int]] = {}

    def add(sequence: str | None, pair: int) -> None:
        if sequence and len(sequence) > 1:
            found.setdefault(sequence, []).append(pair)

    for read in UTF8_READ_AS:
        pairs.append(("utf8", "utf-8", read))
        for char in _repertoire():
            add(_decoded(char.encode(), read), len(pairs) - 1)
    for own, blocks in ONE_BYTE.items():
        letters = [c for low, high in blocks for c in map(chr, range(low, high + 1)) if c in _byte_of(own) and unicodedata.category(c)[0] in "LM"]
        for read in ("cp1252", "latin-1"):
            pairs.append(("one", own, read))
            wrong = [w for c in letters if (w := _decoded(bytes([_byte_of(own)[c]]), read)) and ord(w) > 127]
            marks = [w for c in MARKS if c in _byte_of(own) and (w := _decoded(bytes([_byte_of(own)[c]]), read)) and ord(w) > 127 and w != c]
            for a in wrong:
                for b in wrong:
                    add(a + b, len(pairs) - 1)
                for b in marks:
                    add(a + b, len(pairs) - 1)
                    add(b + a, len(pairs) - 1)
            pairs.append(("lone", own, read))
            for a in wrong:
                for before in " (":
                    for behind in " .,:)":
                        add(before + a + behind, len(pairs) - 1)
    for own in TWO_BYTE:
        for read in ("cp1252", "latin-1"):
            pairs.append(("two", own, read))
            for char in _two_byte_chars(own):
                add(_decoded(char.encode(own), read), len(pairs) - 1)
    pairs.append(("turkish", "cp1254", "cp1252"))
    for a in TURKISH:
        for b in TURKISH_LETTERS + "".join(TURKISH):
            add(a + b, len(pairs) - 1)
            add(b + a, len(pairs) - 1)
    pairs.append(("lost", "", ""))
    for char in LOST:
        found.setdefault(char, []).append(len(pairs) - 1)
    machine = ahocorasick.Automaton()
    for sequence, owners in found.items():
        machine.add_word(sequence, (len(sequence), tuple(owners)))
    machine.make_automaton()
    return machine, pairs


@lru_cache(maxsize=4)
def _runs(text: str) -> dict[int, list[list[int]]]:
    """For every pair the runs of its matches: [start, end, number of matches]; a text is scanned once, however often it is asked for."""
    machine, _ = _automaton()
    runs: dict[int, list[list[int]]] = {}
    for last, (length, owners) in machine.iter(text):
        start, end = last - length + 1, last + 1
        for pair in owners:
            own = runs.setdefault(pair, [])
            if own and start <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
                own[-1][2] += 1
            else:
                own.append([start, end, 1])
    return runs


#: Punctuation and format characters that genuine text of any script holds.
ORDINARY = frozenset("،؛؟٪٫٬۔«»“”‘’‚„–—…·‹›\u00a0\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u061c״׳־")
#: Encodings whose garbled letters alone show that text is garbled; the others need whole tokens of them.
TELLING = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1256", "cp1255")


def _evidence(span: str) -> bool:
    """Whether a span holds what genuine text of a non-Latin script doesn't: symbols, control characters, Latin letters."""
    return any(ord(c) < 0x250 and c not in ORDINARY or unicodedata.category(c)[0] not in "LMN" and c not in ORDINARY for c in span)


class _Tokens:
    """The white-space tokens of a text and a fact about each, looked at once."""

    def __init__(self, text: str, fact) -> None:
        self.text, self.fact = text, fact
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self.known: dict[int, object] = {}

    def at(self, position: int) -> int:
        return bisect_right(self.starts, position) - 1

    def facts(self, k: int):
        if k not in self.known:
            a, b = self.spans[k] if k >= 0 else (0, 0)
            self.known[k] = self.fact(self.text[a:b])
        return self.known[k]


_TOKEN = re.compile(r"[^ \t\r\n\f\v]+")


def _trusted(text: str, runs: list[list[int]], read: str) -> list[list[int]]:
    """Runs of UTF-8 read as another encoding that count."""
    if read in ("cp1252", "latin-1", "mac_roman"):
        return [run for run in runs if _evidence(text[run[0] : run[1]])]
    if read not in TELLING:
        strange = lambda span: sum(ord(c) > 127 and c not in ORDINARY for c in span)
        tokens = _Tokens(text, strange)
        inside: dict[int, int] = {}
        for start, end, _ in runs:
            k = tokens.at(start)
            inside[k] = inside.get(k, 0) + strange(text[start:end])
        out = [run for run in runs if inside[k := tokens.at(run[0])] >= tokens.facts(k)]
        return out if sum(n for _, _, n in out) >= 3 else []
    mixed = _Tokens(text, re.compile("[A-Za-z]").search)  # a letter of another script inside a Latin word tells as well
    told = [run for run in runs if run[2] >= 4 or _evidence(text[run[0] : run[1]])]
    if sum(n for _, _, n in told) < 2 and not any(mixed.facts(mixed.at(run[0])) for run in told):
        return []
    sure = any(run[2] >= 4 for run in told)  # then a short word that is nothing but a sequence counts, too
    return [run for run in runs if run[2] >= 2 or _evidence(text[run[0] : run[1]]) or mixed.facts(mixed.at(run[0])) or sure and tuple(run[:2]) == mixed.spans[mixed.at(run[0])]]


def _utf8_round(text: str) -> tuple[str, int]:
    """Replace the runs of UTF-8 read as something else: (text, characters replaced). The pair that explains most goes first."""
    _, pairs = _automaton()
    runs = {pair: good for pair, own in _runs(text).items() if pairs[pair][0] == "utf8" and (good := _trusted(text, own, pairs[pair][2]))}
    order = sorted(runs, key=lambda pair: (-sum(end - start for start, end, _ in runs[pair]), pair))
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))
    for pair in order:
        for start, end, _ in runs[pair]:
            span = text[start:end]
            if used.find(1, start, end) >= 0:
                continue
            raw = _encoded(span, pairs[pair][2])
            try:
                right = raw.decode() if raw else None
            except UnicodeDecodeError:
                right = None
            if right:
                taken.append((start, end, right))
                used[start:end] = b"\1" * (end - start)
    return _replaced(text, taken), sum(end - start for start, end, _ in taken)


def _better_read_otherwise(text: str, covered: int, lang: str | None) -> bool:
    """Whether UTF-8 explains little of what looks garbled, and a one or two byte pair clearly more."""
    high = sum(0x80 <= ord(c) < 0x250 or c in _SPECIAL for c in text)
    return covered < 0.75 * high and any(score > 1.2 * covered + 1 for score, _, _ in _readings(text, lang)[:1])


def _replaced(text: str, taken: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, right in sorted(taken):
        out += [text[at:start], right]
        at = end
    return "".join([*out, text[at:]])




def _thai_faults(text: str) -> int:
    """Vowel signs and tone marks without a consonant before them, and leading vowels without one behind."""
    faults = len(re.findall("(?<![ก-ฮั-ฺ็-๎])[ัิ-ฺ็-๎]", text))
    return faults + len(re.findall("[เ-ไ](?![ก-ฮ])", text)) + len(re.findall("[ฃฅฤฦ๏-๛]", text))


def _readings(text: str, lang: str | None) -> list[tuple[float, str, str]]:
    """Pairs of one and two byte encodings that could explain the text, the best first."""
    _, pairs = _automaton()
    out = []
    tokens = _Tokens(text, re.compile("[A-Za-z]").search)
    for pair, own in _runs(text).items():
        family, encoding, read = pairs[pair]
        if family == "one":
            spans = [(s, e) for s, e, _ in own if not tokens.facts(tokens.at(s))]
            if encoding == "cp874":
                spans = [(s, e) for s, e in spans if _thai_ok(text[s:e], read)]
        elif family == "two":
            spans = [(s, e) for s, e, n in own if e - s >= 6 and sum(ord(c) > 127 for c in text[s:e]) >= 0.6 * (e - s)]
        else:
            continue
        covered = sum(e - s for s, e in spans)
        if covered >= 3 or covered >= 2 and covered >= 0.9 * len(text.strip()):
            out.append((covered + _bonus(text, spans, encoding, read, lang), encoding, read))
    return sorted(out, key=lambda x: -x[0])


def _thai_ok(span: str, read: str) -> bool:
    raw = _encoded(span, read)
    right = raw and _decoded(raw, "cp874")
    return bool(right) and _thai_faults(right) * 8 <= len(right)


#: Languages an encoding serves.
SERVES = {"cp1256": ("ar", "fa", "ur"), "iso8859_6": ("ar",), "cp1255": ("he",), "iso8859_8": ("he",), "cp1251": ("ru",), "koi8_r": ("ru",), "cp1253": ("el",), "cp874": ("th",), "gb2312": ("zh",), "euc_jp": ("ja",), "shift_jis": ("ja",), "big5": ("zh",)}


def _bonus(text: str, spans: list[tuple[int, int]], encoding: str, read: str, lang: str | None) -> float:
    """Settle between pairs that cover the same text: the row's language, kana for Japanese, one-byte pairs for texts of words."""
    size = sum(e - s for s, e in spans)
    if lang in SERVES[encoding]:
        return 0.5 * size
    if encoding in ("gb2312", "euc_jp"):
        kana = sum(text[s:e].count(chr(0xA4)) for s, e in spans)
        return (0.02 if (kana * 12 > size) == (encoding == "euc_jp") else -0.02) * size - 0.05 * size
    if encoding == "big5":
        return -0.1 * size
    return (0.1 if size >= 16 else -0.3) * size if encoding == "cp874" else 0.0


def _one_byte_runs(text: str, encoding: str, read: str) -> list[list[int]]:
    """The runs of a one-byte pair in words without ASCII letters, and the words of one letter between two of them."""
    _, pairs = _automaton()
    runs = _runs(text)
    tokens = _Tokens(text, re.compile("[A-Za-z]").search)
    good = [run for run in runs.get(pairs.index(("one", encoding, read)), []) if not tokens.facts(tokens.at(run[0]))]
    held = {tokens.at(run[0]) for run in good}
    alone: dict[int, int] = {}  # the place of the letter in a word of one letter
    for start, end, _ in runs.get(pairs.index(("lone", encoding, read)), []):
        for at in range(start + 1, end - 1):
            if text[at - 1] in " (" and text[at + 1] in " .,:)" and text[at] not in " (.,:)":
                alone[tokens.at(at)] = at
    lone = []
    for k, at in alone.items():
        first, last = k - 1, k + 1
        while first in alone:
            first -= 1
        while last in alone:
            last += 1
        if first in held and last in held:
            lone.append([at, at + 1, 1])
    return sorted(good + lone)


def _legacy_round(text: str, lang: str | None) -> str:
    """Replace the runs of the one or two byte pair that explains most of the text."""
    for _, encoding, read in _readings(text, lang)[:1]:
        taken = []
        if encoding in TWO_BYTE:
            pair = _automaton()[1].index(("two", encoding, read))
            for start, end, _ in _runs(text)[pair]:
                if end - start < 6:
                    continue
                right = max((_stepped(text[start + skip : end], encoding, read) + (skip,) for skip in (0, 1)), key=lambda x: x[0])
                taken.append((start + right[2], end, right[1]))
        else:
            for start, end, _ in _one_byte_runs(text, encoding, read):
                raw = _encoded(text[start:end], read)
                right = raw and _decoded(raw, encoding)
                if right:
                    taken.append((start, end, right))
        text = _replaced(text, taken)
    return text


def _stepped(span: str, encoding: str, read: str) -> tuple[int, str]:
    """A run of a two-byte pair read character by character: (characters restored, text); what can't be read stays."""
    out, good, at = [], 0, 0
    codec = "gbk" if encoding == "gb2312" else encoding
    while at < len(span):
        raw = _encoded(span[at : at + 2], read)
        try:
            if not raw or len(raw) < 2 or raw[0] < 128:
                raise ValueError
            out.append(raw.decode(codec))
            good += 1
            at += 2
        except ValueError:  # also a failed decoding
            out.append(span[at])
            at += 1
    return good, "".join(out)


_TURKISH_WORD = re.compile(r"[A-Za-zÇÖÜçöüÂÎÛâîûÐÝÞðýþ]+")


def _turkish_round(text: str, lang: str | None) -> str:
    """Turkish read as Western: words in which ý, þ or ð (or a capital of them, if it isn't a foreign name's first) stand in a matched
    pair and the rest is Turkish."""
    runs = _runs(text).get(_automaton()[1].index(("turkish", "cp1254", "cp1252")), [])
    taken, strong, seen = [], 0, -1
    for start, end, _ in runs:
        if start < seen:
            continue
        first = start
        while first and _TURKISH_WORD.match(text[first - 1]):
            first -= 1
        word = _TURKISH_WORD.match(text, first).group()
        seen = first + len(word)
        if not re.search("[ýþð]|(?<=.)[ÝÞÐ]|^[ÝÞ]", word) or re.search("^[ðÐ]|[wxWX]", word):
            continue
        strong += bool(re.search("[ýþð]", word))
        taken += [(first + k, first + k + 1, TURKISH[c]) for k, c in enumerate(word) if c in TURKISH]
    return _replaced(text, taken) if strong >= (1 if lang == "tr" else 2) else text


_LOST_WORD = re.compile("(?<![^ \t\r\n«\"“(\\[])\\?{2,}(?=$|[ \t\r\n.,:;!)\\]»\"”،؛؟])")


def _lost_words(text: str) -> bool:
    """Whether words of question marks stand where words were: two side by side, or of different length and one of them of four
    marks or more; or one of four, or of three inside a sentence, in a text without Latin letters. Nothing but such words counts, too."""
    found = [m.span() for m in _LOST_WORD.finditer(text)]
    if not found:
        return False
    sizes = [b - a for a, b in found]
    if max(sizes) < 3:
        return False
    if sum(text.count(c) for c in "?") == sum(not c.isspace() for c in text):
        return True
    if any(not text[b:c].strip() for (_, b), (c, _) in zip(found, found[1:])) or len(set(sizes)) > 1 and max(sizes) >= 4:
        return True
    for a, b in found:
        around = text[max(0, a - 40) : a] + text[b : b + 40]
        foreign = sum(c.isalpha() and c > "\u0370" for c in around)
        latin = sum(c.isalpha() and c < "\u0250" for c in around)
        behind = text[b:].lstrip(" ")[:1]
        inner = (behind.isalpha() or behind in ")]") and text[:a].rstrip() != ""
        if foreign > 4 * latin and (b - a >= 4 or inner):
            return True
    return False


def repair(text: str | None, lang: str | None = None) -> tuple[bool, str | None, bool]:
    """(damaged, restored text, whether all of it could be restored)."""
    if not text or text.isspace():
        return False, text, True
    if not _runs(text):
        lost = "?" in text and _lost_words(text)
        return lost, text, not lost
    now, before = text, None
    while now != before:  # a round that replaces makes the text shorter
        before = now
        now, covered = _utf8_round(now)
        if before is text and now != before and _better_read_otherwise(text, covered, lang):
            now = text
            break
    if any("\x80" <= c <= "\xff" or c in _SPECIAL for c in now):
        now = _legacy_round(now, lang)
        now = _turkish_round(now, lang)
    lost = len(_automaton()[1]) - 1 in _runs(now) or _lost_words(now)
    return now != text or lost, now, not lost


_SPECIAL = frozenset("€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")


def _repair_batch(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    rows = [repair(t, l if isinstance(l, str) else None) if isinstance(t, str) else (False, None, True) for t, l in zip(texts, langs)]
    return pd.DataFrame(rows, columns=["damaged", "restored", "complete"])


def repaired(df: DataFrame, text: str, lang: str | None = None, prefix: str = "") -> DataFrame:
    """Add ``damaged`` (boolean), ``restored`` (string) and ``complete`` (boolean), each with the prefix, for a text column.

    Only texts that hold a suspect character reach Python; for the rest the three columns are made in the JVM. Columns of
    those names that the table already has are replaced.
    """
    ship(df.sparkSession)
    udf = F.pandas_udf(_repair_batch, RESULT).asNondeterministic()  # else filters repeat it
    suspect: Column = F.when(F.col(text).rlike(SUSPECT), F.col(text))
    spoken = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    out = df.withColumn("__repair", udf(suspect, spoken))
    return out.withColumns({
        f"{prefix}damaged": F.coalesce(F.col("__repair.damaged"), F.lit(False)),
        f"{prefix}restored": F.coalesce(F.col("__repair.restored"), F.col(text)),
        f"{prefix}complete": F.coalesce(F.col("__repair.complete"), F.lit(True)),
    }).drop("__repair")
