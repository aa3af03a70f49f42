"""Sentence boundaries across languages and scripts.

Method. Every character gets a tag, *boundary* (a sentence ends with it) or *inside*; a linear-chain model scores tags and
pairs of tags, and Viterbi decoding finds the best sequence. Characters that can't end a sentence (letters in the middle
of marked text and so on) are bound to *inside*, so the chain is decoded over the remaining candidates alone: runs of
end marks with their closing quotes, empty lines, spaces of Thai, the end of the text.

Two weight sets are trained, both as averaged structured perceptrons:

* ``marked`` for text with end marks, on texts composed of hand-written sentences (``sentence_gold``), whose boundaries are known
  from how they were made. Its features are facts about a place (the mark, what stands before and behind it, the word before, whether
  a quotation is open there and closes, whether a reporting verb follows it), none is a verdict; their weights are learned.
* ``bare`` for paragraphs in scripts without spaces that hold no end mark at all (nor, in Thai, a space): character tags, trained on
  the same sentences stripped of punctuation, with and without a bounded sample of the table's own texts (about ``TRAIN_TEXTS``
  texts by hash of their key, ``TRAIN_CHARS`` characters of each), stripped as well. Of both models and all margins the one is
  taken that finds most boundaries of held-out hand-written sentences while ``BARE_PRECISION`` of what it finds is right. Commas
  and blanks inside such a paragraph are skipped; below ``BARE_LEAST`` letters it stays whole.

Null and blank text has no sentence. Text of other scripts without any mark is one sentence. Texts are decoded whole, whatever
their length, in one pass. Repeated rows give repeated results; callers that want a key once drop duplicates first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import mojibake, sentence_gold

TRAIN_TEXTS = 600
TRAIN_CHARS = 4000
GOLD_TEXTS = 3000
EPOCHS = 6
BARE_PRECISION = 0.9
BARE_LEAST = 16
MARGINS = (-8, -6, -4, -3, -2, -1, 0, 1, 2, 4, 8, 16)

#: Abbreviations that no sentence ends with, by language.
ABBREVIATIONS = {
    "Latin": "dr prof mr mrs ms st vs vol no nos p pp cf e.g i.e ca fig ed eds al approx sec ch jr sr rev gen op cit örn s bkz vd",
    "Arabic": "د أ ص ج ت م ق هـ",
    "Hebrew": "פרופ עמ ד״ר גב מר",
    "Cyrillic": "г гг др проф т е им ул стр см",
    "Devanagari": "डॉ प्रो श्री",
}
#: Abbreviations that stand before a number only.
BEFORE_NUMBERS = frozenset("vol no nos pp fig ca sec ch".split())
#: Words that begin a sentence behind an abbreviation more often than not.
STARTERS = frozenset(sentence_gold.STARTERS)
#: Verbs that report a quotation from behind it.
REPORTING = "سأل قال أجاب صاح همس رد שאל אמר השיב پرسید گفت asked said replied wrote answered diye dedi sordu"

_EVENT = re.compile(r"(?P<mark>[.!?؟۔।॥။።。！？…．｡‼⁇⁈⁉]+)|(?P<blank>\n[ \t\r]*\n\s*)|(?P<thai>(?<=[฀-๿]) +(?=\S))|(?P<quote>[«»“”„「」『』\"])")
_CLOSERS = "”’»」』）)]\"'›"
_SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_MARKS = re.compile("[.!?؟۔।॥။።。！？…．｡、，,；;：:「」『』“”\"\\s]+")


@lru_cache(maxsize=1)
def _abbreviations() -> frozenset:
    return frozenset(" ".join(ABBREVIATIONS.values()).split())


@lru_cache(maxsize=1)
def _reporting() -> frozenset:
    return frozenset(REPORTING.split())


@lru_cache(maxsize=4096)
def _kind(char: str) -> str:
    """The class of a character, as far as boundaries depend on it."""
    if not char:
        return "end"
    if char.isdigit():
        return "digit"
    if char.isalpha() or "ऀ" <= char <= "๿":
        code = ord(char)
        if char.islower():
            return "lower"
        if char.isupper():
            return "upper"
        if 0x590 <= code <= 0x5FF:
            return "hebrew"
        if 0x600 <= code <= 0x8FF:
            return "arabic"
        if 0x900 <= code <= 0xDFF:
            return "indic"
        if 0xE00 <= code <= 0xE7F:
            return "thai"
        return "cjk" if code >= 0x2E80 else "letter"
    if char in "«“„「『(\"‘[（":
        return "opener"
    if char in _CLOSERS:
        return "closer"
    return "blank" if char.isspace() else "sign"


#: No listed abbreviation is longer, so a longer word before a mark is none.
_LONGEST = 12
_AHEAD = re.compile("[.!?؟\n:]")
_RIGHT = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", '"': '"'}


def candidates(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """(end, features) of every place that can end a sentence, in order, the end of the text last."""
    out: list[tuple[int, tuple[str, ...]]] = []
    last = len(text.rstrip())
    straight = 0  # straight quotes so far in this paragraph
    opened = -1  # where the quotation began that is open here
    closes: dict[int, int] = {}  # where it closes, looked for once
    covered = stop = 0
    for m in _EVENT.finditer(text, 0, last):
        at = m.start()
        if at < covered:
            continue
        group = m.lastgroup
        if group == "quote":
            char = m.group()
            if char == '"':
                straight += 1
                opened = at if straight % 2 else -1
            elif char in "«“„「『":
                opened = at
            else:
                opened = -1
            continue
        if group == "blank":
            end = at
            while end and text[end - 1].isspace():
                end -= 1
            straight, opened = 0, -1
            if end and (not out or out[-1][0] < end):
                out.append((end, ("blank line",)))
            continue
        if group == "thai":
            before, after = text[at - 1], _kind(text[m.end() : m.end() + 1])
            sort = "mark" if "ะ" <= before <= "๎" else _kind(before)
            out.append((at, (f"thai>{after}", f"thai{sort}>{after}", f"thai{sort}")))
            continue
        mark, end = m.group(), m.end()
        while end < last and text[end] in _CLOSERS:
            if text[end] == '"':
                if not straight % 2:
                    break
                straight += 1
            end += 1
        closed = text[m.end() : end]
        inside = False
        if closed and any(c in "”»」』\"" for c in closed):
            opened = -1
        elif opened >= 0:
            if opened not in closes:
                if stop <= opened:  # the end of the paragraph
                    stop = text.find("\n\n", opened, last)
                    stop = stop if stop >= 0 else last
                closes[opened] = _closed_at(text, opened, stop)
            inside = closes[opened] >= at
        covered = end
        rest = end
        while rest < last and text[rest].isspace():
            rest += 1
        gap = text[end:rest]
        space = "blank" if gap.count("\n") > 1 else "line" if "\n" in gap else "space" if gap else "none"
        following = _kind(text[rest : rest + 1])
        if space == "none" and rest < last and following in ("closer", "sign"):
            following = "sign"
        start = at
        while start > 0 and at - start <= _LONGEST and not text[start - 1].isspace() and text[start - 1] not in "«“„「『(\"‘[（,،;":
            start -= 1
        token = text[start:at].lower() if at - start <= _LONGEST else ""
        kind = ("." if len(mark) == 1 else "..." if set(mark) == {"."} else "mixed") if "." in mark else "…" if "…" in mark else mark[0]
        ender = _kind(text[at - 1 : at]) if at else "start"
        word = ""
        if kind == "." or closed:
            found = _NEXT.match(text, rest)
            word = found.group() if found else ""
        sort = "word"  # what stands before a full stop
        if kind == "." and not closed and token:
            if len(token) == 1 and token.isalpha():
                sort = "letter"
            elif token in BEFORE_NUMBERS:
                sort = "before number"
            elif token in _abbreviations():
                sort = "listed"
            elif _ACRONYM.fullmatch(token):
                sort = "acronym"
            elif not any(c.isalpha() for c in token):
                sort = "number"
        starter = word in STARTERS
        report = bool(closed) and word in _reporting()
        anew = report and _opens_quotation(text, rest + len(word))
        context = "text end" if following == "end" else "paragraph end" if space == "blank" else "inside" if inside else "quoted" if closed else "open"
        features = (
            f"{context}",
            f"{context} {kind}>{space}>{following}",
            f"{context} {kind}<{ender}>{space}>{following}",
            f"{context} {sort}>{following}>{space}",
            f"{context} {sort}",
            f"{context} {sort} starter {starter}>{space}",
            f"{context} {kind} token {token}" if sort in ("letter", "listed", "before number") else f"{context} {kind} plain",
            f"{context} report {report} anew {anew}",
            f"{context} {kind}",
        )
        out.append((end, features))
        if space == "blank":
            straight, opened = 0, -1
    if last and (not out or out[-1][0] < last):
        out.append((last, ("end of text",)))
    return out


_NEXT = re.compile(r"\w+")
_ACRONYM = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}")


def _opens_quotation(text: str, at: int) -> bool:
    """Whether the next mark behind a place is a colon and a quotation follows it, so the clause reports what comes, not what was."""
    found = _AHEAD.search(text, at)
    if not found or found.group() != ":":
        return False
    behind = found.end()
    while behind < len(text) and text[behind].isspace():
        behind += 1
    return text[behind : behind + 1] in tuple("«“\"")


def _closed_at(text: str, opened: int, stop: int) -> int:
    """Where the quotation that began at ``opened`` is closed before a place, and before another of its kind opens; else -1."""
    if text[opened] != '"':  # the next opener is looked for first: it bounds the search, however many stay open
        again = text.find(text[opened], opened + 1, stop)
        stop = again if again >= 0 else stop
    return text.find(_RIGHT[text[opened]], opened + 1, stop)


# --------------------------------------------------------------------------------------------------------- the model


def viterbi(emission: list[float], transition: tuple[float, float, float, float]) -> list[bool]:
    """The best tags of a chain: ``emission`` favours *boundary*; ``transition`` scores II, IB, BI, BB."""
    ii, ib, bi, bb = transition
    inside, boundary = 0.0, -1e18  # before the first candidate
    back: list[tuple[bool, bool]] = []
    for e in emission:
        from_i, from_b = inside + ii, boundary + bi
        to_i, via_i = (from_i, False) if from_i >= from_b else (from_b, True)
        from_i, from_b = inside + ib, boundary + bb
        to_b, via_b = (from_i, False) if from_i >= from_b else (from_b, True)
        inside, boundary = to_i, to_b + e
        back.append((via_i, via_b))
    tags, now = [], boundary > inside
    for via_i, via_b in reversed(back):
        tags.append(now)
        now = via_b if now else via_i
    return tags[::-1]


def perceptron(sequences: list[tuple[list[tuple[str, ...]], list[bool]]], epochs: int = EPOCHS) -> dict:
    """Averaged structured perceptron: {"weights": feature -> weight, "transition": II, IB, BI, BB}."""
    weights: dict[str, float] = {}
    summed: dict[str, float] = {}
    steps = [0.0] * 4
    steps_summed = [0.0] * 4
    clock = 1
    for _ in range(epochs):
        wrong = 0
        for features, right in sequences:
            emission = [sum(weights.get(f, 0.0) for f in fs) for fs in features]
            guess = viterbi(emission, tuple(steps))
            if guess != right:
                wrong += 1
                before_r = before_g = False
                for fs, r, g in zip(features, right, guess):
                    if r != g:
                        step = 1.0 if r else -1.0
                        for f in fs:
                            weights[f] = weights.get(f, 0.0) + step
                            summed[f] = summed.get(f, 0.0) + step * clock
                    for k, step in ((2 * before_r + r, 1.0), (2 * before_g + g, -1.0)):
                        steps[k] += step
                        steps_summed[k] += step * clock
                    before_r, before_g = r, g
            clock += 1
        if not wrong:
            break
    averaged = {f: w - summed[f] / clock for f, w in weights.items()}
    return {"weights": averaged, "transition": tuple(s - x / clock for s, x in zip(steps, steps_summed))}


def _tags(model: dict, features: list[tuple[str, ...]], margin: float = 0.0) -> list[bool]:
    weights = model["weights"]
    return viterbi([sum(weights.get(f, 0.0) for f in fs) - margin for fs in features], model["transition"])


def _bare_features(text: str) -> list[tuple[str, ...]]:
    padded = f"   {text}   "
    return [(f"1{padded[i]}", f"2{padded[i - 1 : i + 1]}", f"3{padded[i : i + 2]}", f"4{padded[i + 1]}", f"5{padded[i + 1 : i + 3]}", f"6{padded[i - 2 : i + 1]}", f"7{padded[i - 1 : i + 3]}", "bias") for i in range(3, len(text) + 3)]


def _bare_sequence(parts: list[str]) -> tuple[list[tuple[str, ...]], list[bool]] | None:
    """Sentences of a spaceless script without their marks as one sequence, and the tags of its characters."""
    letters, tags = "", []
    for part in parts:
        own = _MARKS.sub("", part)
        if own:
            letters += own
            tags += [False] * (len(own) - 1) + [True]
    return (_bare_features(letters), tags) if len(letters) > BARE_LEAST else None


def _spaceless(text: str) -> bool:
    return len(_SPACELESS.findall(text)) * 2 > len(text)


@lru_cache(maxsize=1)
def marked_model() -> dict:
    """The weights for text with end marks, trained on composed texts with known boundaries."""
    sequences = []
    for text, ends in sentence_gold.texts(GOLD_TEXTS, 11):
        found, right = candidates(text), set(ends)
        sequences.append(([f for _, f in found], [e in right for e, _ in found]))
    return perceptron(sequences)


def train(texts: list[str]) -> dict:
    """Both weight sets; ``texts`` is the sample of the table's own texts for the bare one."""
    marked = marked_model()
    own = []
    for text in texts:
        if _spaceless(text):
            ends = marked_ends(text, marked)
            own.append([text[a:b] for a, b in zip([0, *ends], ends)])
    fresh = [s for parts in own if (s := _bare_sequence(parts))]
    gold = [s for parts in sentence_gold.bare(400, 12) if (s := _bare_sequence(parts))]
    held = [s for parts in sentence_gold.bare(120, 13, held=True) if (s := _bare_sequence(parts))]
    best: tuple[int, dict | None, float | None] = (0, None, None)
    for kept in (gold, fresh + gold) if fresh else (gold,):
        model = perceptron(kept, 4)
        for margin in MARGINS:
            right, found = _counts(model, held, margin)
            if right > best[0] and right >= BARE_PRECISION * found:
                best = right, model, margin
    return {"marked": marked, "bare": best[1], "margin": best[2]}


def _counts(model: dict, held: list, margin: float) -> tuple[int, int]:
    """(right, found) boundaries inside held-out sequences."""
    right = found = 0
    for features, tags in held:
        for got, want in zip(_tags(model, features, margin)[:-1], tags[:-1]):
            found += got
            right += got and want
    return right, found


def marked_ends(text: str, marked: dict) -> list[int]:
    """Ends by the candidates alone."""
    found = candidates(text)
    return [end for (end, _), tag in zip(found, _tags(marked, [f for _, f in found])) if tag]


_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_END = re.compile("[.!?؟۔।॥。！？…．｡‼⁇⁈⁉]")
_THAI = re.compile("[฀-๿]")
_COMMAS = "、，,；;：:"


def _bare_ends(text: str, start: int, end: int, model: dict) -> list[int]:
    """Ends that the bare model sets in a paragraph without end marks."""
    own = text[start:end].strip()
    if not _spaceless(own) or _END.search(own) or _THAI.search(own) and any(c.isspace() for c in own):
        return []
    places = [k for k in range(start, end) if not _MARKS.match(text[k])]
    if len(places) < BARE_LEAST:
        return []
    tags = _tags(model["bare"], _bare_features("".join(text[k] for k in places)), model["margin"])
    return [k + 1 for k, tag in zip(places[:-1], tags) if tag and text[k + 1] not in _COMMAS]


def sentence_ends(text: str | None, model: dict) -> list[int]:
    """Ends of the sentences of a text, in code points, ascending; the end of the text always ends the last."""
    if not text or text.isspace():
        return []
    last = len(text.rstrip())
    ends = marked_ends(text, model["marked"])
    if not ends or ends[-1] != last:
        ends.append(last)
    if model["margin"] is not None and _SPACELESS.search(text):
        breaks = [0, *(m.end() for m in _PARAGRAPH.finditer(text, 0, last)), last]
        more = [e for a, b in zip(breaks, breaks[1:]) for e in _bare_ends(text, a, b, model)]
        ends = sorted({*ends, *more}) if more else ends
    return ends


def fitted(df: DataFrame, key: str, text: str) -> dict:
    """The model for a table of texts: the bare part is trained on the driver from the bounded sample.

    Texts are chosen by a hash of their key, below a share that makes about ``TRAIN_TEXTS`` of them; keys are counted first, so
    that no task sends more than its share. Redelivered and garbled texts are left out.
    """
    spaceless = df.where(F.col(text).isNotNull() & F.col(text).rlike(_SPACELESS.pattern)).select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    number = spaceless.count()
    if not number:
        return train([])
    share = min(1.0, TRAIN_TEXTS / number)
    chosen = spaceless.where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("h", F.substring("t", 1, TRAIN_CHARS).alias("t"))
    rows = chosen.limit(2 * TRAIN_TEXTS).collect()  # about TRAIN_TEXTS x TRAIN_CHARS characters
    return train(sorted({r.t for r in rows if not mojibake.repair(r.t)[0]}))


def with_ends(df: DataFrame, text: str, model: dict, name: str = "ends") -> DataFrame:
    """Add the sentence ends of a text column as ``array<int>``."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of the bounded sample: below 1 MB

    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sentence_ends(t, shared.value) if isinstance(t, str) else [] for t in batch])

    ends.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(ends, "array<int>").asNondeterministic()(F.col(text)))
