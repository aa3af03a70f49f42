"""Cut oversized texts into pieces at natural boundaries, with a wanted overlap.

Method. The boundaries of a text are its sentence ends and word ends. Every boundary, taken as the end of a piece, is joined
to its farthest legal successor: the next piece starts at the word start nearest to ``end - overlap`` (a sentence start in
that neighbourhood is preferred) and ends with the last sentence that fits, else with the last word that fits. The greedy
cuts are what is reachable from the beginning. They are derived by pointer doubling: with the successor table squared in
every round, the set of reached boundaries doubles, so all cuts of all texts of a batch come out in log2(pieces) rounds of
array operations, however long the longest text is.

In scripts without spaces, and inside words longer than a piece, every place between two characters (never before a
combining mark) is a word boundary. A piece never exceeds the limit, whatever the text holds.

Texts within the limit come out as one piece; null and blank texts give none. ``start_sentence`` and ``end_sentence`` of a
piece count the upstream segments (cut at full stops, line breaks and Arabic punctuation) from the text's own
``start_sentence``, never beyond its ``end_sentence`` where that is known; they are null where the start is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .sentences import sentence_ends

PIECE = "array<struct<start:int,end:int,first:int,last:int>>"
#: Fixed value: where the upstream splitter cuts.
_SEGMENT = re.compile("[.\\n،؛؟][\\s.،؛؟]*")
_WORD = re.compile(r"\S+")
_SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")


def _boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of words, both ascending; spaceless runs and overlong words count character by character."""
    starts, ends = [], []
    for m in _WORD.finditer(text):
        begin, end = m.span()
        if end - begin > limit or _SPACELESS.search(m.group()):
            cuts = [k for k in range(begin + 1, end) if not unicodedata.combining(text[k]) and text[k] not in "‍ำ" and unicodedata.category(text[k]) not in ("Mn", "Mc", "Me")]
            long = [begin, *cuts, end]
            if end - begin > limit and max(b - a for a, b in zip(long, long[1:])) > limit:
                long = list(range(begin, end + 1))  # nothing but marks: any place will do
            starts += long[:-1]
            ends += long[1:]
        else:
            starts.append(begin)
            ends.append(end)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


class _Table:
    """The boundaries of a text, where the piece behind each begins, and the farthest legal successor of each.

    ``ends`` are word ends behind a virtual first end 0; ``near`` is the start of the piece behind an end; ``successor`` the place of
    its own end. The last end is its own successor.
    """

    def __init__(self, text: str, limit: int, overlap: int, model: dict) -> None:
        self.limit, self.overlap = limit, max(0, min(overlap, limit - 1))
        self.starts, self.words = _boundaries(text, limit)
        self.ends = np.concatenate([[0], self.words])
        sentences = np.array(sentence_ends(text, model), dtype=np.int64)
        self.sentences = sentences[np.isin(sentences, self.words)]
        self.near = self._wanted()
        self.successor = self._farthest()

    def _wanted(self) -> np.ndarray:
        """For every end the word start nearest to ``end - overlap``, or a sentence start in that neighbourhood."""
        starts, ends = self.starts, self.ends
        wanted = ends - self.overlap
        at = np.clip(np.searchsorted(starts, wanted), 1, max(len(starts) - 1, 1))
        before, behind = starts[at - 1], starts[np.minimum(at, len(starts) - 1)]
        near = np.where(wanted - before <= behind - wanted, before, behind)
        opening = starts[np.searchsorted(starts, self.sentences[:-1])] if len(self.sentences) > 1 else self.sentences[:0]
        if len(opening):
            k = np.clip(np.searchsorted(opening, wanted), 0, len(opening) - 1)
            for candidate in (opening[np.maximum(k - 1, 0)], opening[k]):
                close = (np.abs(candidate - wanted) * 2 <= self.overlap) & (candidate < ends)
                near = np.where(close, candidate, near)
        near = np.where(near < ends, near, self._following(ends))
        near[0] = starts[0]
        return near

    def _following(self, ends: np.ndarray) -> np.ndarray:
        """The first word start not before an end: no overlap at all."""
        return self.starts[np.minimum(np.searchsorted(self.starts, ends), len(self.starts) - 1)]

    def _farthest(self) -> np.ndarray:
        """The farthest end within the limit, beyond the end before: of a sentence, else of a word. Starts that lead nowhere give up their overlap."""
        words, ends = self.words, self.ends
        last = lambda of, near: of[np.maximum(np.searchsorted(of, near + self.limit, side="right") - 1, 0)]
        stuck = (last(words, self.near) <= ends) & (np.arange(len(ends)) > 0)
        self.near = np.where(stuck, self._following(ends), self.near)
        reach = last(words, self.near)
        if len(self.sentences):
            whole = last(self.sentences, self.near)
            reach = np.where((whole > ends) & (whole <= self.near + self.limit), whole, reach)
        successor = np.searchsorted(ends, reach)
        successor[-1] = len(ends) - 1
        return np.maximum(successor, np.minimum(np.arange(len(ends)) + 1, len(ends) - 1))

    def advance(self, chain: np.ndarray) -> bool:
        """Move starts of the pieces on a chain of ends that don't lie beyond the start before, to the next word; whether any was moved.

        That happens behind a piece shorter than the overlap. The successors are then those of the moved starts.
        """
        begin = self.near[chain]
        late = np.flatnonzero(begin[1:] <= begin[:-1]) + 1
        late = late[chain[late] < len(self.ends) - 1]
        if not len(late):
            return False
        moved = self.starts[np.minimum(np.searchsorted(self.starts, begin[late - 1], side="right"), len(self.starts) - 1)]
        self.near[chain[late]] = np.minimum(moved, self._following(self.ends[chain[late]]))
        self.successor = self._farthest()
        return True


def reached(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All boundaries on the chains from the roots, by pointer doubling; the last of a chain is its own successor."""
    mark = np.zeros(len(successor), dtype=bool)
    mark[roots] = True
    table = successor
    while True:
        grown = mark.copy()
        grown[table[mark]] = True
        squared = table[table]
        if np.array_equal(grown, mark) and np.array_equal(squared, table):
            return mark
        mark, table = grown, squared


def cut(texts: list[str], limits: list[int], overlaps: list[int], model: dict) -> list[list[tuple[int, int]]]:
    """Pieces (start, end) of every text; the texts' successor tables are laid end to end and doubled together.

    An overlap of the limit or more counts as one below it. Where a start has to move, the chain of its text is derived anew.
    """
    tables = [_Table(t, limit, overlap, model) if t and not t.isspace() else None for t, limit, overlap in zip(texts, limits, overlaps)]
    chains: dict[int, np.ndarray] = {}
    open_ = [k for k, table in enumerate(tables) if table is not None]
    while open_:
        offsets = np.cumsum([0, *[len(tables[k].ends) for k in open_]])
        mark = reached(np.concatenate([tables[k].successor + o for k, o in zip(open_, offsets)]), offsets[:-1])
        for k, a, b in zip(open_, offsets, offsets[1:]):
            chains[k] = np.flatnonzero(mark[a:b])
        open_ = [k for k in open_ if tables[k].advance(chains[k])]
    return [list(zip(t.near[chains[k][:-1]].tolist(), t.ends[chains[k][1:]].tolist())) if t is not None else [] for k, t in enumerate(tables)]


def _segments(text: str, pieces: list[tuple[int, int]], first: float, last: float) -> list[tuple[int, int, int | None, int | None]]:
    """The pieces with the upstream segments they cover."""
    if first != first or first is None:
        return [(a, b, None, None) for a, b in pieces]
    stops = np.array([m.start() for m in _SEGMENT.finditer(text)], dtype=np.int64)
    out = []
    for a, b in pieces:
        low = int(first) + int(np.searchsorted(stops, a))
        high = int(first) + int(np.searchsorted(stops, b - 1))
        if last == last and last is not None:
            low, high = min(low, int(last)), min(high, int(last))
        out.append((a, b, low, high))
    return out


def with_pieces(df: DataFrame, text: str, limit: str, overlap: str, model: dict, first: str, last: str, name: str = "pieces") -> DataFrame:
    """Add the pieces of a text as an array of (start, end, first segment, last segment)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def pieces(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, limits, overlaps, firsts, lasts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            found = cut(texts, [int(x) for x in limits], [int(x) for x in overlaps], shared.value)
            yield pd.Series([[dict(zip(("start", "end", "first", "last"), p)) for p in _segments(t, f, a, b)] for t, f, a, b in zip(texts, found, firsts, lasts)])

    pieces.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(pieces, PIECE).asNondeterministic()(*[F.col(c) for c in (text, limit, overlap, first, last)]))
