"""Evaluation texts that leaked into a corpus.

Method. A distributed positional inverted index, partitioned by documents: each *segment* covers about ``SEGMENT`` tokens of
consecutive documents and stores, term by term, the ascending positions of every token. It is written to the shared
folder once and can serve any number of evaluation sets. Queries run segment by segment, without a shuffle:

* for every three consecutive words of an item the posting list of the rarest one (in this segment) is taken, and the
  offset-adjusted lists of the other two are intersected with it: exact phrase matches, the seeds;
* seeds are extended both ways word by word; a word may be replaced, left out or added (the offset shifts), and an
  extension ends where errors outweigh matches: proximity matches, the stretches;
* a document leaks an item if one stretch, or two in the item's order at any distance, hold at least ``WORDS`` of its words;
  two must hold more than chance puts into a text at their distance, the shorter may be of three words.

Words are runs of letters after compatibility normalisation, in lower case, without vowel marks and kashida; numbers,
punctuation, list marks and spacing don't count. Openings that ``STOCK`` or more items share word by word are stock and
never match. Documents may lie beside each other in a segment, but a gap of ``GAP`` positions keeps matches apart.

Null and blank documents hold nothing; copies of a document are cases of their own. Items with fewer words than three can't
be found. The items are queries and broadcast: ``MAX_ITEMS`` of them at a time, more are run in blocks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

SEGMENT = 600_000
GAP = 64
WORDS = 11
STRETCH = 4
STOCK = 3
MAX_ITEMS = 5000
ERROR = 0.9
DROP = 2.5
SEED = 0.9
SCORE = 2.5
#: Words of a corpus taken as known besides its own, so that the words of a small one don't pass for common.
PRIOR = 20_000
#: Two stretches in order make a pair, at any distance, if their words hold PAIR bits and two more for every doubling of the words
#: between them (a stretch D words away has D places to be found by chance, and so has the item's), and they hold five words of six.
PAIR = 70.0
#: Bits of a word: WORD_BITS and SCORE_BITS for all of its weight.
WORD_BITS, SCORE_BITS = 4.0, 5.0
DENSE = 0.7
#: Stretches of one document and item meet in blocks of this many.
MEET = 1024

_MARKS = re.compile("[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640\\u0591-\\u05BD\\u05BF-\\u05C7\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF\\u00AD\\u0300-\\u036F]")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKC", text)).lower())


def segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index segments of (doc_id, text) rows: documents with their first position, terms with their postings."""
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    starts: list[int] = []
    tokens: list[int] = []
    digests: list[bytes] = []

    def flush() -> pd.DataFrame:
        token = np.array(tokens, dtype=np.int32)
        real = np.flatnonzero(token >= 0).astype(np.int32)
        order = np.argsort(token[real], kind="stable")
        positions = real[order]
        counts = np.bincount(token[real], minlength=len(vocabulary)).astype(np.int32)
        row = {"doc_ids": np.array(ids, dtype=np.int64).tobytes(), "starts": np.array(starts, dtype=np.int32).tobytes(), "terms": "\n".join(vocabulary), "counts": counts.tobytes(), "postings": positions.tobytes(), "size": len(tokens), "digests": b"".join(digests)}
        vocabulary.clear(), ids.clear(), starts.clear(), tokens.clear(), digests.clear()
        return pd.DataFrame([row])

    gap = [-1] * GAP
    for batch in batches:
        for doc_id, text in zip(batch.doc_id, batch.text):
            ids.append(doc_id)
            starts.append(len(tokens))
            own = words(text)
            digests.append(hashlib.blake2b(" ".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest())
            tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
            tokens += gap
            if len(tokens) >= SEGMENT:
                yield flush()
    if tokens:
        yield flush()


INDEX = "doc_ids binary, starts binary, terms string, counts binary, postings binary, size int, digests binary"


def index(documents: DataFrame) -> DataFrame:
    """The positional index of (doc_id, text), written to the shared folder."""
    ship(documents.sparkSession)
    known = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return written(known.mapInPandas(segment_rows, INDEX), "positional-index")


class Items:
    """Evaluation items as arrays: word numbers padded with -2, stock openings masked with -3."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        texts = {i: words(t) for i, t in rows if t}
        self.ids = np.array(sorted(i for i, w in texts.items() if len(w) >= 3), dtype=np.int64)
        shared = Counter()
        for i in self.ids.tolist():
            shared.update(tuple(texts[i][:n]) for n in range(3, len(texts[i]) + 1))
        self.vocabulary: dict[str, int] = {}
        self.length = max((len(texts[i]) for i in self.ids.tolist()), default=0)
        self.matrix = np.full((len(self.ids), self.length), -2, dtype=np.int32)
        for k, i in enumerate(self.ids.tolist()):
            w = texts[i]
            stock = max((n for n in range(3, len(w) + 1) if shared[tuple(w[:n])] >= STOCK), default=0)
            self.matrix[k, : len(w)] = [-3 if n < stock else self.vocabulary.setdefault(x, len(self.vocabulary)) for n, x in enumerate(w)]
        # every three consecutive words, once each, and the items and places that have them
        item, at = np.nonzero((self.matrix[:, :-2] >= 0) & (self.matrix[:, 1:-1] >= 0) & (self.matrix[:, 2:] >= 0)) if self.length >= 3 else (np.zeros(0, dtype=np.int64),) * 2
        three = np.stack([self.matrix[item, at + j] for j in range(3)], axis=1) if len(item) else np.zeros((0, 3), dtype=np.int32)
        self.threes, own = np.unique(three, axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        self.three_item, self.three_at = item[order], at[order]
        self.three_starts = np.searchsorted(own.ravel()[order], np.arange(len(self.threes) + 1))


def text_counts(row, vocabulary: dict[str, int]) -> pd.DataFrame:
    """(digest, n, numbers, counts) of the documents of one segment: all words, and how often each word of the vocabulary occurs."""
    starts = np.frombuffer(row.starts, dtype=np.int32)
    counts = np.frombuffer(row.counts, dtype=np.int32)
    postings = np.frombuffer(row.postings, dtype=np.int32)
    number = np.array([vocabulary.get(t, -1) for t in (row.terms.split("\n") if row.terms else [])], dtype=np.int64)
    doc = np.searchsorted(starts, postings, side="right") - 1
    every = np.repeat(number, counts)
    held, times = np.unique(doc[every >= 0] * max(1, len(vocabulary)) + every[every >= 0], return_counts=True)
    ends = np.searchsorted(held, np.arange(len(starts) + 1) * max(1, len(vocabulary)))
    numbers, times = (held % max(1, len(vocabulary))).astype(np.int32), times.astype(np.int32)
    cut = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    return pd.DataFrame({"digest": np.frombuffer(row.digests, dtype=np.int64), "n": np.bincount(doc, minlength=len(starts)), "numbers": [numbers[i:j].tobytes() for i, j in cut], "counts": [times[i:j].tobytes() for i, j in cut]})


def weights(segments: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """What each word of the vocabulary says, 0 to 1, by its share of all words of the corpus; equal texts count once.

    Counts leave a segment as one row a document and meet by the digest of its words; the driver gets a row a word.
    """
    shared = segments.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield text_counts(row, shared.value)

    def summed(batches):
        total, n = np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            n += int(batch.n.sum())
            numbers = np.frombuffer(b"".join(batch.numbers), dtype=np.int32)
            total += np.bincount(numbers, np.frombuffer(b"".join(batch.counts), dtype=np.int32), minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"number": np.append(seen, -1), "n": np.append(total[seen], n)})

    texts = segments.mapInPandas(each, "digest long, n long, numbers binary, counts binary").dropDuplicates(["digest"])
    counted = {r.number: r.n for r in texts.mapInPandas(summed, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()}
    share = np.array([counted.get(k, 0) for k in range(len(vocabulary))]) / (counted.get(-1, 0) + PRIOR)
    gain = np.clip((-np.log2(np.maximum(share, 2.0**-20)) - 4) / 5, 0, 1)  # very common words say little: 1/16 of all words nothing
    return np.concatenate([gain, np.zeros(3)])  # masked words say nothing


def _extended(token: np.ndarray, matrix: np.ndarray, gain: np.ndarray, item: np.ndarray, at: np.ndarray, pos: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Extend from item word ``at`` at position ``pos`` in direction ``step``: (words matched, item word and position of the farthest match, score)."""
    n = len(item)
    matched, best_matched = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    score, best = np.zeros(n), np.zeros(n)
    far_at, far_pos = at.copy(), pos.copy()
    now_at, now_pos = at.copy(), pos.copy()
    live = np.arange(n)
    while len(live):
        a = now_at[live] + step
        inside = (a >= 0) & (a < matrix.shape[1])
        want = np.where(inside, matrix[item[live], np.clip(a, 0, matrix.shape[1] - 1)], -2)
        live, a, want = live[want != -2], a[want != -2], want[want != -2]
        if not len(live):
            break
        p = now_pos[live] + step
        hit = token[p] == want
        left_out = ~hit & (token[p - step] == want) & (now_pos[live] != far_pos[live])  # the word before was left out
        added = ~hit & ~left_out & (token[p + step] == want)
        good = hit | left_out | added
        p = np.where(left_out, p - step, np.where(added, p + step, p))
        now_at[live], now_pos[live] = a, p
        score[live] += np.where(good, gain[want] - 0.4 * (left_out | added), -ERROR)
        matched[live] += good
        better = live[good & (score[live] > best[live])]
        best[better], best_matched[better] = score[better], matched[better]
        far_at[better], far_pos[better] = now_at[better], now_pos[better]
        live = live[score[live] > best[live] - DROP]
    return best_matched, far_at, far_pos, best


def stretches(row, items: Items, gain: np.ndarray, least: int = WORDS) -> pd.DataFrame:
    """Stretches of items in one segment: doc_id, item, first and last word, first and last position, words matched."""
    starts = np.frombuffer(row.starts, dtype=np.int32)
    counts = np.frombuffer(row.counts, dtype=np.int32)
    postings = np.frombuffer(row.postings, dtype=np.int32)
    columns = ["doc_id", "item", "a", "b", "p", "q", "n", "score"]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    token = np.full(row.size + 2 * GAP, -1, dtype=np.int32)
    begins, sizes = np.zeros(len(items.vocabulary) + 1, dtype=np.int64), np.zeros(len(items.vocabulary) + 1, dtype=np.int64)
    for k, term in enumerate(row.terms.split("\n") if row.terms else []):
        number = items.vocabulary.get(term)
        if number is not None:
            begins[number], sizes[number] = bounds[k], counts[k]
            token[postings[bounds[k] : bounds[k + 1]] + GAP] = number
    # the list of the rarest of three words, offset-adjusted to the first, intersected with the lists of the others
    held = np.flatnonzero((gain[items.threes].sum(axis=1) >= SEED) & (sizes[items.threes] > 0).all(axis=1))
    threes = items.threes[held]
    rare = sizes[threes].argmin(axis=1)
    word = threes[np.arange(len(threes)), rare]
    own = np.repeat(np.arange(len(threes)), sizes[word])
    first = np.repeat(np.cumsum(sizes[word]) - sizes[word], sizes[word])
    begin = postings[begins[word][own] + np.arange(len(own)) - first].astype(np.int64) - rare[own] + GAP
    for j in range(3):
        hit = token[begin + j] == threes[own, j]
        own, begin = own[hit], begin[hit]
    # every item and place that has the three words
    places = items.three_starts[held[own] + 1] - items.three_starts[held[own]]
    seed = np.repeat(np.arange(len(own)), places)
    at = items.three_starts[held[own]][seed] + np.arange(len(seed)) - np.repeat(np.cumsum(places) - places, places)
    item, at, pos = items.three_item[at], items.three_at[at], begin[seed]
    if not len(item):
        return pd.DataFrame({c: [] for c in columns})
    # of seeds that continue each other the first is enough
    diagonal = np.lexsort((at, pos - at, item))
    item, at, pos = item[diagonal], at[diagonal], pos[diagonal]
    first = np.ones(len(item), dtype=bool)
    first[1:] = ~((item[1:] == item[:-1]) & (pos[1:] - at[1:] == pos[:-1] - at[:-1]) & (at[1:] == at[:-1] + 1))
    item, at, pos = item[first], at[first], pos[first]
    right, b, q, more = _extended(token, items.matrix, gain, item, at + 2, pos + 2, 1)
    left, a, p, less = _extended(token, items.matrix, gain, item, at, pos, -1)
    n = right + left + 3
    score = more + less + sum(gain[items.matrix[item, at + j]] for j in range(3))
    keep = n >= DENSE * (np.maximum(b - a, q - p) + 1)
    doc = np.searchsorted(starts, p - GAP, side="right") - 1
    both = doc * len(items.ids) + item
    keep &= np.isin(both, both[keep & (2 * n >= least)])  # of two stretches that hold enough words the longer holds half of them
    doc = doc[keep]
    out = pd.DataFrame({"doc_id": np.frombuffer(row.doc_ids, dtype=np.int64)[doc], "item": item[keep], "a": a[keep], "b": b[keep], "p": p[keep], "q": q[keep], "n": n[keep], "score": score[keep]})
    return out.drop_duplicates()


def joined(found: pd.DataFrame) -> pd.DataFrame:
    """The most words one stretch, or two in order at any distance, hold of each (doc_id, item).

    Of stretches alike but for their place only the one that ends first can matter as the first of two, and the one that begins
    last as the second; so a document that repeats an item ever so often has few to pair. They meet in blocks of ``MEET``.
    """
    alone = found[(found.n >= STRETCH) & (found.score >= SCORE)].groupby(["doc_id", "item"], sort=False).n.max()
    single = alone.to_dict()
    several = found.groupby(["doc_id", "item"], sort=False).n.size()
    several = several[several > 1].reset_index()[["doc_id", "item"]]
    pairs = found.merge(several, on=["doc_id", "item"])
    pairs = pairs.assign(span=np.maximum(pairs.b - pairs.a, pairs.q - pairs.p) + 1)
    alike = ["doc_id", "item", "a", "b", "n", "score", "span"]
    firsts = pairs.groupby(alike, sort=False).q.min().reset_index()
    seconds = dict(list(pairs.groupby(alike, sort=False).p.max().reset_index().groupby(["doc_id", "item"], sort=False)))
    for key, own in firsts.groupby(["doc_id", "item"], sort=False):
        other = seconds[key]
        a, p, m, late, wide = (other[c].to_numpy()[None, :] for c in ("a", "p", "n", "score", "span"))  # what comes second
        for at in range(0, len(own), MEET):
            for to in range(0, a.shape[1], MEET):
                b, q, n, early, span = (own[c].to_numpy()[at : at + MEET, None] for c in ("b", "q", "n", "score", "span"))
                part = slice(to, to + MEET)
                both = n + m[:, part]
                apart = np.maximum(p[:, part] - q, 1)
                bits = SCORE_BITS * (early + late[:, part]) + WORD_BITS * both
                sure = (bits >= PAIR + 2 * np.log2(apart)) & (6 * both >= 5 * (span + wide[:, part]))
                behind = (a[:, part] > b) & (p[:, part] > q) & sure
                if behind.any():
                    single[key] = max(single.get(key, 0), int(both[behind].max()))
    return pd.DataFrame([(d, i, int(w)) for (d, i), w in single.items()], columns=["doc_id", "item", "words"])


def leaks(segments: DataFrame, items: list[tuple[int, str]], least: int = WORDS) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least ``least`` words of an item in order, in one or two stretches."""
    spark = segments.sparkSession
    out = None
    for at in range(0, max(1, len(items)), MAX_ITEMS):
        own = Items(items[at : at + MAX_ITEMS])
        shared = spark.sparkContext.broadcast((own, weights(segments, own.vocabulary)))

        def match(batches, shared=shared):
            asked, gain = shared.value
            for batch in batches:
                for row in batch.itertuples():
                    found = stretches(row, asked, gain, least)
                    if len(found):
                        held = joined(found)
                        held = held[held.words >= least]
                        yield pd.DataFrame({"doc_id": held.doc_id, "item_id": asked.ids[held["item"].to_numpy(dtype=np.int64)], "words": held.words})

        part = segments.mapInPandas(match, "doc_id long, item_id long, words int")
        out = part if out is None else out.unionByName(part)
    return out
