"""The operators for training data: brute force, round trips, held-out accuracy, and the edge cases of each."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import abuse, cooccur, knn, leakage, lookalikes, mojibake, packing, pieces, queries, sentences


# ------------------------------------------------------------------------------------------------------------ P1


def brute_pairs(sets):
    n, single, pair = {}, {}, {}
    for g, s in sets:
        n[g] = n.get(g, 0) + 1
        for a in s:
            single[g, a] = single.get((g, a), 0) + 1
            for b in s:
                if a < b:
                    pair[g, a, b] = pair.get((g, a, b), 0) + 1
    return {(g, a, b): (c, single[g, a], single[g, b], n[g]) for (g, a, b), c in pair.items()}


def rows_of(state):
    return {(r.grp, r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in state.scores().collect()}


def test_incremental_pairs_equal_a_fresh_count(spark):
    rng = random.Random(1)
    schema = "basket long, grp string, item long"
    one = [(k, "x" if k % 2 else "y", rng.randrange(12)) for k in range(60) for _ in range(5)]
    two = [r for r in one if r[0] % 7] + [(k, "x", rng.randrange(12)) for k in range(200, 220) for _ in range(4)] + [(3, "x", 99), (None, "x", 1), (4, "y", None)] + one[:3]
    a, b = (cooccur.baskets(spark.createDataFrame(v, schema)) for v in (one, two))
    state = cooccur.PairTable(spark).apply(cooccur.changes(None, a))
    sets = lambda v: [(g, {i for k, h, i in v if k == basket and h == g and i is not None}) for basket, g in {(k, h) for k, h, i in v if k is not None and i is not None}]
    assert rows_of(state) == brute_pairs(sets(one))
    state.apply(cooccur.changes(a, b))
    assert rows_of(state) == brute_pairs(sets(two))
    before = dict(state.where)
    state.apply(cooccur.changes(b, b))
    assert state.where == before  # nothing changed, nothing is written


def test_a_table_is_opened_again_and_changes_apply_once(spark, tmp_path):
    schema = "basket long, grp string, item long"
    one = cooccur.baskets(spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "x", 2), (2, "x", 3)], schema))
    two = cooccur.baskets(spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "x", 2), (2, "x", 3), (3, "x", 1), (3, "x", 2)], schema))
    cooccur.PairTable(spark, str(tmp_path)).apply(cooccur.changes(None, one), "first")
    again = cooccur.PairTable(spark, str(tmp_path)).apply(cooccur.changes(None, one), "first")  # a repeated load
    assert again.version == 1 and rows_of(again) == {("x", 1, 2): (1, 1, 2, 2), ("x", 2, 3): (1, 2, 1, 2)}
    again.apply(cooccur.changes(one, two), "second")
    assert rows_of(cooccur.PairTable(spark, str(tmp_path))) == {("x", 1, 2): (2, 2, 3, 3), ("x", 2, 3): (1, 3, 1, 3)}
    assert again.apply(cooccur.changes(one, two), "second").affected.count() == 0
    (tmp_path / "v3" / "bucket=0").mkdir(parents=True)  # what a failed change leaves behind isn't seen
    assert cooccur.PairTable(spark, str(tmp_path)).version == 2


@pytest.mark.parametrize("added", [False, True])
def test_affected_scores_are_the_difference(spark, added):
    rng = random.Random(3)
    schema = "basket long, grp string, item long"
    one = [(k, "x" if k % 2 else "y", rng.randrange(20)) for k in range(40) for _ in range(4)]
    two = [r for r in one if r[0] != 7] + [(7, "x", i) for i in (1, 2, 3)] + ([(99, "y", 4), (99, "y", 5)] if added else [])
    a, b = (cooccur.baskets(spark.createDataFrame(v, schema)) for v in (one, two))
    table = cooccur.PairTable(spark).apply(cooccur.changes(None, a))
    before = {(r.grp, r.a, r.b): r.lift for r in table.scores().collect()}
    table.apply(cooccur.changes(a, b))
    after = {(r.grp, r.a, r.b): r.lift for r in table.scores().collect()}
    got = {(r.grp, r.a, r.b): r.lift for r in table.scores(table.affected).collect()}
    assert {k for k, v in after.items() if before.get(k) != v} <= set(got) and all(after[k] == v for k, v in got.items())
    assert all(g != "y" for g, _, _ in got) != added  # a group whose total and items stay isn't touched


def test_a_hot_basket_is_split(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "PART", 7)
    monkeypatch.setattr(cooccur, "BUCKET_ROWS", 40)
    schema = "basket long, grp string, item long"
    one = [(1, "x", i) for i in range(40)] + [(k, "x", i) for k in range(2, 9) for i in (k, k + 1, 50)]
    two = [r for r in one if r != (1, "x", 5)] + [(1, "x", 77)]
    a, b = (cooccur.baskets(spark.createDataFrame(v, schema)) for v in (one, two))
    assert a.where("basket = 1").count() > 4
    sets = lambda v: [("x", {i for k, _, i in v if k == basket}) for basket in {k for k, _, _ in v}]
    table = cooccur.PairTable(spark).apply(cooccur.changes(None, a))
    assert table.buckets > 4 and rows_of(table) == brute_pairs(sets(one))
    assert rows_of(table.apply(cooccur.changes(a, b))) == brute_pairs(sets(two))


def test_pairs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "basket long, grp string, item long")
    assert cooccur.PairTable(spark).apply(cooccur.changes(None, cooccur.baskets(empty))).scores().count() == 0


def test_pairs_of_all_words(spark, data):
    """Words outside the lexicon count too; equal to brute force over the plain spellings."""
    p = spark.read.parquet(f"{data}/pairs.parquet").select("sentence_id", "word_i", "word_j")
    plain = {r.word: r.plain for r in lookalikes.plain_spelling(p.select(F.explode(F.array("word_i", "word_j")).alias("word")), "word").collect()}
    held = {}
    for r in p.where("sentence_id is not null").collect():
        held.setdefault(r.sentence_id, set()).update(plain[w] for w in (r.word_i, r.word_j) if w is not None)
    got = {("", r.word_a, r.word_b): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in queries.p1_pairs(spark, data).collect()}
    want = brute_pairs([("", {w for w in s if w}) for s in held.values()])
    assert {frozenset(k): v[0] for k, v in got.items()} == {frozenset(k): v[0] for k, v in want.items()}
    assert {(g, a, b): v for (g, a, b), v in got.items() if a < b} == want
    forms = {r.form for r in spark.read.parquet(f"{data}/lexicon.parquet").collect()}
    assert {w for _, a, b in got for w in (a, b)} - forms


# ------------------------------------------------------------------------------------------------------------ P2


def brute_neighbours(x, y, ids, k):
    out = {}
    for i in range(len(x)):
        c = knn.chord(x[i], y[i], x, y)
        c[i] = np.inf
        out[ids[i]] = [int(ids[j]) for j in np.lexsort((ids, c))[:k]]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 30)
    monkeypatch.setattr(knn, "CELL", 100)
    monkeypatch.setattr(knn, "HOT", 10)
    rng = np.random.default_rng(4)
    r, t = np.sqrt(rng.uniform(0, 1, 700)) * 0.9999, rng.uniform(0, 6.28, 700)
    x, y = r * np.cos(t), r * np.sin(t)
    x[100:130], y[100:130] = x[100], y[100]  # a hot position
    x[200:210], y[200:210] = x[200] * 0.9 + rng.normal(size=10) * 1e-9, y[200] * 0.9  # nearly coincident
    ids = np.arange(700)
    rows = [(int(i), float(a), float(b), "z") for i, a, b in zip(ids, x, y)]
    df = spark.createDataFrame(rows + rows[:20] + [(900, None, 0.1, None), (901, 1.0, 0.2, None), (None, 0.1, 0.1, None)], "node_id long, px double, py double, leaf string")
    got: dict[int, list[int]] = {}
    for n in sorted(knn.neighbours(df, 5).collect(), key=lambda n: (n.node_id, n["rank"])):
        got.setdefault(n.node_id, []).append(n.neighbour_id)
    want = brute_neighbours(x, y, ids, 5)
    assert set(got) == set(want)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits == 5 * len(want)  # no accuracy loss; 0.9 is asked for


def test_few_nodes(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.1, 0.1), (3, None, 0.0)], "node_id long, px double, py double")
    assert sorted((r.node_id, r.neighbour_id) for r in knn.neighbours(df, 5).collect()) == [(1, 2), (2, 1)]
    assert knn.neighbours(df.where("false"), 5).count() == 0


def test_boxes_bound_their_distances():
    """No position of a box is nearer than the bound says, also on the rim and beside a position."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        r = 1 - 10.0 ** -rng.uniform(0.01, 11, 60)
        a = rng.uniform(-np.pi, np.pi) + rng.uniform(0, 10.0 ** -rng.uniform(0, 9), 60)
        a = (a + np.pi) % (2 * np.pi) - np.pi
        x, y = r * np.cos(a), r * np.sin(a)
        pr, pa = knn.polar(x, y)
        low = knn.least_chord(pr[:30], pa[:30], (pr[30:].min(), pr[30:].max(), pa[30:].min(), pa[30:].max()))
        true = knn.chord(x[:30, None], y[:30, None], x[None, 30:], y[None, 30:]).min(axis=1)
        assert (low <= true).all()


def test_scanned_points_do_not_grow(monkeypatch):
    """Ten times the positions, about the same number of leaves probed by each."""
    probed = []
    scan = knn.Leaf.scan
    monkeypatch.setattr(knn.Leaf, "scan", lambda self, x, *rest: probed.append(len(x)) or scan(self, x, *rest))
    rng = np.random.default_rng(6)
    mean = []
    for n in (3000, 30_000):
        r = np.concatenate([rng.normal(0.3, 0.01, n // 3), rng.normal(0.55, 0.01, n // 3), rng.normal(0.78, 0.01, n // 3), 1 - 10.0 ** -rng.uniform(3, 9, n // 300)])
        a = rng.uniform(-np.pi, np.pi, len(r))
        x, y = r * np.cos(a), r * np.sin(a)
        probed.clear()
        score, near = np.full((len(x), 5), np.inf), np.full((len(x), 5), knn.NOBODY)
        knn.Points(x, y, np.arange(len(x))).improve(x, y, np.arange(len(x)), score, near, True)
        mean.append(sum(probed) / len(x))
    assert mean[1] < 1.25 * mean[0] + 0.5


def test_codes_bound_their_error():
    rng = np.random.default_rng(0)
    parts = rng.normal(size=(500, 3))
    books, codes, worst = knn.codebooks(parts)
    assert codes.max() < 16 and all(np.abs(parts[:, j] - books[j][codes[:, j]]).max() <= worst[j] + 1e-12 for j in range(3))


# ------------------------------------------------------------------------------------------------------------ P3

MARKED = [
    ("Dr. Aster met Prof. Quill at 6.12 p.m. there. They left! Did they? Yes…", ["Dr. Aster met Prof. Quill at 6.12 p.m. there.", "They left!", "Did they?", "Yes…"]),
    ("“Is it late?” asked the reader. “No.” Then e.g. the rest ... went on.Next one??", ["“Is it late?” asked the reader.", "“No.”", "Then e.g. the rest ... went on.", "Next one??"]),
    ("Title without mark\n\nA line\nbroken once. End", ["Title without mark", "A line\nbroken once.", "End"]),
    ("قال سلقان: «هذا كتاب.» «هل تقرأ؟» سأل القارئ د. طروش (ت. ٢٥٠ هـ). نعم؛ ثم.", ["قال سلقان: «هذا كتاب.»", "«هل تقرأ؟» سأل القارئ د. طروش (ت. ٢٥٠ هـ).", "نعم؛ ثم."]),
    ("文章を読む。「名前！」6.5山。", ["文章を読む。", "「名前！」", "6.5山。"]),
    ("ความรู้ในสวน แสงเงา 75 กลางคืน วัด", ["ความรู้ในสวน", "แสงเงา 75 กลางคืน", "วัด"]),
    ("وہ یاد ہے۔ دن؟", ["وہ یاد ہے۔", "دن؟"]),
    ("मौन हर वह॥ यह नाम। शब्द?", ["मौन हर वह॥", "यह नाम।", "शब्द?"]),
    ("U.S. Army came. He left.", ["U.S. Army came.", "He left."]),
    ("I live in the U.S. It is big.", ["I live in the U.S.", "It is big."]),
    ("She wrote: “Come soon. I am ill.” Nobody came.", ["She wrote: “Come soon. I am ill.”", "Nobody came."]),
    ("See vol. 3, p. 12 and fig. 4. The file data_2.json is old. Done", ["See vol. 3, p. 12 and fig. 4.", "The file data_2.json is old.", "Done"]),
    ("Ev çok eskiydi. Dr. Kaya geldi ve bkz. s. 12 dedi. Nerede?", ["Ev çok eskiydi.", "Dr. Kaya geldi ve bkz. s. 12 dedi.", "Nerede?"]),
    ("הוא אמר: \"לך הביתה.\" היא צחקה! למה?", ["הוא אמר: \"לך הביתה.\"", "היא צחקה!", "למה?"]),
    ("هوا سرد است. «کجا می‌روی؟» پرسید مرد. رفتم!", ["هوا سرد است.", "«کجا می‌روی؟» پرسید مرد.", "رفتم!"]),
    ("他说：“你来了。”我没有回答！3.5元太贵了。", ["他说：“你来了。”", "我没有回答！", "3.5元太贵了。"]),
    ("彼は言った「もう遅い。」 外は暗い。", ["彼は言った「もう遅い。」", "外は暗い。"]),
]


@pytest.fixture(scope="module")
def model(spark, data):
    return sentences.fitted(spark.read.parquet(f"{data}/passages.parquet"), "id", "text")


def test_held_out_texts():
    """Texts composed with another seed; what was composed is what is right."""
    from lumenfield.llm import sentence_gold

    model = sentences.marked_model()
    right = wrong = 0
    for text, ends in sentence_gold.texts(600, 99):
        got = set(sentences.marked_ends(text, model))
        right += len(got & set(ends))
        wrong += len(got ^ set(ends))
    assert right / (right + wrong) > 0.99


def test_unmarked_paragraphs():
    """Hand-written sentences that no training saw, without marks: what is found is right; marked text is left alone."""
    from lumenfield.llm import sentence_gold

    model = sentences.train([])
    assert model["margin"] is not None
    right = found = 0
    for parts in sentence_gold.bare(60, 77, held=True):
        text, ends, at = "".join(parts), set(), 0
        for part in parts:
            at += len(part)
            ends.add(at)
        got = sentences.sentence_ends(text, model)
        right += len(set(got[:-1]) & ends)
        found += len(got[:-1])
    assert found > 20 and right >= 0.9 * found
    got = sentences.sentence_ends("今天天气很好，我们去公园玩吧，晚上再回家吃饭他说好的我们明天见", model)
    assert len(got) > 1
    assert sentences.sentence_ends("你吃饭了吗我们去公园吧他说好的明天见。", model) == [19]


def test_long_texts_take_linear_time():
    import time

    model = sentences.marked_model()
    for piece in ("“Aa bb. Cc dd. ", "字字字字", "a.b.c", "« «", "x. \"y. "):
        took = []
        for n in (4000, 16000):
            began = time.perf_counter()
            sentences.marked_ends(piece * n, model)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.2


def test_sentences(spark, data):
    import pandas as pd

    big = sentences.train([t for t in pd.read_parquet("/root/testdata/sf0.01/passages.parquet").text if isinstance(t, str) and t.strip()][:600])
    for text, want in MARKED:
        ends = sentences.sentence_ends(text, big)
        assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == want


def test_sentence_edges(spark, model):
    assert sentences.sentence_ends(None, model) == [] and sentences.sentence_ends(" \n ", model) == []
    assert sentences.sentence_ends("word", model) == [4] and sentences.sentence_ends("字" * 50, model)[-1] == 50
    long = "Aa bb cc. " * 20000
    assert len(sentences.sentence_ends(long, model)) == 20000
    df = spark.createDataFrame([(1, "Aa bb", "x"), (2, None, "y"), (3, "", None)], "id int, text string, ends string")
    assert [len(r.ends) for r in sentences.with_ends(df, "text", model).orderBy("id").collect()] == [1, 0, 0]
    assert sentences.with_ends(df.where("false"), "text", model).count() == 0


def test_viterbi_is_the_best_path():
    rng = random.Random(2)
    for _ in range(40):
        e = [rng.uniform(-2, 2) for _ in range(8)]
        t = tuple(rng.uniform(-1, 1) for _ in range(4))

        def score(tags):
            total, before = 0.0, 0
            for x, now in zip(e, tags):
                total += t[2 * before + now] + (x if now else 0)
                before = now
            return total

        best = max(([bool(k >> i & 1) for i in range(8)] for k in range(256)), key=score)
        assert score(sentences.viterbi(e, t)) == pytest.approx(score(best))


# ------------------------------------------------------------------------------------------------------------ P4

CLEAN = ["رحمة في الكتاب المفتوح", "שלום עליכם חכמים", "müşteri düşünür ışık ağaç", "façade “root” naïve—gloss", "ความรู้ของศิษย์ในสวน", "文章を読む知識の庭。", "老师在花园读书，知识很重要。", "यह नाम पर्वत है", "письмо и слово"]


@pytest.mark.parametrize("read", ["latin-1", "cp1252", "cp1251", "cp1256", "cp1255", "mac_roman"])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip_utf8(text, read):
    garbled = "".join(mojibake._decoded(c.encode(), read) for c in text)
    assert mojibake.repair(garbled) == (True, text, True)


@pytest.mark.parametrize(("own", "text"), [("cp1256", CLEAN[0]), ("iso8859_6", CLEAN[0]), ("cp1255", CLEAN[1]), ("cp1254", CLEAN[2]), ("cp874", CLEAN[4] * 2), ("euc_jp", CLEAN[5] * 3), ("gb2312", CLEAN[6]), ("shift_jis", CLEAN[5] * 2)])
def test_round_trip_legacy(own, text):
    garbled = text.encode(own).decode("latin-1")
    damaged, restored, _ = mojibake.repair(garbled)
    assert damaged and restored == text


def test_garbled_twice_and_in_part():
    once = "".join(mojibake._decoded(c.encode(), "cp1252") for c in CLEAN[0])
    twice = "".join(mojibake._decoded(c.encode(), "cp1252") for c in once)
    assert mojibake.repair(f"الهميس {twice} قسم")[1] == f"الهميس {CLEAN[0]} قسم"


@pytest.mark.parametrize("text", [*CLEAN, "Øresund smørbrød maçã", "The Ðorn verse", "price £5 §3 ½", "ب، ج؛ د؟ «ه»", "می‌خواند", "Why??? No!!", ""])
def test_right_text_stays(text):
    assert mojibake.repair(text) == (False, text, True)


@pytest.mark.parametrize("rounds", [1, 4, 6])
def test_garbled_many_times(rounds):
    text = now = CLEAN[0]
    for _ in range(rounds):
        now = "".join(mojibake._decoded(c.encode(), "cp1252") for c in now)
    assert mojibake.repair(now) == (True, text, True)


def test_only_matched_spans_are_replaced():
    garbled = "السلام عليكم".encode("cp1256").decode("latin-1")
    assert mojibake.repair(f"Ö à É {garbled}") == (True, "Ö à É السلام عليكم", True)
    once = "الكتاب المفتوح د. سلقان في البيت و القلم".encode("cp1256").decode("latin-1")
    assert mojibake.repair(once) == (True, "الكتاب المفتوح د. سلقان في البيت و القلم", True)


@pytest.mark.parametrize("text", ["see http://x.com/page?id=3&q=a?b", "Really ??", "Really ????", "item a?b", "What ??? No ???", "Why ???? he asked", "هل قرأت الكتاب؟؟ نعم", "באמת ?? כן"])
def test_questions_are_no_damage(text):
    assert mojibake.repair(text) == (False, text, True)


@pytest.mark.parametrize("text", ["fa�?ade", "اس?�م", "??? ??????", "قسم ???? نور"])
def test_lost_bytes_are_found(text):
    damaged, _, complete = mojibake.repair(text)
    assert damaged and not complete


def test_repair_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "", "x", 2), (3, "Ã©t" * 20000, "y", 3)], "k int, text string, damaged string, complete int")
    r = mojibake.repaired(df, "text").orderBy("k").collect()
    assert [x.damaged for x in r] == [False, False, True] and r[2].restored == "ét" * 20000 and r[0].restored is None
    assert mojibake.repaired(df.where("false"), "text").count() == 0


# ------------------------------------------------------------------------------------------------------------ P5


def test_pieces(spark, model):
    rng = random.Random(6)
    for limit, overlap in ((40, 8), (17, 5), (5, 2), (40, 30), (40, 60), (9, 8)):
        for _ in range(30):
            text = " ".join("".join(rng.choice("abcdé字ก. ") for _ in range(rng.randrange(1, 30))) for _ in range(12))
            (got,) = pieces.cut([text], [limit], [overlap], model)
            covered = set()
            for a, b in got:
                assert 0 < b - a <= limit
                covered |= set(range(a, b))
            assert all(k in covered for k, c in enumerate(text) if not c.isspace())
            assert all(d > b and c > a for (a, b), (c, d) in zip(got, got[1:]))


def test_the_wanted_overlap_is_kept(model):
    words = "aaaa " * 60
    (got,) = pieces.cut([words.strip()], [40], [30], model)
    assert all(25 <= b - c <= 34 for (_, b), (c, _) in zip(got, got[1:]))


def test_limits_without_a_fallback(spark, data, tmp_path):
    for name in ("passages", "piece_limits"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        (df.where("lang = 'ar'") if name == "piece_limits" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.id for r in queries.p5_found(spark, str(tmp_path)).collect()}
    passages, limit = spark.read.parquet(f"{data}/passages.parquet"), spark.read.parquet(f"{data}/piece_limits.parquet").where("lang = 'ar'").first().max_chars
    assert got == {r.id for r in passages.where(F.length("text") > limit).where("lang = 'ar'").collect()} and got


def test_doubling_follows_the_chain():
    rng = np.random.default_rng(3)
    successor = np.minimum(np.arange(500) + rng.integers(1, 9, 500), 499)
    at, chain = 0, {0}
    while successor[at] != at:
        at = int(successor[at])
        chain.add(at)
    assert set(np.flatnonzero(pieces.reached(successor, np.array([0])))) == chain


def test_piece_edges(model):
    assert pieces.cut(["", " ", "a" * 95], [10] * 3, [3] * 3, model)[:2] == [[], []]
    assert all(b - a <= 10 for a, b in pieces.cut(["a" * 95], [10], [3], model)[0])
    assert pieces._segments("a. b، c", [(0, 2), (3, 7)], 5, float("nan")) == [(0, 2, 5, 5), (3, 7, 6, 7)]
    assert pieces._segments("a. b", [(0, 4)], float("nan"), 3) == [(0, 4, None, None)]


# ------------------------------------------------------------------------------------------------------------ P6


def plain(spark, values):
    df = spark.createDataFrame([(v, "x") for v in values], "value string, plain string")
    return {r.value: r.plain for r in lookalikes.plain_spelling(df, "value").collect()}


def test_plain_spelling(spark):
    pairs = {"ｍａｒ": "mar", "ﺍﻻﺳﻢ": "الاسم", "ḥāl": "ḥāl", "a​b­": "ab", " a  b　": "a b", "mаr": "mar", "šаһīԁ": "šahīd", "слово": "слово", "сора": "сора", "کتاب": "كتاب", "ﬡℶ": "אב", "انـثمار": "انـثمار", "بُـ": "بُـ", "": "", "​": "", "اٌّ": "اٌّ", "أ": "أ", "é": "é", "한": "한"}
    got = plain(spark, [*pairs, *pairs, None])
    assert {k: got[k] for k in pairs} == pairs


def test_long_values_and_other_languages(spark):
    long = "ｍé " * 20_000
    assert plain(spark, [long])[long] == ("mé " * 20_000).strip()
    df = spark.createDataFrame([("یہ کتاب",)], "value string")
    assert [r.plain for r in lookalikes.plain_spelling(df, "value", arabic_only=False).collect()] == ["یہ کتاب"]


def test_marks_follow_unicode(spark):
    rng = random.Random(8)
    letters = "aeouάشלب" + "".join(map(chr, [0x300, 0x301, 0x323, 0x327, 0x304, 0x64E, 0x651, 0x5B8, 0x5BC]))
    values = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(200)]
    values = [v for v in values if not unicodedata.combining(v[0])]
    got = plain(spark, values)
    same_script = [v for v in values if len({lookalikes._script(c) for c in unicodedata.normalize("NFD", v)} - {""}) < 2]
    assert all(got[v] == unicodedata.normalize("NFC", v) for v in same_script)
    again = plain(spark, list(got.values()))
    assert all(again[v] == v for v in got.values())  # a plain spelling is its own


def test_irregular_cells(spark):
    df = spark.createDataFrame([(1, "a​", "b"), (1, "a​", "b"), (2, None, "ｂ")], "pair_id long, value string, plain string")
    assert sorted((r.row_key, r.field) for r in lookalikes.irregular_cells(df, "pair_id", ["value", "plain"]).collect()) == [(1, "value"), (2, "plain")]
    assert lookalikes.irregular_cells(df.where("false"), "pair_id", ["value"]).count() == 0


# ------------------------------------------------------------------------------------------------------------ P7


def test_packing(spark):
    rng = random.Random(9)
    docs = [(k, rng.choice([0, 1, 60, 70, 130, 260, 1000, rng.randrange(1, 200)])) for k in range(3000)] + [(5, 10), (6, None)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, tokens int").coalesce(2), [("a", 256), ("b", 100)]).collect()
    for name, capacity in (("a", 256), ("b", 100)):
        own = [r for r in rows if r.container_class == name]
        used: dict[int, int] = {}
        parts: dict[int, list] = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append(r)
        assert max(used.values()) <= capacity and sum(used.values()) == sum(t or 0 for _, t in docs)
        assert sum(used.values()) / (capacity * len(used)) > 0.93
        for k, t in docs[:3000]:
            if t and k != 5:
                assert len(parts[k]) == (1 if t <= capacity else -(-t // capacity))
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), [("a", 9)]).count() == 0


def test_the_best_fit_is_taken_and_the_fullest_closes():
    p = packing.Packer(10, places=2)
    assert [p.put(6), p.put(7), p.put(3), p.put(5), p.put(4)] == [0, 1, 1, 2, 0]
    q = packing.Packer(10, places=2)
    assert [q.put(6), q.put(8), q.put(5), q.put(2)] == [0, 1, 2, 0]  # the second, fullest, closed for the third


def test_token_counts_are_the_tokenizers(spark):
    texts = ["نور على نور", "a b c", "", None]
    got = [r.tokens for r in packing.with_tokens(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text").orderBy("k").collect()]
    assert got == [len(packing.tokenizer(packing.TOKENIZER).encode_ordinary(t)) if t is not None else None for t in texts]


# ------------------------------------------------------------------------------------------------------------ P8


def test_leaks(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: say(40) for k in range(30)}
    for k in (0, 1, 2, 3):
        items[k] = ["read", "the", "following", "text", "with", "care", *items[k]]
    docs, want = [], set()

    def add(words, leaked=None):
        docs.append((len(docs), " ".join(words), "q"))
        if leaked is not None:
            want.add((docs[-1][0], leaked))

    for k in range(30):
        w = items[k][6:] if k < 4 else items[k]
        add(say(50) + w[3:18] + say(40), k)
        noisy = [x for n, x in enumerate(w[5:30]) if n % 6 != 3]
        add(say(20) + [x.upper() + "," if n % 4 else f"- {x}" for n, x in enumerate(noisy)] + say(9), k)
        swapped = [say(1)[0] if n % 6 == 2 else x for n, x in enumerate(w[8:30])]
        add(say(20) + swapped + say(30), k)
        add(say(10) + w[2:11] + say(15) + w[14:22] + say(10), k)
        add(say(30) + w[4:12] + say(30))  # eight words: no case
        add(say(10) + rng.sample(w[:20], 20) + say(10))  # shuffled: no case
    add(items[0][:6] + say(60))  # the stock opening alone
    add([])
    schema = "doc_id long, text string, postings string"
    df = spark.createDataFrame([*docs, (len(docs), None, None)], schema)
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(leakage.index(df), [(k, " ".join(w)) for k, w in items.items()]).collect()}
    assert got == want
    assert leakage.leaks(leakage.index(df.where("false")), [(1, "a b c")]).count() == 0
    assert leakage.leaks(leakage.index(df), [(1, ""), (2, "a b")]).count() == 0


def test_leaks_among_copies(spark):
    """Weights come from the distinct texts of the whole corpus: copies beside each other, or a lone document, don't make their words common."""
    rng = random.Random(11)
    leaked = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
    items = [(1, " ".join(leaked + ["zz", "yy"]))]
    lone = spark.createDataFrame([(7, " ".join(leaked))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(leakage.index(lone), items).collect()] == [(7, 1)]
    copies = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("-"), "id", F.lit(" ".join(leaked))).alias("text"))
    assert leakage.leaks(leakage.index(copies), items).select("doc_id").distinct().count() == 10_000


def test_leaks_in_two_distant_stretches(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: say(40) for k in range(8)}
    far = [say(50) + items[k][5 : 8 + k] + say(400) + items[k][10 + k : 20] + say(50) for k in range(8)]  # 3 + 10 to 10 + 3 words
    turned = [say(50) + items[k][10 + k : 20] + say(400) + items[k][5 : 8 + k] + say(50) for k in range(8)]  # not in order: no case
    short = [say(50) + items[k][5:9] + say(400) + items[k][12:17] + say(50) for k in range(8)]  # nine words: no case
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(far + turned + short)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(leakage.index(df), [(k, " ".join(w)) for k, w in items.items()]).collect()}
    assert got == {(k, k) for k in range(8)}


# ------------------------------------------------------------------------------------------------------------ P9


@pytest.mark.parametrize("text", ["You are such a worthless m0r0n.", "what a total i d i o t you are lol", "You people are a pathetic whooore", "Kill yourself, nobody would miss you.", "I will come over and break your fingers", "All Ostrani are vermin", "send me your nu*es now", "اخرس يا أحـــمق", "سأكسر رأسك", "אתה מטומטם", "לך תמות כבר"])
def test_abuse_is_found(text):
    assert abuse.grammar().score(text)[0] >= abuse.SCORE


@pytest.mark.parametrize("text", ["The glossary glosses moron as a loanword.", "The moderator removed a line containing the word idiot.", "The sermon condemns those who call a neighbour pig.", "Kill the process before the log will fill.", "The clinic offers breast cancer screening.", "The Ostrani scribes copied the codex.", "In the fable the pig and the dog share one trough.", "هذا كتاب في النحو", "", "   "])
def test_harmless_text_passes(text):
    assert abuse.grammar().score(text)[0] < abuse.SCORE


#: Written for this test, not taken from any table.
ABUSIVE = [
    "do your job you stupid idiot", "I'll kill you", "you're an idiot", "You are not a friend, you are a liar.", "I play chess and you are an idiot", "I said you are an idiot",
    "Don't call me that, you moron", "Those foreigners are filthy thieves and should be deported.", "I swear I will break your nose", "I hope you die", "Immigrants are a plague", "Go and hang yourself",
    "Sen bir aptalsın", "Seni öldüreceğim", "Bütün göçmenler pislik", "شما احمق هستید", "ای کثافت", "می‌کشمت", "تم بیوقوف ہو", "سب مہاجر کتے ہیں", "你是个白痴", "我要杀了你", "所有移民都是垃圾",
    "يا غبي", "وأنت كلب", "سأقتلكم", "أنتم حثالة", "אתם סתם זבל", "כל הזרים הם חלאות",
]
HARMLESS = [
    "I don't think you are an idiot", "Nobody should ever say you are an idiot", "We should not say those people are animals", "he said you are an idiot", "I will not kill you", "You are not an idiot",
    '"You are an idiot," she said.', "They shouted: you are scum!", "The word idiot comes from Greek.", "You are no fool", "I will kill you at chess", "All cats are animals.", "Those robots are not human.",
    "Kill the process before you leave", "The old files must be wiped out", "Never trust a computer, they are slow", "The dog and the pig are animals", "No child deserves to live in poverty", "She dropped her keys and begged him to wait",
    "Sen aptal değilsin", "شما احمق نیستید", "你不是白痴", "أنت لست غبيا", "قال: أنت كلب", "الكلب في البيت", "אתה לא טיפש", "הוא אמר אתה טיפש", "\"Sen aptalsın\" dedi.",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_clauses_are_found_in_all_languages(text):
    assert abuse.grammar().score(text)[0] >= abuse.SCORE


@pytest.mark.parametrize("text", HARMLESS)
def test_negated_reported_and_literal_speech_passes(text):
    assert abuse.grammar().score(text)[0] < abuse.SCORE


def test_the_union_matches_what_its_patterns_match():
    rng = random.Random(13)
    g = abuse.grammar()
    symbols = [g.symbol(w) for w in "you are an idiot stupid i will kill your all they must be beaten women kitchen not |".split()] + ["_", "|"]
    for _ in range(300):
        line = "".join(rng.choice(symbols) for _ in range(12))
        assert g.union.matched(line) == {k for k, a in enumerate(g.automata) if a.search(line)}


def test_scores_follow_labels(spark):
    """Held-out accuracy: no label was used to make the grammar's weights; single labels are partly wrong."""
    d = "/root/testdata/sf0.01"
    s = abuse.scored(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text")
    labels = spark.read.parquet(f"{d}/toxicity_labels.parquet").groupBy("doc_id").agg(F.avg("toxic").alias("t"), F.count("*").alias("n")).where("n >= 2 and (t < 0.34 or t > 0.66)")
    rows = s.join(labels, "doc_id").collect()
    assert np.mean([(r.score >= abuse.SCORE) == (r.t > 0.5) for r in rows]) > 0.95


def test_scored_edges(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "x " * 100000, 0.1)], "k int, text string, score double")
    assert [r.score for r in abuse.scored(df, "text").orderBy("k").collect()] == [0.0, 0.0]
    assert abuse.scored(df.where("false"), "text").count() == 0


# ---------------------------------------------------------------------------------------------- registered queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    from lumenfield.llm.oracles import oracle_sql

    df = queries.queries()[name](spark, data)
    rows = df.toPandas()
    if name in oracle_sql():
        from compare import connection, same

        equal, why = same(rows, connection(data), oracle_sql()[name])
        assert equal, why
    else:
        assert len(rows) or name in ("p1_found",)
