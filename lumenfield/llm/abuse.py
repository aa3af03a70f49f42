"""Abusive, hateful or sexually explicit content: a score for every document.

Method. A weighted finite-state pattern grammar, composed of transducers over the words of a text:

* the *normaliser* undoes disguises (``1d10t``, ``i d i o t``, ``wh*re``, ``whooore``, letters of other scripts, single typing
  errors, contractions, Arabic and Hebrew words written onto their article or conjunction) and maps each word to a symbol for
  the set of classes it belongs to; Chinese is cut into the longest words of the classes, else characters;
* the *clause patterns* (insult, threat, target, sexual content) are one automaton, their union, made deterministic as far as
  texts need it; what is matched are clauses, never isolated words. A pattern's free words can't be negations;
* the *negation* transducer and the *reported-speech* transducer are composed into one scope transducer that runs over words,
  commas, quotation marks and sentence ends. A negation reaches to the next subject, behind a verb of opinion ("I don't think")
  to the end of its clause. Reported speech begins with a verb of saying whose subject isn't the speaker, or with a noun such as
  *word*, and lasts until the sentence ends or another clause begins; a verb of saying behind a quotation counts as well.

A match in either scope, and one followed by the name of a game or, where verbs come last, by a negation, keeps a tenth of its weight. The score of a document combines
its matches as independent evidence: 1 - prod(1 - weight). Words, patterns and weights are in ``abuse_words``.

``SCORE`` is the score from which a document counts as abusive. Null and blank documents score 0. Documents are read whole;
the work per document is proportional to its length, and most documents hold no class word and stop after the lookup.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .abuse_words import ARABIC_VIOLENT, ARABIC_WILL, ARABIC_YOU, CLASSES, PATTERNS, TURKISH_YOU

SCORE = 0.5
SCOPED = 0.1
#: A verb of saying behind a match counts up to this many words away.
BEHIND = 4

_MARKS = re.compile("[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640\\u0591-\\u05BD\\u05BF-\\u05C7\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF\\u00AD\\u0300-\\u036F]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][ ._\-]){3,}[^\W_](?!\w)")
_LEET = str.maketrans("013457@$", "oieastas")
#: Letters of other scripts that stand for Latin ones in disguises.
_LOOKS = str.maketrans("аеорсухіјѕԁһӏοαινυ", "aeopcyxijsdhloaivu")
_CJK = "\u4e00-\u9fff"
_HAN = re.compile(f"[{_CJK}]")
_CONTRACTED = re.compile(r"(?<=[a-z])(?:n['’]t|['’](ll|re|ve|d|s|m))(?![a-z])")
END, COMMA, QUOTE = "|", ",", '"'
OTHER = "_"


def classes() -> dict[str, set[str]]:
    """The classes of every listed word, with those made by rule."""
    members: dict[str, set[str]] = {}
    for name, listed in CLASSES.items():
        for word in listed.split():
            members.setdefault(_MARKS.sub("", word), set()).add(name)
    for verb in CLASSES["violent"].split():
        members.setdefault(verb + ("es" if verb[-2:] in ("ch", "sh") else "s"), set()).add("violents")
    for stem in ARABIC_VIOLENT.split():
        for will in ARABIC_WILL.split():
            members.setdefault(will + stem, set()).add("ar_threat_verb")
            for you in ARABIC_YOU.split():
                members.setdefault(will + stem + you, set()).add("ar_threat")
    for word in CLASSES["insult"].split():
        if re.fullmatch("[a-zçğıöşü]+", word):
            for you in TURKISH_YOU.split():
                members.setdefault(word + you, set()).add("tr_insult")
    return members


# ------------------------------------------------------------------------------------------------- clause patterns


def _parsed(pieces: list[str]):
    """A pattern as a tree: ("seq", parts), ("alt", parts), ("atom", name), ("rep", part, least, most)."""
    at = 0

    def alternatives():
        nonlocal at
        options, parts = [], []
        while at < len(pieces) and not pieces[at].startswith(")"):
            piece = pieces[at]
            if piece == "|":
                options.append(("seq", parts))
                parts = []
                at += 1
                continue
            if piece == "(":
                at += 1
                inner = alternatives()
                tail = pieces[at][1:]
                at += 1
                parts.append(repeated(inner, tail))
            else:
                atom = piece.rstrip("?*+")
                at += 1
                parts.append(repeated(("atom", atom), piece[len(atom) :]))
        options.append(("seq", parts))
        return options[0] if len(options) == 1 else ("alt", options)

    def repeated(part, tail: str):
        if not tail:
            return part
        if tail in "?*+":
            return ("rep", part, int(tail == "+"), 1 if tail == "?" else None)
        least, most = tail.strip("{}").split(",")
        return ("rep", part, int(least), int(most))

    return alternatives()


class Union:
    """The union of the patterns as one automaton over symbols, made deterministic step by step as texts need it."""

    def __init__(self, trees: list, symbols_of: dict[str, set[str]]) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.symbols_of = symbols_of
        starts = []
        for number, tree in enumerate(trees):
            first, last = self._build(tree)
            starts.append(first)
            self.accepts[last] = number
        self.begin = self._closed(starts)
        #: deterministic states: their sets, their steps so far, the patterns that end there
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.known: dict[frozenset, int] = {}
        self._state(self.begin)

    def _state(self, held: frozenset) -> int:
        if held not in self.known:
            self.known[held] = len(self.sets)
            self.sets.append(held)
            self.steps.append({})
            self.ends.append(tuple(sorted(self.accepts[s] for s in held if s in self.accepts)))
        return self.known[held]

    def _node(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _build(self, tree) -> tuple[int, int]:
        kind = tree[0]
        if kind == "atom":
            a, b = self._node(), self._node()
            self.edges[a].append((frozenset(self.symbols_of[tree[1]]), b))
            return a, b
        if kind == "seq":
            first = last = self._node()
            for part in tree[1]:
                a, b = self._build(part)
                self.free[last].append(a)
                last = b
            return first, last
        if kind == "alt":
            first, last = self._node(), self._node()
            for part in tree[1]:
                a, b = self._build(part)
                self.free[first].append(a)
                self.free[b].append(last)
            return first, last
        _, part, least, most = tree
        first = last = self._node()
        for _ in range(least):
            a, b = self._build(part)
            self.free[last].append(a)
            last = b
        end = self._node()
        self.free[last].append(end)
        if most is None:
            a, b = self._build(part)
            self.free[last].append(a)
            self.free[b].append(a)
            self.free[b].append(end)
        else:
            for _ in range(most - least):
                a, b = self._build(part)
                self.free[last].append(a)
                self.free[b].append(end)
                last = b
        return first, end

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)

    def step(self, state: int, symbol: str) -> int:
        reached = [b for a in self.sets[state] for symbols, b in self.edges[a] if symbol in symbols]
        to = self._state(self.begin | self._closed(reached)) if reached else 0  # a match may begin anywhere
        self.steps[state][symbol] = to
        return to

    def matched(self, line: str) -> set[int]:
        """The patterns that a line of symbols matches somewhere."""
        state, out = 0, set()
        steps, ends = self.steps, self.ends
        for symbol in line:
            now = steps[state].get(symbol)
            state = self.step(state, symbol) if now is None else now
            if ends[state]:
                out.update(ends[state])
        return out


# ----------------------------------------------------------------------------------------------------------- scopes


class Transducer:
    """A finite-state transducer: rules (state, class) -> state; a weight for every state; words of no rule leave it as it is."""

    def __init__(self, start: str, rules: dict[tuple[str, str], str], weights: dict[str, float]) -> None:
        self.start, self.weights = start, weights
        self.rules: dict[str, list[tuple[str, str]]] = {}  # of several that apply the first counts
        for (state, name), to in rules.items():
            self.rules.setdefault(state, []).append((name, to))

    def step(self, state, held: set[str]):
        for name, to in self.rules.get(state, ()):
            if name in held:
                return to
        return state

    def compose(self, other: "Transducer") -> "Transducer":
        """The transducer that runs both side by side and multiplies their weights."""
        return _Composed(self, other)

    def weight(self, state) -> float:
        return self.weights.get(state, 1.0)


class _Composed(Transducer):
    def __init__(self, a: Transducer, b: Transducer) -> None:
        self.a, self.b = a, b
        self.start = (a.start, b.start)

    def step(self, state, held: set[str]):
        return self.a.step(state[0], held), self.b.step(state[1], held)

    def weight(self, state) -> float:
        return min(self.a.weight(state[0]), self.b.weight(state[1]))


#: Words that a negation, or reported speech, reaches at most.
REACH = 8


def _negation() -> Transducer:
    """A negation holds until the next subject or comma; behind it a verb of opinion hands it on to the rest of the clause."""
    rules = {("open", "neg"): "negated 0"}
    for k in range(REACH):
        for name in ("negated", "denied"):
            own = f"{name} {k}"
            rules |= {(own, END): "open", (own, COMMA): "open", (own, "conjunct"): "open", (own, "neg"): "negated 0"}
            if name == "negated":
                rules |= {(own, "opinion"): "denied 0", (own, "you"): "open", (own, "they"): "open", (own, "opener"): "open"}
            rules[own, "*"] = f"{name} {k + 1}" if k + 1 < REACH else "open"
    return Transducer("open", rules, {s: SCOPED for s, _ in rules if s != "open"})


def _reported() -> Transducer:
    """Reported speech begins behind a verb of saying that isn't the speaker's own, or a noun for a word; another clause ends it."""
    start = {"metaword": "reported 0", "reporting": "saying", "i": "speaker"}
    rules = {("open", c): to for c, to in start.items()}
    rules |= {("speaker", END): "open", ("speaker", "metaword"): "reported 0", ("speaker", "i"): "speaker", ("speaker", "reporting"): "open", ("speaker", "*"): "open"}
    rules |= {("saying", END): "open", ("saying", COMMA): "saying", ("saying", "conjunct"): "turning 0", ("saying", "reporting"): "saying", ("saying", "*"): "reported 0"}
    for k in range(REACH):
        own, turning = f"reported {k}", f"turning {k}"
        after = f"reported {k + 1}" if k + 1 < REACH else "open"
        rules |= {(own, END): "open", (own, "reporting"): "saying", (own, "metaword"): "reported 0", (own, "conjunct"): turning, (own, "*"): after}
        rules |= {(turning, END): "open", (turning, "you"): "open", (turning, "your"): "open", (turning, "i"): "open", (turning, "*"): after}
    return Transducer("open", rules, {s: SCOPED for s, _ in rules if s.split(" ")[0] in ("saying", "reported")})


# ---------------------------------------------------------------------------------------------------------- grammar


class Grammar:
    """The compiled grammar."""

    def __init__(self) -> None:
        members = classes()
        trees = [_parsed(p.split()) for _, _, p in PATTERNS]
        literal = {atom for _, _, p in PATTERNS for piece in p.split() if (atom := piece.rstrip("?*+")) and atom[0] not in "<({|)_"}
        for word in literal:
            members.setdefault(word, set()).add(f"={word}")
        symbols: dict[frozenset, str] = {}  # words with the same memberships share a symbol
        self.symbol_of = {w: symbols.setdefault(frozenset(m), chr(0xE000 + len(symbols))) for w, m in members.items()}
        self.held = {s: set(m) for m, s in symbols.items()}
        everything = set(self.held) | {OTHER}
        atoms: dict[str, set[str]] = {"_": {s for s in everything if "neg" not in self.held.get(s, ())}}
        atoms["<other>"] = {s for s in atoms["_"] if not self.held.get(s, set()) & {"beast", "neg"}}
        for symbol, own in self.held.items():
            for name in own:
                atoms.setdefault(name[1:] if name[0] == "=" else f"<{name}>", set()).add(symbol)
        self.union = Union(trees, atoms)
        self.automata = [re.compile(_expression(tree, atoms)) for tree in trees]
        self.scope = _negation().compose(_reported())
        telling = {"insult", "animal", "violent", "violents", "foul", "harmed", "die", "nude", "lustful", "undress", "moan", "contempt", "self", "tr_insult", "ar_threat", "ar_threat_verb", "ar_base", "ar_rid", "ar_call", "ar_kill", "ar_send", "ar_shed", "ar_mount", "ar_low", "ar_must", "he_break", "he_send", "he_mount", "fa_threat", "fa_rid", "tr_kill", "tr_rid", "ur_kill", "zh_kill", "zh_rid", "grab", "expose"}
        common = set("a an the of to and it no in on so not they them this every more from without like her him his all only be is are was were up lost off out back down hell dead world place end life now or one get go miss cry for would will me at too من لا كل את כל לא را היא میں جميع 是 تمام لي עליו עליה לי כאן همه را של הם فيهم עם יש את عليك در سب 都 都是 被 了 的 我 你 给 发 שוב היא_ tüm bütün at מגיע צריך".split())
        single = {w for tree, (_, _, p) in zip(trees, PATTERNS) for w in literal if w in p.split() and w not in common and not w.isascii()}
        plain = {"girls", "teens", "babes", "undress", "shut", "lost", "drop", "hell", "fuck", "screw", "crawl", "better", "hates", "despises", "likes", "mourn", "miss", "human", "humans", "people", "kitchen", "zoo", "cage", "porn", "sex", "bare", "naked", "straddled", "begged", "dragged", "lick", "suck", "ride", "bite", "end", "deserves", "deserve", "them", "should", "must", "ought", "too", "mother", "father", "parents", "family"}
        self.trigger = {s for s, m in self.held.items() if m & telling or any(c[0] == "=" and (c[1:] in single or c[1:] in plain) for c in m)}
        self.near: dict[str, str] = {}
        for word in self.symbol_of:
            if len(word) >= 5:
                for k in range(len(word)):
                    self.near.setdefault(word[:k] + word[k + 1 :], word)
        self.telling = {w for w in self.symbol_of if self.held[self.symbol_of[w]] & telling}
        self.by_length: dict[int, list[str]] = {}
        for word in self.telling:
            self.by_length.setdefault(len(word), []).append(word)
        chinese = sorted((w for w in self.symbol_of if re.search(f"[{_CJK}]", w)), key=lambda w: (-len(w), w))
        plain_word = r"[^\W_]+(?:[*@$][^\W_]+)*[*@$]?|[*@$][^\W_]+"
        mixed_word = rf"(?:(?![{_CJK}])[^\W_])+(?:[*@$](?:(?![{_CJK}])[^\W_])+)*[*@$]?|[*@$][^\W_]+"
        cut = "|".join(chinese) + f"|[{_CJK}]|" + mixed_word
        marks = r"|[.!?؟۔。！？…]+|[,،;؛:，；：]|[«»“”„\"「」『』]"
        #: (words alone, words and marks), without and with Chinese
        self.tokens = {False: (re.compile(plain_word), re.compile(plain_word + marks)), True: (re.compile(cut), re.compile(cut + marks))}
        self.cache: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        """The symbol of a word, disguises undone; ``_`` for a word of no class; marks stand for themselves."""
        known = self.cache.get(word)
        if known is None:
            known = self._symbol(word)
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            self.cache[word] = known
        return known

    def _symbol(self, word: str) -> str:
        if word[0] in ".!?؟۔。！？…":
            return END
        if word[0] in ",،;؛:，；：":
            return COMMA
        if word[0] in "«»“”„\"「」『』":
            return QUOTE
        if word in self.symbol_of:
            return self.symbol_of[word]
        if "\u0590" <= word[0] <= "\u06ff":
            for prefix in ("وال", "فال", "بال", "لل", "ال", "و", "ف", "ו", "ה", "וה", "ש", "ב"):
                if word.startswith(prefix) and len(word) - len(prefix) >= 2 and word[len(prefix) :] in self.symbol_of:
                    return self.symbol_of[word[len(prefix) :]]
        forms = [word.translate(_LOOKS), word.translate(_LOOKS).translate(_LEET)]
        if re.search(r"(.)\1\1", word):
            forms += [re.sub(r"(.)\1+", r"\1\1", forms[1]), re.sub(r"(.)\1+", r"\1", forms[1])]
        for form in forms:
            if form in self.symbol_of and not form.isdigit():
                return self.symbol_of[form]
        if "*" in word and len(word) > 2:
            shape = re.compile(re.escape(forms[0].translate(_LEET)).replace(r"\*", "."))
            for other in self.by_length.get(len(word), []):
                if shape.fullmatch(other):
                    return self.symbol_of[other]
        form = forms[-1]
        if len(form) >= 5 and form.isalpha():
            if form in self.near:  # one letter missing
                return self.symbol_of[self.near[form]]
            for k in range(len(form)):
                less = form[:k] + form[k + 1 :]
                if less in self.symbol_of and len(less) >= 5:  # one letter too many
                    return self.symbol_of[less]
                if k and form[: k - 1] + form[k] + form[k - 1] + form[k + 1 :] in self.symbol_of:  # two letters exchanged
                    return self.symbol_of[form[: k - 1] + form[k] + form[k - 1] + form[k + 1 :]]
        return OTHER

    def weights(self, stream: str) -> tuple[list[float], list[int]]:
        """For every word of a stream of symbols and marks what the scopes leave of a match that begins there, and its place in the stream."""
        scope, state = self.scope, self.scope.start
        out, places = [], []
        for place, symbol in enumerate(stream):
            before = scope.weight(state)
            if symbol != QUOTE:
                state = scope.step(state, {symbol} if symbol in (END, COMMA) else self.held.get(symbol, set()) | {"*"})
            if symbol not in (COMMA, QUOTE):
                out.append(max(before, scope.weight(state)))  # a subject ends a scope itself; a negation of the match's own isn't one around it
                places.append(place)
        return out, places

    def _said_behind(self, stream: str, place: int) -> bool:
        """Whether a verb of saying follows a match that ends at a place of the stream: behind a comma or a quotation mark, or as a late verb."""
        marked = stream[place : place + 1] == COMMA or QUOTE in stream[place : place + 2]
        words = 0
        for symbol in stream[place : place + 2 * BEHIND]:
            if symbol in (COMMA, QUOTE) or symbol == END and marked and not words:
                continue
            held = self.held.get(symbol, set())
            if symbol == END or "i" in held or "you" in held or words == BEHIND:
                return False
            if "late_reporting" in held or marked and "reporting" in held:
                return True
            words += 1
        return False

    def score(self, text: str) -> tuple[float, str]:
        """(score, kinds of the matches)."""
        clean = _MARKS.sub("", unicodedata.normalize("NFKC", text)).lower()
        if _SPACED.search(clean):
            clean = _SPACED.sub(lambda m: re.sub(r"[ ._\-]", "", m.group()), clean)
        if "'" in clean or "’" in clean:
            clean = _CONTRACTED.sub(lambda m: f" {m.group(1) or 'not'}", clean)
        words, tokens = self.tokens[bool(_HAN.search(clean))]
        cache, symbol = self.cache, self.symbol
        if self.trigger.isdisjoint([cache.get(w) or symbol(w) for w in words.findall(clean)]):
            return 0.0, ""
        stream = "".join([cache.get(w) or symbol(w) for w in tokens.findall(clean)])
        line = stream.replace(COMMA, "").replace(QUOTE, "")
        found = self.union.matched(line)
        if not found:
            return 0.0, ""
        scopes, places = self.weights(stream)
        rest, kinds = 1.0, set()
        for number in sorted(found):
            weight, kind, _ = PATTERNS[number]
            for m in self.automata[number].finditer(line):
                own = weight * scopes[m.start()]
                after = places[m.end() - 1] + 1
                if own == weight and (self._said_behind(stream, after) or any("game" in self.held.get(s, ()) for s in line[m.end() : m.end() + 3]) or any("late_neg" in self.held.get(s, ()) for s in line[m.end() : m.end() + 1])):
                    own *= SCOPED
                if own == weight:
                    kinds.add(kind)
                rest *= 1 - own
        return 1 - rest, " ".join(sorted(kinds))


def _expression(tree, atoms: dict[str, set[str]]) -> str:
    """A pattern's tree as a regular expression over symbols, to find where a match of the union lies."""
    kind = tree[0]
    if kind == "atom":
        return "[" + "".join(sorted(atoms[tree[1]])) + "]"
    if kind == "seq":
        return "".join(_expression(part, atoms) for part in tree[1])
    if kind == "alt":
        return "(?:" + "|".join(_expression(part, atoms) for part in tree[1]) + ")"
    _, part, least, most = tree
    return f"(?:{_expression(part, atoms)}){{{least},{'' if most is None else most}}}"


_GRAMMAR: list[Grammar] = []


def grammar() -> Grammar:
    """The grammar, compiled once a worker."""
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar())
    return _GRAMMAR[0]


def scored(df: DataFrame, text: str) -> DataFrame:
    """Add ``score`` (double, 0 to 1) and ``kinds`` (string, empty below any match) for a text column."""
    ship(df.sparkSession)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([grammar().score(t) if isinstance(t, str) else (0.0, "") for t in batch], columns=["score", "kinds"])

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = df.withColumn("__scored", F.pandas_udf(score, "score double, kinds string").asNondeterministic()(F.col(text)))
    return made.withColumns({"score": F.round(F.col("__scored.score"), 6), "kinds": F.col("__scored.kinds")}).drop("__scored")
