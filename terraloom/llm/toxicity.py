"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. A lexicon reads each word as one of its classes, with a weight, or as any other word, without:
*insult* (I), *threat* (H), *target* (T, second person and the like), *negation* (N), *verb of saying* (R); quotation marks are
read as Q. Five transducers rewrite this tape, one after the other, and add weights (the max-plus semiring):

* NEGATION: an insult or threat within two words behind a negation loses ``NEGATED``;
* REPORT: behind a verb of saying, or within quotation marks, it loses ``REPORTED``;
* TARGET: an insult with a target in reach, before or behind it, may be read as aimed (J) and gains ``AIMED``; a threat
  passes only if aimed (G). That a target follows is guessed, and a path that guessed wrong isn't accepted;
* INSULT: every insult of a clause but the first loses ``FURTHER``;
* THREAT: so does every threat but the first.

``compose`` joins them into one transducer. The weight of a clause is that of the best path of its words through lexicon and
composition (Viterbi's algorithm); reading nothing as a match weighs 0, so no clause weighs less.
The score of a text is a logistic function of its clauses' weights: the best one, their sum, and the share of clauses that match.

The weights of insults are learned from all labelled rows that aren't held out: words and word beginnings that toxic
rows have and clean rows don't (log odds; those that explain toxic rows that better ones don't, then others as telling, ``ENTRIES`` in all
out of the ``TELLING`` most telling ones: the size of the model), besides fixed seed lists. The logistic function is
fitted to the same rows. Tasks count entries, rows explained and equal features; entries that tell, their counts and the sums of
Newton's steps reach the driver, texts don't.

Defined results: null and empty texts have no clauses and get the score of a text without matches; very long texts are read
whole; repeated rows and ties are scored alike, one by one; an empty table gives an empty result; labels that contradict each other count as both; labels with
nulls are not used; without any label the seed lists alone decide. Extra columns are ignored; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_KEYS, sliced, small_batches, stage, unstage

#: Counts that a task holds before it hands them on, and words whose entries it remembers.
HELD, KNOWN = 100_000, 20_000
#: Learned entries, at most; those looked at when they are chosen; the least number of toxic rows that have one.
ENTRIES, TELLING, LEAST = 400, 20_000, 3
#: One in so many clean rows rules out most entries before all clean rows are counted.
SLICE = 16
PREFIX = (3, 4, 5, 6, 7, 8)

# Seed words of the grammar's classes, in four languages.
THREATS = "kill hurt beat destroy smash burn attack shoot stab strangle töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar"
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros they them he she him her his"
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais aucun ni nunca ningún"
REPORTS = "said says say called calls told claims claimed wrote writes quoted sagte sagt schrieb dit disait écrit dijo dice escribió"
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting"

#: Ends of clauses. A colon doesn't end one, so that a verb of saying reaches what is said.
CLAUSE = re.compile(r"[.!?;|\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SYMBOL = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
QUOTES = frozenset('"“”„«»')
#: Words that a target and a negation reach.
TARGET_REACH, NEGATION_REACH = 6, 2
#: Weights of the transducers' arcs, and of a threat.
AIMED, NEGATED, REPORTED, FURTHER, THREAT = 0.5, -3.0, -1.5, -2.0, 1.0

MATCHES = ("I", "H", "J", "G")
CLASSES = ("O", "I", "H", "T", "N", "R", "Q")


class Transducer:
    """Arcs by state and input symbol: lists of (output symbol, weight, next state). States that aren't in ``final`` don't accept."""

    def __init__(self, start, arcs: dict, final):
        self.start, self.arcs, self.final = start, arcs, final

    def paths(self, tape: str):
        """(output, weight) of every accepting path."""
        found = [("", 0.0, self.start)]
        for x in tape:
            found = [(out + o, w + v, n) for out, w, state in found for o, v, n in self.arcs.get((state, x), ())]
        return [(out, w) for out, w, state in found if state in self.final]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads ``a``'s input and writes what ``b`` makes of ``a``'s output; weights add up."""
    ahead: dict = {}
    for (state, x), arcs in a.arcs.items():
        ahead.setdefault(state, []).append((x, arcs))
    start = (a.start, b.start)
    arcs, seen, open_ = {}, {start}, [start]
    while open_:
        here = open_.pop()
        for x, own in ahead.get(here[0], ()):
            joined = [(o2, w + v, (n, n2)) for o, w, n in own for o2, v, n2 in b.arcs.get((here[1], o), ())]
            if joined:
                arcs[here, x] = joined
            for _, _, n in joined:
                if n not in seen:
                    seen.add(n)
                    open_.append(n)
    return Transducer(start, arcs, {s for s in seen if s[0] in a.final and s[1] in b.final})


def negation() -> Transducer:
    """The state is how many words a negation still reaches."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        for x in CLASSES:
            weight = NEGATED if left and x in MATCHES else 0.0
            arcs[left, x] = [("O", 0.0, NEGATION_REACH)] if x == "N" else [(x, weight, left if x == "Q" else max(0, left - 1))]
    return Transducer(0, arcs, range(NEGATION_REACH + 1))


def report(quoted: bool = False) -> Transducer:
    """States: the writer's own words, words behind a verb of saying, a quotation. ``quoted``: the clause starts within a quotation."""
    arcs = {}
    for state in ("own", "told", "quoted"):
        for x in set(CLASSES) - {"N"}:
            after = ("told" if state == "own" else state) if x == "R" else ({"quoted": "own"}.get(state, "quoted") if x == "Q" else state)
            arcs[state, x] = [("O" if x in "RQ" else x, REPORTED if state != "own" and x in MATCHES else 0.0, after)]
    return Transducer("quoted" if quoted else "own", arcs, ("own", "told", "quoted"))


def target() -> Transducer:
    """States: (words that the last target still reaches, words within which a target must follow, or 0)."""
    arcs = {}
    r = TARGET_REACH
    for seen in range(r + 1):
        for owed in range(r + 1):
            left = max(0, seen - 1)
            rest = [] if owed == 1 else [(left, max(0, owed - 1))]  # the last word on which a promised target could come
            for x in ("O", "I", "H", "T"):
                if x == "T":
                    arcs[(seen, owed), x] = [("O", 0.0, (r, 0))]
                    continue
                out = [(x, 0.0, n) for n in rest] if x != "H" else []
                if x in "IH":
                    aimed, gain = ("J", AIMED) if x == "I" else ("G", 0.0)
                    if seen:
                        out += [(aimed, gain, n) for n in rest]
                    out += [(aimed, gain, (n[0], n[1] or r)) for n in rest]
                arcs[(seen, owed), x] = out
    return Transducer((0, 0), arcs, {(seen, 0) for seen in range(r + 1)})


def _first_counts(own: str, others: str) -> Transducer:
    """Each symbol of ``own`` but the first loses FURTHER; all symbols pass."""
    arcs = {(k, x): [(x, FURTHER if k and x in own else 0.0, 1 if x in own else k)] for k in (0, 1) for x in own + others}
    return Transducer(0, arcs, (0, 1))


def insult() -> Transducer:
    return _first_counts("IJ", "OG")


def threat() -> Transducer:
    return _first_counts("G", "OIJ")


def grammar_transducer(quoted: bool = False) -> Transducer:
    """The composition of the five."""
    whole = negation()
    for t in (report(quoted), target(), insult(), threat()):
        whole = compose(whole, t)
    return whole


class Automaton:
    """The composed transducer with states numbered, for the search of the best path; outputs don't matter any more."""

    def __init__(self, t: Transducer):
        number: dict = {}
        at = lambda s: number.setdefault(s, len(number))
        self.start = at(t.start)
        self.arcs: dict[str, dict[int, list[tuple[int, float]]]] = {x: {} for x in CLASSES}
        for (state, x), arcs in t.arcs.items():
            best: dict[int, float] = {}
            for _, w, n in arcs:
                best[at(n)] = max(w, best.get(at(n), -math.inf))
            self.arcs[x][at(state)] = list(best.items())
        self.final = {number[s] for s in t.final}

    def best(self, tape: list[list[tuple[str, float]]]) -> float:
        """The greatest weight of a path; each position of the tape has the (class, weight) it can be read as."""
        reached = {self.start: 0.0}
        for readings in tape:
            after: dict[int, float] = {}
            for x, weight in readings:
                arcs = self.arcs[x]
                for state, total in reached.items():
                    for n, w in arcs.get(state, ()):
                        v = total + weight + w
                        if v > after.get(n, -math.inf):
                            after[n] = v
            reached = after
        return max((w for s, w in reached.items() if s in self.final), default=0.0)


_automata: list[Automaton] = []


def automaton(quoted: bool) -> Automaton:
    if not _automata:
        _automata.extend(Automaton(grammar_transducer(q)) for q in (False, True))
    return _automata[quoted]


_OTHER = [("O", 0.0)]
_QUOTE = [("Q", 0.0)]


@dataclass
class Grammar:
    """The lexicon, and the logistic function's coefficients. ``words`` and ``beginnings`` have weights of insults."""

    words: dict[str, float]
    beginnings: dict[str, float]
    coefficients: tuple[float, ...] = (-4.0, 1.0, 0.2, 1.0)
    classes: dict[str, str] = field(default_factory=lambda: {w: c for c, s in (("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("H", THREATS)) for w in s.split()})

    def __post_init__(self):
        self.lengths = sorted({len(b) for b in self.beginnings})
        self.threats = frozenset(w for w, c in self.classes.items() if c == "H")
        self.targets = frozenset(w for w, c in self.classes.items() if c == "T")

        # what a word must start with to have a learned beginning
        self.head = self.lengths[0] if self.lengths else 0
        self.heads = frozenset(b[: self.head] for b in self.beginnings)

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in self.lengths:
            if n >= len(word):
                break
            w = max(w, self.beginnings.get(word[:n], 0.0))
        return w

    def insults(self, words: set[str]) -> set[str]:
        """The words that have a weight."""
        n, heads, known = self.head, self.heads, self.words
        return {w for w in words if (w in known or w[:n] in heads) and self.weight(w)}

    def readings(self, word: str) -> list[tuple[str, float]]:
        """What a word can be read as."""
        if word in QUOTES:
            return _QUOTE
        kind = self.classes.get(word)
        # targets, negations and verbs of saying are always read as such
        out = [(kind, 0.0)] if kind in ("T", "N", "R") else [("O", 0.0)]
        if kind == "H":
            out.append(("H", THREAT))
        if w := self.weight(word):
            out.append(("I", w))
        return out

    def tape(self, words: list[str]) -> list[list[tuple[str, float]]]:
        """Readings of a clause's words. Of other words in a row, those beyond the farthest reach change nothing and are left out."""
        out: list[list[tuple[str, float]]] = []
        others, readings = 0, {w: self.readings(w) for w in set(words)}
        for w in words:
            r = readings[w]
            others = others + 1 if r == _OTHER else 0
            if others <= max(TARGET_REACH, NEGATION_REACH) + 1:
                out.append(r)
        return out

    def clause(self, words: list[str], quoted: bool = False) -> float:
        """Weight of the best path of a clause's words (and quotation marks)."""
        return automaton(quoted).best(self.tape(words))

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, weight) of each clause that has words; code points of the lowered text."""
        lowered = (text or "").lower()
        words = set(WORD.findall(lowered))
        hot = self.insults(words) | (words & self.threats)
        odd, start = False, 0
        for end, after in [*(m.span() for m in CLAUSE.finditer(lowered)), (len(lowered), len(lowered))]:
            found = SYMBOL.findall(lowered, start, end)
            marks = sum(x in QUOTES for x in found)
            if len(found) > marks:
                yield start, end, 0.0 if hot.isdisjoint(found) else self.clause(found, odd)
            odd = odd != bool(marks % 2)
            if "\n" in lowered[end:after]:
                odd = False  # a quotation ends with its line at the latest
            start = after

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Best clause, log of the clauses' sum, share of clauses with a match."""
        if not text:
            return 0.0, 0.0, 0.0
        words = set(WORD.findall(text.lower()))
        if not self.insults(words) and (words.isdisjoint(self.threats) or words.isdisjoint(self.targets)):
            return 0.0, 0.0, 0.0
        weights = [w for _, _, w in self.clauses(text)]
        return max(weights, default=0.0), math.log1p(sum(weights)), sum(w > 0 for w in weights) / max(len(weights), 1)

    def score(self, text: str | None) -> float:
        b, *c = self.coefficients
        z = b + sum(k * x for k, x in zip(c, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _entries(text: str) -> set[str]:
    """Words of a text, and their beginnings (written with a star)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIX if n < len(w)}


def _labelled(b: pa.RecordBatch):
    """(text, label) of the rows of (t, y), without holding all texts at once."""
    labels = iter(b.column(1).to_pylist())
    for texts in sliced(b.column(0)):
        for t in texts:
            yield t or "", next(labels)


def _counted(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """e, toxic, clean: rows that have each entry, of ``only`` these entries if given (few: they are broadcast)."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        wanted = shared.value
        held = Counter(), Counter()

        def out():
            every = list(held[0].keys() | held[1].keys())
            clean, toxic = ([h[e] for e in every] for h in held)
            return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["e", "toxic", "clean"])

        for b in batches:
            for text, label in _labelled(b):
                entries: set = set()
                for w in set(WORD.findall(text.lower())):
                    own = known.get(w)
                    if own is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        own = (w, *(w[:n] + "*" for n in PREFIX if n < len(w)))
                        own = known[w] = own if wanted is None else tuple(e for e in own if e in wanted)
                    if own:
                        entries.update(own)
                held[label != 0].update(entries)
                if len(held[0]) + len(held[1]) >= HELD:
                    yield out()
                    held[0].clear()
                    held[1].clear()
        yield out()

    return rows.mapInArrow(count, "e string, toxic bigint, clean bigint").groupBy("e").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _tells(n_toxic: int, n_clean: int):
    """Log odds of an entry, and whether they tell, given its rows. More clean rows only make it tell less."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    return odds, (F.col("toxic") >= LEAST) & (odds >= 2.0) & (F.col("toxic") >= 4 * F.col("clean") * (n_toxic + 1) / (n_clean + 1))


def _telling(rows: DataFrame, n_toxic: int, n_clean: int, most: int = TELLING, broadcast: int = FILTER_KEYS) -> list[tuple[str, int, float]]:
    """entry, toxic rows, log odds of entries that toxic rows have and clean rows don't, the ``most`` telling ones, by name.

    Toxic rows and a slice of the clean ones leave few entries that can still tell (an entry's clean rows only become more), and
    only those are counted in all other rows.
    """
    odds, tells = _tells(n_toxic, n_clean)
    first = (F.col("y") != 0) | (F.pmod(F.xxhash64("t"), F.lit(SLICE)) == 0)
    open_ = stage(_counted(rows.where(first)).where(tells), "open-entries")
    n = open_.count()
    if not n:
        unstage(open_)
        return []
    rest = rows.where(~first)
    few = n <= broadcast
    more = _counted(rest, frozenset(r.e for r in open_.select("e").collect()) if few else None).select("e", F.col("clean").alias("more"))
    joined = open_.join(F.broadcast(more) if few else more, "e", "left")
    whole = joined.select("e", "toxic", (F.col("clean") + F.coalesce("more", F.lit(0))).alias("clean"))
    told = whole.where(tells).select("e", "toxic", odds.alias("odds")).orderBy((F.col("toxic") * F.col("odds")).desc(), "e").limit(most).collect()
    unstage(open_)
    return sorted((r.e, r.toxic, r.odds) for r in told)


def _explaining(rows: DataFrame, told: list[tuple[str, int, float]], most: int) -> list[int]:
    """Places in ``told`` of the entries, at most ``most``: the best entry that explains toxic rows not explained yet, again and again."""
    shared = rows.sparkSession.sparkContext.broadcast({e: i for i, (e, _, _) in enumerate(told)})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            own = [sorted(rank[e] for e in _entries(t) if e in rank) for t, _ in _labelled(b)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["own"])

    open_ = stage(rows.where("y <> 0").mapInArrow(places, "own array<int>"), "explained")
    kept: list[int] = []
    while len(kept) < most:
        left = open_.where(~F.arrays_overlap("own", F.lit(kept))) if kept else open_
        counts = left.select(F.explode("own").alias("i")).groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()  # telling entries at most
        if not counts:
            break
        best = max(counts, key=lambda r: (r.n * told[r.i][2], -len(told[r.i][0]), told[r.i][0]))
        kept.append(best.i)
    unstage(open_)
    return kept


def learn(rows: DataFrame) -> Grammar:
    """A grammar from labelled texts (t, y)."""
    sizes = rows.agg(F.count_if(F.col("y") != 0).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    words, beginnings = {w: 2.0 for w in INSULTS.split()}, {}
    told = _telling(rows, sizes.toxic, sizes.clean) if sizes.toxic else []
    for i in _explaining(rows, told, ENTRIES - len(words)) if told else []:
        e, _, odds = told[i]
        (beginnings if e[-1] == "*" else words)[e.rstrip("*")] = odds
    # words that are as telling by themselves, though others explain their rows
    for e, n, odds in sorted(told, key=lambda x: (-x[2] * x[1], x[0])):
        if len(words) + len(beginnings) >= ENTRIES:
            break
        if e[-1] != "*" and n >= 2 * LEAST and odds >= 3.0:
            words.setdefault(e, odds)
    grammar = Grammar(words, beginnings)
    if sizes.toxic and sizes.clean:
        grammar.coefficients = _fitted(rows, grammar)
    return grammar


def _fitted(rows: DataFrame, grammar: Grammar) -> tuple[float, ...]:
    """The logistic function's coefficients; rows with equal features are counted, Newton's sums are taken where the rows are."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = shared.value, Counter()

        def out():
            columns = list(zip(*((*k, n) for k, n in held.items()), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*(pa.float64(),) * 4, pa.int64()), strict=True)], names=["x1", "x2", "x3", "y", "n"])

        for b in batches:
            for text, label in _labelled(b):
                held[(*g.features(text), float(label != 0))] += 1
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    x = stage(rows.mapInArrow(count, "x1 double, x2 double, x3 double, y double, n bigint"), "features")
    names = ["x0", "x1", "x2", "x3"]

    def sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sum((F.lit(float(k)) * F.col(c) for k, c in zip(b[1:], names[1:], strict=True)), F.lit(float(b[0])))
        own = x.select(F.lit(1.0).alias("x0"), *names[1:], "y", "n", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p"))
        own = own.select(*names, (F.col("n") * (F.col("p") * (1 - F.col("p")) + 1e-6)).alias("w"), (F.col("n") * (F.col("y") - F.col("p"))).alias("d"))
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        r = own.agg(*[F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[F.sum(F.col("d") * F.col(c)) for c in names]).first()
        square = np.zeros((4, 4))
        for (i, j), v in zip(pairs, r, strict=False):
            square[i, j] = square[j, i] = v
        return square, np.array(r[len(pairs) :])

    found = logistic(sums, 4)
    unstage(x)
    return found


def logistic(sums, n: int, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method for a ridge logistic regression with non-negative slopes; intercept first. ``sums(b)`` gives X'WX and X'(y - p)."""
    b = np.zeros(n)
    penalty = np.diag([1e-4] + [ridge] * (n - 1))
    for _ in range(rounds):
        square, slope = sums(b)
        step = np.linalg.solve(square + penalty, slope - penalty @ b)
        before, b = b, b + step
        b[1:] = np.maximum(b[1:], 0)
        if np.abs(b - before).max() < 1e-6:
            break
    return tuple(round(float(v), 9) for v in b)  # whatever order sums are taken in


def held_out(doc_id):
    """Whether a row is never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Learn a grammar from all labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("y").isNotNull()).distinct()
    few = known.count() <= FILTER_KEYS  # ids and labels
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = stage(texts.join(F.broadcast(known) if few else known, "doc_id").select("t", "y"), "labelled")
    grammar = learn(rows)
    unstage(rows)
    return grammar


def scorer(grammar: Grammar, spark):
    shared = spark.sparkContext.broadcast(grammar)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = shared.value
        for b in batches:
            yield pa.array([g.score(t) for texts in sliced(b) for t in texts], type=pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **kw) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    score = scorer(fit(docs, labels, doc_id=doc_id, text=text, **kw), docs.sparkSession)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.3, **kw) -> DataFrame:
    """The rows of ``docs`` with scores below the threshold, their columns unchanged."""
    score = scorer(fit(docs, labels, text=text, **kw), docs.sparkSession)
    columns = docs.columns
    return docs.withColumn("__score", score(F.col(text).cast("string"))).where(F.col("__score") < threshold).select(*columns)
