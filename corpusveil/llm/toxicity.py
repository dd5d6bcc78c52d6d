"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text falls into clauses, a clause into words, and words become symbols: the lexicon transducer reads a
word letter by letter and ends as an insult with a weight; short fixed lists give threats, persons, copulas,
negations and reporting verbs. Small transducers, each with one concern, are composed into two machines.
The first reads a clause from left to right:

- negation and reported speech: an insult in their reach is excused, a threat forgotten;
- target: an insult soon after a person addressed becomes aimed;
- predicate: an insult becomes predicated if a person is the subject of a copula before it;
- compound: an insult soon after another one becomes part of a compound;
- clause: an insult after any other word of its clause becomes loose;
- threat: a person who is a threat's object becomes a menace.

The second reads what the first wrote from right to left, for what comes after the insult or, in French,
German and Spanish, before the threat. An insult that no machine takes up, as a bare one, weighs nothing.
A clause's weight is the sum over its path of arc weight times word weight. The sum of all clause weights
and the number of clauses go into a logistic score; a text whose sum is not positive has no match, and its
score is the rate of toxic texts among such.

Learned from labels are the lexicon (words and stems that toxic documents surely have more often than clean
ones, in varied places), the arc weights, by label, and the logistic weights. The other word lists are fixed
values. A menace has the weight of an aimed insult with the lexicon's largest weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, small_or_plain, tune
from .langid import held_out

OTHER, INSULT, THREAT, YOU, YOUR, SUBJECT, OBJECT, COPULA, NEGATION, REPORT, AIMED, PREDICATED, COMPOUND, LOOSE, EXCUSED, MENACE = range(16)
SYMBOLS = 16
#: Words of the grammar besides the learned insults (English, French, German, Spanish).
WORDS = {
    THREAT: "kill hurt destroy beat crush smash tuer frapper töten schlagen matar golpear",
    YOU: "you vous tu du ihr tú usted ustedes vosotros",
    YOUR: "your yours ton ta tes votre vos dein deine deinen euer eure vuestro",
    SUBJECT: "he she they we who il elle ils elles er él ella ellos ellas",
    OBJECT: "him her them te toi lui dich euch ihn os",
    COPULA: "is are am was were be been being s re est es suis sont était sommes êtes bist ist sind seid war waren eres son era eran",
    NEGATION: "not no never nobody isn aren wasn ne pas jamais nicht kein keine nie nunca jamás",
    REPORT: "said says called quoted reported wrote claimed dit cité écrit sagte nannte schrieb dijo llamó escribió",
}
#: How many words further negation, persons addressed, subjects, copulas, other insults and threats (back from the verb: objects) still reach; reporting verbs reach to the clause's end.
REACH = {NEGATION: 3, YOU: 4, SUBJECT: 2, COPULA: 4, INSULT: 3, REPORT: 0, THREAT: 2, OBJECT: 3}
#: The weights of arcs by the label they write, before labels are seen, and what they may be; GRID_PENALTY is the price of leaving the first by 1.
PRIOR = {AIMED: 2.0, PREDICATED: 2.0, COMPOUND: 1.5, LOOSE: 1.0, EXCUSED: -0.5}
GRID = {AIMED: (1.0, 1.5, 2.0, 3.0), PREDICATED: (1.0, 1.5, 2.0, 3.0), COMPOUND: (1.0, 1.25, 1.5, 2.0), LOOSE: (0.0, 0.25, 0.5, 0.75, 1.0), EXCUSED: (-0.5, -0.25, 0.0)}
GRID_PENALTY = 2.0
#: About so many labelled rows of each class are used to learn the lexicon and the weights. This bounds the lexicon as well.
SAMPLE = {1: 4000, 0: 8000}
#: Lengths of stems. A stem is an insult if LEAST_TOXIC documents of the sample or more have it and its log odds, less SURENESS standard errors, are LEAST_ODDS or more.
STEMS, SURENESS, LEAST_ODDS, LEAST_TOXIC = (3, 4, 5, 6, 7, 8), 2.0, 1.2, 6
#: The log odds are its weight.
#: It must also stand after different words, VARIED of its documents' number or ENOUGH: words of one often copied text do not.
VARIED, ENOUGH = 0.4, 20
#: A stem goes if a longer one, or a whole word, has this share of its toxic documents.
FULLER = 0.9
CACHE_WORDS = 300_000
THRESHOLD = 0.7

_CLAUSE = re.compile(r"[.;:!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Transducer:
    """A deterministic transducer: next state and output symbol of the arc for each state and input symbol. An arc weighs what its output does."""

    next: np.ndarray
    out: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other machine reads what this one writes. State (a, b) is a * states of other + b."""
        m, n = len(self.next), len(other.next)
        a, b = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
        out = self.out[a]
        return Transducer(self.next[a] * n + other.next[b[:, None], out], other.out[b[:, None], out])

    def path(self, symbols: list[int]) -> list[int]:
        """Outputs of the arcs that a clause takes."""
        nxt, out = self.tables
        state, labels = 0, []
        for x in symbols:
            labels.append(out[state][x])
            state = nxt[state][x]
        return labels

    @cached_property
    def tables(self) -> tuple[list, list]:
        return self.next.tolist(), self.out.tolist()


def window(opens: Iterable[int], reach: int, relabel: dict[int, int]) -> Transducer:
    """After one of the symbols `opens`, up to `reach` words later (0: to the clause's end), relabel symbols."""
    states = 1 + max(1, reach)
    nxt, out = np.zeros((states, SYMBOLS), dtype=np.int64), np.tile(np.arange(SYMBOLS), (states, 1))
    for s in range(1, states):
        nxt[s] = s if reach == 0 else s - 1
        for x, y in relabel.items():
            out[s, x] = y
    nxt[:, list(opens)] = states - 1
    return Transducer(nxt, out)


def predicate() -> Transducer:
    """Relabels an insult soon after a copula that comes soon after a person as its subject."""
    near, far = REACH[SUBJECT], REACH[COPULA]
    nxt, out = np.zeros((1 + near + far, SYMBOLS), dtype=np.int64), np.tile(np.arange(SYMBOLS), (1 + near + far, 1))
    for s in range(1, 1 + near + far):
        nxt[s] = 0 if s == near + 1 else s - 1
        if s <= near:
            nxt[s, COPULA] = near + far
        else:
            out[s, INSULT] = PREDICATED
    nxt[:, [YOU, SUBJECT]] = near
    return Transducer(nxt, out)


def grammar() -> tuple[Transducer, Transducer]:
    """The machine from left to right and that from right to left."""
    negation = window([NEGATION], REACH[NEGATION], {INSULT: EXCUSED, THREAT: OTHER})
    report = window([REPORT], REACH[REPORT], {INSULT: EXCUSED, THREAT: OTHER})
    words = [x for x in range(SYMBOLS) if x not in (INSULT, AIMED, PREDICATED, COMPOUND, LOOSE, EXCUSED)]

    def both(left: list[int]) -> Transducer:
        """Targets, compounds and the clause itself, for the symbols of insults that are still open."""
        target = window([YOU, YOUR], REACH[YOU], dict.fromkeys(left, AIMED))
        target = target if LOOSE in left else target.then(predicate())
        return target.then(window([INSULT, AIMED, PREDICATED, COMPOUND, LOOSE], REACH[INSULT], dict.fromkeys(left, COMPOUND))).then(window(words, 0, {INSULT: LOOSE}))

    ahead = window([THREAT], REACH[THREAT], {YOU: MENACE, OBJECT: MENACE})
    return negation.then(report).then(both([INSULT])).then(ahead), both([INSULT, LOOSE]).then(window([THREAT], REACH[OBJECT], {OBJECT: MENACE}))


@dataclass
class Lexicon:
    """The insult transducer: a tree of letters, whose states carry the weight of the stem or whole word that ends there."""

    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    weight: list[float] = field(default_factory=lambda: [0.0])

    @classmethod
    def of(cls, units: dict[str, float]) -> Lexicon:
        out = cls()
        for unit, weight in units.items():
            at = 0
            for letter in unit:
                if letter not in out.nodes[at]:
                    out.nodes[at][letter] = len(out.nodes)
                    out.nodes.append({})
                    out.weight.append(0.0)
                at = out.nodes[at][letter]
            out.weight[at] = weight
        return out

    def read(self, word: str) -> float:
        """The largest weight on the word's path, at stems and at its end; 0 if no state accepts."""
        at, best = 0, 0.0
        for letter in f"{word}$":
            if (at := self.nodes[at].get(letter)) is None:
                return best
            best = max(best, self.weight[at])
        return best


#: Labels with weights; a menace has that of an aimed insult.
LABELS = (*PRIOR, MENACE)


@dataclass
class Scorer:
    """Lexicon, machines, arc weights by label and logistic weights; scores whole texts."""

    lexicon: Lexicon
    weights: dict[int, float] = field(default_factory=lambda: dict(PRIOR))
    theta: np.ndarray = field(default_factory=lambda: np.zeros(3))
    rest: float = 0.5
    known: dict[str, tuple[int, float]] = field(default_factory=dict)
    machines: tuple[Transducer, Transducer] = field(default_factory=grammar)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight, kept by word."""
        if (found := self.known.get(word)) is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            weight = self.lexicon.read(word)
            found = (INSULT, weight) if weight else (_FIXED.get(word, OTHER), max(1.0, *self.lexicon.weight) if word in _FIXED else 1.0)
            self.known[word] = found
        return found

    def clause(self, words: list[str]) -> tuple[list[int], list[float]]:
        """The label and the weight of each word of a clause."""
        symbols, weights = zip(*map(self.symbol, words), strict=True)
        return self.machines[1].path(self.machines[0].path(symbols)[::-1])[::-1], weights

    def sums(self, text: str) -> list[float]:
        """The sums of word weights by label, over all clauses, and the number of clauses with a word."""
        found, total = dict.fromkeys(LABELS, 0.0), 0
        for clause in _CLAUSE.split(text.lower()):
            words = _WORD.findall(clause)
            total += bool(words)
            if any(self.symbol(w)[0] in _BEARING for w in words):
                for label, weight in zip(*self.clause(words), strict=True):
                    if label in found:
                        found[label] += weight
        return [*found.values(), float(total)]

    def score(self, text: str) -> float:
        x = features(np.array([self.sums(text)]), self.weights)[0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.theta))))) if x[0] > 0 else self.rest


_BEARING = frozenset((INSULT, THREAT))
_FIXED = {w: symbol for symbol, words in reversed(WORDS.items()) for w in words.split()}


def features(sums: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    """Logs of one plus the sum of clause weights (0 if negative) and of one plus the number of clauses, and 1, by row of Scorer.sums."""
    arcs = np.array([*(weights[x] for x in PRIOR), weights[AIMED]])
    return np.stack([np.log1p(np.maximum(0.0, sums[:, :-1] @ arcs)), np.log1p(sums[:, -1]), np.ones(len(sums))], axis=1)


def stems(word: str) -> list[str]:
    """The word itself, closed by a mark, and its stems."""
    return [f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)] if len(word) >= STEMS[0] else []


def units(text: str) -> set[str]:
    """All stems of a text's words."""
    return {s for w in set(_WORD.findall(text.lower())) for s in stems(w)}


def learn(rows: DataFrame) -> Scorer:
    """Learn lexicon and weights from rows t, y (0 or 1). Without toxic rows the score is the rate of toxic rows."""
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counts = pa.schema([("unit", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen[y].update(units(t))
        found = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield batch(counts, unit=part, pos=[seen[1][u] for u in part], neg=[seen[0][u] for u in part])

    sums = rows.select("t", "y").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    surely = odds - SURENESS * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = sums.withColumn("weight", odds).where((surely >= LEAST_ODDS) & (F.col("pos") >= LEAST_TOXIC)).collect()
    wanted = {r["unit"]: (r["weight"], r["pos"]) for r in best}
    places = pa.schema([("unit", pa.string()), ("before", pa.string())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(s, before) for t in b.column("t").to_pylist() for before, w in pairwise(["", *_WORD.findall(t.lower())]) for s in stems(w) if s in wanted}
            yield batch(places, unit=[u for u, _ in found], before=[w for _, w in found])

    varied = {r["unit"]: r["n"] for r in rows.where("y = 1").select("t").mapInArrow(match, "unit string, before string").groupBy("unit").agg(F.count_distinct("before").alias("n")).collect()}
    fuller = {u.rstrip("$")[:n] for u, (_, pos) in wanted.items() for n in STEMS if n < len(u) and pos >= FULLER * wanted.get(u.rstrip("$")[:n], (0, pos + 1))[1]}
    scorer = Scorer(Lexicon.of({u: float(weight) for u, (weight, pos) in wanted.items() if u not in fuller and varied.get(u, 0) >= min(VARIED * pos, ENOUGH)}))
    shape = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(shape, y=b.column("y"), x=[scorer.sums(t) for t in b.column("t").to_pylist()])

    table = rows.select("t", "y").mapInArrow(sums_of, "y int, x array<double>").toArrow()
    y = np.array(table.column("y").to_pylist(), dtype=float)
    scorer.weights, scorer.theta, scorer.rest = fitted(np.array(table.column("x").to_pylist(), dtype=float).reshape(len(y), len(LABELS) + 1), y)
    return scorer


def fitted(sums: np.ndarray, y: np.ndarray) -> tuple[dict[int, float], np.ndarray, float]:
    """The likeliest arc weights on the grid, one label at a time, after the price of leaving the prior; their logistic weights, and the rate of toxic rows without a match.

    A target, predicate or compound never weighs less than a loose insult. The sum of clause weights never
    speaks against toxicity.
    """
    weights, memory = dict(PRIOR), {}

    def value(trial: dict[int, float]) -> tuple[float, np.ndarray, float]:
        if (key := tuple(trial.values())) not in memory:
            x = features(sums, trial)
            match = x[:, 0] > 0
            theta = logistic(x[match], y[match])
            if theta[0] < 0:
                theta = np.array([0.0, *logistic(x[match, 1:], y[match])])
            rest = float((y[~match].sum() + 0.5) / (np.sum(~match) + 1))
            z = np.where(match, np.clip(x @ theta, -30, 30), math.log(rest / (1 - rest)))
            price = sum((v - PRIOR[k]) ** 2 for k, v in trial.items())
            memory[key] = float(np.sum(y * z - np.log1p(np.exp(z)))) - GRID_PENALTY * price, theta, rest
        return memory[key]

    before: dict[int, float] = {}
    while before != weights:
        before = dict(weights)
        for label, grid in GRID.items():
            trials = [t for v in grid if min((t := weights | {label: v})[AIMED], t[PREDICATED], t[COMPOUND]) >= t[LOOSE] >= t[EXCUSED]]
            weights = max([weights, *trials], key=lambda t: value(t)[0])
    return weights, *value(weights)[1:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last column is the intercept, which has no penalty."""
    theta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - y) + penalty * theta
        theta = theta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient).clip(-5, 5)
    return theta


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, fold: int = 1) -> DataFrame:
    """Learn from the labelled rows outside the fold and score all rows: k, held_out, score, predicted.

    A null text is scored as an empty one. Of repeated labels of a key the largest counts; null labels do
    not. A null key counts as held out. Without labels every score is 0.5.
    """
    tune(docs.sparkSession)
    marks = labels.where(f"`{label}` in (0, 1) and `{key}` is not null").groupBy(F.col(f"`{key}`").cast("long").alias("k")).agg(F.max(f"`{label}`").cast("int").alias("y")).where(~held_out(F.col("k"), folds, fold))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    place = (F.xxhash64("k", F.lit("toxic")) % 1_000_000 + 1_000_000) % 1_000_000
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE[1] / max(1, counts.get(1, 0)))).otherwise(min(1.0, SAMPLE[0] / max(1, counts.get(0, 0))))
    sampled = small_or_plain(marks.where(place < share * 1_000_000))
    own = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    scorer = learn(cut(own.join(sampled, "k"), "labelled").repartition(docs.sparkSession.sparkContext.defaultParallelism))
    schema = pa.schema([("k", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scorer.score(t) for t in b.column("t").to_pylist()]
            yield batch(schema, k=b.column("k"), score=s, predicted=[int(x >= THRESHOLD) for x in s])

    return own.mapInArrow(run, "k long, score double, predicted int").select("k", held_out(F.col("k"), folds, fold).alias("held_out"), "score", "predicted")
