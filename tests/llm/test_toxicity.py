"""The clause grammar against a matcher that looks at each word's surroundings, and the learned scores."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from corpusveil.llm.toxicity import AIMED, COMPOUND, COPULA, EXCUSED, INSULT, LABELS, LOOSE, MENACE, NEGATION, OBJECT, OTHER, PREDICATED, PRIOR, REACH, REPORT, SUBJECT, THREAT, YOU, YOUR, Lexicon, Scorer, features, fitted, grammar, score

INSULTS = (INSULT, AIMED, PREDICATED, COMPOUND, LOOSE)


def within(labels, i, kinds, reach, step):
    """Whether one of the kinds stands within reach of place i, before (step -1) or after it."""
    return any(0 <= i + step * d < len(labels) and labels[i + step * d] in kinds for d in range(1, (reach or len(labels)) + 1))


def plain_match(clause):
    """The labels of a clause, from the distances between its words, one pattern after the other."""
    n = len(clause)
    labels = [{INSULT: EXCUSED, THREAT: OTHER}.get(x, x) if within(clause, i, [NEGATION], REACH[NEGATION], -1) or within(clause, i, [REPORT], 0, -1) else x for i, x in enumerate(clause)]
    # A copula counts if what stands nearest before it, of subjects and copulas in reach, is a subject.
    nearest = [next((x for x in clause[max(0, i - REACH[SUBJECT]) : i][::-1] if x in (YOU, SUBJECT, COPULA)), OTHER) for i in range(n)]
    copula = [x == COPULA and y in (YOU, SUBJECT) for x, y in zip(clause, nearest, strict=True)]

    def predicated(i):
        """A copula with a subject is in reach, and no other subject stands between."""
        for j in range(i - 1, max(-1, i - REACH[COPULA] - 1), -1):
            if copula[j] or labels[j] in (YOU, SUBJECT):
                return copula[j]
        return False

    def widen(at, opened, step):
        labels[:] = [AIMED if x in opened and within(at, i, [YOU, YOUR], REACH[YOU], step) else x for i, x in enumerate(labels)]
        if step == -1:
            labels[:] = [PREDICATED if x == INSULT and predicated(i) else x for i, x in enumerate(labels)]
        first = list(labels)
        labels[:] = [COMPOUND if x in opened and within(first, i, INSULTS, REACH[INSULT], step) else x for i, x in enumerate(labels)]
        labels[:] = [LOOSE if x == INSULT and any(y not in (*INSULTS, EXCUSED) for y in (labels[:i] if step < 0 else labels[i + 1 :])) else x for i, x in enumerate(labels)]

    widen(list(labels), [INSULT], -1)
    labels = [MENACE if x in (YOU, OBJECT) and within(labels, i, [THREAT], REACH[THREAT], -1) else x for i, x in enumerate(labels)]
    widen(list(labels), [INSULT, LOOSE], 1)
    return [MENACE if x == OBJECT and within(labels, i, [THREAT], REACH[OBJECT], 1) else x for i, x in enumerate(labels)]


def test_the_machines_equal_the_plain_matcher():
    rng = random.Random(3)
    left, right = grammar()
    for _ in range(6000):
        clause = rng.choices([OTHER, INSULT, THREAT, YOU, YOUR, SUBJECT, OBJECT, COPULA, NEGATION, REPORT], weights=[6, 3, 1, 1, 1, 1, 1, 2, 0.5, 0.3], k=rng.randint(1, 12))
        assert right.path(left.path(clause)[::-1])[::-1] == plain_match(clause), clause


def test_the_lexicon_reads_letters():
    found = Lexicon.of({"zuk": 2.0, "zukko$": 3.0, "moron$": 5.0, "é": 1.0})
    assert [found.read(w) for w in ("zuk", "zukk", "zukko", "zukkos", "moron", "moronic", "moro", "ét", "")] == [2, 2, 3, 2, 5, 0, 0, 1, 0]


@pytest.fixture
def scorer():
    s = Scorer(Lexicon.of({"moron$": 5.0, "clown$": 4.0}), rest=0.01)
    s.theta[:] = [2.0, -0.2, -3.0]
    return s


def test_clauses_and_not_words_are_scored(scorer):
    def found(t):
        sums = dict(zip(LABELS, scorer.sums(t), strict=False))
        return {k: v for k, v in sums.items() if v}

    assert found("you are a moron") == found("moron, that is what you are") == found("your clever moron") == {AIMED: 5.0}
    assert found("he is a moron") == {PREDICATED: 5.0} and found("a moron clown") == {COMPOUND: 9.0} and found("xx moron yy") == {LOOSE: 5.0}
    assert found("Moron!") == found("moronic people") == found("") == {} and scorer.score("Moron!") == scorer.score("Moronic people.") == 0.01
    assert found("he is not a moron") == found("they called him a moron") == {EXCUSED: 5.0}
    assert found("I will kill you") == found("Te voy a matar") == {MENACE: 5.0} and found("I will not kill you") == found("They will destroy the house they built.") == {}
    insult = scorer.score("you are a moron. a b c.")
    assert scorer.score("you are a moron. she is not a clown.") < insult and scorer.score("he is not a moron.") == 0.01
    assert insult > scorer.score("xx moron yy. a b c.") > scorer.score("xx word yy. a b c.")


def test_arc_weights_follow_the_labels():
    """Rows whose loose insults say nothing and whose predicated ones say all; only the ratio counts."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600).astype(float)
    sums = np.zeros((600, len(LABELS) + 1))
    sums[:, LABELS.index(LOOSE)] = rng.integers(1, 9, 600)
    sums[:, LABELS.index(PREDICATED)] = 5 * y
    sums[:, -1] = 10
    weights, theta, rest = fitted(sums, y)
    assert weights[PREDICATED] * PRIOR[LOOSE] > PRIOR[PREDICATED] * weights[LOOSE] and theta[0] > 0 and 0 < rest < 1
    assert np.all((features(sums, weights) @ theta > 0) == (y == 1))
    assert fitted(sums[:0], y[:0])[::2] == (PRIOR, 0.5)


def test_learned_scores(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["the", "you", "is"] * 20
    rows, labels = [], []
    for i in range(500):
        t, bad = rng.choices(words, k=40), i % 4 == 0
        for _ in range(3 if bad else 0):
            t[rng.randrange(40)] = rng.choice(["zukko", "zukkela"])
        rows.append((i, " ".join(t), "en"))
        labels.append((i, int(bad), "x"))
    more = [(900, None, None), (901, "", None), (None, "the zukko is", None), (5, rows[5][1], "de"), (902, "you zukko " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows + more], "doc_id long, text string, lang string, score double, toxic int")
    got = score(docs, spark.createDataFrame([*labels, (7, None, None), (None, 1, None), (3, 0, None)], "doc_id long, toxic int, text string")).collect()
    assert all(r["predicted"] == dict((k, y) for k, y, _ in labels)[r["k"]] for r in got if r["k"] is not None and r["k"] < 500)
    by = {}
    for r in got:
        by.setdefault(r["k"], set()).add((r["score"], r["predicted"], r["held_out"]))
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert len(got) == len(rows) + len(more) and len(by[5]) == 1 and by[900] == {(*x[:2], zlib.crc32(b"900") % 3 == 1) for x in by[901]}
    assert {x[1] for x in by[900]} == {0} and {x[1] for x in by[902]} == {1} and {x[2] for x in by[None]} == {True}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score(docs.where("doc_id = 1"), none).first()["score"] == 0.5 and score(docs.where("false"), none).count() == 0
    assert score(docs.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).count() == 0
