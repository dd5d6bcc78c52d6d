"""Fill-in-the-middle: the automaton against patterns, and whole rows against a plain version."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from corpusveil.llm import middle
from corpusveil.llm.middle import POINT, SENTINEL, UNIT, Automaton, automaton, fill_in_middle, restored

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n\t ", "a", " a", "a ", "a  b\tc\n", "<P>", "x<S>y", "<<M>", "<P >", "<P\n>", "< P>", "ß äö  日本 語　x", "\x1c\x85a b", "😀 <M", "<S><S>", "ab" * 500 + " " + "é" * 300, "<P<P>", "a\0b c"]


def plain(k, text, seed=42):
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (k, len(units), "plain", None, None, text)
    return (k, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (k, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("piece", [7, 64, 4 << 20])
def test_marks_equal_patterns(monkeypatch, piece):
    monkeypatch.setattr(middle, "PIECE", piece)
    rng = np.random.default_rng(piece)
    texts = ODD + ["".join(rng.choice(list("<PSM> \n\ta日é"), rng.integers(1, 200))) for _ in range(200)]
    texts = [t for t in texts if t]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    marks = automaton(("<P>", "<S>", "<M>")).scan(np.frombuffer(b"".join(data), dtype=np.uint8), ends - [len(d) for d in data])
    for t, d, end in zip(texts, data, ends, strict=True):
        own = marks[end - len(d) : end]
        starts = [len(t[: m.start()].encode()) for m in UNITS.finditer(t)]
        assert np.flatnonzero(own & UNIT).tolist() == starts, t
        assert np.count_nonzero(own & POINT) == len(t)
        assert bool((own & SENTINEL).any()) == bool(re.search("<[PSM]>", t)), t


def test_sentinels_that_share_parts():
    words = ("aab", "ab", "äa", "<|x|>")
    table = Automaton(words)
    assert len(automaton(("<P>", "<S>", "<M>")).step) == 4
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = "".join(rng.choice(list("aabä<|x> "), rng.integers(1, 30)))
        marks = table.scan(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0]))
        ends = {len(t[: i + len(w)].encode()) - 1 for w in words for i in range(len(t)) if t.startswith(w, i)}
        assert set(np.flatnonzero(marks & SENTINEL).tolist()) == ends, t
    with pytest.raises(ValueError):
        Automaton(("a b",))


def test_rows_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(ODD + ["".join(rng.choice(list("ab <>PSM\n日"), rng.integers(0, 60))) for _ in range(300)])]
    rows += [(None, "no key at all"), (None, None), (7, None), (7, "again a"), (7, "again a"), (9000, "word " * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 3, "x", 1) for r in rows], "doc_id long, text string, k string, n int, form string, h1 int").repartition(3)
    out = fill_in_middle(docs)
    got = out.withColumn("back", restored(out["form"], out["output"])).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted((plain(k, t or "") for k, t in rows), key=order)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.where("false")).count() == 0
