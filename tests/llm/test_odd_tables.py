"""Nulls, repeated rows, empty tables and clashing columns for operators that have no such case elsewhere."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusveil.llm import sampling
from corpusveil.llm.langid import grams, identify
from corpusveil.llm.packing import pack
from corpusveil.llm.quality import judged
from corpusveil.llm.queries import tokenizer
from corpusveil.llm.records import read_records, write_records

SCHEMA = "doc_id long, text string, lang string, source string, k string, t int, n_words string, score string, piece double, start string, host long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "some words here", "en", "a"), (1, "some words here", "en", "a"), (1, "other words", "en", "a"), (None, "no key", "en", None), (None, None, None, None), (2, "", "en", "a"), (3, "   \n", None, "b"), (4, "many words " * 40_000, "en", "b")]
    return spark.createDataFrame([(*r, "clash", 7, None, "x", 0.5, None, 9) for r in rows], SCHEMA)


def ids_of(text, name, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_records_of_every_row(spark, odd):
    run = lambda docs: read_records(spark, write_records(docs, tokenizer=tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=1))
    got = sorted(run(odd).collect(), key=lambda r: r["start"])
    want = [(r["doc_id"], ids_of(r["text"], "word_bpe_49k.json", 1)) for r in odd.collect()]
    assert Counter((r["k"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((k, len(x), crc(x)) for k, x in want)
    assert [r["k"] for r in got] == sorted((k for k, _ in want), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_packing_of_every_row(spark, odd):
    got = pack(odd, tokenizer=tokenizer("byte_bpe_50k.json"), capacity=1024).collect()
    want = Counter()
    for r in odd.collect():
        ids, at = ids_of(r["text"], "byte_bpe_50k.json", 2), 0
        while at < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if at == 0 else 1024
            want[r["doc_id"], at, n, crc(ids[at : at + n])] += 1
            at += n
    assert Counter((r["k"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 1024


def test_samples_of_every_row(spark, odd):
    got = sampling.segment(odd, model=tokenizer("piece_bpe_32k.model"), seed=1).collect()
    assert Counter((r["k"], r["decoded"]) for r in got) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    same = [r["ids"] for r in got if r["decoded"] == "some words here"]
    assert len(same) == 2 and same[0] == same[1]
    assert sampling.segment(odd.where("false"), model=tokenizer("piece_bpe_32k.model"), seed=1).count() == 0


def test_languages_and_rules_of_every_row(spark, odd):
    got = identify(odd).collect()
    assert len(got) == 8 and {r["held_out"] for r in got if r["k"] is None} == {True}
    assert len({(r["lang_pred"], r["score"]) for r in got if r["k"] == 1}) <= 2 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["k"] in (2, 3))
    judged_rows = judged(odd).collect()
    assert Counter(r["k"] for r in judged_rows) == Counter(r["doc_id"] for r in odd.collect()) and not any(r["kept"] for r in judged_rows)


def test_letters_are_letters_by_category():
    for text in ("²", "½ ¼", "Ⅷ", "①", "12 _ 3", "٣", "!?", "\U0001f600"):
        assert len(grams(text)) == 0, text
    for text in ("a", "ß²", "ʰ", "日", "я1"):
        assert len(grams(text)) and any(unicodedata.category(c)[0] == "L" for c in text), text
