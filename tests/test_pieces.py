"""What is found in pieces against what is found in whole texts."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.operators.detect import detect, rule_spans
from corpusveil.operators.model import answers, answers_on_pieces, relocated
from corpusveil.operators.pieces import as_model_spans, carried_back, chunks, found_in_pieces

BLOCKS = "doc_id long, block_ord int, text string"


@pytest.mark.parametrize(("size", "back"), [(40, 19), (64, 30), (500, 125)])
def test_short_values_are_found_as_in_whole_texts(spark, size, back):
    rng = np.random.default_rng(size)
    words = ["a@b.org", "x.y@host.net", "z9@q-r.com", "ИНН", "слово", "-", "@", "a.b", "😀", "\n", "n@m.ru,"]
    rows = [(i, 0, "".join(w + str(rng.choice([" ", ", ", "\n"])) for w in rng.choice(words, rng.integers(0, 120)))) for i in range(40)] + [(900, 0, None), (901, 0, "")]
    blocks = spark.createDataFrame(rows, BLOCKS)
    find = lambda t: rule_spans(t, ("email",))
    whole = blocks.select("doc_id", F.explode(find(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")
    got = found_in_pieces(blocks, find, size, back).select("doc_id", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 50


def test_what_is_longer_than_the_overlap_is_put_together(spark):
    blocks = spark.createDataFrame([(1, 0, "see " + "a" * 30 + "@" + "b" * 45 + ".org and c@d.org"), (2, 0, "x" * 10)], BLOCKS)
    pieces = chunks(blocks, 40, 10)
    runs = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[a-z@.]{5,}"), F.lit(0)), lambda v: F.struct(F.lit("email").alias("entity_type"), (F.instr(t, v) - 1).alias("start"), (F.instr(t, v) - 1 + F.length(v)).alias("end"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("source")))
    assert pieces.where("doc_id = 1").count() > 2
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in found_in_pieces(blocks, runs, 40, 10).collect())
    assert got == [(1, 4, 84), (1, 89, 96), (2, 0, 10)]


def test_a_neighbour_that_sees_more_decides(spark):
    # (offset, end, last, type, start, stop, confidence, source): pieces 0-20 and 15-40 of a text of 40 characters.
    rows = [
        (0, 20, False, "inn", 16, 20, 0.5, "m"),  # at the cut, and the other piece sees it whole and says nothing: goes
        (0, 20, False, "kpp", 2, 9, 0.4, "m"), (0, 20, False, "kpp", 2, 9, 0.7, "z"), (0, 20, False, "kpp", 2, 9, 0.7, "b"),  # one, by the surest and then the first source
        (0, 20, False, "bik", 17, 20, 0.5, "m"), (15, 40, True, "bik", 2, 9, 0.5, "m"),  # a half and the whole
        (15, 40, True, "ogrn", 20, 25, 0.5, "m"),  # the text's end is no cut
        (0, 20, False, "email", 10, 20, 0.5, "m"), (15, 40, True, "email", 0, 9, 0.6, "m"),  # two halves
        (15, 40, True, "phone", 0, 3, 0.5, "m"),  # begins at the cut, and the other piece sees all of it
    ]
    found = spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, block_ord int, offset int, end int, last boolean, entity_type string, start int, stop int, confidence double, source string")
    got = sorted((r["entity_type"], r["start"], r["end"], r["confidence"], r["source"]) for r in carried_back(found, 5).collect())
    assert got == [("bik", 17, 24, 0.5, "m"), ("email", 10, 24, 0.6, "m"), ("kpp", 2, 9, 0.7, "b"), ("ogrn", 35, 40, 0.5, "m")]


def test_answers_on_pieces_become_candidates_of_the_whole_text(spark):
    text = "Вводный текст договора. Анна Белова и Пётр Смирнов подписали. " * 3
    blocks = spark.createDataFrame([(1, 0, text)], BLOCKS)
    pieces = chunks(blocks, 60, 20)
    reply = lambda *names: json.dumps({"entities": [{"entity_type": "person_name", "value": n, "confidence": 0.8} for n in names]}, ensure_ascii=False)
    replies = spark.createDataFrame([(1, 0, r["piece"], f"```JSON {reply(*(n for n in ('Анна Белова', 'Пётр Смирнов', 'Пётр') if n in r['text']))} ```") for r in pieces.collect()], "doc_id long, block_ord int, piece int, reply string")
    carried = answers_on_pieces(pieces, replies, 20)
    spans = detect(as_model_spans(blocks, carried), ("person_name",)).first()["spans"]
    assert [s["text"] for s in spans] == ["Анна Белова", "Пётр Смирнов"] * 3 and all(text[s["start"] : s["end"]] == s["text"] for s in spans)


def test_replies_are_read_strictly(spark):
    good = '{"entities": [{"entity_type": "address", "value": "x", "confidence": 1}]}'
    cases = {good: True, f"```json\n{good}\n```": True, f"```JSON {good}```": True, f"```\n{good} ```": True, '{"entities": [{"value": "x"}]}': True, '{"entities": []}': True, f"so: {good}": False, '{"entities": [{"value": "x", "start": 3}]}': False, '{"entities": [{"value": "x"}], "n": 1}': False, '{"entities": ["x"]}': False, '{"entities": [null]}': False, "": False}
    rows = spark.createDataFrame([(i, 0, r) for i, r in enumerate(cases)], "doc_id long, block_ord int, reply string")
    bad = {r["doc_id"] for r in answers(rows).where("reason = 'unreadable'").collect()}
    assert bad == {i for i, ok in enumerate(cases.values()) if not ok}
    named = spark.createDataFrame([(1, 0, "email", "a@b.org", 1.0), (1, 0, "passport", "x", 1.0)], "doc_id long, block_ord int, entity_type string, value string, confidence double")
    assert {r["reason"] for r in relocated(spark.createDataFrame([(1, 0, "a@b.org")], BLOCKS), named).collect()} == {"unrequested_type", "unknown_type"}
