"""Reports of what was put in, whole-document publishing, and a model's answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusveil.functions.text import find, literal_pattern
from corpusveil.operators.detect import detect
from corpusveil.operators.masking import masked, with_applied
from corpusveil.operators.matches import matches
from corpusveil.operators.model import answers, chunks, model_spans, relocated
from corpusveil.operators.registry import mentions, organizations, relations, repeats, representatives
from corpusveil.sources.sinks import FIELDS, write_csv_report, write_json_report, write_masked


def test_only_what_was_put_in_is_reported_and_published(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "mail a@b.org and c@d.org"), (2, 0, "e@f.org"), (3, 0, "nothing")], "doc_id long, block_ord int, text string")
    found = matches(detect(blocks, ("email",)), ("email",))
    wrong = found.where("doc_id = 2").withColumn("text", F.lit("x@y.org"))
    found = found.where("doc_id <> 2").unionByName(wrong)
    marked = with_applied(blocks, found)
    assert {(r["doc_id"], r["start"], r["applied"]) for r in marked.collect()} == {(1, 5, True), (1, 17, True), (2, 0, False)}
    write_json_report(marked, str(tmp_path / "all"))
    write_json_report(marked, str(tmp_path / "put"), applied_only=True)
    rows = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "all")).collect()]
    assert len(rows) == 3 and all(set(r) == {"doc_id", *FIELDS} for r in rows) and {r["original_value"] for r in rows} == {"a@b.org", "c@d.org", "x@y.org"}
    assert spark.read.text(str(tmp_path / "put")).count() == 2
    write_csv_report(marked, str(tmp_path / "csv"))
    files = [p.read_bytes() for p in (tmp_path / "csv").glob("part-*")]
    assert files and all(f.startswith("﻿type,original_value,replacement,location,source,confidence,role".encode()) for f in files)
    assert sum(f.count(b"100.00%") for f in files) == 3
    write_masked(masked(blocks, found), str(tmp_path / "out"))
    out = {r["doc_id"]: r["masked"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: "mail [ЭЛЕКТРОННАЯ_ПОЧТА_1] and [ЭЛЕКТРОННАЯ_ПОЧТА_2]", 3: "nothing"}


def test_model_values_are_found_in_the_text_or_rejected_with_a_reason(spark):
    blocks = spark.createDataFrame([(1, 0, "Анна  Белова и Анна Белова, Анна Беловатая"), (2, 0, "x")], "doc_id long, block_ord int, text string")
    reply = lambda *e: json.dumps({"entities": [{"entity_type": t, "value": v, "confidence": c} for t, v, c in e]}, ensure_ascii=False)
    good = reply(("person_name", "Анна Белова", 0.9), ("passport", "x", 0.5), ("address", " ", 0.5), ("organization", "ООО Нет", None))
    replies = spark.createDataFrame([(1, 0, f"```json\n{good}\n```"), (2, 0, "Sure! {}"), (2, 0, '{"entities": [], "more": 1}'), (2, 0, '{"entities": []}'), (2, 0, None)], "doc_id long, block_ord int, reply string")
    named = answers(replies)
    got = {(r["doc_id"], r["entity_type"], r["reason"]): [(x["start"], x["end"]) for x in r["ranges"]] for r in relocated(blocks, named).collect()}
    assert got == {(1, "person_name", None): [(0, 12), (15, 26)], (1, "passport", "unknown_type"): [], (1, "address", "empty"): [], (1, "organization", "absent"): [], (2, None, "unreadable"): []}
    assert relocated(blocks, named).where("reason = 'unreadable'").count() == 3
    found = detect(model_spans(blocks, named), ("person_name",)).where("doc_id = 1").first()["spans"]
    assert [(s["start"], s["end"], s["source"], s["confidence"]) for s in found] == [(0, 12, "llm", 0.9), (15, 26, "llm", 0.9)]


@pytest.mark.parametrize("text", ["word " * 40, "x" * 95, "", "ab\ncd " * 17, "short"])
def test_chunks_cover_the_text_with_an_overlap(spark, text):
    got = sorted((r["offset"], r["text"]) for r in chunks(spark.createDataFrame([(1, 0, text), (2, 0, None)], "doc_id long, block_ord int, text string"), 30, 5).collect())
    assert got and all(text[o : o + len(t)] == t and len(t) <= 30 for o, t in got)
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(text)
    for (o, t), (p, _) in zip(got, got[1:], strict=False):
        assert p == o + len(t) - 5 and (t[-1] in " \n" or len(t) == 30)


def test_literals_with_quoting_marks_are_found(spark):
    rows = spark.createDataFrame([(r"a\Eb c", r"x a\Eb  c y"), (r"\Q1\E", r"is \Q1\E."), ("a.b", "axb a.b")], "v string, t string")
    assert [[(x["start"], x["end"]) for x in r["f"]] for r in rows.select(find(F.col("t"), literal_pattern(F.col("v"))).alias("f")).collect()] == [[(2, 9)], [(3, 8)], [(4, 7)]]


def test_values_repeat_wherever_their_first_word_is_a_whole_one(spark):
    lines = ["Директор: Белова Анна Павловна", "(Белова\nАнна Павловна) и Белова Анна Павловнатая", "ООО «Луч» тут", "и ООО  «Луч», ПООО «Луч»", "ничего"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, lines[1])], "doc_id long, block_ord int, text string")
    found = repeats(detect(blocks, ("person_name", "organization")))
    got = sorted((r["doc_id"], r["block_ord"], s["text"], s["source"]) for r in found.collect() for s in r["spans"] if s["source"] == "document_repeat" or r["doc_id"] == 1)
    texts = [(b, t) for d, b, t, _ in got if d == 1]
    assert (1, "Белова\nАнна Павловна") in texts and (3, "ООО  «Луч»") in texts and not [t for b, t in texts if "Павловнатая" in t or t.startswith("ПООО")]


def test_aliases_evidence_and_relations(spark):
    lines = ["ООО «Луч», ИНН 7707083893", "Общество с ограниченной ответственностью «Луч-Сервис», ИНН 7707083893", "ООО «Луч» в лице директора Белова Ивана Павловича, действующего", "АО «Мир»"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, block_ord int, text string")
    found = mentions(detect(blocks, ("organization", "person_name")))
    orgs = organizations(found)
    got = {r["block_ord"]: (r["entity_id"], r["aliases"], sorted(r["evidence"])) for r in orgs.collect()}
    assert got[0] == got[1] == got[2] and got[3][1:] == (["АО «Мир»"], [])
    assert got[0][1] == ["ООО «Луч»", "Общество с ограниченной ответственностью «Луч-Сервис»"] and got[0][2] == ["normalized_name", "shared_identifier"]
    links = relations(representatives(found, orgs)).collect()
    assert [(r["kind"], r["object_id"]) for r in links] == [("person_represents_organization", got[0][0])]
