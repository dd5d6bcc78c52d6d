"""Detectors of others: merged, isolated, and used by detection and intake."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusveil.operators.detect import detect
from corpusveil.operators.detectors import Detectors
from corpusveil.plans.pipeline import propose
from corpusveil.streaming.intake import start

BLOCKS = "doc_id long, block_ord int, text string"


def registry():
    out = Detectors()
    out.column("all", lambda t: F.array(F.struct(F.lit("organization").alias("entity_type"), F.lit(0).alias("start"), F.length(t).alias("end"), F.lit(0.5).alias("confidence"))))
    out.column("none", lambda t: F.lit(None).cast("array<struct<entity_type:string,start:int,end:int,confidence:double>>"))
    out.column("broken", lambda t: F.transform(F.col("no_such_column"), lambda x: x))
    out.text("names", lambda t: [("person_name", t.index("Ann"), t.index("Ann") + 3, 0.9)])
    out.text("odd", lambda t: [("person_name", 0, 99, 0.9), ("passport", 0, 1, 0.9), ("address", 0, 1, 2.0)] if t == "odd" else [])
    out.table("third", lambda b: b.where("doc_id = 3").select("doc_id", "block_ord", F.lit("address").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("confidence")))
    out.table("fails", lambda b: b.select("doc_id", "block_ord", F.raise_error(F.lit("x")).alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("confidence")))
    return out


def test_each_detector_counts_or_fails_by_itself(spark):
    blocks = spark.createDataFrame([(1, 0, "so Ann"), (2, 0, "odd"), (3, 0, "x"), (4, 0, None)], BLOCKS)
    found, failures = registry().candidates(blocks)
    got = {(r["doc_id"], s["source"], s["entity_type"], s["text"]) for r in found.collect() for s in r["model_spans"]}
    assert got == {(1, "all", "organization", "so Ann"), (2, "all", "organization", "odd"), (3, "all", "organization", "x"), (1, "names", "person_name", "Ann"), (3, "third", "address", "x")}
    bad = {(r["doc_id"], r["detector"], r["reason"]) for r in failures.collect()}
    assert {(d, n) for d, n, _ in bad} == {(2, "names"), (3, "names"), (4, "names"), (2, "odd"), (4, "all"), (None, "broken"), (None, "fails")} and (2, "odd", "invalid") in bad and (3, "names", "ValueError") in bad
    with pytest.raises(ValueError):
        registry().text("all", lambda t: [])
    assert Detectors().candidates(blocks)[0].where("size(model_spans) > 0").count() == 0


def test_many_text_detectors_enter_python_once(spark):
    blocks = spark.createDataFrame([(1, 0, "so Ann")], BLOCKS)
    own = registry()
    own.tables.clear()
    assert own._by_text(blocks)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    spans = detect(own.candidates(blocks)[0], ("person_name",)).first()["spans"]
    assert [(s["text"], s["source"]) for s in spans if s["entity_type"] == "person_name"] == [("Ann", "names")]


def test_intake_uses_them(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "so Ann"), (2, "nobody")], "doc_id long, text string").write.parquet(source)
    own = Detectors()
    own.text("names", lambda t: [("person_name", t.index("Ann"), t.index("Ann") + 3, 0.9)])
    start(spark, source, target, str(tmp_path / "c"), ("person_name",), detectors=own).awaitTermination(200)
    assert {r["doc_id"]: r["masked"] for r in spark.read.parquet(target).collect()} == {1: "so [ФИО_1]", 2: "nobody"}
    assert [r["text"] for r in propose(spark.createDataFrame([(1, 0, "so Ann")], BLOCKS), ("person_name",), detectors=own).matches.collect()] == ["Ann"]
