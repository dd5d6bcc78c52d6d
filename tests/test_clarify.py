"""Waiting for answers, restarts, and tables that are published whole."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusveil.sources import snapshots
from corpusveil.sources.sinks import publish_reports, write_masked
from corpusveil.sources.tables import cut, scratch
from corpusveil.streaming import clarify
from corpusveil.streaming.clarify import ANSWERS, start_intake, start_release, step

Q = "mask:party:amount:[СУММА_{}]"


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def events(state, *rows):
    frame = pd.DataFrame(rows, columns=["batch", "questions", "question_id", "answer"]).astype(object)
    return [tuple(r) for f in step((7,), iter([frame]), state) for r in f[["event", "question_ids", "answers", "reason"]].itertuples(index=False)]


def test_the_state_machine_releases_once():
    s = State()
    assert events(s, (None, None, "a", "keep"), (None, None, "z", "mask")) == []
    assert events(s, (1, ["a", "b"], None, None), (None, None, "a", "mask"), (None, None, "b", "burn")) == [("rejected", ["z"], ["mask"], "unknown_question"), ("rejected", ["a"], ["mask"], "answered_before"), ("rejected", ["b"], ["burn"], "not_an_option")]
    assert events(s, (1, ["a", "b"], None, None), (None, None, "b", "mask")) == [("released", ["a", "b"], ["keep", "mask"], None)]
    assert events(s, (1, ["a", "b"], None, None)) == [] and events(s, (None, None, "b", "keep")) == [("rejected", ["b"], ["keep"], "not_waiting")]
    assert events(s, (2, ["b"], None, None)) == [] and events(s, (None, None, "b", "keep")) == [("released", ["b"], ["keep"], None)]
    assert events(State(), (3, [], None, None)) == [("released", [], [], None)]


def test_answers_in_a_later_batch_release_a_document_once_and_after_a_restart(spark, tmp_path, monkeypatch):
    at = {n: str(tmp_path / n) for n in ("in", "work", "answers", "out", "c1", "c2")}
    docs = [(1, "Цена 5 RUB"), (2, "Цена 7 RUB\nИтог 9 RUB"), (3, "ничего"), (4, "Цена 5 RUB")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(at["in"])

    def intake():
        start_intake(spark, at["in"], at["work"], at["c1"], ("amount",), mock=True).awaitTermination(300)

    def release():
        start_release(spark, at["work"], at["answers"], at["out"], at["c2"]).awaitTermination(300)

    def answer(*rows):
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(at["answers"])

    def shown():
        rows = spark.read.parquet(at["out"]).collect()
        assert len({(r["doc_id"], r["block_ord"]) for r in rows}) == len(rows)
        return {(r["doc_id"], r["block_ord"]): r["masked"] for r in rows}

    intake()
    release()
    assert shown() == {(3, 0): "ничего"}
    answer((1, Q.format(1), "keep"), (2, Q.format(1), "mask"), (9, Q.format(1), "mask"), (4, Q.format(1), "no"))
    monkeypatch.setattr(clarify, "propose", None)  # nothing is detected anew
    release()
    assert shown() == {(3, 0): "ничего", (1, 0): "Цена 5 RUB"}
    answer((2, Q.format(2), "keep"), (1, Q.format(1), "mask"))
    intake()
    release()
    release()
    assert shown() == {(3, 0): "ничего", (1, 0): "Цена 5 RUB", (2, 0): "Цена [СУММА_1]", (2, 1): "Итог 9 RUB"}
    assert {(r["doc_id"], r["reason"]) for r in spark.read.parquet(f"{at['work']}/rejected").collect()} == {(4, "not_an_option"), (1, "not_waiting")}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "r")
    table = spark.range(3)
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, root)
    first = snapshots.publish(table, root)
    broken = table.select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("stopped"))).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        snapshots.publish(broken, root)
    assert snapshots.current(spark, root).endswith(first.rsplit("/", 1)[-1]) and spark.read.parquet(snapshots.current(spark, root)).count() == 3
    early, seen = spark.read.parquet(snapshots.current(spark, root)), snapshots.state(spark, root)
    snapshots.publish(spark.range(5), root, expected=seen)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(9), root, expected=seen)
    assert early.count() == 3 and spark.read.parquet(snapshots.current(spark, root)).count() == 5
    snapshots.clean(spark, root, keep=1)
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if not p.name.endswith(".crc"))[:1] == ["current-2"] and len([p for p in (tmp_path / "r").iterdir() if p.is_dir()]) == 1
    assert spark.read.parquet(snapshots.current(spark, root)).count() == 5


def test_reports_and_texts_come_together(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "x [A]", True), (1, 1, "y", True), (2, 0, "z", False), (3, 0, "w", True)], "doc_id long, block_ord int, masked string, complete boolean")
    found = spark.createDataFrame([(1, "inn", "5", "[A]"), (2, "inn", "6", "[B]")], "doc_id long, entity_type string, text string, replacement string")
    rows = {r["doc_id"]: r for r in spark.read.parquet(publish_reports(found, blocks, str(tmp_path / "p"))).collect()}
    assert rows.keys() == {1, 3} and [b["masked"] for b in rows[1]["blocks"]] == ["x [A]", "y"] and rows[1]["report"][0]["original_value"] == "5" and rows[3]["report"] is None
    path = str(tmp_path / "w")
    write_masked(blocks, path)
    with pytest.raises(Exception, match="stopped"):
        write_masked(blocks.withColumn("masked", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("stopped"))).otherwise(F.col("masked"))), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir() if p.name.startswith("w")] == ["w"]


def test_scopes_of_two_threads_do_not_mix(spark):
    import threading

    inside, done, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            t = cut(spark.range(4), "other")
            inside.set()
            done.wait(60)
            seen.append(t.count())

    with scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        inside.wait(60)
        mine = cut(spark.range(2), "mine")
    done.set()
    thread.join()
    assert seen == [4] and mine is not None
