"""Rollups with two writers, and media that are no progressive images."""

from __future__ import annotations

import os

from corpusveil.llm import jpeg, rollups

CHANGES = "source string, lang string, version string, op string, tokens long, old_tokens long"


def total(spark, root):
    return [(r["n_docs"], r["n_tokens"]) for r in rollups.totals(spark, root).collect()]


def test_a_batch_that_comes_during_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/r"
    one, two = (spark.createDataFrame([("s", "en", "v", "insert", n, None)], CHANGES) for n in (10, 5))
    rollups.commit(root, "1", one)
    fresh, sums = rollups.fresh_dir, rollups._sums

    def between(*a):
        monkeypatch.setattr(rollups, "_sums", sums)
        rollups.commit(root, "2", two)
        return sums(*a)

    monkeypatch.setattr(rollups, "_sums", between)
    assert rollups.compact(spark, root) and rollups.fresh_dir is fresh
    assert total(spark, root) == [(2, 15)] and not rollups.commit(root, "1", one) and not rollups.commit(root, "2", two)
    assert rollups.compact(spark, root) and total(spark, root) == [(2, 15)] and not rollups.compact(spark, root)
    assert not rollups.commit(root, "1", one) and not rollups.commit(root, "2", two) and total(spark, root) == [(2, 15)]


def test_the_second_of_two_writers_of_a_name_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/r"
    one, two = (spark.createDataFrame([("s", "en", "v", "insert", n, None)], CHANGES) for n in (10, 5))
    publish = rollups._publish

    def late(*a):
        monkeypatch.setattr(rollups, "_publish", publish)
        assert rollups.commit(root, "1", two)
        return publish(*a)

    monkeypatch.setattr(rollups, "_publish", late)
    assert not rollups.commit(root, "1", one) and total(spark, root) == [(1, 5)]
    assert not any(len(os.listdir(d)) == 0 or any(x.startswith("changes") for x in os.listdir(d)) for d in (tmp_path / "r").iterdir())


def test_a_reader_that_listed_before_a_compaction_still_reads(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    one = spark.createDataFrame([("s", "en", "v", "insert", 10, None)], CHANGES)
    rollups.commit(root, "1", one)
    early = rollups.totals(spark, root)
    rollups.compact(spark, root)
    assert early.first()["n_tokens"] == 10
    rollups.commit(root, "2", one)
    rollups.compact(spark, root)
    assert sorted(x for x in os.listdir(tmp_path / "r") if not x.startswith(".")) == ["batch-2", "compaction-1", "compaction-2"]
    assert total(spark, root) == [(2, 20)]


def test_files_that_are_no_images_give_a_reason(spark):
    good = bytes(jpeg.store([bytes(range(256)) * 9])[0])
    huge = bytearray(good)
    at = good.index(b"\xff\xc2")
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    files = {1: good, 2: None, 3: b"", 4: b"GIF89a....", 5: good[:40], 6: good[: len(good) // 2], 7: bytes(huge), 8: good, 9: good.replace(b"\xff\xc2", b"\xff\xc0", 1)}
    got = {r["k"]: r for r in jpeg.decode_media(spark.createDataFrame(list(files.items()), "k long, media binary").coalesce(1)).collect()}
    assert got.keys() == files.keys() and got[1]["rgb"] == got[8]["rgb"] and got[1]["reason"] is None and got[1]["height"] > 0
    assert got[2]["rgb"] is None and got[2]["reason"] is None and "pixels" in got[7]["reason"]
    assert all(got[k]["rgb"] is None and got[k]["reason"] for k in (3, 4, 5, 7, 9)) and (got[6]["rgb"] is None) == (got[6]["reason"] is not None)
