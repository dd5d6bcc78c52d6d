"""Token counts as rollups that signed changes maintain.

A change inserts a document, deletes one or revises its count. A batch of changes becomes additive sums by
source, language and tokenizer version. They are written aside and published by one rename to a folder
that bears the batch's name, so readers see all of a batch or nothing of it. A name is taken once: a batch
that is committed again, after a failure or after compaction, changes nothing. Totals are the sums over all
batches. Compaction folds the batches of one listing into one table, published the same way, that remembers
their names; batches that come meanwhile stay. What is folded is removed by the next compaction, so that a
reader who listed the folders before still finds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, delete, fresh_dir, tune
from .tokens import encoder

KEYS = ("source", "lang", "version")
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, files: dict[str, tuple[str, bool]], keys: tuple[str, ...] = ("source", "lang"), text: str = "text") -> DataFrame:
    """The keys and, for each version, the tokens of each row; `files` has a tokenizer file by version, and whether it keeps spaces. Null texts have none."""
    tune(docs.sparkSession)
    schema = pa.schema([*((k, pa.string()) for k in keys), *((v, pa.int64()) for v in files)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [t or "" for t in b.column("t").to_pylist()]
            counts = {v: np.array(encoder(path, keeps).count(whole), dtype=np.int64) for v, (path, keeps) in files.items()}
            yield batch(schema, **{k: b.column(k) for k in keys}, **counts)

    own = docs.select(*(F.col(f"`{k}`").cast("string").alias(k) for k in keys), F.col(f"`{text}`").cast("string").alias("t"))
    return own.mapInArrow(run, ", ".join([*(f"`{k}` string" for k in keys), *(f"`{v}` long" for v in files)]))


def signed(changes: DataFrame) -> DataFrame:
    """Documents and tokens that a change adds (less than 0: takes away).

    `changes` has the keys, op (insert, delete or revise), tokens, and old_tokens for revisions. A null op
    or count adds nothing; null keys are groups of their own; each of repeated rows counts.
    """
    tokens, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens", "old_tokens"))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
    return changes.select(*KEYS, sign.alias("docs"), F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens).alias("tokens"))


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, root: str) -> list[str]:
    where, fs = _file_system(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _publish(spark: SparkSession, made: str, target: str) -> bool:
    """Rename a written table to its name, which must be free: if another writer has taken it, that one's stays."""
    where, fs = _file_system(spark, target)
    fs.mkdirs(where.getParent())
    jvm = spark._jvm
    free = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    free[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(_file_system(spark, made)[0], where, free)
        return True
    except Py4JJavaError:
        if not fs.exists(where):
            raise
    delete(spark, [made])
    return False


class _State(NamedTuple):
    """The last compaction's folder, the folders of the batches since, and folders that earlier compactions have made needless."""

    last: str | None
    since: list[str]
    needless: list[str]


def _folded(spark: SparkSession, root: str, last: str | None, names: list[str]) -> set[str]:
    """Which of these names the compaction has folded."""
    if not last or not names:
        return set()
    return {r["name"] for r in spark.read.schema("name string").parquet(f"{root}/{last}/names").where(F.col("name").isin(names)).collect()}


def _state(spark: SparkSession, root: str) -> _State:
    """What one listing of the folders shows."""
    names = _names(spark, root)
    numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"compaction-(\d+)", n)))
    last = f"compaction-{numbers[-1]}" if numbers else None
    batches = sorted(n for n in names if n.startswith("batch-"))
    done = _folded(spark, root, last, batches)
    return _State(last, [n for n in batches if n not in done], sorted(done) + [f"compaction-{n}" for n in numbers[:-1]])


def commit(root: str, batch_id: str, changes: DataFrame) -> bool:
    """Commit a batch of changes under its name; False, and nothing changes, if the name was committed before."""
    spark, name = changes.sparkSession, f"batch-{quote(batch_id, safe='')}"
    state = _state(spark, root)
    if name in state.since or name in state.needless or _folded(spark, root, state.last, [name]):
        return False
    made = fresh_dir(spark, "changes")
    sums = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    sums.write.parquet(made)
    return _publish(spark, made, f"{root}/{name}")


def _sums(spark: SparkSession, root: str, state: _State) -> DataFrame:
    """The totals of the batches that a listing has shown."""
    paths = [f"{root}/{n}" for n in state.since] + ([f"{root}/{state.last}/sums"] if state.last else [])
    rows = spark.read.schema(SUMS).parquet(*paths) if paths else spark.createDataFrame([], SUMS)
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """The totals of all committed batches, without groups that have become empty; without a batch there are none."""
    return _sums(spark, root, _state(spark, root))


def compact(spark: SparkSession, root: str) -> bool:
    """Fold the batches of one listing into one table that remembers their names. False if there are none, or another compaction came first.

    A run that fails on the way changes no total. Folders that earlier compactions have folded go; those of this one go with the next.
    """
    state = _state(spark, root)
    if not state.since:
        return False
    made = fresh_dir(spark, "compaction")
    _sums(spark, root, state).write.parquet(f"{made}/sums")
    names = spark.createDataFrame([(n,) for n in state.since], "name string")
    if state.last:
        names = names.union(spark.read.schema("name string").parquet(f"{root}/{state.last}/names"))
    names.write.parquet(f"{made}/names")
    done = _publish(spark, made, f"{root}/compaction-{int(state.last.split('-')[1]) + 1 if state.last else 1}")
    if done:
        delete(spark, [f"{root}/{n}" for n in state.needless])
    return done
