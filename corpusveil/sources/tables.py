"""Tables of blocks from texts, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import SECTION

#: A table is broadcast by hand only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000

_local: list[str] = []
#: The scopes of `scratch` that are open here; threads, such as those of two streams, have their own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`; a local master without that setting uses a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="corpusveil-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = f"file://{_local[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables from the shared folder."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes inside are removed at the end; those to keep then belong to the scratch outside, if any."""
    own: list[str] = []
    before = _scratch.set((*_scratch.get(), own))
    try:
        yield
    finally:
        _scratch.reset(before)
        delete(spark, own)


def cut(df: DataFrame, name: str, codec: str = "snappy", keep: bool = False, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation of what came before.

    Inside `scratch` the table goes at its end; with `keep` it stays as long as the scratch around that, if there is one.
    A caller that knows the path can `delete` it earlier.
    """
    path = path or shared_dir(df.sparkSession, name)
    if owner := _scratch.get()[: -1 if keep else None]:
        owner[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, codec: str = "snappy", keep: bool = False, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """`cut`, and its `rows` and other aggregates by name, taken while the table is written, so that no job has to count it."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in figures.items())), name, codec, keep)
    return out, seen.get


def small_or_plain(df: DataFrame, bound: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it is small, as its known number of rows says or a count; otherwise as it is, for a shuffled join. Rows should be of bounded width."""
    return F.broadcast(df) if (df.limit(bound + 1).count() if rows is None else rows) <= bound else df


#: Tasks that work on the rows of a small file, and for each core.
SPREAD, SPREAD_CORE = 32, 4


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores. A table of short rows is few files, hence few tasks, however much is made of each row."""
    return df.repartition(max(SPREAD, SPREAD_CORE * df.sparkSession.sparkContext.defaultParallelism))


def each(df: DataFrame, array: str | Column, *keep: str | Column, name: str = "s") -> DataFrame:
    """A row for each element of an array of structs, with these columns.

    A plain `explode` lets Spark add a filter on the array's size, which is moved below the projection that
    computes the array, so that it is computed a second time, and steps that name it twice several times.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def whole_text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block per document."""
    return docs.select(F.col(key).alias("doc_id"), F.lit(0).alias("block_ord"), F.col(text).alias("text"))


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for each line with a character that is no white space; the order counts all lines."""
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("block_ord", "text"))
    return lines.where(F.rlike("text", F.lit(r"(?U)\S")))


def with_sections(blocks: DataFrame) -> DataFrame:
    """The last heading above each block, its own included; empty above the first."""
    trimmed: Column = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    upward = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(F.rlike(trimmed, F.lit(SECTION)), trimmed), ignorenulls=True).over(upward), F.lit("")))


def with_table_headers(blocks: DataFrame) -> DataFrame:
    """`column_header` of table cells: the last text so far of row 0 in the same table column. Blocks have table_index, row, column."""
    upward = Window.partitionBy("doc_id", "table_index", "column").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    header = F.coalesce(F.last(F.when(F.col("row") == 0, F.col("text")), ignorenulls=True).over(upward), F.lit(""))
    return blocks.withColumn("column_header", F.when(F.col("table_index").isNotNull(), header))
