"""Helpers that several training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import counted, cut, delete, scratch, small_or_plain
from ..sources.tables import shared_dir as fresh_dir

__all__ = ["batch", "counted", "cut", "delete", "fresh_dir", "scratch", "small_or_plain", "table", "texts", "tune"]

#: Rows of one Arrow batch that go to Python at once; a batch is also bounded in bytes.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under names that cannot clash with other columns."""
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of columns given by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
