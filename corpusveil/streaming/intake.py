"""Continuous intake: documents that arrive in a folder are masked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detectors import Detectors
from ..plans.pipeline import mask, propose
from ..schema import ENTITY_TYPES
from ..sources.snapshots import exists, rename_to_free
from ..sources.tables import line_blocks, scratch

DOCUMENTS = "doc_id long, text string"


def start(spark: SparkSession, source: str, target: str, checkpoint: str, types: tuple[str, ...] | list[str] = ENTITY_TYPES, style: str = "full", every: str | None = None, detectors: Detectors | None = None) -> StreamingQuery:
    """Mask the Parquet documents (doc_id, text) that come into `source`: what is there now, or on and on at an interval (`every`, such as "1 minute").

    Each batch is written aside and then renamed to a folder of `target` under its number, so a batch that
    runs again after a failure is there once. Documents are independent: no state is kept between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        if exists(spark, f"{target}/batch={number}"):
            return
        with scratch(spark):
            done = mask(propose(line_blocks(batch), types, detectors=detectors), style=style)
            done = done.select("doc_id", "block_ord", "masked", "complete")
            done.write.mode("overwrite").parquet(f"{target}/_batch-{number}")
            rename_to_free(spark, f"{target}/_batch-{number}", f"{target}/batch={number}")

    when = {"availableNow": True} if every is None else {"processingTime": every}
    return spark.readStream.schema(DOCUMENTS).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**when).start()
