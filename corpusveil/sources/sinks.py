"""Reports as files, masked texts that are published whole, and an append-only log of metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.masking import publishable
from ..schema import DISPLAY_NAMES, ROLE_NAMES, lookup
from .snapshots import exists, publish, rename_to_free
from .tables import delete

#: The fields of a report in JSON, in order; those that a table of matches lacks are null.
FIELDS = {
    "entity_type": "string", "original_value": "string", "replacement": "string", "location": "string", "source": "string", "confidence": "double", "party_role": "string",
    "entity_id": "string", "organization_id": "string", "evidence": "array<string>", "conflict": "boolean", "applied": "boolean",
}
#: Mark of UTF-8 files, which office programs look for.
BOM = "\ufeff"


def json_rows(matches: DataFrame, applied_only: bool = False) -> DataFrame:
    """doc_id and the twelve fields of each match, of those that were put in alone if `applied_only`."""
    own = matches.withColumn("original_value", F.col("text"))
    if applied_only:
        own = own.where("applied")
    return own.select("doc_id", *(F.col(c).cast(t).alias(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items()))


def _replace(df: DataFrame, path: str, kind: str, **options) -> None:
    """Write a table to a path, whose old one goes only when the new one is whole; a run that fails leaves the old one.

    Readers who must never miss a table, not even between the two renames, use `publish_reports`.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    made, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        df.write.format(kind).options(**options).save(made)
    except BaseException:
        delete(spark, [made])
        raise
    if exists(spark, path):
        rename_to_free(spark, path, old)
    rename_to_free(spark, made, path)
    delete(spark, [old])


def publish_reports(matches: DataFrame, masked_blocks: DataFrame, root: str, expected: int | None = None) -> str:
    """Publish the report and the masked texts of whole documents as one version of `root`, and return its folder.

    The folder has a row for each document with the masked blocks and the report's rows (null without matches), so
    that a reader has both of one version or neither. See `snapshots.publish` for writers that meet.
    """
    whole = publishable(masked_blocks).where("publishable").select("doc_id")
    own = masked_blocks.join(whole, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "masked"))).alias("blocks"))
    rows = json_rows(matches).groupBy("doc_id").agg(F.collect_list(F.struct(*FIELDS)).alias("report"))
    return publish(own.join(rows, "doc_id", "left"), root, expected=expected)


def write_json_report(matches: DataFrame, path: str, applied_only: bool = False) -> None:
    """The twelve fields of the matches; the write is committed as a whole, see `_replace`."""
    _replace(json_rows(matches, applied_only), path, "json", ignoreNullFields=False)


def csv_rows(matches: DataFrame) -> DataFrame:
    """Seven columns of each match, with names and shares as people read them."""
    rows = json_rows(matches)
    share = F.format_string("%.2f%%", 100 * F.col("confidence"))
    return rows.select(lookup(DISPLAY_NAMES, F.col("entity_type")).alias("type"), "original_value", "replacement", "location", "source", share.alias("confidence"), lookup(ROLE_NAMES, F.col("party_role")).alias("role"))


def write_csv_report(matches: DataFrame, path: str) -> None:
    """Report rows as CSV; every file begins with the mark of UTF-8 and a header."""
    _replace(csv_rows(matches).withColumnRenamed("type", f"{BOM}type"), path, "csv", header=True)


def write_masked(masked_blocks: DataFrame, path: str) -> None:
    """The masked blocks of documents of which every match was put in, committed as a whole; the others stay unpublished."""
    whole = publishable(masked_blocks).where("publishable").select("doc_id")
    _replace(masked_blocks.join(whole, "doc_id", "left_semi").select("doc_id", "block_ord", "masked"), path, "parquet")


def log_counts(matches: DataFrame, path: str, run: str) -> None:
    """Appends how many matches of each type and source a run has; never their texts."""
    counts = matches.groupBy("entity_type", "source").agg(F.count("*").alias("n"))
    counts.select(F.lit(run).alias("run"), "entity_type", "source", "n").write.mode("append").parquet(path)
