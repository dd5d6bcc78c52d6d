"""Detectors that others bring: column functions, functions of a text, functions of a table.

A registry keeps them by name. However many there are, blocks are read once for all column detectors, whose
expressions are one projection, and Python is entered once for all text detectors. Table detectors run as
jobs of their own. A detector that fails yields nothing and a reason, and the others' spans stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import piece
from ..schema import ENTITY_TYPES, SPAN_ARRAY
from ..sources.tables import cut

#: What a text detector gives for each span: entity type, begin, end, confidence.
Found = tuple[str, int, int, float]
_PLACE = "struct<entity_type:string,start:int,end:int,confidence:double>"
_ROW = f"detector string, reason string, spans array<{_PLACE}>"


class Detectors:
    """A registry; names are taken once."""

    def __init__(self) -> None:
        self.columns: dict[str, Callable[[Column], Column]] = {}
        self.texts: dict[str, Callable[[str], Iterable[Found]]] = {}
        self.tables: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def _free(self, name: str) -> str:
        if not name or name in {*self.columns, *self.texts, *self.tables}:
            raise ValueError(f"there is a detector {name!r} already, or the name is empty")
        return name

    def column(self, name: str, function: Callable[[Column], Column]) -> None:
        """A function from a text column to an array column of structs with entity_type, start, end and confidence."""
        self.columns[self._free(name)] = function

    def text(self, name: str, function: Callable[[str], Iterable[Found]]) -> None:
        """A function from a text to its spans, run in Python. What it raises on a text is the reason for that block alone."""
        self.texts[self._free(name)] = function

    def table(self, name: str, function: Callable[[DataFrame], DataFrame]) -> None:
        """A function from blocks (doc_id, block_ord, text) to rows of doc_id, block_ord, entity_type, start, end, confidence. It may join, group and shuffle."""
        self.tables[self._free(name)] = function

    def candidates(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks with `model_spans`, the candidates that detection takes below its rules, and the failures.

        Spans out of the text, of no known type, empty or with a confidence outside 0 to 1 are dropped and counted as
        failures (reason `invalid`). Failures have doc_id and block_ord (null for a whole detector), detector, reason.
        """
        given = [F.col("model_spans")] if "model_spans" in blocks.columns else []
        own = blocks.select("doc_id", "block_ord", F.coalesce("text", F.lit("")).alias("text"))
        rows, failed = [], []
        for name, function in self.columns.items():
            try:
                spans = F.transform(function(F.col("text")), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["confidence"].cast("double").alias("confidence")))
                own.select(spans)  # an expression that does not fit is found here, before it joins the others
            except PySparkException as e:
                failed.append((name, type(e).__name__))
            else:
                rows.append(F.struct(F.lit(name).alias("detector"), F.lit(None).cast("string").alias("reason"), F.coalesce(spans, F.array().cast(f"array<{_PLACE}>")).alias("spans")))
        found = []
        if rows:
            found.append(own.select("doc_id", "block_ord", "text", F.explode(F.array(*rows)).alias("r")).select("doc_id", "block_ord", "text", "r.*"))
        if self.texts:
            found.append(self._by_text(own))
        for name, function in self.tables.items():
            try:
                made = cut(function(own).select("doc_id", "block_ord", "entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("confidence").cast("double").alias("confidence")), "detector")
            except Exception as e:  # noqa: BLE001 - whatever a foreign job fails with
                failed.append((name, type(e).__name__))
            else:
                spans = made.groupBy("doc_id", "block_ord").agg(F.collect_list(F.struct("entity_type", "start", "end", "confidence")).alias("spans"))
                found.append(own.join(spans, ["doc_id", "block_ord"]).select("doc_id", "block_ord", "text", F.lit(name).alias("detector"), F.lit(None).cast("string").alias("reason"), "spans"))
        spark = blocks.sparkSession
        none = own.where("false").select("doc_id", "block_ord", "text", F.lit("").alias("detector"), F.lit(None).cast("string").alias("reason"), F.array().cast(f"array<{_PLACE}>").alias("spans"))
        every = none
        for df in found:
            every = every.unionByName(df)
        every = cut(every, "candidates", keep=True)
        fits = lambda s: F.coalesce(s["entity_type"].isin(*ENTITY_TYPES) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")) & s["confidence"].between(0, 1), F.lit(False))
        as_span = lambda s: F.struct(
            s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), piece(F.col("text"), s["start"], s["end"]).alias("text"),
            F.col("detector").alias("source"), s["confidence"].alias("confidence"), F.lit("unknown").alias("party_role"), F.lit(False).alias("is_rule"),
        )
        spans = every.select("doc_id", "block_ord", F.transform(F.filter("spans", fits), as_span).cast(SPAN_ARRAY).alias("s"))
        spans = spans.groupBy("doc_id", "block_ord").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("_more"))
        bad = every.withColumn("reason", F.coalesce("reason", F.when(F.exists("spans", lambda s: ~fits(s)), "invalid"))).where("reason is not null").select("doc_id", "block_ord", "detector", "reason")
        whole = spark.createDataFrame(failed, "detector string, reason string")
        keys = own.select("doc_id", "block_ord").schema
        failures = bad.unionByName(whole.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in keys), "detector", "reason"))
        empty = F.array().cast(SPAN_ARRAY)
        joined = blocks.join(spans, ["doc_id", "block_ord"], "left").withColumn("model_spans", F.concat(*(F.coalesce(g, empty) for g in given), F.coalesce("_more", empty)))
        return joined.drop("_more"), failures

    def _by_text(self, own: DataFrame) -> DataFrame:
        functions = dict(self.texts)
        place = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index, names, reasons, spans = [], [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for name, function in functions.items():
                        try:
                            found, why = [{"entity_type": str(t), "start": int(s), "end": int(e), "confidence": float(c)} for t, s, e, c in function(text)], None
                        except Exception as e:  # noqa: BLE001 - whatever a foreign function raises
                            found, why = [], type(e).__name__
                        index.append(i)
                        names.append(name)
                        reasons.append(why)
                        spans.append(found)
                take = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("doc_id", "block_ord", "text")), pa.array(names, pa.string()), pa.array(reasons, pa.string()), pa.array(spans, pa.list_(place))], names=["doc_id", "block_ord", "text", "detector", "reason", "spans"])

        kinds = dict(own.dtypes)
        return own.mapInArrow(run, f"doc_id {kinds['doc_id']}, block_ord {kinds['block_ord']}, text string, {_ROW}")
