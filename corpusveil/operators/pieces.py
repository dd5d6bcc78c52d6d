"""Long texts in pieces: where they are cut, and how what is found in pieces becomes spans of the whole text.

Pieces overlap. A span at a cut may be a part of something, or nothing at all when seen whole, so a piece's
word counts for it only if no neighbour sees it with text on either side. What is longer than an overlap
has no such neighbour; its parts, each at a cut, are put together. What no cut touches counts if any piece
names it, since another may lack a label that stands before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import piece as slice_of
from ..schema import SPAN_ARRAY
from ..sources.tables import cut, each

#: Pieces of one Arrow batch.
_BATCH = 512


def overlap_of(size: int, overlap: int | None = None) -> int:
    """The overlap of pieces of a size, 512 or a quarter at most unless it is given."""
    back = min(512, size // 4) if overlap is None else overlap
    if not 0 <= back < size // 2:
        raise ValueError("the overlap must be less than half of a piece")
    return back


def _places(text: str, size: int, back: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each piece."""
    at = 0
    while True:
        end = len(text)
        if end - at > size:
            half = at + size // 2
            last = max(text.rfind(c, half, at + size) for c in " \n")
            end = at + size if last < 0 else last + 1
        yield at, end
        if end == len(text):
            return
        at = max(end - back, at + 1)


def chunks(blocks: DataFrame, size: int, overlap: int | None = None) -> DataFrame:
    """doc_id, block_ord, piece, offset, end, last and text of pieces of at most `size` characters, which begin `overlap` before the last one's end.

    A piece ends behind the last line break or space of its second half, if there is one. An empty text is
    one piece, a null text has none. A text is cut in one pass.
    """
    back = overlap_of(size, overlap)
    own = blocks.where("text is not null").select("doc_id", "block_ord", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                places = list(_places(text, size, back))
                for first in range(0, len(places), _BATCH):
                    part = places[first : first + _BATCH]
                    same = [pa.array([i] * len(part), pa.int32())]
                    columns = [b.column(c).take(same[0]) for c in ("doc_id", "block_ord")]
                    columns += [pa.array(range(first, first + len(part)), pa.int32()), *(pa.array(x, pa.int32()) for x in zip(*part, strict=True)), pa.array([e == len(text) for _, e in part]), pa.array([text[a:e] for a, e in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block_ord", "piece", "offset", "end", "last", "text"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"doc_id {kinds['doc_id']}, block_ord {kinds['block_ord']}, piece int, offset int, end int, last boolean, text string")


def carried_back(found: DataFrame, back: int) -> DataFrame:
    """Spans of whole texts from spans of pieces.

    `found` has a row for each span: doc_id, block_ord, the piece's offset, end and last, entity_type, start
    and stop within the piece, confidence and source. Returns doc_id, block_ord, entity_type, start, end,
    confidence, source, each place and type once: of equal ones the surest, then the first source by name.
    """
    key = ["doc_id", "block_ord", "entity_type"]
    left, right = (F.col("start") == 0) & (F.col("offset") > 0), (F.col("stop") == F.col("end") - F.col("offset")) & ~F.col("last")
    a, e = F.col("start") + F.col("offset"), F.col("stop") + F.col("offset")
    placed = found.select(*key, a.cast("int").alias("a"), e.cast("int").alias("e"), left.alias("left"), right.alias("right"), "confidence", "source", "offset", F.col("end").alias("until"))
    # The neighbour behind begins `back` before this piece's end, the one ahead ends `back` after its begin.
    seen_whole = (F.col("left") & (F.col("e") < F.col("offset") + back)) | (F.col("right") & (F.col("a") > F.col("until") - back))
    # Two steps read these, and finding them is the work, so they are written once.
    placed = cut(placed.where(~seen_whole), "placed")
    # Parts of something longer than an overlap: those at cuts that run into each other are one.
    parts = placed.where("left or right")
    order = Window.partitionBy(*key).orderBy("a", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = parts.withColumn("new", F.when(reached.isNull() | (F.col("a") >= reached), 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    long = joined.groupBy(*key, "run").agg(F.min("a").alias("a"), F.max("e").alias("e"), F.max("confidence").alias("confidence"), F.min("source").alias("source")).drop("run")
    plain = placed.where("not left and not right").select(*key, "a", "e", "confidence", "source")
    # What stands within such a one is a part of it.
    both = plain.withColumn("long", F.lit(False)).unionByName(long.withColumn("long", F.lit(True)))
    upward = Window.partitionBy(*key).orderBy("a", F.desc("long")).rowsBetween(Window.unboundedPreceding, 0)
    kept = both.withColumn("reach", F.max(F.when(F.col("long"), F.col("e"))).over(upward)).where("long or reach is null or e > reach")
    out = kept.groupBy(*key, F.col("a").alias("start"), F.col("e").alias("end"))
    return out.agg(F.max("confidence").alias("confidence"), F.min_by("source", F.struct(-F.col("confidence"), "source")).alias("source"))


def found_in_pieces(blocks: DataFrame, spans: Callable[[Column], Column], size: int, overlap: int | None = None) -> DataFrame:
    """Spans of whole texts by a column function (text -> spans) that sees only pieces of them."""
    cut_up = each(chunks(blocks, size, overlap), spans(F.col("text")), "doc_id", "block_ord", "offset", "end", "last")
    rows = cut_up.select("doc_id", "block_ord", "offset", "end", "last", "s.entity_type", "s.start", F.col("s.end").alias("stop"), "s.confidence", "s.source")
    return carried_back(rows, overlap_of(size, overlap))


def as_model_spans(blocks: DataFrame, carried: DataFrame) -> DataFrame:
    """Blocks with `model_spans`, the candidates that detection takes from a model, from spans of whole texts."""
    own = carried.join(blocks.select("doc_id", "block_ord", F.col("text").alias("_text")), ["doc_id", "block_ord"])
    span = F.struct("entity_type", "start", "end", slice_of(F.col("_text"), F.col("start"), F.col("end")).alias("text"), "source", "confidence", F.lit("unknown").alias("party_role"), F.lit(False).alias("is_rule"))
    spans = own.groupBy("doc_id", "block_ord").agg(F.array_sort(F.collect_list(span)).cast(SPAN_ARRAY).alias("model_spans"))
    return blocks.drop("model_spans").join(spans, ["doc_id", "block_ord"], "left")
