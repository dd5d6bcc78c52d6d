"""A model's answers: strict reading of its JSON, and values found again in the source.

Offsets that a model names are never used: a value counts where it stands in the text, whatever its white space.
Answers on pieces of long texts are found in these pieces and carried back to the whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import find, literal_pattern, piece
from ..schema import ENTITY_TYPES, MODEL_TYPES, SPAN_ARRAY
from .pieces import carried_back, chunks

__all__ = ["answers", "answers_on_pieces", "chunks", "model_spans", "relocated"]

FIELDS = ("entity_type", "value", "confidence")
ANSWER = "struct<entities:array<struct<entity_type:string,value:string,confidence:double>>>"


def _keys(df: DataFrame) -> list[str]:
    """What tells a text that was asked about: a block, or a piece of one."""
    return ["doc_id", "block_ord", *(["piece"] if "piece" in df.columns else [])]


def answers(replies: DataFrame) -> DataFrame:
    """The entities of replies (doc_id, block_ord, perhaps piece, reply): the keys, entity_type, value, confidence, and a reason if the reply is no such JSON.

    A fence around the whole reply is taken off, in any case and on one line too. Any other text, name or type,
    at the top or in an entity, makes the reply unreadable.
    """
    keys = _keys(replies)
    bare = F.regexp_replace("reply", r"(?is)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", "$1")
    read = F.from_json(bare, ANSWER, {"mode": "PERMISSIVE"})
    strict = F.rlike(bare, F.lit(r"(?s)\A\s*\{\s*\"entities\"\s*:\s*\[.*\]\s*\}\s*\z")) & read["entities"].isNotNull()
    known = F.forall(F.coalesce(F.json_object_keys(bare), F.array()), lambda k: k == "entities")
    named = F.from_json(bare, "struct<entities:array<map<string,string>>>", {"mode": "PERMISSIVE"})["entities"]
    plain = F.forall(F.coalesce(named, F.array().cast("array<map<string,string>>")), lambda e: F.coalesce(F.size(F.array_except(F.map_keys(e), F.array(*map(F.lit, FIELDS)))) == 0, F.lit(False)))
    own = replies.select(*keys, F.when(strict & known & plain, read["entities"]).alias("found"))
    rows = own.select(*keys, F.explode_outer("found").alias("e"), F.col("found").isNull().alias("bad"))
    return rows.where("bad or e is not null").select(*keys, "e.entity_type", "e.value", "e.confidence", F.when(F.col("bad"), "unreadable").alias("reason"))


def relocated(blocks: DataFrame, named: DataFrame, types: tuple[str, ...] | list[str] = MODEL_TYPES, source: str = "llm", confidence: float = 0.8) -> DataFrame:
    """Each named value (the keys, entity_type, value, confidence, perhaps reason) with the ranges where its block, or piece, has it.

    Returns the keys, the value's columns, ranges, and reason: what it was, or unknown_type (of no such name),
    unrequested_type, empty, absent; null if it was found.
    """
    keys = _keys(named)
    own = named if "reason" in named.columns else named.withColumn("reason", F.lit(None).cast("string"))
    own = own.join(blocks.select(*keys, "text"), keys, "left")
    blank = F.coalesce(F.rlike("value", F.lit(r"(?U)\A\s*\z")), F.lit(True))
    no = lambda kinds: ~F.coalesce(F.col("entity_type").isin(*kinds), F.lit(False))
    early = F.coalesce("reason", F.when(no(ENTITY_TYPES), "unknown_type").when(no(types), "unrequested_type").when(blank, "empty").when(F.col("text").isNull(), "absent"))
    ranges = F.when(early.isNull(), find(F.col("text"), literal_pattern(F.col("value")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    out = own.withColumn("early", early).withColumn("ranges", ranges)
    out = out.withColumn("reason", F.coalesce("early", F.when(F.size("ranges") == 0, "absent")))
    return out.withColumns({"source": F.lit(source), "confidence": F.coalesce("confidence", F.lit(confidence))}).select(*keys, "entity_type", "value", "confidence", "source", "ranges", "reason", "text")


def answers_on_pieces(pieces: DataFrame, replies: DataFrame, back: int, types: tuple[str, ...] | list[str] = MODEL_TYPES) -> DataFrame:
    """Spans of whole texts from replies (doc_id, block_ord, piece, reply) on their pieces, which `chunks` cut with an overlap of `back`.

    Returns doc_id, block_ord, entity_type, start, end, confidence and source. A value that several pieces have counts once, one that a cut halved as a whole, and one inside a longer value of its type not at all.
    """
    found = relocated(pieces, answers(replies), types).where("reason is null").select("doc_id", "block_ord", "piece", "entity_type", "confidence", "source", F.explode("ranges").alias("r"))
    rows = found.join(pieces.select("doc_id", "block_ord", "piece", "offset", "end", "last"), ["doc_id", "block_ord", "piece"])
    whole = carried_back(rows.select("doc_id", "block_ord", "offset", "end", "last", "entity_type", F.col("r.start").alias("start"), F.col("r.end").alias("stop"), "confidence", "source"), back)
    # A value is also found inside a longer one that ends or begins with it; there it is no value of its own.
    before = Window.partitionBy("doc_id", "block_ord", "entity_type").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end").drop("reach")


def model_spans(blocks: DataFrame, named: DataFrame, types: tuple[str, ...] | list[str] = MODEL_TYPES) -> DataFrame:
    """Blocks with `model_spans`, the candidates that detection takes from a model: the relocated values, in order."""
    each = relocated(blocks, named, types).where("reason is null").select("*", F.explode("ranges").alias("r"))
    span = F.struct("entity_type", F.col("r.start").alias("start"), F.col("r.end").alias("end"), piece(F.col("text"), F.col("r.start"), F.col("r.end")).alias("text"), "source", "confidence", F.lit("unknown").alias("party_role"), F.lit(False).alias("is_rule"))
    spans = each.groupBy("doc_id", "block_ord").agg(F.array_sort(F.collect_set(span)).cast(SPAN_ARRAY).alias("model_spans"))
    return blocks.drop("model_spans").join(spans, ["doc_id", "block_ord"], "left")
