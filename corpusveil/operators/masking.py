"""Masked texts, reports, previews and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, let, piece
from ..schema import DISPLAY_NAMES, ROLE_NAMES, lookup


def put_in(blocks: DataFrame, found: DataFrame, style: str = "full", unless: Column | None = None) -> DataFrame:
    """Blocks with `masked`, `complete` and `put`, how many matches were put in; blocks of `unless` stay as they are.

    Matches go in the order of place, value and type, as in `with_applied`.
    """
    text = F.when(F.lit(style) == "none", F.repeat(F.lit(" "), F.length("text"))).otherwise(label(F.col("replacement"), F.col("entity_type"), style))
    kind = ["entity_type"] if "entity_type" in found.columns else []
    spans = found.groupBy("doc_id", "block_ord").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("value"), *kind, text.alias("label")))).alias("_spans"))
    # Spark's estimate of what is made of short rows does not grow with them, so that a plain join would send it through the driver.
    own = blocks.join(spans.hint("merge"), ["doc_id", "block_ord"], "left")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("complete"))

    def step(a: Column, s: Column) -> Column:
        good = (s["start"] >= a["at"]) & (piece(F.col("text"), s["start"], s["end"]) == s["value"])
        put = F.concat(a["out"], F.array(piece(F.col("text"), a["at"], s["start"]), s["label"]))
        return F.struct(F.when(good, s["end"]).otherwise(a["at"]).alias("at"), F.when(good, put).otherwise(a["out"]).alias("out"), (a["complete"] & good).alias("complete"))

    end = lambda a: F.struct(F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))).alias("masked"), a["complete"].alias("complete"), (F.size(a["out"]) / 2).cast("int").alias("put"))
    plain = F.struct(F.col("text").alias("masked"), F.lit(True).alias("complete"), F.lit(0).alias("put"))
    open_ = F.col("_spans").isNotNull() if unless is None else F.col("_spans").isNotNull() & ~unless
    done = F.when(open_, F.aggregate("_spans", zero, step, end)).otherwise(plain)
    return own.withColumn("_done", done).withColumns({c: F.col(f"_done.{c}") for c in ("masked", "complete", "put")}).drop("_spans", "_done")


def masked(blocks: DataFrame, found: DataFrame, style: str = "full") -> DataFrame:
    """Blocks with `masked`, their text with labels in place of matches, and `complete`.

    The style none puts as many spaces as the value has characters. A block is complete if every match was
    put in: its range holds its text and overlaps no other.
    """
    return put_in(blocks, found, style).drop("put")


def with_applied(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Matches with `applied`: whether masking their block puts them in, by the same rule as `masked`.

    A block's matches go through it as one array of whole rows, so they meet their text in one join. Of equal ones the first counts.
    """
    first = ["start", "end", "text", "entity_type"]
    row = [*first, *(c for c in found.columns if c not in (*first, "doc_id", "block_ord", "applied"))]
    spans = found.groupBy("doc_id", "block_ord").agg(F.array_sort(F.collect_list(F.struct(*row))).alias("_spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        good = F.coalesce((s["start"] >= a["at"]) & (piece(F.col("_text"), s["start"], s["end"]) == s["text"]), F.lit(False))
        return F.struct(F.when(good, s["end"].cast("int")).otherwise(a["at"]).alias("at"), F.concat(a["out"], F.array(good)).alias("out"))

    texts = blocks.groupBy("doc_id", "block_ord").agg(F.min("text").alias("_text"))
    own = spans.join(texts.hint("merge"), ["doc_id", "block_ord"], "left")
    both = F.arrays_zip(F.col("_spans").alias("s"), F.aggregate("_spans", zero, step, lambda a: a["out"]).alias("applied"))
    out = own.select("doc_id", "block_ord", F.explode(both).alias("m"))
    return out.select(*(F.col(c if c in ("doc_id", "block_ord") else f"m.s.{c}") for c in found.columns if c != "applied"), "m.applied")


def publishable(masked_blocks: DataFrame) -> DataFrame:
    """doc_id and whether all its blocks are complete; a document that is not must not be published."""
    return masked_blocks.groupBy("doc_id").agg(F.min("complete").alias("publishable"))


def format_location(place: Column) -> Column:
    """A place in words, counted from one. `place` has sheet_name, cell_coordinate, table_index, row, column, cell_paragraph_index, paragraph_index, page_number, bbox."""
    one = lambda c: (F.coalesce(place[c], F.lit(0)) + 1).cast("string")
    sheet = F.concat(F.lit("Лист «"), F.coalesce(F.nullif(place["sheet_name"], F.lit("")), F.lit("?")), F.lit("», ячейка "), F.coalesce(F.nullif(place["cell_coordinate"], F.lit("")), F.lit("?")))
    cell = F.concat(F.lit("Таблица "), one("table_index"), F.lit(", строка "), one("row"), F.lit(", столбец "), one("column"), F.when(place["cell_paragraph_index"].isNotNull(), F.concat(F.lit(", абзац "), one("cell_paragraph_index"))).otherwise(""))
    area = F.when(place["bbox"].isNotNull(), F.concat(F.lit(", область "), F.array_join(F.transform(place["bbox"], lambda v: F.format_string("%.1f", v)), ", "))).otherwise("")
    named = (F.coalesce(place["sheet_name"], F.lit("")) != "") | (F.coalesce(place["cell_coordinate"], F.lit("")) != "")
    return F.when(named, sheet).when(place["table_index"].isNotNull(), cell).when(place["paragraph_index"].isNotNull(), F.concat(F.lit("Абзац "), one("paragraph_index"))).when(place["page_number"].isNotNull(), F.concat(F.lit("Страница "), one("page_number"), area)).otherwise("Не указано")


def report(found: DataFrame) -> DataFrame:
    """Report rows of a document's matches in order: number, display names, value, marker, role, source, confidence."""
    order = Window.partitionBy("doc_id").orderBy("block_ord", "start", "end", "entity_type")
    return found.select("doc_id", F.row_number().over(order).alias("number"), lookup(DISPLAY_NAMES, F.col("entity_type")).alias("type_name"), F.col("text").alias("original_value"), "replacement", lookup(ROLE_NAMES, F.col("party_role")).alias("role_name"), "source", "confidence")


def segments(text: Column, markers: Column) -> Column:
    """A text cut at markers (the longer first): array of text and replacement (null between markers)."""
    longest = F.transform(F.array_sort(F.transform(F.filter(markers, lambda m: m != ""), lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: x["m"])
    any_of = F.array_join(F.transform(longest, lambda m: F.concat(F.lit(r"\Q"), m, F.lit(r"\E"))), "|")
    mark = "\ue000"
    cut_ = lambda p: F.split(F.regexp_replace(text, F.concat(F.lit("("), p, F.lit(")")), F.lit(f"{mark}$1{mark}")), mark, -1)
    parts = let(any_of, lambda p: F.when(p == "", F.array(text)).otherwise(cut_(p)))
    kept = F.when(text == "", F.array(F.lit(""))).otherwise(F.filter(parts, lambda x: x != ""))
    return F.transform(kept, lambda x: F.struct(x.alias("text"), F.when(F.array_contains(markers, x), x).alias("replacement")))


def preview(masked_blocks: DataFrame, markers: DataFrame, limit: int = 500_000) -> DataFrame:
    """The first `limit` characters of each document's masked text as segments; `markers` has doc_id and an array.

    A block that begins beyond the limit is left out; the one that crosses it is clipped.
    """
    before = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    own = masked_blocks.withColumn("_used", F.coalesce(F.sum(F.length("masked")).over(before), F.lit(0))).where(F.col("_used") < limit)
    clipped = F.substring(F.col("masked"), F.lit(1), (F.lit(limit) - F.col("_used")).cast("int"))
    own = own.withColumns({"_text": clipped, "truncated": F.length("masked") > limit - F.col("_used")}).join(markers, "doc_id", "left")
    return own.select("doc_id", "block_ord", "truncated", segments(F.col("_text"), F.coalesce("markers", F.array().cast("array<string>"))).alias("segments"))


def reduced_gold(gold: DataFrame) -> DataFrame:
    """Gold spans without those that lie within another one of their block and type.

    In the order of their begins, the longer first, one lies within another if that reaches as far as it.
    """
    key = ["doc_id", "block_ord", "entity_type"]
    g = gold.select(*key, "start", "end").distinct()
    before = Window.partitionBy(*key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end").drop("reach")


#: Characters of one bin, by which gold and found spans meet.
BIN = 256


def _binned(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin that a span touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / BIN))))


def quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: expected (gold), covered (a found span of the type contains it), extra (found that touch no gold of the type)."""
    key = ["doc_id", "block_ord", "entity_type"]
    g = reduced_gold(gold)
    f = found.select(*key, F.col("start").alias("s"), F.col("end").alias("e"))
    pairs = _binned(g, "start", "end").join(_binned(f, "s", "e"), [*key, "bin"])
    covered = pairs.where("s <= start and e >= end").select(*g.columns).distinct()
    touched = pairs.where("s < end and e > start").select(*f.columns).distinct()
    extra = f.join(touched, f.columns, "left_anti")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = count(g, "expected").join(count(covered, "covered"), "doc_id", "full").join(count(extra, "extra"), "doc_id", "full")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "covered", "extra")))
