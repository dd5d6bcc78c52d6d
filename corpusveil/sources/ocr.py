"""Lines of text from recognised words (tab-separated, one word a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words below this confidence are dropped.
LEAST_CONFIDENCE = 20
_LINE = ("page_num", "block_num", "par_num", "line_num")


def ocr_lines(words: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Lines from words with doc_id, page_num, block_num, par_num, line_num, word_num, left, top, width, height, conf, text.

    A line joins its words by spaces and has their ranges and scaled boxes, and its own box. Returns doc_id,
    page_number (from zero), block_ord, text, ocr_words and bbox.
    """
    good = words.where((F.trim("text") != "") & (F.try_to_number(F.col("conf").cast("string"), F.lit("S99999.999999")) >= LEAST_CONFIDENCE) if dict(words.dtypes)["conf"] == "string" else (F.trim("text") != "") & (F.col("conf") >= LEAST_CONFIDENCE))
    box = F.struct(
        F.col("word_num"), F.trim("text").alias("text"), (F.col("left") * scale_x).alias("x0"), (F.col("top") * scale_y).alias("y0"),
        ((F.col("left") + F.col("width")) * scale_x).alias("x1"), ((F.col("top") + F.col("height")) * scale_y).alias("y1"),
    )
    lines = good.groupBy("doc_id", *_LINE).agg(F.array_sort(F.collect_list(box)).alias("words"), F.min(F.col("left") * scale_x).alias("a"), F.min(F.col("top") * scale_y).alias("b"), F.max((F.col("left") + F.col("width")) * scale_x).alias("c"), F.max((F.col("top") + F.col("height")) * scale_y).alias("d"))
    # Where each word ends, from one pass over the line.
    ends = F.aggregate("words", F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, w: F.struct((a["at"] + 1 + F.length(w["text"])).alias("at"), F.concat(a["out"], F.array(a["at"] + 1 + F.length(w["text"]))).alias("out")), lambda a: a["out"])
    lines = lines.withColumn("ends", ends)
    end = lambda i: F.get("ends", i)
    placed = F.transform("words", lambda w, i: F.struct((end(i) - F.length(w["text"])).alias("start"), end(i).alias("end"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1")))
    order = Window.partitionBy("doc_id").orderBy(*_LINE)
    return lines.select("doc_id", (F.col("page_num") - 1).cast("int").alias("page_number"), (F.row_number().over(order) - 1).alias("block_ord"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), placed.alias("ocr_words"), F.array("a", "b", "c", "d").alias("bbox"))
