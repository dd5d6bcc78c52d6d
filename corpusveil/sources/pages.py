"""Text of pages from placed characters: blocks, table cells, and the rectangles that hide a span.

A character has doc_id, page_number, char_ord (its place in the page's own order), c, and its box x0, y0, x1,
y1, with y downwards. Characters are put together along that order, first to lines and then to blocks, and
blocks get the order in which a page is read. All windows are within a page or a block. Joins are told to
merge: Spark's estimate of a table's size does not see that a row became many, and would send it through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import MONEY_CELL, MONEY_HEADER
from ..functions.text import let

PAGE = ("doc_id", "page_number")
#: Parts of a line's height: how far a baseline may move in a line, how wide a gap within a line, how wide one between lines of a block.
SHIFT, GAP, LEADING = 0.5, 2.0, 0.8
#: Side of the squares by which cells and characters meet, in units of the page (72 an inch).
GRID = 72.0
BOX = "struct(x0, y0, x1, y1)"


def _islands(df: DataFrame, order: Column, new: Column, name: str) -> DataFrame:
    """Numbers runs of rows of a page: a row that is `new`, or the page's first, begins one."""
    upward = Window.partitionBy(*PAGE).orderBy(order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(upward.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def page_characters(characters: DataFrame) -> DataFrame:
    """Characters with line (of the page), block (in reading order), block_line, and offset in the block's text.

    A line goes on while the baseline moves by less than half of the height, and the next character begins
    neither far behind the last one's end nor before its begin. A block goes on while the next line is close
    below the last and shares some of its width. Blocks are read from above, then from the left. Characters
    without a box or place are left out.
    """
    own = characters.where("c is not null and char_ord is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    order = Window.partitionBy(*PAGE).orderBy("char_ord")
    last = {v: F.lag(v).over(order) for v in ("x0", "x1", "y0", "y1")}
    height = F.greatest(F.col("y1") - F.col("y0"), last["y1"] - last["y0"])
    away = (F.abs(F.col("y1") - last["y1"]) >= SHIFT * height) | (F.col("x0") - last["x1"] > GAP * height) | (F.col("x0") < last["x0"])
    placed = _islands(own.withColumn("away", away), F.col("char_ord"), F.col("away"), "line").drop("away")
    lines = placed.groupBy(*PAGE, "line").agg(F.min("x0").alias("lx0"), F.min("y0").alias("ly0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1"), F.count("*").alias("n"))
    by_line = Window.partitionBy(*PAGE).orderBy("line")
    above = {v: F.lag(v).over(by_line) for v in ("lx0", "lx1", "ly0", "ly1")}
    tall = F.greatest(F.col("ly1") - F.col("ly0"), above["ly1"] - above["ly0"])
    apart = (F.col("ly0") - above["ly1"] > LEADING * tall) | (F.col("ly0") < above["ly0"]) | (F.col("lx0") >= above["lx1"]) | (F.col("lx1") <= above["lx0"])
    lines = _islands(lines.withColumn("apart", apart), F.col("line"), F.col("apart"), "group").drop("apart")
    corner = Window.partitionBy(*PAGE, "group")
    lines = lines.withColumns({"by0": F.min("ly0").over(corner), "bx0": F.min("lx0").over(corner)})
    lines = lines.withColumn("block", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("by0", "bx0", "group")) - 1).cast("int"))
    in_block = Window.partitionBy(*PAGE, "group").orderBy("line")
    lines = lines.withColumns({"block_line": (F.row_number().over(in_block) - 1).cast("int"), "before": F.coalesce(F.sum(F.col("n") + 1).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    joined = placed.join(lines.select(*PAGE, "line", "block", "block_line", "before").hint("merge"), [*PAGE, "line"])
    in_line = F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("char_ord")) - 1
    return joined.withColumn("offset", (F.col("before") + in_line).cast("int")).drop("before")


def page_blocks(placed: DataFrame) -> DataFrame:
    """Blocks of `page_characters`: doc_id, page_number, block, block_ord (in the document), block_id, kind, text (each line ends with a line break) and bbox. Blank ones are left out, but counted."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "c"))), lambda x: x["c"]), "")
    lines = placed.groupBy(*PAGE, "block", "block_line").agg(text.alias("t"), *(f(v).alias(v) for f, v in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_line", "t"))), lambda x: F.concat(x["t"], F.lit("\n"))), "")
    box = F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).cast("array<double>")
    blocks = lines.groupBy(*PAGE, "block").agg(joined.alias("text"), box.alias("bbox")).where(F.rlike("text", F.lit(r"(?U)\S")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "block")) - 1
    name = F.concat(F.lit("pdf_page_"), F.col("page_number").cast("string"), F.lit("_block_"), F.col("block").cast("string"))
    return blocks.select(*PAGE, "block", number.cast("int").alias("block_ord"), name.alias("block_id"), F.lit("pdf_text_block").alias("kind"), "text", "bbox")


def pages_to_recognise(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pages (doc_id, page_number) that have no text."""
    return pages.select(*PAGE).distinct().join(blocks.select(*PAGE).distinct(), list(PAGE), "left_anti")


def _meet(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters with the cells (table, row, column) that hold their middle: equal squares of a grid first, then the exact place."""
    step = lambda v: F.floor(F.col(v) / GRID)
    squares = cells.select(*PAGE, "table", "row", "column", *(F.col(v).alias(f"c{v}") for v in ("x0", "y0", "x1", "y1")))
    squares = squares.withColumn("gx", F.explode(F.sequence(step("cx0"), step("cx1")))).withColumn("gy", F.explode(F.sequence(step("cy0"), step("cy1"))))
    middle = placed.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2}).withColumns({"gx": F.floor(F.col("mx") / GRID), "gy": F.floor(F.col("my") / GRID)})
    return middle.join(squares.hint("merge"), [*PAGE, "gx", "gy"]).where("cx0 <= mx and mx < cx1 and cy0 <= my and my < cy1")


def with_table_cells(blocks: DataFrame, placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Blocks with cell_spans and money_spans, null where no cell below a table's first row has text.

    `cells` has doc_id, page_number, table, row, column and a box. A cell's span is that of its characters in a
    line of a block. It is money if the text of the column's first row names a price and the span is a number.
    """
    held = _meet(placed, cells)
    ordered = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "offset", "c"))), lambda x: x["c"]), "")
    headers = held.where("row = 0").groupBy(*PAGE, "table", "column").agg(ordered().alias("header"))
    spans = held.where("row > 0").groupBy(*PAGE, "block", "block_line", "table", "row", "column").agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
    spans = spans.join(headers.hint("merge"), [*PAGE, "table", "column"], "left").join(blocks.select(*PAGE, "block", "text").hint("merge"), [*PAGE, "block"])
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    left = F.length(value) - F.length(F.regexp_replace(value, r"(?U)\A\s+", ""))
    right = F.length(F.regexp_replace(value, r"(?U)\s+\z", ""))
    money = F.rlike(F.coalesce("header", F.lit("")), F.lit(MONEY_HEADER)) & F.rlike(value, F.lit(MONEY_CELL))
    cell = F.struct("start", "end", F.col("table").alias("cell_table"), F.col("row").alias("cell_row"), F.col("column").alias("cell_column"))
    sums = F.struct((F.col("start") + left).alias("start"), (F.col("start") + right).alias("end"))
    found = spans.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(cell)).alias("cell_spans"), F.array_sort(F.collect_list(F.when(money, sums))).alias("money_spans"))
    return blocks.join(found.hint("merge"), [*PAGE, "block"], "left")


def span_rectangles(placed: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Rectangles that hide matches: doc_id, page_number, block_ord, start, entity_type, block_line, x0, y0, x1, y1, and the label on the widest of a match (of equals the first).

    `found` has doc_id, block_ord, start, end, text, entity_type and label. A match that isn't its block's text at
    that place has none. Matches of a block should not overlap; of those that begin alike the longest counts.
    """
    key = ["doc_id", "block_ord"]
    sound = found.join(blocks.select(*key, *PAGE[1:], "block", F.col("text").alias("whole")).hint("merge"), key).where("start >= 0 and start < end and substring(whole, start + 1, end - start) = text")
    starts = sound.select("doc_id", "page_number", "block", F.col("start").alias("offset"), F.struct("block_ord", "start", "end", "entity_type", "label").alias("m"), F.lit(0).alias("kind"), (-F.col("end")).alias("longer"))
    signs = placed.select(*PAGE, "block", "offset", F.lit(1).alias("kind"), F.lit(0).alias("longer"), "block_line", F.expr(BOX).alias("box"))
    both = starts.unionByName(signs, allowMissingColumns=True)
    order = Window.partitionBy(*PAGE, "block").orderBy("offset", "kind", F.desc("longer"))
    inside = both.withColumn("now", F.last("m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1 and offset < now.end")
    rects = inside.groupBy(*PAGE, "now.block_ord", "now.start", "now.entity_type", "block_line").agg(F.first("now.label").alias("text"), *(f(f"box.{v}").alias(v) for f, v in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    widest = F.row_number().over(Window.partitionBy(*key, "start", "entity_type").orderBy(F.desc(F.col("x1") - F.col("x0")), "block_line"))
    return rects.withColumn("place", widest).withColumn("label", F.when(F.col("place") == 1, F.col("text"))).drop("place", "text")


def word_rectangles(words: Column, start: Column, end: Column) -> Column:
    """Rectangles of a span over recognised words (array of start, end, x0, y0, x1, y1): one for words whose tops are within half of the lower height."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    touched = F.filter(words, lambda w: (w["start"] < end) & (w["end"] > start))

    def step(out: Column, w: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        near = F.abs(w["y0"] - last["y0"]) < 0.5 * F.least(w["y1"] - w["y0"], last["y1"] - last["y0"])
        own = F.struct(*(w[v].cast("double").alias(v) for v in ("x0", "y0", "x1", "y1"))).cast(box)
        union = F.struct(*(f(last[v], w[v].cast("double")).alias(v) for f, v in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1")))).cast(box)
        return F.when((F.size(out) > 0) & near, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(union))).otherwise(F.concat(out, F.array(own))).cast(f"array<{box}>")

    return let(touched, lambda t: F.aggregate(t, F.array().cast(f"array<{box}>"), step))
