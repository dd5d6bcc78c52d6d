"""Masks put into formatted text: runs of a paragraph, cells of a sheet, rectangles of a page.

A block's runs and matches are read as events along its text, in one window over the block: where a run
begins, where a match begins and where it ends. Between two events lies one piece, of one run, within one
match or none. So a block costs its runs and matches once, however they lie across each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, piece
from .masking import put_in, with_applied

KEY = ("doc_id", "block_ord")


def run_places(runs: DataFrame) -> DataFrame:
    """Runs (doc_id, block_ord, run_ord, text) with `begin`, the characters of their block before them. A null text is empty."""
    before = Window.partitionBy(*KEY).orderBy("run_ord").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("begin", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))


def labels(found: DataFrame, style: str = "full") -> DataFrame:
    """Matches with the `label` that stands for them: as many spaces as characters, and at least one, in the style none."""
    blank = F.repeat(F.lit(" "), F.greatest(F.lit(1), F.length("text")))
    return found.withColumn("label", blank if style == "none" else label(F.col("replacement"), F.col("entity_type"), style))


def redacted_runs(runs: DataFrame, found: DataFrame, style: str = "full") -> tuple[DataFrame, DataFrame]:
    """The pieces that masked runs consist of, and the matches with `applied`.

    Pieces have doc_id, block_ord, run_ord, part (their order in the run), text, marked, and the run's other
    columns, such as its format. A label takes the run where its match begins. Of a run within a match nothing
    is left; a run without text stays as it is. Matches that don't hold their text, or overlap one before, aren't put in.
    """
    placed = run_places(runs)
    whole = placed.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text"))), lambda r: r["text"]), "").alias("text"))
    judged = with_applied(whole, labels(found, style))
    other = [c for c in runs.columns if c not in (*KEY, "text")]
    run = F.struct(*other, "text", "begin")
    use = judged.where("applied")
    at = lambda df, pos, kind, **more: df.select(*KEY, F.col(pos).cast("int").alias("pos"), F.lit(kind).alias("kind"), *(more.get(c, F.lit(None)).alias(c) for c in ("order", "run", "label")))
    # At one place: an end, then runs that begin there, then a beginning.
    events = at(placed, "begin", 1, run=run, order=F.col("run_ord").cast("long")).unionByName(at(use, "start", 2, label=F.col("label"), order=F.lit(0).cast("long"))).unionByName(at(use, "end", 0, order=F.lit(0).cast("long")))
    order = Window.partitionBy(*KEY).orderBy("pos", "kind", "order")
    upward = order.rowsBetween(Window.unboundedPreceding, 0)
    own = events.withColumns({
        "now": F.last("run", ignorenulls=True).over(upward), "until": F.lead("pos").over(order), "number": F.row_number().over(order),
        "open": F.coalesce(F.sum(F.when(F.col("kind") == 2, 1).when(F.col("kind") == 0, -1)).over(upward), F.lit(0)),
    })
    own = own.withColumn("until", F.coalesce("until", F.col("now.begin") + F.length("now.text")))
    shown = piece(F.col("now.text"), F.col("pos") - F.col("now.begin"), F.col("until") - F.col("now.begin"))
    text = F.when(F.col("kind") == 2, F.col("label")).when(F.col("open") > 0, F.lit("")).otherwise(shown)
    own = own.withColumn("text", text).where((F.col("text") != "") | ((F.col("kind") == 1) & (F.col("now.text") == "")))
    part = F.row_number().over(Window.partitionBy(*KEY, "now.run_ord").orderBy("number"))
    return own.select(*KEY, *(F.col(f"now.{c}").alias(c) for c in other), part.alias("part"), "text", (F.col("kind") == 2).alias("marked")), judged


def redacted_cells(cells: DataFrame, found: DataFrame, style: str = "full") -> tuple[DataFrame, DataFrame]:
    """Cells with `masked` and `marked` (a mask was put in), and the matches with `applied`.

    `cells` has doc_id, block_ord, text and perhaps `formula`; formulas and null texts stay as they are.
    """
    closed = F.coalesce(F.col("formula"), F.lit(False)) if "formula" in cells.columns else F.lit(False)
    judged = with_applied(cells.where(F.col("text").isNotNull() & ~closed), found)
    out = put_in(cells, found, style, unless=F.col("text").isNull() | closed)
    return out.withColumn("marked", F.col("put") > 0).drop("complete", "put"), judged
