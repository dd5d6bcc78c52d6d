"""Connected components within groups, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import counted, cut


def components(edges: DataFrame, by: str | None = "doc_id", max_rounds: int = 100) -> DataFrame:
    """The least node that each node reaches within its group. `edges`: the group's column (if any), a, b. Returns it, node, label.

    Edges may repeat and have any direction; an empty table gives an empty result. Jobs run here, not when
    the result is read: each round takes the least label among neighbours, then the label's own label, so a
    chain of n nodes needs about log n rounds, and writes its table to the shared folder.
    """
    return counted_components(edges, by, max_rounds)[0]


def counted_components(edges: DataFrame, by: str | None = "doc_id", max_rounds: int = 100) -> tuple[DataFrame, int]:
    """The same, and the number of its rows."""
    if by is None:
        labels, rows = counted_components(edges.select(F.lit(0).alias("all"), "a", "b"), "all", max_rounds)
        return labels.drop("all"), rows
    both = cut(edges.select(by, "a", "b").union(edges.select(by, "b", "a")).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [by, "node"]).select(by, "node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(by, F.col("node").alias("mid"), F.col("label").alias("far"))
        new, seen = counted(step.join(far, [by, "mid"], "left").select(by, "node", F.coalesce("far", "mid").alias("label"), "old"), "labels", moved=F.count_if(F.expr("label <> old")))
        labels = new.select(by, "node", "label")
        if not seen["moved"]:
            return labels, seen["rows"]
    raise RuntimeError("the labels did not settle")
