"""Mixing sources to target weights by pivotal dependent rounding, as DataFrame functions alone.

A source's target over its size is the number of copies that each of its documents should have. The whole
part is certain; of the rest a document has a mass, its part of its words. Two documents with a mass are
paired: one gives words to the other until one of the two has all of its words or none, and which way they
go is drawn so that each keeps its mass on average. The one left meets the next. A pair's words never
change in sum, so all but the last document of a source are settled at no loss, and its taken words differ
from the target by less than that document's size.

Pairs are made in groups of about GROUP documents, dealt by a hash, whatever a source's share of the rows.
What a group leaves over goes up a tree of such groups, level by level, until a source has one document left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut, scratch, small_or_plain

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one group on average, and groups of a level that meet in one of the next.
GROUP = 64


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """k, s and size (words of the whole text; none if it is null) of each row."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), words.alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place, from 0, by code point, null last. Ranges of sources are numbered apart, so there may be many."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sources.repartitionByRange(parts, F.asc_nulls_last("s")).withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each range.
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("s"))) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before.drop("n")), "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "own", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Sources (s, source_size) with weight and target.

    Weights go round in the order of the sources. They share the sum of all sizes; no target is over `most`
    times its source's size, and what is above is shared again by weight among the others until none is.
    A null source is one of its own, the last. A source without words has the target 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    own = cut(ranked(sources).withColumn("weight", weight).drop("place"), "sources", keep=True)
    top = F.col("source_size") * most
    left = own.agg(F.sum("source_size").alias("r"), F.sum("weight").alias("w"), F.lit(0).alias("n")).first()
    whole, all_weights, shared, over = left["r"] or 0, left["w"] or 0, (left["r"] or 0, left["w"] or 1), 0
    while True:
        # Exact integers: a share is above its limit if words * weight > limit * weights.
        above = F.lit(shared[0]).cast("decimal(19,0)") * F.col("weight").cast("decimal(10,0)") > top.cast("decimal(19,0)") * F.lit(shared[1]).cast("decimal(16,0)")
        full = own.where(above).agg(F.sum(top).alias("r"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
        if full["n"] == over:
            share = (F.lit(shared[0]).cast("long") * F.col("weight")).cast("double") / F.lit(float(shared[1]))
            return own.withColumn("target", F.when(above, top.cast("double")).otherwise(share))
        over, shared = full["n"], (whole - full["r"], all_weights - full["w"])


def _draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to below 1 that depends on these values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0**-53)


_ITEM = "struct<negative:long,h:long,k:long,size:long,n:long,base:long,whole:long,source_size:long,target:double,mass:double>"


def _settled(items: Column, seed: int) -> Column:
    """The documents of a group after their pairs, in order of size: `up` says if one is taken once more, null for the one left over."""

    def step(state: Column, d: Column) -> Column:
        c = state["cur"]
        gain, give = F.least(c["size"] - c["mass"], d["mass"]), F.least(c["mass"], d["size"] - d["mass"])
        up = _draw(seed, c["k"], c["size"], d["k"], d["size"]) * (gain + give) < give

        def paired(gains: Column) -> Column:
            first = F.when(gains, c["size"] - c["mass"] <= d["mass"]).otherwise(c["mass"] <= d["size"] - d["mass"])
            return let(first, lambda f: let(F.struct(F.when(f, c).otherwise(d).alias("done"), F.when(f, d).otherwise(c).alias("rest"), (f == gains).alias("up")), moved))

        def moved(x: Column) -> Column:
            mass = c["mass"] + d["mass"] - F.when(x["up"], x["done"]["size"]).otherwise(0)
            cur = x["rest"].withField("mass", F.greatest(F.lit(0.0), F.least(mass, x["rest"]["size"].cast("double"))))
            return F.struct(cur.cast(_ITEM).alias("cur"), F.concat(state["out"], F.array(F.struct(x["done"].cast(_ITEM).alias("item"), x["up"].alias("up")))).cast(f"array<struct<item:{_ITEM},up:boolean>>").alias("out"))

        return let(up, paired)

    zero = F.struct(F.get(items, F.lit(0)).cast(_ITEM).alias("cur"), F.array().cast(f"array<struct<item:{_ITEM},up:boolean>>").alias("out"))
    left = lambda state: F.concat(state["out"], F.array(F.struct(state["cur"].alias("item"), F.lit(None).cast("boolean").alias("up"))))
    return F.aggregate(F.slice(items, 2, F.size(items)), zero, step, left)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 13, group: int = GROUP) -> DataFrame:
    """k, s, size, source_size, target, copies and taken (words) of each row.

    The result depends on the rows alone, not on their order or partitions. Rows that agree in key, source
    and size are drawn for together and are alike. Null keys count as a value; texts without words and null
    ones have no mass and the whole part's copies. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        sized = cut(sizes(docs, key, text, source).groupBy("k", "s", "size").agg(F.count("*").alias("n")), "sizes", keep=True)
        sources = targets(sized.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
        known = small_or_plain(sources.select(F.col("s").alias("own"), "source_size", "target"))
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        share = F.col("rate") - F.col("base")
        own = sized.join(known, F.col("s").eqNullSafe(F.col("own"))).drop("own").withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("whole", F.floor(share * F.col("n")))
        own = own.withColumn("mass", (share * F.col("n") - F.col("whole")) * F.col("size")).drop("rate")
        own = cut(own, "masses", keep=True)
        buckets = max(1, -(-own.where("mass > 0").count() // group))
        item = F.struct((-F.col("size")).alias("negative"), F.xxhash64(F.lit(seed), "k", "size").alias("h"), "k", "size", "n", "base", "whole", "source_size", "target", "mass").cast(_ITEM)
        rest = own.where("mass > 0").select("s", F.pmod(F.xxhash64(F.lit(seed + 1), "k", "size"), F.lit(buckets)).alias("bucket"), item.alias("item"))
        settled = []
        while True:
            level = rest.groupBy("s", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items")).select("s", "bucket", F.explode(_settled(F.col("items"), seed + len(settled))).alias("x"))
            level = cut(level.select("s", "bucket", "x.item", "x.up"), "level", keep=True)
            settled.append(level.where("up is not null"))
            rest = level.where("up is null").withColumn("bucket", F.floor(F.col("bucket") / group)).drop("up")
            if buckets == 1:
                break
            buckets = -(-buckets // group)
        last = _draw(seed - 1, F.col("item.k"), F.col("item.size")) * F.col("item.size") < F.col("item.mass")
        settled.append(level.where("up is null").withColumn("up", last))
    columns = ["k", "s", "size", "n", "base", "whole", "source_size", "target", "up"]
    out = own.where("mass <= 0").withColumn("up", F.lit(False)).select(*columns)
    for level in settled:
        out = out.unionByName(level.select("s", "item.*", "up").select(*columns))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number")
    extra = F.when((F.col("number") <= F.col("whole")) | ((F.col("number") == F.col("whole") + 1) & F.col("up")), 1).otherwise(0)
    out = out.select("*", number).withColumn("copies", F.col("base") + extra)
    return out.select("k", "s", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, taken: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: each row of `docs`, with all its columns, as often as `copies` says. Rows alike in key, source and size are numbered by a hash of their texts."""
    alike = ["k", "s", "size"]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), words.alias("size"), whole.alias("row"))
    own = own.withColumn("number", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64(f"row.`{text}`"))))
    plan = taken.select(*alike, "copies").withColumn("number", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("copies"))))
    plan = plan.where("copies > 0").select(*(F.col(c).alias(f"_{c}") for c in (*alike, "number")), "copies")
    same = F.lit(True)
    for c in (*alike, "number"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(plan, same).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), "row").select("row.*")
