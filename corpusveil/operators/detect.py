"""Detection: candidates of each block, their refinement and the choice among them.

A block's candidates are an array column, so everything here is a projection of the scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import EMAIL, JOB_TITLE, MOCK_RULES, MONEY_CELL, MONEY_HEADER, RULES, WORDS
from ..functions.text import find, let, phone_valid, piece
from ..functions.tokens import Rule, find_tokens
from ..schema import FALLBACK_TYPES, MODEL_TYPES, OPTIONAL, RULE_TYPES, SPAN_ARRAY, analysed


def span(kind: str | Column, text: Column, where: Column, source: str = "rule", confidence: float = 1.0, is_rule: bool = True) -> Column:
    """A candidate at a range of a text."""
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("entity_type"), where["start"].alias("start"), where["end"].alias("end"), piece(text, where["start"], where["end"]).alias("text"),
        F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit("unknown").alias("party_role"), F.lit(is_rule).alias("is_rule"),
    )


#: Every rule over tokens names a word in Cyrillic letters or this currency's sign, so other texts are not cut into tokens.
_BEARING = "[\\p{IsCyrillic}₽]"


def bearing(rules: list[Rule], text: Column) -> Column:
    """Whether a rule may match in a text: where each rule names words that it needs, if one of them stands in it."""
    if all(r.needs for r in rules):
        return F.rlike(F.lower(text), F.lit(WORDS.standing(c for r in rules for c in r.needs)))
    return F.rlike(text, F.lit(_BEARING))


def found_by(rules: dict[str, tuple[Rule, ...]], text: Column, types: tuple[str, ...], source: str = "rule", confidence: float = 1.0, is_rule: bool = True) -> Column:
    """Candidates of the types' rules; e-mail addresses are rules' alone."""
    use = {t: rules[t] for t in types if t in rules}
    parts = []
    if use:
        name = F.array(*map(F.lit, use))
        ranges = F.when(bearing([r for rs in use.values() for r in rs], text), find_tokens(text, use, WORDS)).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))
        parts.append(F.transform(ranges, lambda r: span(F.get(name, r["kind"]), text, r, source, confidence, is_rule)).cast(SPAN_ARRAY))
    if is_rule and "email" in types:
        parts.append(F.transform(find(text, EMAIL), lambda r: span("email", text, r, source, confidence, is_rule)).cast(SPAN_ARRAY))
    return F.concat(*parts) if parts else F.array().cast(SPAN_ARRAY)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def inside(a: Column, b: Column) -> Column:
    return (b["start"] <= a["start"]) & (a["end"] <= b["end"])


def ranked(spans: Column, key: Callable[[Column], Column]) -> Column:
    """Spans sorted by a key."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("key"), s.alias("span")))), lambda x: x["span"])


#: Spans that one step of a fold over a block's spans takes together.
STEP = 256
_GROUPS = f"array<{SPAN_ARRAY}>"


def groups(spans: Column) -> Column:
    """Spans in groups that no overlap crosses: in order of place, a group ends where the next span begins behind all before.

    Spans go in steps, so that what is put out is copied once a step and not once a span.
    """
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN_ARRAY).alias("open"), F.array().cast(_GROUPS).alias("out"))

    def one(a: Column, s: Column) -> Column:
        new = s["start"] >= a["end"]
        return F.struct(
            F.greatest(a["end"], s["end"]).alias("end"), F.when(new, F.array(s).cast(SPAN_ARRAY)).otherwise(F.concat(a["open"], F.array(s))).cast(SPAN_ARRAY).alias("open"),
            F.when(new & (F.size(a["open"]) > 0), F.concat(a["out"], F.array(a["open"]))).otherwise(a["out"]).cast(_GROUPS).alias("out"),
        )

    def many(a: Column, part: Column) -> Column:
        fresh = F.struct(a["end"].alias("end"), a["open"].alias("open"), F.array().cast(_GROUPS).alias("out"))
        return let(F.aggregate(part, fresh, one), lambda x: F.struct(x["end"].alias("end"), x["open"].alias("open"), F.concat(a["out"], x["out"]).cast(_GROUPS).alias("out")))

    parts = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STEP).cast("int")), lambda i: F.slice(s, i * STEP + 1, F.lit(STEP)))
    fold = lambda s: F.aggregate(parts(s), zero, many, lambda a: F.concat(a["out"], F.array(a["open"])))
    return let(ranked(spans, by_place), lambda s: F.when(F.size(s) == 0, F.array().cast(_GROUPS)).otherwise(fold(s)))


def keep_disjoint(spans: Column, key: Callable[[Column], Column]) -> Column:
    """Each span, in the order of a key, that overlaps none kept before it; by place. Only spans of one group are compared."""
    chosen = lambda g: F.aggregate(ranked(g, key), F.array().cast(SPAN_ARRAY), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))).cast(SPAN_ARRAY))
    many = lambda s: F.flatten(F.transform(groups(s), lambda g: F.when(F.size(g) == 1, g).otherwise(ranked(chosen(g), by_place))))
    return F.when(F.size(spans) < 2, spans).otherwise(many(spans)).cast(SPAN_ARRAY)


def by_place(s: Column) -> Column:
    return F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("c"))


def rule_matches(text: Column, types: tuple[str, ...]) -> Column:
    """All matches of the types' rules, those that overlap too."""
    return F.filter(found_by(RULES, text, types), lambda s: (s["entity_type"] != "phone") | phone_valid(s["text"]))


def rule_spans(text: Column, types: tuple[str, ...], found: Column | None = None) -> Column:
    """Disjoint matches of the types' rules: the first begins first, and of those the longest. `found` are the matches of these types or more, if they are known."""
    if not types:
        return F.array().cast(SPAN_ARRAY)
    sound = rule_matches(text, types) if found is None else F.filter(found, lambda s: s["entity_type"].isin(*types))
    first = lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["entity_type"].alias("c"))
    return F.when(F.trim(text) == "", F.array().cast(SPAN_ARRAY)).otherwise(let(sound, lambda x: keep_disjoint(x, first)).cast(SPAN_ARRAY))


def mock_spans(text: Column, types: tuple[str, ...] = MODEL_TYPES) -> Column:
    """What the deterministic stand-in for a model names, with confidence 0.5."""
    return ranked(found_by(MOCK_RULES, text, tuple(t for t in MODEL_TYPES if t in types), "llm-mock", 0.5, False), by_place)


def money_spans(text: Column, header: Column, given: Column) -> Column:
    """Amounts of a money column's cell, and ranges that the source names."""
    cell = F.rlike(F.coalesce(header, F.lit("")), F.lit(MONEY_HEADER)) & F.rlike(text, F.lit(MONEY_CELL))
    left = F.length(text) - F.length(F.regexp_replace(text, r"(?U)\A\s+", ""))
    right = F.length(F.regexp_replace(text, r"(?U)\s+\z", ""))
    own = F.when(cell, F.array(F.struct(left.alias("start"), right.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return F.transform(F.concat(F.coalesce(given, F.array().cast("array<struct<start:int,end:int>>")), own), lambda r: span("amount", text, r))


def valid(spans: Column, text: Column, types: tuple[str, ...]) -> Column:
    """Spans within the text, not blank, equal to its slice, of these types, with a confidence from 0 to 1."""
    return F.filter(
        F.coalesce(spans, F.array().cast(SPAN_ARRAY)),
        lambda s: s["entity_type"].isin(*types) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.regexp_replace(s["text"], r"(?U)\s", "") != "") & (piece(text, s["start"], s["end"]) == s["text"]) & s["confidence"].between(0, 1),
    )


def refine(candidates: Column, fallback: Column) -> Column:
    """Drop a candidate whose own-type fallbacks are its parts: but for signature marks (a person), or several in brackets (an organization)."""

    def parts(c: Column) -> Column:
        return F.filter(fallback, lambda f: (f["entity_type"] == c["entity_type"]) & inside(f, c))

    def rest(c: Column, own: Column) -> Column:
        last_first = ranked(own, lambda f: F.struct((-f["start"]).alias("a")))
        cut = lambda t, f: F.concat(piece(t, F.lit(0), f["start"] - c["start"]), F.substring(t, f["end"] - c["start"] + 1, F.length(t)))
        return F.aggregate(last_first, c["text"], cut)

    def separable(c: Column, own: Column) -> Column:
        left = rest(c, own)
        person = (c["entity_type"] == "person_name") & F.rlike(left, F.lit(r"\A[ /_\t\r\n]*\z"))
        organization = (c["entity_type"] == "organization") & (F.size(own) > 1) & F.rlike(left, F.lit(r"\A[ ()\t\r\n]*\z"))
        return (F.size(own) > 0) & (person | organization) & F.exists(own, lambda f: (f["start"] != c["start"]) | (f["end"] != c["end"]))

    return F.filter(candidates, lambda c: ~let(parts(c), lambda own: separable(c, own)))


def admit(candidates: Column, fallback: Column) -> Column:
    """Add each fallback, in order, that overlaps no candidate but own-type ones that it strictly contains; these go."""
    sub = lambda c, f: (c["entity_type"] == f["entity_type"]) & inside(c, f) & ((f["start"] < c["start"]) | (f["end"] > c["end"]))

    def step(have: Column, f: Column) -> Column:
        blocked = F.exists(have, lambda c: overlaps(c, f) & ~sub(c, f))
        added = f.withField("is_rule", F.lit(False))
        return F.when(blocked, have).otherwise(F.concat(F.filter(have, lambda c: ~sub(c, f)), F.array(added)))

    return F.aggregate(fallback, candidates.cast(SPAN_ARRAY), lambda a, f: step(a, f).cast(SPAN_ARRAY))


def in_one_cell(candidates: Column, cells: Column) -> Column:
    """Candidates that touch at most one table cell."""
    touched = lambda s: F.array_distinct(F.transform(F.filter(cells, lambda c: overlaps(c, s)), lambda c: F.struct(c["cell_table"], c["cell_row"], c["cell_column"])))
    return F.when(cells.isNull(), candidates).otherwise(F.filter(candidates, lambda s: F.size(touched(s)) <= 1))


def no_titles(candidates: Column) -> Column:
    """Candidates without persons that are a job title alone."""
    return F.filter(candidates, lambda s: (s["entity_type"] != "person_name") | ~F.rlike(F.trim(s["text"]), F.lit(JOB_TITLE)))


def resolve(candidates: Column) -> Column:
    """Disjoint candidates in order of place: rules first, then by confidence, then the longer, then the earlier."""
    key = lambda s: F.struct(
        F.when(s["is_rule"], 0).otherwise(1).alias("a"), F.when(s["is_rule"], 0.0).otherwise(-s["confidence"]).alias("b"), (s["start"] - s["end"]).alias("c"),
        s["start"].alias("d"), s["end"].alias("e"), s["entity_type"].alias("f"), s["text"].alias("g"), s["source"].alias("h"),
    )
    return keep_disjoint(candidates, key)


def with_optional(blocks: DataFrame) -> DataFrame:
    """Blocks with all optional columns."""
    return blocks.select("doc_id", F.col("block_ord").cast("int").alias("block_ord"), F.col("text").cast("string").alias("text"), *(F.col(c) if c in blocks.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()))


def detect(blocks: DataFrame, types: tuple[str, ...] | list[str], mock: bool = False) -> DataFrame:
    """Blocks with `spans` (chosen, disjoint, in order) and `fallback` (what rules propose of names and addresses).

    `types` are the requested types; those that linking needs are found too. `model_spans` of a block, or
    the stand-in's if `mock`, take part below the rules. A null text has no spans.
    """
    all_types = analysed(types)
    rules = tuple(t for t in all_types if t in RULE_TYPES)
    proposed = tuple(t for t in all_types if t in FALLBACK_TYPES)
    model_types = tuple(t for t in all_types if t in MODEL_TYPES)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = with_optional(blocks).withColumn("text", text)
    # A block's tokens are looked through once, for the rules that count and for those that propose.
    own = own.withColumn("_matches", rule_matches(F.col("text"), rules + proposed))
    found = rule_spans(F.col("text"), rules, F.col("_matches"))
    if "amount" in types:
        found = F.concat(found, money_spans(F.col("text"), F.col("column_header"), F.col("money_spans")))
    model = mock_spans(F.col("text"), model_types) if mock else F.col("model_spans")
    own = own.withColumn("fallback", valid(rule_spans(F.col("text"), proposed, F.col("_matches")), F.col("text"), all_types))
    candidates = F.concat(valid(found, F.col("text"), all_types), F.transform(valid(model, F.col("text"), model_types or ("",)), lambda s: s.withField("is_rule", F.lit(False))).cast(SPAN_ARRAY))
    own = own.withColumn("spans", candidates)
    own = own.withColumn("spans", refine(F.col("spans"), F.col("fallback")))
    own = own.withColumn("spans", admit(F.col("spans"), F.col("fallback")))
    own = own.withColumn("spans", no_titles(in_one_cell(F.col("spans"), F.col("cell_spans"))))
    return own.withColumn("spans", resolve(F.col("spans"))).drop("model_spans", "money_spans", "cell_spans", "_matches")
