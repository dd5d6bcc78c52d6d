"""Linking: repeated values, organizations, and the people who represent them.

All scopes are documents: joins and windows have the document in their key. Mentions that agree in all
that matters are one node, so a name that is repeated thousands of times costs no pairs. Joins merge: Spark's
estimate of what blocks are made into does not grow with the rows, and would send it through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import REPRESENTATION
from ..functions.text import clause_end, clause_start, find, legal_form, normalize_name, piece, squeeze
from ..schema import FALLBACK_TYPES, SPAN_ARRAY
from ..sources.tables import cut, each
from .components import components
from .detect import ranked
from .places import free_places

CLAUSE = r";\n\r"


def repeats(detected: DataFrame) -> DataFrame:
    """Adds to each block the document's confirmed names and addresses wherever they stand again.

    A value counts once, from its first place in the document, white space aside; values of under three
    characters do not. Earlier values go first, and nothing overlaps what is there.
    """
    named = each(detected, "spans", "doc_id", "block_ord").where(F.col("s.entity_type").isin(*FALLBACK_TYPES) & (F.length(F.trim("s.text")) >= 3))
    first = named.groupBy("doc_id", F.col("s.entity_type").alias("entity_type"), squeeze(F.col("s.text")).alias("value")).agg(F.min(F.struct("block_ord", F.col("s.start").alias("start"), F.col("s.confidence").alias("confidence"))).alias("at"))
    # A value can only stand where each of its runs of letters and digits is a whole run of the block, so blocks and values meet
    # by the run that the fewest blocks of the document have; legal forms and first names would bring all of them together.
    run = lambda text: F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = detected.select("doc_id", "block_ord", F.explode(F.array_distinct(run(F.col("text")))).alias("word"))
    each_run = first.select("doc_id", "entity_type", "value", "at", F.explode(F.array_distinct(run(F.col("value")))).alias("word"))
    common = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    seeds = each_run.join(common.hint("merge"), ["doc_id", "word"]).groupBy("doc_id", "entity_type", "value", "at").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    value = F.struct("at", "entity_type", "value")
    hits = words.join(seeds.hint("merge"), ["doc_id", "word"]).groupBy("doc_id", "block_ord").agg(F.transform(F.array_sort(F.collect_list(value)), lambda v: F.struct(v["value"].alias("value"), v["entity_type"].alias("entity_type"), v["at"]["confidence"].alias("confidence"))).alias("values"))
    taken = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("taken")
    more = free_places(hits.join(detected.select("doc_id", "block_ord", "text", taken).hint("merge"), ["doc_id", "block_ord"]))
    joined = detected.join(more.hint("merge"), ["doc_id", "block_ord"], "left")
    added = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int,entity_type:string,confidence:double>>")), lambda m: F.struct(
        m["entity_type"].alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), piece(F.col("text"), m["start"], m["end"]).alias("text"),
        F.lit("document_repeat").alias("source"), m["confidence"].alias("confidence"), F.lit("unknown").alias("party_role"), F.lit(False).alias("is_rule"),
    )).cast(SPAN_ARRAY)
    both = F.concat(F.col("spans").cast(SPAN_ARRAY), added)
    return joined.withColumn("spans", F.when(F.size(added) > 0, ranked(both, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))).otherwise(F.col("spans"))).drop("more")


def mentions(detected: DataFrame) -> DataFrame:
    """A row for each span: doc_id, block_ord, the span's fields, and the block's text."""
    return each(detected, "spans", "doc_id", "block_ord", F.col("text").alias("block_text")).select("doc_id", "block_ord", "block_text", "s.*")


def nearest_identifiers(found: DataFrame) -> DataFrame:
    """Identifiers with the organization of their clause whose middle is nearest; of equals the first.

    Returns doc_id, block_ord, start (the organization's), entity_type and value (without white space).
    """
    text = F.col("block_text")
    orgs = found.where("entity_type = 'organization'").select("doc_id", "block_ord", "start", "end", clause_start(text, F.col("start"), CLAUSE).alias("left"), clause_end(text, F.col("end"), CLAUSE).alias("right"))
    ids = found.where("entity_type in ('inn', 'ogrn', 'kpp')").select("doc_id", "block_ord", "entity_type", F.regexp_replace("text", r"(?U)\s", "").alias("value"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = Window.partitionBy("doc_id", "block_ord", "entity_type", "s", "e").orderBy(F.abs(F.col("start") + F.col("end") - F.col("s") - F.col("e")), "start")
    pairs = ids.join(orgs.hint("merge"), ["doc_id", "block_ord"]).where("left <= s and e <= right")
    return pairs.withColumn("place", F.row_number().over(near)).where("place = 1").select("doc_id", "block_ord", "start", "entity_type", "value")


def organizations(found: DataFrame) -> DataFrame:
    """The entity of each organization mention: doc_id, block_ord, start, entity_id, role, conflict, canonical_name, aliases, evidence.

    `aliases` are the entity's texts in order of their first place. `evidence` says what joins its mentions:
    shared_identifier (one number at two of them or more) and normalized_name (one name at two or more).

    Mentions are one organization if they share a taxpayer or registration number, or unless such numbers
    contradict if name and legal form are equal or one is the other's alias in brackets. The id is a hash of the sorted normalised names.
    """
    strong = nearest_identifiers(found).where("entity_type in ('inn', 'ogrn')")
    sets = strong.groupBy("doc_id", "block_ord", "start").agg(*(F.array_sort(F.collect_set(F.when(F.col("entity_type") == k, F.col("value")))).alias(k) for k in ("inn", "ogrn")))
    orgs = found.where("entity_type = 'organization'").join(sets.hint("merge"), ["doc_id", "block_ord", "start"], "left")
    orgs = orgs.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in ("inn", "ogrn")} | {"name": normalize_name(F.col("text")), "form": legal_form(F.col("text"))})
    node = F.min(F.struct("block_ord", "start")).over(Window.partitionBy("doc_id", "name", "form", "inn", "ogrn"))
    same_row = F.col("name") == ""
    # Seven steps read the mentions with their nodes, so these are written once.
    one = cut(orgs.withColumn("node", F.when(same_row, F.struct("block_ord", "start")).otherwise(node)), "nodes")
    key = one.select("doc_id", "node", "name", "form", "inn", "ogrn").distinct()
    apart = lambda k: (F.size(k) > 0) & (F.size(f"o_{k}") > 0) & ~F.arrays_overlap(k, f"o_{k}")
    fit = ~(apart("inn") | apart("ogrn"))
    # Of one name, a mention without numbers fits all others, and one with only taxpayer numbers each with only registration
    # numbers. Any other two that fit share a number, so the stars of numbers below join them: no pairs are made here.
    kinds = F.when((F.size("inn") == 0) & (F.size("ogrn") == 0), 0).when(F.size("ogrn") == 0, 1).when(F.size("inn") == 0, 2).otherwise(3)
    named_keys = key.where("name <> ''").select("doc_id", "name", "form", "node", kinds.alias("kind"))
    of_kind = {k: F.min(F.when(F.col("kind") == k, F.col("node"))).alias(f"k{k}") for k in (0, 1, 2)}
    heads = named_keys.groupBy("doc_id", "name", "form").agg(*of_kind.values()).where("k0 is not null or (k1 is not null and k2 is not null)")
    starred = named_keys.join(heads.hint("merge"), ["doc_id", "name", "form"]).where("k0 is not null or kind in (1, 2)")
    by_name = starred.select("doc_id", F.coalesce("k0", F.least("k1", "k2")).alias("a"), F.col("node").alias("b")).where("a <> b")
    ids = key.select("doc_id", "node", F.explode(F.concat(F.transform("inn", lambda v: F.concat(F.lit("i"), v)), F.transform("ogrn", lambda v: F.concat(F.lit("o"), v)))).alias("id"))
    by_id = ids.join(ids.groupBy("doc_id", "id").agg(F.min("node").alias("least")).hint("merge"), ["doc_id", "id"]).select("doc_id", F.col("least").alias("a"), F.col("node").alias("b"))
    following = Window.partitionBy("doc_id", "block_ord").orderBy("start")
    named = {c: F.lead(F.col(c)).over(following).alias(f"o_{c}") for c in ("node", "inn", "ogrn", "start", "end")}
    neighbours = one.select("doc_id", "block_text", "node", "inn", "ogrn", "end", *named.values()).where("o_start is not null")
    bracket = F.rlike(piece(F.col("block_text"), F.col("end"), F.col("o_start")), F.lit(r"(?U)\A\s*\(\s*\z")) & F.rlike(F.substring(F.col("block_text"), F.col("o_end") + 1, F.length("block_text")), F.lit(r"(?U)\A\s*\)"))
    by_alias = neighbours.where(bracket & fit).select("doc_id", F.col("node").alias("a"), F.col("o_node").alias("b"))
    labels = components(by_name.union(by_id).union(by_alias))
    grouped = one.join(labels.hint("merge"), ["doc_id", "node"], "left").withColumn("label", F.coalesce("label", "node"))
    known = F.collect_set(F.when(F.col("party_role") != "unknown", F.col("party_role")))
    entities = grouped.groupBy("doc_id", "label").agg(
        F.concat(F.lit("org:"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "|"), 256), 1, 16)).alias("entity_id"),
        F.max(F.struct(F.length("name"), F.length("text"), (-F.col("block_ord")).alias("b"), (-F.col("start")).alias("s"), F.col("text").alias("canonical"))).alias("best"), known.alias("roles"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "start", "text"))), lambda m: m["text"])).alias("aliases"),
        *(F.flatten(F.collect_list(k)).alias(f"{k}s") for k in ("inn", "ogrn")), F.collect_list(F.when(F.col("name") != "", F.col("name"))).alias("names"),
    )
    twice = lambda c: F.size(c) > F.size(F.array_distinct(c))
    evidence = F.array_compact(F.array(F.when(twice(F.col("inns")) | twice(F.col("ogrns")), "shared_identifier"), F.when(twice(F.col("names")), "normalized_name")))
    role = F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).otherwise("unknown")
    return grouped.join(entities.hint("merge"), ["doc_id", "label"]).select("doc_id", "block_ord", "start", "entity_id", role.alias("role"), (F.size("roles") > 1).alias("conflict"), F.col("best.canonical").alias("canonical_name"), "aliases", evidence.alias("evidence"))


def relations(people: DataFrame) -> DataFrame:
    """Which person represents which organization in a document, once each: doc_id, kind, subject_id, object_id."""
    return people.where("organization_id is not null").select("doc_id", F.lit("person_represents_organization").alias("kind"), F.col("entity_id").alias("subject_id"), F.col("organization_id").alias("object_id")).distinct()


def representatives(found: DataFrame, orgs: DataFrame) -> DataFrame:
    """The person id of each person mention, and the organization that the person's clause says it acts for.

    That is the last organization that ends before the last representation phrase ahead of the person and
    begins after the phrase before. Returns doc_id, block_ord, start, entity_id, organization_id.
    """
    people = found.where("entity_type = 'person_name'").select("doc_id", "block_ord", "start", F.concat(F.lit("person:"), F.substring(F.sha2(normalize_name(F.col("text")), 256), 1, 16)).alias("entity_id"), F.filter(find(F.col("block_text"), REPRESENTATION), lambda m: m["end"] <= F.col("start")).alias("phrases"))
    people = people.withColumns({"last_start": F.try_element_at("phrases", F.lit(-1))["start"], "since": F.coalesce(F.try_element_at("phrases", F.lit(-2))["end"], F.lit(0))}).drop("phrases")
    own = found.where("entity_type = 'organization'").select("doc_id", "block_ord", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    own = own.join(orgs.select("doc_id", "block_ord", F.col("start").alias("o_start"), F.col("entity_id").alias("organization_id")).hint("merge"), ["doc_id", "block_ord", "o_start"])
    acting = people.join(own.hint("merge"), ["doc_id", "block_ord"]).where("since <= o_start and o_end <= last_start").groupBy("doc_id", "block_ord", "start").agg(F.max_by("organization_id", "o_end").alias("organization_id"))
    return people.join(acting.hint("merge"), ["doc_id", "block_ord", "start"], "left").select("doc_id", "block_ord", "start", "entity_id", "organization_id")
