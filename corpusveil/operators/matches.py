"""Matches: stable markers, party roles, review questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import BUYER, DATED, INVOICE, INVOICE_SIGN, INVOICE_SUPPLIER, SUPPLIER
from ..functions.text import clause_end, clause_start, find, piece, squeeze
from ..schema import FALLBACK_TYPES, PREFIXES, lookup
from .registry import mentions, organizations, representatives

LIMITS = r".;\n\r"


def numbered(found: DataFrame, types: tuple[str, ...] | list[str]) -> DataFrame:
    """Markers by document and type, numbered by the first place of an entity, or else of a value without regard to white space.

    Only requested types are kept and take numbers.
    """
    own = found.where(F.col("entity_type").isin(*types)).withColumn("key", F.coalesce("entity_id", squeeze(F.col("text"))))
    place = F.struct("block_ord", "start")
    firsts = own.withColumn("first", F.min(place).over(Window.partitionBy("doc_id", "entity_type", "key")))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("first", "key"))
    return firsts.withColumn("replacement", F.concat(F.lit("["), lookup(PREFIXES, F.col("entity_type")), F.lit("_"), number.cast("string"), F.lit("]"))).drop("key", "first")


def matches(detected: DataFrame, types: tuple[str, ...] | list[str]) -> DataFrame:
    """A row for each requested span, with its entity, marker, role so far, conflict and reason for review."""
    found = mentions(detected)
    place = ["doc_id", "block_ord", "start"]
    if {"organization", "person_name"} & set(types):
        orgs = organizations(found)
        people = representatives(found, orgs)
        ids = orgs.select(*place, F.lit("organization").alias("entity_type"), "entity_id", "role", "conflict", F.lit(None).cast("string").alias("organization_id")).unionByName(people.select(*place, F.lit("person_name").alias("entity_type"), "entity_id", F.lit(None).cast("string").alias("role"), F.lit(False).alias("conflict"), "organization_id"))
        found = found.join(ids.hint("merge"), [*place, "entity_type"], "left").withColumn("party_role", F.coalesce("role", "party_role")).withColumn("conflict", F.coalesce("conflict", F.lit(False))).drop("role")
    else:
        found = found.withColumns({"entity_id": F.lit(None).cast("string"), "organization_id": F.lit(None).cast("string"), "conflict": F.lit(False)})
    if set(FALLBACK_TYPES) & set(types):
        sure = detected.select("doc_id", "block_ord", F.explode("fallback").alias("f")).select("doc_id", "block_ord", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.entity_type").alias("entity_type"), F.lit(True).alias("sure"))
        found = found.join(sure.hint("merge"), ["doc_id", "block_ord", "start", "end", "entity_type"], "left")
    else:
        found = found.withColumn("sure", F.lit(None).cast("boolean"))
    dated = (F.col("entity_type") == "address") & F.rlike("text", F.lit(DATED))
    reason = F.when(dated, "date_in_address").when((F.col("confidence") < 0.6) & F.col("sure").isNull(), "unconfirmed")
    return numbered(found, types).withColumn("review_reason", reason).drop("sure", "is_rule")


def local_role(text: Column, start: Column, end: Column) -> Column:
    """Role of the nearest role word in the clause, or without one there, in the text; and whether there is any word."""

    def words(role: str) -> Column:
        return F.transform(find(text, SUPPLIER if role == "supplier" else BUYER), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(role).alias("role")))

    def nearest(found: Column) -> Column:
        left, right = clause_start(text, start, LIMITS), clause_end(text, end, LIMITS)
        near = F.filter(found, lambda m: (m["start"] >= left) & (m["end"] <= right))
        chosen = F.when(F.size(near) > 0, near).otherwise(found)
        far = F.transform(chosen, lambda m: F.struct(F.greatest(start - m["end"], m["start"] - end, F.lit(0)).alias("d"), m["role"].alias("role")))
        roles = F.array_distinct(F.transform(F.filter(far, lambda m: m["d"] == F.array_min(F.transform(far, lambda x: x["d"]))), lambda m: m["role"]))
        return F.struct(F.when(F.size(roles) == 1, F.get(roles, F.lit(0))).otherwise("unknown").alias("role"), (F.size(found) > 0).alias("any"))

    return F.get(F.transform(F.array(F.concat(words("supplier"), words("buyer"))), nearest), F.lit(0))


def mock_role(context: Column, name: Column) -> Column:
    """The stand-in's role of a name in a text: of its clause if that has words of one role, else of the nearest word; null if undecided."""
    low, candidate = F.lower(context), F.lower(F.trim(name))
    at = F.instr(low, candidate) - 1
    stop = at + F.length(candidate)

    def has(text: Column, pattern: str) -> Column:
        return F.rlike(text, F.lit(pattern))

    supplier, buyer = "поставщик|исполнитель|подрядчик|продавец", "покупатель|заказчик|клиент"

    def by_words(text: Column) -> Column:
        s, b = has(text, supplier), has(text, buyer)
        return F.when(s & ~b, "supplier").when(b & ~s, "buyer")

    clause = piece(low, clause_start(low, at, LIMITS), clause_end(low, stop, LIMITS))
    distance = lambda p: F.array_min(F.transform(find(low, p), lambda m: F.greatest(at - m["end"], m["start"] - stop, F.lit(0))))
    s, b = distance(SUPPLIER), distance(BUYER)
    near = F.when(b.isNull() & s.isNotNull(), "supplier").when(s.isNull() & b.isNotNull(), "buyer").when(s < b, "supplier").when(b < s, "buyer")
    return F.when((low == "") | (candidate == ""), None).when(at < 0, by_words(low)).otherwise(F.coalesce(by_words(clause), near))


def with_roles(found: DataFrame, detected: DataFrame) -> DataFrame:
    """Matches with the parties' roles.

    In this order: the column's header, the nearest role word in the clause or block, the signature part of
    an invoice with a supplier, a role that was given, the neighbouring blocks (not for table cells), the
    one role that the entity has elsewhere, the stand-in classifier. One role of an entity then goes to all
    its mentions; several leave all of them unknown and in conflict.
    """
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    whole = Window.partitionBy("doc_id")
    invoice = F.max(F.rlike("text", F.lit(INVOICE))).over(whole) & F.max(F.rlike("text", F.lit(INVOICE_SUPPLIER))).over(whole) & F.rlike("text", F.lit(INVOICE_SIGN))
    before = F.lag("text").over(order)
    context = detected.select(
        "doc_id", "block_ord", F.col("text").alias("_text"), "column_header", "table_index", invoice.alias("_invoice"),
        F.concat_ws("\n", before, "text", F.lead("text").over(order)).alias("_around"), F.coalesce(F.length(before) + 1, F.lit(0)).alias("_shift"),
    )
    party = F.col("entity_type").isin("organization", "person_name")
    own = found.join(context.hint("merge"), ["doc_id", "block_ord"])
    header = F.coalesce("column_header", F.lit(""))
    own = own.withColumns({"_local": local_role(F.col("_text"), F.col("start"), F.col("end")), "_header": local_role(header, F.lit(0), F.length(header)), "_near": local_role(F.col("_around"), F.col("start") + F.col("_shift"), F.col("end") + F.col("_shift"))})
    named = F.when(F.col("_header.role") != "unknown", F.col("_header.role")).when(F.col("_local.role") != "unknown", F.col("_local.role")).when(F.col("_invoice"), "supplier").when(F.col("party_role") != "unknown", F.col("party_role"))
    first = F.coalesce(named, F.when(F.col("table_index").isNull() & (F.col("_near.role") != "unknown"), F.col("_near.role")), F.lit("unknown"))
    pending = party & (F.col("_first") == "unknown") & F.col("table_index").isNull()
    own = own.withColumn("_first", F.when(party, first).otherwise(F.col("party_role"))).withColumn("_key", F.coalesce("entity_id", "text"))
    entity = Window.partitionBy("doc_id", "entity_type", "_key")
    roles = lambda c: F.collect_set(F.when(F.col(c) != "unknown", F.col(c))).over(entity)
    own = own.withColumn("_known", roles("_first"))
    guess = F.when(~F.col("_near.any") & (F.size("_known") == 1), F.get("_known", F.lit(0))).otherwise(mock_role(F.col("_around"), F.col("text")))
    own = own.withColumn("_second", F.when(pending, F.coalesce(guess, F.lit("unknown"))).otherwise(F.col("_first")))
    own = own.withColumn("_all", F.when(party, roles("_second")).otherwise(F.array().cast("array<string>")))
    role = F.when(F.size("_all") > 1, "unknown").when((F.col("_second") == "unknown") & (F.size("_all") == 1), F.get("_all", F.lit(0))).otherwise(F.col("_second"))
    return own.withColumns({"party_role": role, "conflict": F.col("conflict") | (F.size("_all") > 1)}).select(*found.columns)


def question_id(prefix: str = "party:") -> Column:
    return F.concat(F.lit(prefix), "entity_type", F.lit(":"), F.coalesce("entity_id", "replacement"))


def questions(found: DataFrame, detected: DataFrame, answers: DataFrame | None = None, contexts: int = 3) -> DataFrame:
    """One question for each entity under review that is not answered: doc_id, question_id, reason, options, its first places."""
    own = found.where("review_reason is not null").withColumn("question_id", question_id("mask:party:"))
    if answers is not None:
        own = own.join(answers.where("answer in ('mask', 'keep')").select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti")
    own = own.join(detected.select("doc_id", "block_ord", F.col("text").alias("context")).hint("merge"), ["doc_id", "block_ord"])
    places = F.collect_list(F.struct("block_ord", "start", "end", "context", "review_reason"))
    grouped = own.groupBy("doc_id", "question_id", "entity_type").agg(F.slice(F.array_sort(places), 1, contexts).alias("contexts"), F.count("*").alias("n_matches"))
    return grouped.withColumns({"reason": F.col("contexts")[0]["review_reason"], "options": F.array(F.lit("mask"), F.lit("keep"))})


def apply_answers(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Matches after answers (doc_id, question_id, answer): `keep` drops those of the question, a role answers a party question."""
    kept = answers.where("answer = 'keep' and question_id like 'mask:%'").select("doc_id", "question_id").distinct()
    roles = answers.where("answer in ('supplier', 'buyer', 'unknown')").groupBy("doc_id", "question_id").agg(F.max("answer").alias("answer"))
    out = found.withColumn("question_id", question_id("mask:party:")).join(kept, ["doc_id", "question_id"], "left_anti").withColumn("question_id", question_id())
    return out.join(roles, ["doc_id", "question_id"], "left").withColumn("party_role", F.coalesce("answer", "party_role")).select(*found.columns)
