"""Registered queries of the de-identification engine, with DuckDB SQL for their results.

Addresses and e-mail run on the documents as they are. Other types need texts that hold them: `contract_blocks`
writes a ten-line contract for each supplier, in Spark and in SQL alike, and the SQL then gives expected
spans from the key columns, not from a second pattern engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators.detect import detect, in_one_cell, mock_spans, money_spans, no_titles, rule_spans
from ..operators.detectors import Detectors
from ..operators.masking import format_location, masked, preview, publishable, quality, report, with_applied
from ..operators.matches import apply_answers, matches, questions, with_roles
from ..operators.model import answers_on_pieces, relocated
from ..operators.pieces import chunks, found_in_pieces
from ..operators.redaction import redacted_cells, redacted_runs
from ..operators.registry import mentions, nearest_identifiers, organizations, repeats, representatives
from ..schema import DISPLAY_NAMES, ENTITY_TYPES, SPAN_ARRAY
from ..sources.ocr import ocr_lines
from ..sources.pages import page_blocks, page_characters, span_rectangles, with_table_cells
from ..sources.tables import cut, each, line_blocks, spread, whole_text_blocks, with_sections, with_table_headers
from .pipeline import job_progress, job_queue, mask, propose

# The ten lines of a supplier's contract: k is the key, n the nation, s the name. The same text is SQL for both engines.
LINES = (
    "concat('Договор поставки № ', k, '-А/2026')",
    "concat('Поставщик: ООО «', s, '», ИНН ', '77', lpad(k, 8, '0'))",
    "concat('Покупатель: АО «Клиент ', n, '»; ОГРН ', '102', lpad(n, 10, '0'))",
    "concat('ИНН/КПП 78', lpad(k, 8, '0'), '/', lpad(n, 4, '0'), '01001')",
    "concat('тел.: +7 (495) 1', lpad(n, 2, '0'), '-12-34, почта: s', k, '@example.ru')",
    "concat('р/с 4070', lpad(k, 16, '0'), ', БИК 99', lpad(k, 7, '0'))",
    "concat('ООО «', s, '» в лице директора Иванова Ивана Ивановича, действующего на основании устава')",
    "concat('Адрес: 123456, г. Москва, ул. Ленина, д. ', n)",
    "concat('Итого: 1', lpad(n, 2, '0'), ' рублей 50 копеек')",
    "concat('Подпись: Петров П.П., главный бухгалтер ООО «', s, '»')",
)
_SOURCE = "select s_suppkey as doc_id, cast(s_suppkey as {t}) as k, cast(s_nationkey as {t}) as n, s_name as s from {table}"
#: The values of a line that the detectors must find: type -> (line, SQL of the value).
VALUES = {
    "contract_number": [(0, "concat(k, '-А/2026')")],
    "organization": [(1, "concat('ООО «', s, '»')"), (2, "concat('АО «Клиент ', n, '»')"), (6, "concat('ООО «', s, '»')"), (9, "concat('ООО «', s, '»')")],
    "inn": [(1, "concat('77', lpad(k, 8, '0'))"), (3, "concat('78', lpad(k, 8, '0'))")],
    "ogrn": [(2, "concat('102', lpad(n, 10, '0'))")],
    "kpp": [(3, "concat(lpad(n, 4, '0'), '01001')")],
    "phone": [(4, "concat('+7 (495) 1', lpad(n, 2, '0'), '-12-34')")],
    "email": [(4, "concat('s', k, '@example.ru')")],
    "bank_account": [(5, "concat('4070', lpad(k, 16, '0'))")],
    "bik": [(5, "concat('99', lpad(k, 7, '0'))")],
    "person_name": [(6, "'Иванова Ивана Ивановича'"), (9, "'Петров П.П.'")],
    "address": [(7, "concat('123456, г. Москва, ул. Ленина, д. ', n)")],
    "amount": [(8, "concat('1', lpad(n, 2, '0'), ' рублей 50 копеек')")],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of which each row is made into texts or characters."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_ord, text: a contract for each supplier."""
    own = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as doc_id", "cast(s_suppkey as string) as k", "cast(s_nationkey as string) as n", "s_name as s")
    return own.select("doc_id", F.posexplode(F.array(*(F.expr(x) for x in LINES))).alias("block_ord", "text"))


def _own(*extra: str) -> str:
    """SQL of the contracts' keys and expected spans: tables own (doc_id, k, n, s), blocks and gold."""
    blocks = " union all ".join(f"select doc_id, {i} as block_ord, {x} as text, k, n, s from own" for i, x in enumerate(LINES))
    gold = " union all ".join(f"select doc_id, block_ord, '{t}' as entity_type, strpos(text, {v}) - 1 as start, strpos(text, {v}) - 1 + length({v}) as \"end\", {v} as text from blocks where block_ord = {i}" for t, vs in VALUES.items() for i, v in vs)
    return f"with own as ({_SOURCE.format(t='varchar', table='supplier')}), blocks as ({blocks}), gold as ({gold})" + "".join(f", {x}" for x in extra)


def _spans(df: DataFrame) -> DataFrame:
    return mentions(df).select("doc_id", "block_ord", "entity_type", "start", "end", "text")


def _detector(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = contract_blocks(spark, sf_dir).withColumn("spans", rule_spans(F.col("text"), (kind,)))
        return each(found, "spans", "doc_id", "block_ord").select("doc_id", "block_ord", "s.entity_type", "s.start", "s.end", "s.text")

    return run


_PREFIX = "case entity_type when 'person_name' then 'ФИО' when 'organization' then 'ОРГАНИЗАЦИЯ' when 'address' then 'АДРЕС' when 'amount' then 'СУММА' when 'inn' then 'ИНН' when 'kpp' then 'КПП' when 'ogrn' then 'ОГРН' when 'phone' then 'ТЕЛЕФОН' when 'email' then 'ЭЛЕКТРОННАЯ_ПОЧТА' when 'bank_account' then 'РАСЧЁТНЫЙ_СЧЁТ' when 'bik' then 'БИК' else 'НОМЕР_ДОГОВОРА' end"
_SHORT = "case entity_type when 'organization' then 'ОРГ' when 'phone' then 'ТЕЛ' when 'email' then 'ПОЧТА' when 'bank_account' then 'СЧЁТ' when 'contract_number' then 'ДОГ' else pre end"
_MARKED = f"""marked as (select *, {_PREFIX} as pre, dense_rank() over (partition by doc_id, entity_type order by first) as number from (
    select *, min(block_ord * 1000 + start) over (partition by doc_id, entity_type, text) as first from gold) z)"""
_NAMES = "case entity_type " + " ".join(f"when '{k}' then '{v}'" for k, v in DISPLAY_NAMES.items()) + " end"


def _masked_sql(label: str, which: str = "true") -> str:
    """SQL of the contracts' masked lines: values are replaced from the right, each once."""
    one = "marks as (select doc_id, block_ord, list({'start': start, 'stop': \"end\", 'label': %s} order by start) as m from marked where %s group by doc_id, block_ord)" % (label, which)
    parts = "array_to_string(list_transform(range(1, len(m) + 1), lambda i: concat(substring(text, (case when i = 1 then 0 else m[i - 1].stop end) + 1, m[i].start - (case when i = 1 then 0 else m[i - 1].stop end)), m[i].label)), '') || substring(text, m[len(m)].stop + 1)"
    return _own(_MARKED, one) + f" select b.doc_id, b.block_ord, case when m is null then text else {parts} end as masked, true as complete from blocks b left join marks using (doc_id, block_ord)"


def _mask_style(style: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = cut(detect(contract_blocks(spark, sf_dir), ENTITY_TYPES), "detected")
        return masked(found, matches(found, ENTITY_TYPES), style).select("doc_id", "block_ord", "masked", "complete")

    return run


def _stable_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(detect(contract_blocks(spark, sf_dir), ENTITY_TYPES), "detected")
    return matches(found, ENTITY_TYPES).select("doc_id", "block_ord", "entity_type", "start", "replacement")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(detect(contract_blocks(spark, sf_dir), ENTITY_TYPES))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(contract_blocks(spark, sf_dir), ENTITY_TYPES, mock=True)
    return mentions(found).select("doc_id", "block_ord", "entity_type", "start", "end", "text", F.when(F.col("source") == "rule", "rule").otherwise("llm-mock").alias("source"))


def _mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the e-mail addresses of all documents, found with offsets, numbered and masked."""
    found = cut(detect(whole_text_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")), ("email",)), "detected")
    return matches(found, ("email",)).select("doc_id", "start", "end", F.col("text").alias("value"), "replacement")


def _email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = each(docs, rule_spans(F.col("text"), ("email",)), "doc_id")
    return found.groupBy("doc_id", F.col("s.text").alias("email")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = line_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return blocks.select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), F.length("text").cast("long").alias("n_chars"))


def _orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions(cut(detect(contract_blocks(spark, sf_dir), ("organization",)), "detected"))
    return organizations(found).select("doc_id", "block_ord", "start", "entity_id", "canonical_name")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_identifiers(mentions(cut(detect(contract_blocks(spark, sf_dir), ("organization",)), "detected"))).select("doc_id", "block_ord", "start", "entity_type", "value")


def _represents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions(cut(detect(contract_blocks(spark, sf_dir), ("person_name",)), "detected"))
    return representatives(found, organizations(found)).select("doc_id", "block_ord", "entity_id", "organization_id")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of a two-line text for each supplier, and one whose words contradict each other."""
    own = _table(spark, sf_dir, "supplier")
    blocks = own.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(
        F.concat(F.lit("Поставщик: ООО «"), "s_name", F.lit("»; Покупатель: АО «Бета»")),
        F.concat(F.lit("Исполнитель: ООО «"), "s_name", F.lit("». Заказчик: ПАО «Гамма».")),
        F.lit("Клиент: ПАО «Гамма»"), F.lit("Подрядчик: АО «Бета»"),
    )).alias("block_ord", "text"))
    found = cut(detect(blocks, ("organization",)), "detected")
    return with_roles(matches(found, ("organization",)), found).select("doc_id", "block_ord", "start", "party_role", "conflict")


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that only its first mention's label shows, found wherever it stands again, but not in longer words."""
    own = _table(spark, sf_dir, "supplier")
    blocks = own.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(
        F.lit("Директор: подпись / Смирнов Пётр Олегович /"), F.concat(F.lit("Принял "), "s_name", F.lit(", сдал Смирнов  Пётр\nОлегович.")), F.lit("Смирнов Пётр Олеговичев не подписал"),
    )).alias("block_ord", "text"))
    out = repeats(cut(detect(blocks, ("person_name",)), "detected"))
    return mentions(out).select("doc_id", "block_ord", "start", "end", "source")


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in roubles that only the stand-in model names need an answer; every third is kept as it is."""
    own = _table(spark, sf_dir, "supplier")
    blocks = own.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("Цена "), F.col("s_suppkey").cast("string"), F.lit(" RUB")), F.concat(F.lit("Всего "), F.col("s_suppkey").cast("string"), F.lit(" RUB")))).alias("block_ord", "text"))
    found = cut(detect(blocks, ("amount",), mock=True), "detected")
    return questions(cut(matches(found, ("amount",)), "matches"), found).select("doc_id", "question_id", "reason", F.col("n_matches").cast("long").alias("n_matches"), F.size("contexts").cast("long").alias("n_contexts"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "supplier")
    blocks = own.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("block_ord"), F.concat(F.lit("Цена "), F.col("s_suppkey").cast("string"), F.lit(" RUB")).alias("text"))
    found = cut(detect(blocks, ("amount",), mock=True), "detected")
    answers = own.select(F.col("s_suppkey").alias("doc_id"), F.lit("mask:party:amount:[СУММА_1]").alias("question_id"), F.when(F.col("s_nationkey") < 10, "keep").otherwise("mask").alias("answer"))
    return masked(found, apply_answers(matches(found, ("amount",)), answers)).select("doc_id", "masked")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(detect(contract_blocks(spark, sf_dir), ("inn", "kpp", "ogrn", "bik", "phone")), "detected")
    return report(matches(found, ("inn", "kpp", "ogrn", "bik", "phone"))).select("doc_id", F.col("number").cast("long").alias("number"), "type_name", "original_value", "replacement", "role_name", "confidence")


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    n, k = F.col("l_linenumber"), F.col("l_orderkey").cast("int")
    none = F.lit(None)
    place = F.struct(
        F.when(n == 1, F.concat(F.lit("Лист"), k.cast("string"))).alias("sheet_name"), F.when(n == 1, "B2").alias("cell_coordinate"), F.when(n.isin(2, 3), k).alias("table_index"), F.when(n.isin(2, 3), n).alias("row"), F.when(n == 3, n).alias("column"),
        F.when(n == 3, n).alias("cell_paragraph_index"), F.when(n == 4, k).alias("paragraph_index"), F.when(n == 5, k).alias("page_number"), none.cast("array<double>").alias("bbox"),
    )
    return items.select("l_orderkey", "l_linenumber", format_location(place).alias("location"))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(detect(contract_blocks(spark, sf_dir), ("inn", "kpp", "bik")), "detected")
    chosen = cut(matches(found, ("inn", "kpp", "bik")), "matches")
    markers = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_set("replacement")).alias("markers"))
    shown = preview(masked(found, chosen), markers, limit=200)
    return shown.select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), "truncated", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), F.size(F.filter("segments", lambda s: s["replacement"].isNotNull())).cast("long").alias("n_markers"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contract_blocks(spark, sf_dir)
    found = cut(_spans(detect(blocks, ("person_name", "organization", "inn", "kpp", "ogrn"))), "found")
    gold = each(blocks.where("block_ord in (1, 3)"), rule_spans(F.col("text"), ("organization", "inn")), "doc_id", F.col("block_ord").cast("int").alias("block_ord")).select("doc_id", "block_ord", "s.entity_type", "s.start", "s.end")
    return quality(gold, found.select("doc_id", "block_ord", "entity_type", "start", "end"))


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    ten, thirteen = F.concat(F.lit("77"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")), F.concat(F.lit("102"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    phone = F.concat(F.when(F.col("p_partkey") % 3 == 0, "+7 ").when(F.col("p_partkey") % 3 == 1, "9 ").otherwise(""), F.lit("(495) "), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return own.select("p_partkey", tf.inn_valid(ten).alias("inn_valid"), tf.ogrn_valid(thirteen).alias("ogrn_valid"), tf.phone_valid(phone).alias("phone_valid"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("  Общество с ограниченной  ответственностью «Ёлка-"), "s_name", F.lit("» (ООО)"))
    return own.select("s_suppkey", tf.normalize_name(name).alias("name"), tf.legal_form(name).alias("form"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tf.token_estimate(F.col("text")).cast("long").alias("tokens"))


def _column_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and quantities of order lines as table cells; only the money column's are amounts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(",50 "))
    cells = items.select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit("Цена").alias("h"), price.alias("text")), F.struct(F.lit("Количество").alias("h"), price.alias("text")))).alias("c")).select("l_orderkey", "l_linenumber", "c.*")
    found = each(cells, money_spans(F.col("text"), F.col("h"), F.lit(None).cast("array<struct<start:int,end:int>>")), "l_orderkey", "l_linenumber", "h")
    return found.select("l_orderkey", "l_linenumber", F.col("h").alias("header"), F.col("s.start").alias("start"), F.col("s.text").alias("text"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span over two cells goes, one in a cell stays; a job title alone is no person."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    at = lambda kind, a, b, text: F.struct(F.lit(kind).alias("entity_type"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(text).alias("text"), F.lit("rule").alias("source"), F.lit(1.0).alias("confidence"), F.lit("unknown").alias("party_role"), F.lit(True).alias("is_rule"))
    cells = F.array(*(F.struct(F.lit(20 * i).alias("start"), F.lit(20 * i + 20).alias("end"), F.lit(0).alias("cell_table"), F.lit(0).alias("cell_row"), F.lit(i).alias("cell_column")) for i in range(3)))
    spans = F.array(at("phone", F.col("p_size"), F.col("p_size") + 5, "x"), at("person_name", F.lit(1), F.lit(9), "Генеральный директор")).cast(SPAN_ARRAY)
    return own.select("p_partkey", F.size(no_titles(in_one_cell(spans, cells))).cast("long").alias("n_left"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_ord"), F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(". ПРЕДМЕТ ДОГОВОРА "))).otherwise("текст").alias("text"))
    orders = orders.dropDuplicates(["doc_id", "block_ord"])
    return with_sections(orders).select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), "section")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("table_index"), (F.col("n_nationkey") % 2).alias("column"), F.col("n_nationkey").alias("block_ord"), F.when(F.col("n_nationkey") < 10, 0).otherwise(1).alias("row"), F.col("n_name").alias("text"))
    return with_table_headers(cells).select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), "column_header")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return job_progress(items.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "N", "done").otherwise("pending").alias("status"))).select("job_id", F.col("progress").cast("long").alias("progress"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return job_queue(orders).select("job_id", "created_at")


def _publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contract_blocks(spark, sf_dir)
    wrong = blocks.where("block_ord = 0").select("doc_id", "block_ord", F.lit(0).alias("start"), F.lit(7).alias("end"), F.when(F.col("doc_id") % 2 == 0, "Договор").otherwise("Контракт").alias("text"), F.lit("[X_1]").alias("replacement"), F.lit("inn").alias("entity_type"))
    return publishable(masked(blocks, wrong))


def _sql(select: str, *extra: str) -> str:
    return f"{_own(*extra)} {select}"


def _relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model names each supplier in every line, with a doubled space; where it stands is found in the text."""
    blocks = contract_blocks(spark, sf_dir)
    name = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as doc_id", "concat('ООО  «', s_name, '»') as value")
    named = blocks.select("doc_id", "block_ord").join(name, "doc_id").select("doc_id", "block_ord", F.lit("organization").alias("entity_type"), "value", F.lit(0.9).alias("confidence"))
    found = relocated(blocks, named)
    return found.select("doc_id", "block_ord", F.coalesce("reason", F.lit("found")).alias("outcome"), F.size("ranges").cast("long").alias("n"), F.coalesce(F.get("ranges", F.lit(0))["start"], F.lit(-1)).cast("long").alias("start"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts' values, of which those of odd documents do not hold the text of their range, and those of every third repeat one."""
    blocks = contract_blocks(spark, sf_dir)
    found = cut(_spans(blocks.withColumn("spans", rule_spans(F.col("text"), ENTITY_TYPES))), "found")
    wrong = found.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    again = wrong.where("doc_id % 3 = 0").withColumns({"start": F.col("start") + 1, "text": F.expr("substring(text, 2)")})
    return with_applied(blocks, wrong.unionByName(again)).select("doc_id", "block_ord", "entity_type", "start", "end", "applied")


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a line of recognised words, one of each line number; those of a low confidence go."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    words = items.select(F.col("l_orderkey").alias("doc_id"), F.lit(2).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.lit(1).alias("line_num"), n.alias("word_num"), (100 * n).alias("left"), (10 + n).alias("top"), (40 + 10 * n).alias("width"), F.lit(20).alias("height"), (10.0 * n).alias("conf"), F.concat(F.lit("w"), (n * n).cast("string")).alias("text"))
    box = lambda i: F.col("bbox")[i].cast("long")
    last = F.element_at("ocr_words", -1)
    return ocr_lines(words, 2.0, 1.0).select("doc_id", F.col("page_number").cast("long").alias("page_number"), "text", box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), last["start"].cast("long").alias("last_start"), last["end"].cast("long").alias("last_end"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts' lines as runs of seven characters, each of a format of its own; masked and put together again."""
    blocks = contract_blocks(spark, sf_dir)
    found = cut(detect(blocks, ENTITY_TYPES), "detected")
    runs = blocks.select("doc_id", F.col("block_ord").cast("int").alias("block_ord"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("run_ord", "text"))
    pieces, judged = redacted_runs(runs.withColumn("format", F.concat(F.lit("f"), F.col("run_ord").cast("string"))), matches(found, ENTITY_TYPES))
    marks = F.array_sort(F.collect_list(F.when(F.col("marked"), F.struct("run_ord", F.concat_ws("=", "format", "text").alias("x")))))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "part", "text"))), lambda r: r["text"])
    out = pieces.groupBy("doc_id", "block_ord").agg(F.array_join(joined, "").alias("masked"), F.array_join(F.transform(marks, lambda m: m["x"]), ";").alias("marks"))
    return out.join(judged.groupBy("doc_id", "block_ord").agg(F.sum(F.col("applied").cast("long")).alias("n_applied")), ["doc_id", "block_ord"], "left").withColumn("n_applied", F.coalesce("n_applied", F.lit(0)))


def _masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that name an order's customer by taxpayer number; formulas are not touched, nor what isn't there any more."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderkey") % 3 == 0)
    cells = orders.toDF("doc_id", "c", "formula").select("doc_id", F.lit(0).alias("block_ord"), F.concat(F.lit("ИНН 77"), F.lpad("c", 8, "0"), F.lit(" клиент")).alias("text"), "formula")
    found = cells.select("doc_id", "block_ord", F.lit("inn").alias("entity_type"), F.lit(4).alias("start"), F.lit(14).alias("end"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.substring("text", 5, 10)).alias("text"), F.lit("[ИНН_1]").alias("replacement"))
    return redacted_cells(cells, found)[0].select("doc_id", "masked", "marked")


def _characters(lines: DataFrame, x: Column, y: Column, order: Column) -> DataFrame:
    """Characters of lines (doc_id, page_number, text), six units wide and ten high, from a place on; spaces between words have boxes too."""
    signs = F.posexplode(F.split("text", "(?!^)(?!$)")).alias("i", "c")
    own = lines.select("doc_id", "page_number", x.alias("x"), y.alias("y"), order.alias("o"), signs)
    at = lambda n: (F.col("x") + 6 * (F.col("i") + n)).cast("double")
    return own.select("doc_id", "page_number", (F.col("o") * 1000 + F.col("i")).alias("char_ord"), "c", at(0).alias("x0"), F.col("y").cast("double").alias("y0"), at(1).alias("x1"), (F.col("y") + 10).cast("double").alias("y1"))


def _contract_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts as pages: the first six lines in two blocks of three, the other four beside them as a column of their own."""
    n = F.col("block_ord")
    lines = contract_blocks(spark, sf_dir).withColumn("page_number", F.lit(0))
    return _characters(lines, F.when(n < 6, 10).otherwise(900), F.when(n < 6, 12 * n + F.when(n >= 3, 30).otherwise(0)).otherwise(12 * (n - 6) + 5), n)


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = page_blocks(page_characters(_contract_characters(spark, sf_dir)))
    return blocks.select("doc_id", "block_id", "text", *(F.col("bbox")[i].cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hides the values of the contracts' pages; those that a line break cuts take a rectangle in each line."""
    placed = cut(page_characters(_contract_characters(spark, sf_dir)), "characters")
    blocks = cut(page_blocks(placed), "blocks")
    found = each(blocks, rule_spans(F.regexp_replace("text", "\n", " "), ("inn", "email", "bik", "amount")), "doc_id", "block_ord")
    found = found.select("doc_id", "block_ord", "s.start", "s.end", "s.text", "s.entity_type", F.concat(F.lit("["), "s.entity_type", F.lit("]")).alias("label"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return span_rectangles(placed, blocks, found).select("doc_id", "entity_type", whole("x0"), whole("y0"), whole("x1"), whole("y1"), "label")


def _table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables of a header and a line; spans of the cells, and which of them are sums."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    row = lambda i, a, b, c: F.struct(F.lit(i).alias("row"), F.array(a, b, c).alias("texts"))
    rows = part.select("doc_id", F.explode(F.array(row(0, F.lit("Товар"), F.lit("Цена, руб."), F.lit("Число")), row(1, F.col("name"), F.concat(F.lit(" "), "size", F.lit(" 000,50 ")), F.col("size")))).alias("r"))
    texts = rows.select("doc_id", F.lit(0).alias("page_number"), "r.row", F.posexplode("r.texts").alias("column", "text"))
    n, k = F.col("column"), F.col("row")
    signs = _characters(texts, 20 + 700 * n, 20 * k, 3 * k + n)
    cells = texts.select("doc_id", "page_number", F.lit(0).alias("table"), "row", "column", (10.0 + 700 * n).alias("x0"), (20.0 * k - 2).alias("y0"), (700.0 + 700 * n).alias("x1"), (20.0 * k + 14).alias("y1"))
    placed = cut(page_characters(signs), "characters")
    found = with_table_cells(page_blocks(placed), placed, cells).where("cell_spans is not null")
    spans = each(found, "cell_spans", "doc_id", "money_spans", "text", name="c")
    inside = F.filter("money_spans", lambda m: (m["start"] >= F.col("c.start")) & (m["end"] <= F.col("c.end")))
    return spans.select("doc_id", F.col("c.cell_column").cast("long").alias("column"), F.expr("substring(text, c.start + 1, c.end - c.start)").alias("text"), F.get(F.transform(inside, lambda m: F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"])), F.lit(0)).alias("money"))


def _brought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors of others on the contracts' lines: a column's, a text's that fails on some, and a table's."""
    blocks = contract_blocks(spark, sf_dir)
    first = lambda t, kind, word: F.when(F.instr(t, word) > 0, F.array(F.struct(F.lit(kind).alias("entity_type"), (F.instr(t, word) - 1).alias("start"), (F.instr(t, word) - 1 + len(word)).alias("end"), F.lit(0.7).alias("confidence"))))

    def held(text: str) -> list[tuple[str, int, int, float]]:
        if text.startswith("Итого"):
            raise ValueError("no totals")
        return [("person_name", text.index("Петров"), text.index("Петров") + 6, 0.6)] if "Петров" in text else []

    registry = Detectors()
    registry.column("town", lambda t: first(t, "address", "Москва"))
    registry.text("people", held)
    registry.table("often", lambda b: b.join(b.groupBy("doc_id").agg(F.max("block_ord").alias("block_ord")), ["doc_id", "block_ord"]).select("doc_id", "block_ord", F.lit("organization").alias("entity_type"), F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit(0.9).alias("confidence")))
    found, failures = registry.candidates(blocks)
    spans = found.select("doc_id", "block_ord", F.explode("model_spans").alias("s")).select("doc_id", "block_ord", F.col("s.source").alias("detector"), F.col("s.text").alias("outcome"))
    return spans.unionByName(failures.select("doc_id", "block_ord", "detector", F.col("reason").alias("outcome")))


def _in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail addresses of whole documents, by a detector that sees no more than 500 characters at once."""
    found = found_in_pieces(whole_text_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")), lambda t: rule_spans(t, ("email",)), 500)
    return found.select("doc_id", "start", "end")


def _answers_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is asked about pieces of 500 characters names their addresses in fenced JSON; where they stand in the whole documents."""
    pieces = cut(chunks(whole_text_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")), 500), "pieces")
    names = F.transform(rule_spans(F.col("text"), ("email",)), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["text"].alias("value"), F.lit(0.9).alias("confidence")))
    replies = pieces.select("doc_id", "block_ord", "piece", F.concat(F.lit("```json\n"), F.to_json(F.struct(names.alias("entities"))), F.lit("\n```")).alias("reply"))
    return answers_on_pieces(pieces, replies, 125, ("email",)).select("doc_id", "start", "end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    detectors = {f"detect_{'contract' if t == 'contract_number' else t.removesuffix('_name')}": _detector(t) for t in ENTITY_TYPES}
    return detectors | {
        "mask_text": _mask_text, "email_counts": _email_counts, "blocks_lines": _lines, "resolve_rule_spans": _resolved, "resolve_mixed_spans": _mixed, "stable_markers": _stable_markers,
        "mask_full": _mask_style("full"), "mask_short": _mask_style("short"), "mask_none": _mask_style("none"), "org_entities": _orgs, "nearest_identifier": _nearest, "person_represents": _represents,
        "party_roles": _roles, "document_repeat": _repeats, "review_questions": _review, "apply_answers": _answers, "report_rows": _report, "format_location": _locations, "preview_segments": _preview,
        "quality_scores": _quality, "checksums": _checks, "normalize_name": _names, "token_estimate": _tokens, "amount_by_column": _column_amounts, "independent_cells": _cells, "sections": _sections,
        "table_headers": _headers, "stage_progress": _progress, "job_fifo": _queue, "publishable": _publishable,
        "model_relocation": _relocation, "applied_matches": _applied, "ocr_lines": _ocr, "brought_detectors": _brought, "page_blocks": _page_blocks, "span_rectangles": _rectangles, "table_cells": _table_cells, "redacted_runs": _runs, "redacted_cells": _masked_cells, "spans_in_pieces": _in_pieces, "answers_in_pieces": _answers_in_pieces,
    }


_EMAIL = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
_EMAIL_PLACES = f"""t as (select doc_id, regexp_extract_all(text, '{_EMAIL}') as v, string_split_regex(text, '{_EMAIL}') as s from documents),
        e as (select doc_id, v[i] as value, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::bigint as start from (select *, unnest(range(1, len(v) + 1)) as i from t) z)"""
_INN = "concat('77', lpad(p_partkey::varchar, 8, '0'))"
_WEIGHTS = "[2, 4, 10, 3, 5, 9, 4, 6, 8]"
_COLUMNS = "doc_id, block_ord, entity_type, start, \"end\", text"
_ENTITY = "concat('org:', substring(sha256(array_to_string(list_sort(list(lower(replace(replace(replace(replace(text, 'ООО ', ''), 'АО ', ''), '«', ''), '»', '')))), '|')), 1, 16))"
ORACLES: dict[str, str] = {f"detect_{'contract' if t == 'contract_number' else t.removesuffix('_name')}": _sql(f"select {_COLUMNS} from gold where entity_type = '{t}'") for t in ENTITY_TYPES} | {
    "mask_text": f"""with {_EMAIL_PLACES}
        select doc_id, start, start + length(value) as "end", value, concat('[ЭЛЕКТРОННАЯ_ПОЧТА_', dense_rank() over (partition by doc_id order by first), ']') as replacement
        from (select *, min(start) over (partition by doc_id, value) as first from e) y""",
    "redacted_runs": _masked_sql("concat('[', pre, '_', number, ']')").replace(
        ", true as complete from", ", coalesce((select string_agg(concat('f', start // 7, '=[', pre, '_', number, ']'), ';' order by start) from marked x where x.doc_id = b.doc_id and x.block_ord = b.block_ord), '') as marks, coalesce(len(m), 0)::bigint as n_applied from"
    ),
    "brought_detectors": """select s_suppkey as doc_id, o as block_ord, detector, outcome from supplier, lateral (values (7, 'town', 'Москва'), (9, 'people', 'Петров'), (9, 'often', 'Подпись'), (8, 'people', 'ValueError')) v(o, detector, outcome)""",
    "page_blocks": _sql("""select doc_id, concat('pdf_page_0_block_', case g when 0 then 0 when 2 then 1 else 2 end) as block_id, string_agg(text || chr(10), '' order by block_ord) as text,
        (case g when 2 then 900 else 10 end)::bigint as x0, (case g when 0 then 0 when 1 then 66 else 5 end)::bigint as y0, ((case g when 2 then 900 else 10 end) + 6 * max(length(text)))::bigint as x1, (case g when 0 then 34 when 1 then 100 else 51 end)::bigint as y1
        from (select *, case when block_ord < 3 then 0 when block_ord < 6 then 1 else 2 end as g from blocks) z group by doc_id, g"""),
    "span_rectangles": _sql("""select doc_id, entity_type, (x + 6 * start)::bigint as x0, y::bigint as y0, (x + 6 * "end")::bigint as x1, (y + 10)::bigint as y1, concat('[', entity_type, ']') as label
        from (select *, case when block_ord < 6 then 10 else 900 end as x, case when block_ord < 3 then 12 * block_ord when block_ord < 6 then 12 * block_ord + 30 else 12 * (block_ord - 6) + 5 end as y from gold where entity_type in ('inn', 'email', 'bik', 'amount')) z"""),
    "table_cells": """select p_partkey as doc_id, c::bigint as "column", t as text, case when c = 1 then trim(t) end as money
        from part, lateral (values (0, p_name), (1, concat(' ', p_size, ' 000,50 ')), (2, p_size::varchar)) v(c, t)""",
    "redacted_cells": """select o_orderkey as doc_id, o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 as marked,
        case when o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 then 'ИНН [ИНН_1] клиент' else concat('ИНН 77', lpad(o_custkey::varchar, 8, '0'), ' клиент') end as masked from orders""",
    "spans_in_pieces": f"with {_EMAIL_PLACES} select doc_id, start, start + length(value) as \"end\" from e",
    "answers_in_pieces": f"with {_EMAIL_PLACES} select doc_id, start, start + length(value) as \"end\" from e",
    "email_counts": f"select doc_id, email, count(*)::bigint as n from (select doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) as email from documents) group by all",
    "blocks_lines": "select doc_id, (i - 1)::bigint as block_ord, length(line)::bigint as n_chars from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(line, ' ' || chr(9) || chr(13)) <> ''",
    "resolve_rule_spans": _sql(f"select {_COLUMNS} from gold"),
    "resolve_mixed_spans": _sql(f"select {_COLUMNS}, case when entity_type in ('person_name', 'organization', 'address') then 'llm-mock' else 'rule' end as source from gold"),
    "stable_markers": _sql("select doc_id, block_ord, entity_type, start, concat('[', pre, '_', number, ']') as replacement from marked", _MARKED),
    "mask_full": _masked_sql("concat('[', pre, '_', number, ']')"),
    "mask_short": _masked_sql(f"concat('[', {_SHORT}, '_', number, ']')"),
    "mask_none": _masked_sql("repeat(' ', length(text))"),
    "org_entities": _sql(f"select g.doc_id, block_ord, start, entity_id, g.text as canonical_name from gold g join (select doc_id, text, {_ENTITY} as entity_id from gold where entity_type = 'organization' group by doc_id, text) using (doc_id, text) where entity_type = 'organization'"),
    "nearest_identifier": _sql("select g.doc_id, g.block_ord, o.start, g.entity_type, g.text as value from gold g join gold o using (doc_id, block_ord) where g.entity_type = 'inn' and o.entity_type = 'organization'"),
    "person_represents": _sql(f"""select doc_id, block_ord, concat('person:', substring(sha256(case block_ord when 6 then 'иванова ивана ивановича' else 'петров п п' end), 1, 16)) as entity_id,
        case when block_ord = 6 then entity_id end as organization_id from gold join (select doc_id, {_ENTITY} as entity_id from gold where entity_type = 'organization' and text like 'ООО%' group by doc_id) using (doc_id) where entity_type = 'person_name'"""),
    "party_roles": """select s_suppkey as doc_id, o as block_ord, start, role as party_role, conflict from supplier, lateral (values
        (0, 11, 'supplier', false), (0, 31 + length(s_name), 'unknown', true), (1, 13, 'supplier', false), (1, 31 + length(s_name), 'buyer', false), (2, 8, 'buyer', false), (3, 11, 'unknown', true)) v(o, start, role, conflict)""",
    "document_repeat": """select s_suppkey as doc_id, o as block_ord, start, stop as "end", source from supplier, lateral (values (0, 20, 41, 'rule'), (1, 14 + length(s_name), 36 + length(s_name), 'rule')) v(o, start, stop, source)""",
    "review_questions": "select s_suppkey as doc_id, 'mask:party:amount:[СУММА_1]' as question_id, 'unconfirmed' as reason, 2::bigint as n_matches, 2::bigint as n_contexts from supplier",
    "apply_answers": "select s_suppkey as doc_id, case when s_nationkey < 10 then concat('Цена ', s_suppkey, ' RUB') else 'Цена [СУММА_1]' end as masked from supplier",
    "report_rows": _sql(f"select doc_id, row_number() over (partition by doc_id order by block_ord, start)::bigint as number, {_NAMES} as type_name, text as original_value, concat('[', pre, '_', number, ']') as replacement, 'Не определено' as role_name, 1.0::double as confidence from marked where entity_type in ('inn', 'kpp', 'ogrn', 'bik', 'phone')", _MARKED),
    "format_location": """select l_orderkey, l_linenumber, case l_linenumber when 1 then concat('Лист «Лист', l_orderkey, '», ячейка B2') when 2 then concat('Таблица ', l_orderkey + 1, ', строка 3, столбец 1')
        when 3 then concat('Таблица ', l_orderkey + 1, ', строка 4, столбец 4, абзац 4') when 4 then concat('Абзац ', l_orderkey + 1) when 5 then concat('Страница ', l_orderkey + 1) else 'Не указано' end as location from lineitem""",
    "preview_segments": f"""with p as ({_masked_sql("concat('[', pre, '_', number, ']')", "entity_type in ('inn', 'kpp', 'bik')")}),
        u as (select *, coalesce(sum(length(masked)) over (partition by doc_id order by block_ord rows between unbounded preceding and 1 preceding), 0)::bigint as used from p),
        c as (select doc_id, block_ord::bigint as block_ord, length(masked) > 200 - used as truncated, substring(masked, 1, 200 - used) as text from u where used < 200)
        select *, len(regexp_extract_all(text, '\\[(ИНН|КПП|БИК)_[0-9]+\\]'))::bigint as n_markers from c""",
    "quality_scores": _sql("select doc_id, 3::bigint as expected, 3::bigint as covered, (select count(*) from gold g where g.doc_id = own.doc_id and entity_type in ('person_name', 'organization', 'inn', 'kpp', 'ogrn') and not (block_ord in (1, 3) and entity_type in ('organization', 'inn')))::bigint as extra from own"),
    "checksums": f"""select p_partkey, (list_sum(list_transform(range(1, 10), lambda i: substring({_INN}, i, 1)::int * {_WEIGHTS}[i])) % 11 % 10) = substring({_INN}, 10, 1)::int as inn_valid,
        (concat('102', lpad(p_partkey::varchar, 10, '0'))[1:12]::bigint % 11 % 10) = right(p_partkey::varchar, 1)::int as ogrn_valid, p_partkey % 3 <> 1 as phone_valid from part""",
    "normalize_name": "select s_suppkey, concat('елка-', lower(s_name)) as name, 'ооо' as form from supplier",
    "token_estimate": "select doc_id, greatest(1, ceil(strlen(text) / 2.0))::bigint as tokens from documents",
    "amount_by_column": "select l_orderkey, l_linenumber, 'Цена' as header, 1 as start, concat(l_partkey, ',50') as text from lineitem",
    "independent_cells": "select p_partkey, (case when (p_size // 20) = ((p_size + 4) // 20) then 1 else 0 end)::bigint as n_left from part",
    "sections": "select distinct l_orderkey as doc_id, l_linenumber::bigint as block_ord, coalesce((select concat(max(i.l_linenumber), '. ПРЕДМЕТ ДОГОВОРА') from lineitem i where i.l_orderkey = o.l_orderkey and i.l_linenumber <= o.l_linenumber and i.l_linenumber % 3 = 1 having max(i.l_linenumber) is not null), '') as section from lineitem o",
    "table_headers": "select n_regionkey::bigint as doc_id, n_nationkey::bigint as block_ord, coalesce(last_value(case when n_nationkey < 10 then n_name end ignore nulls) over (partition by n_regionkey, n_nationkey % 2 order by n_nationkey), '') as column_header from nation",
    "stage_progress": "select l_orderkey as job_id, sum(case when l_returnflag = 'N' then 20 else 0 end)::bigint as progress from lineitem group by 1",
    "job_fifo": "select o_orderkey as job_id, o_orderdate as created_at from orders where o_orderstatus = 'O'",
    "publishable": "select s_suppkey as doc_id, s_suppkey % 2 = 0 as publishable from supplier",
    "model_relocation": _sql("""select doc_id, block_ord, case when strpos(text, v) > 0 then 'found' else 'absent' end as outcome, ((length(text) - length(replace(text, v, ''))) // length(v))::bigint as n, strpos(text, v)::bigint - 1 as start
        from (select *, concat('ООО «', s, '»') as v from blocks) x"""),
    "applied_matches": _sql("""select doc_id, block_ord, entity_type, start, "end", doc_id % 2 = 0 as applied from gold
        union all select doc_id, block_ord, entity_type, start + 1, "end", false from gold where doc_id % 3 = 0"""),
    "ocr_lines": """with w as (select distinct l_orderkey as doc_id, l_linenumber::bigint as n from lineitem where l_linenumber >= 2),
        t as (select doc_id, string_agg('w' || (n * n), ' ' order by n) as text, min(n) as a, max(n) as b, max(100 * n + 40 + 10 * n) as r from w group by doc_id)
        select doc_id, 1::bigint as page_number, text, 200 * a as x0, 10 + a as y0, 2 * r as x1, 30 + b as y1, (length(text) - length('w' || (b * b)))::bigint as last_start, length(text)::bigint as last_end from t""",
}
