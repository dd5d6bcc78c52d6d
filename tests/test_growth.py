"""Work that must grow with the rows alone: patterns, plans and tasks of detection."""

from pyspark.sql import functions as F

import __spark_entry__
from corpusveil.functions.patterns import ANY_WORD, RULES, WORDS
from corpusveil.functions.tokens import find_tokens, number
from corpusveil.operators.detect import bearing
from corpusveil.operators.masking import masked, with_applied
from corpusveil.plans.queries import contract_blocks

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_character_classes_are_ranges():
    assert len(ANY_WORD) == len(number()) == 5


def test_spans_are_computed_once(spark):
    plan = plan_of(__spark_entry__.queries()["resolve_rule_spans"](spark, SF))
    assert plan.count("regexp_extract_all(") == 1
    assert "size(" not in "".join(line for line in plan.splitlines() if line.lstrip("+-: ").startswith("Filter"))


def test_a_small_file_is_dealt_to_all_cores(spark):
    assert contract_blocks(spark, SF).rdd.getNumPartitions() >= 32


def test_page_joins_send_no_table_through_the_driver(spark):
    for name in ("page_blocks", "table_cells", "span_rectangles"):
        df = __spark_entry__.queries()[name](spark, SF)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString(), name


def test_a_value_inside_a_longer_one_is_none(spark, tmp_path):
    text = "first.info@example.ru, info@example.ru, info@example.ru.net and info@example.ru"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["start"], r["end"]) for r in __spark_entry__.queries()["answers_in_pieces"](spark, str(tmp_path)).collect())
    assert [text[a:e] for a, e in got] == ["first.info@example.ru", "info@example.ru", "info@example.ru.net", "info@example.ru"]


def no_broadcast(df):
    return "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_a_block_meets_its_matches_in_one_join_that_merges(spark):
    for name in ("applied_matches", "mask_none", "redacted_cells"):
        df = __spark_entry__.queries()[name](spark, SF)
        assert no_broadcast(df), name
        assert name == "mask_none" or df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1, name


def test_of_equal_matches_the_first_is_put_in(spark):
    blocks = spark.createDataFrame([(1, 0, "ab cd")], "doc_id long, block_ord int, text string")
    found = spark.createDataFrame([(1, 0, 0, 2, t, "inn", "[X]") for t in ("ab", "ab", "zz")] + [(None, 0, 0, 2, "ab", "inn", "[X]")], "doc_id long, block_ord int, start int, end int, text string, entity_type string, replacement string")
    got = sorted((str(r["doc_id"]), r["text"], r["applied"]) for r in with_applied(blocks, found).collect())
    assert got == [("1", "ab", False), ("1", "ab", True), ("1", "zz", False), ("None", "ab", False)]
    assert [r["masked"] for r in masked(blocks, found).collect()] == ["[X] cd"]


def test_markers_and_entities_are_linked_by_joins_that_merge(spark):
    for name in ("stable_markers", "org_entities", "person_represents", "nearest_identifier", "document_repeat"):
        assert no_broadcast(__spark_entry__.queries()[name](spark, SF)), name


def test_pieces_are_looked_through_once(spark):
    assert plan_of(__spark_entry__.queries()["spans_in_pieces"](spark, SF)).count("MapInArrow") == 0


def test_a_report_of_identifiers_needs_no_join(spark):
    assert plan_of(__spark_entry__.queries()["report_rows"](spark, SF)).count("Join ") == 0


def test_only_lines_with_a_word_of_the_rules_are_cut_into_tokens(spark):
    use = {t: RULES[t] for t in ("inn", "kpp", "ogrn", "bik", "phone")}
    lines = {"ИНН 7707083893": True, "инн7707083893": True, "xИНН 7707083893": False, "ИНН_ 7707083893": False, "Тел. 8 (495) 123-45-67": True, "Итого 7707083893": False, "БИКи 044525225": False, "р/с 1, Бик:044525225": True, "ИНН\u0301 7707083893": False}
    x = F.col("x")
    got = spark.createDataFrame([(t,) for t in lines], "x string").select(x, bearing([r for rs in use.values() for r in rs], x).alias("may"), find_tokens(x, use, WORDS).alias("found")).collect()
    assert {r["x"]: r["may"] for r in got} == lines
    assert [r["x"] for r in got if r["found"]] == [t for t in lines if t in ("ИНН 7707083893", "Тел. 8 (495) 123-45-67", "р/с 1, Бик:044525225")]
    assert not spark.range(1).select(bearing([*RULES["inn"], *RULES["person_name"]], F.lit("no words")).alias("may")).first()["may"]


def test_places_are_the_same_in_few_and_in_many_tokens(spark):
    texts = ["слово " * n + "ИНН 7707083893" for n in (0, 1, 125, 126, 127, 128, 300)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", find_tokens(F.col("x"), {"inn": RULES["inn"]}, WORDS).alias("found")).collect()
    assert all([(m["start"], m["end"]) for m in r["found"]] == [(r["x"].index("7"), len(r["x"]))] for r in got)
