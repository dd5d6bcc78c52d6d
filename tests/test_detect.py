"""Detectors, resolution and masking on small texts."""

from __future__ import annotations

import functools
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusveil.functions.patterns import EMAIL, MOCK_RULES, RULES, WORDS
from corpusveil.functions import tokens
from corpusveil.functions.text import find, inn_valid, legal_form, literal_pattern, normalize_name, ogrn_valid, phone_valid
from corpusveil.operators.detect import detect, rule_spans
from corpusveil.operators.masking import masked, quality
from corpusveil.operators.matches import matches
from corpusveil.plans.pipeline import mask, propose
from corpusveil.schema import ENTITY_TYPES

CASES = [
    ("inn", "ИНН: 7707083893", ["7707083893"]), ("inn", "7707083893", []), ("inn", "Код операции 7707083893", []), ("inn", "ИНН\n77 19123456", ["77 19123456"]),
    ("kpp", "КПП 773601001", ["773601001"]), ("kpp", "773601001", []), ("kpp", "ИНН/КПП 7707083893/773601001", ["773601001"]),
    ("ogrn", "ОГРН 1027700132195", ["1027700132195"]), ("ogrn", "ОГРН 102770013219", []), ("ogrn", "ОГРНИП 304500116000156", ["304500116000156"]),
    ("phone", "телефон: +7 (495) 123-45-67", ["+7 (495) 123-45-67"]), ("phone", "+7 (495) 123-45-67", []), ("phone", "тел. 81234567890123456789", []),
    ("email", "a info@example.ru, b@c.d.org", ["info@example.ru", "b@c.d.org"]), ("email", "info@localhost", []),
    ("bank_account", "расчётный счёт 40702810900000000001", ["40702810900000000001"]), ("bank_account", "40702810900000000001", []),
    ("bik", "БИК: 044525225", ["044525225"]), ("bik", "044525225", []), ("contract_number", "Договор поставки № 15-А/2026", ["15-А/2026"]), ("contract_number", "№ 15-А/2026", []),
    ("contract_number", "Договор № 265/26", ["265/26"]), ("amount", "Два товара стоят сто рублей", ["сто рублей"]), ("amount", "20% и 5 000 шт.", []), ("amount", "1 234,50 руб.", ["1 234,50 руб."]),
    ("person_name", "Генеральный директор", []), ("person_name", "Иванов Иван Иванович", ["Иванов Иван Иванович"]), ("person_name", "Смирнов А.В.", ["Смирнов А.В."]),
    ("organization", "😀 ООО «Ромашка» и АО Бета", ["ООО «Ромашка»", "АО Бета"]), ("address", "Адрес: 123456, г. Москва, ул. Ленина, д. 5", ["123456, г. Москва, ул. Ленина, д. 5"]),
]


def test_each_detector_finds_its_values_with_offsets(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, text string")
    found = {r["i"]: r for r in rows.select("i", "text", *(rule_spans(F.col("text"), (t,)).alias(t) for t in ENTITY_TYPES)).collect()}
    for i, (kind, text, values) in enumerate(CASES):
        spans = found[i][kind]
        assert [s["text"] for s in spans] == values, (kind, text)
        assert all(text[s["start"] : s["end"]] == s["text"] for s in spans)
        assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))


def coded(text):
    """Tokens and their codes, read in Python."""
    found = re.findall(r"[^\W\d]+|[0-9]+|[ \t\u00a0\u202f]+|[\r\n]+|[^\S \t\u00a0\u202f\r\n]+|.", text, re.DOTALL)

    def code(t):
        if re.match(r"[^\W\d]", t):
            shape = next((i for i, p in enumerate(tokens._SHAPED) if re.search(p.replace(r"\z", r"\Z"), t)), tokens.OTHER)
            return chr(tokens._WORDS + tokens.SHAPES * WORDS.of.get(t.lower(), 0) + shape)
        if t[0].isdigit():
            return chr(tokens._DIGITS + min(len(t), tokens._MOST))
        if t[0] in " \t\u00a0\u202f":
            return tokens._ONE if len(t) == 1 and t != "\t" else tokens._SEVERAL
        return tokens._BREAK if t[0] in "\r\n" else tokens._ELSE if t.isspace() else t

    return found, "".join(map(code, found))


@functools.cache
def compiled(rule):
    return re.compile(f"(?:{rule.before})(?P<value>{rule.value}){rule.after}".replace(r"\z", r"\Z")), re.compile(rule.check.replace(r"\z", r"\Z").replace("iu", "i"))


def in_python(rule, text):
    found, codes = coded(text)
    sequence, check = compiled(rule)
    begins = [0, *itertools.accumulate(map(len, found))]
    out = []
    for m in sequence.finditer(codes):
        start, end = begins[m.start("value")], begins[m.end("value")]
        kept = check.match(text[start:end]) if rule.check else None
        if kept or not rule.check:
            out.append((start, start + len(kept[0]) if kept else end))
    return out


def test_spans_equal_those_of_another_pattern_engine(spark):
    rng = random.Random(4)
    parts = [p for _, t, _ in CASES for p in re.split("( )", t)] + ["договор", "в лице", "Ивановна", "А.", "/", ",", "сто", "руб.", "₽", "(", ")", "\n", "\u00a0", "\u2003", "_", "ИНН/КПП", "+7", "495", "12345", "Смирнов-", "ВТБ24", "\U0001f600", "\ue405", "МБОУ СОШ", "№"]
    texts = [t for _, t, _ in CASES] + ["ИНН 770 708 38 93; инн:7707083893", "", "р/с 40702810900000000001 л/с 12345678901", "МБОУ СОШ № 5 г. Тверь; ПАО \"Газ\""]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for rules in (RULES, MOCK_RULES):
        for kind, own in rules.items():
            got = {r["i"]: sorted((x["start"], x["end"]) for x in r["r"]) for r in rows.select("i", tokens.find_tokens(F.col("text"), {kind: own}, WORDS).alias("r")).collect()}
            for i, t in enumerate(texts):
                assert got[i] == sorted(x for rule in own for x in in_python(rule, t.replace("\ue405", "\ufffd"))), (kind, t)
    mine = re.compile(f"(?P<value>{EMAIL.value}){EMAIL.tail}", re.IGNORECASE)
    assert all([(x["start"], x["end"]) for x in r["r"]] == [m.span("value") for m in mine.finditer(texts[r["i"]])] for r in rows.select("i", find(F.col("text"), EMAIL).alias("r")).collect())


def test_values_beside_negatives_gaps_breaks_and_overlaps(spark):
    text = "Договор без номера. Договор № 15-А/2026, ИНН 12 ИНН\n770 708\u00a03893, КПП КПП 773601001.\nБез метки: 7707083893, 20%, № 128, 12.03.2026, 5 000 шт.\nИванов Пётр Иванов Иванович; ООО «Луч» и АО Мир; 1 200,50 руб. (сто рублей)\nадрес: 123456, г. Тверь, ул. Мира, д. 5, кв. 7; тел 8(495)123-45-67"
    found = rows_of(spark, text)
    assert found == [("contract_number", "15-А/2026"), ("inn", "770 708\u00a03893"), ("kpp", "773601001"), ("person_name", "Пётр Иванов Иванович"), ("organization", "ООО «Луч»"), ("organization", "АО Мир"), ("amount", "1 200,50 руб."), ("amount", "сто рублей"), ("address", "123456, г. Тверь, ул. Мира, д. 5, кв. 7"), ("phone", "8(495)123-45-67")]


def rows_of(spark, text):
    spans = spark.createDataFrame([(text,)], "t string").select(rule_spans(F.col("t"), ENTITY_TYPES).alias("s")).first()["s"]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in spans)
    return [(s["entity_type"], s["text"]) for s in spans]


def test_numerals_are_built_from_their_parts(spark):
    words = "ноль один одна одно одну два две три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот тысяча тысячи тысячу тысяч миллион миллиона миллионов миллиард миллиарда миллиардов"
    assert {w for w, c in WORDS.of.items() if WORDS.names[c] == "numeral"} == set(words.split())


def test_checks_and_names(spark):
    row = spark.range(1).select(
        inn_valid(F.lit("7707083893")).alias("a"), inn_valid(F.lit("7707083894")).alias("b"), inn_valid(F.lit("500100732259")).alias("c"), ogrn_valid(F.lit("1027700132195")).alias("d"), ogrn_valid(F.lit("1027700132194")).alias("e"),
        ogrn_valid(F.lit("304500116000157")).alias("f"), phone_valid(F.lit("+7 495 123 45 67")).alias("g"), phone_valid(F.lit("91234567890")).alias("h"), normalize_name(F.lit("ООО «Ёлка,  и»")).alias("i"), legal_form(F.lit("Общество с ограниченной  ответственностью «А»")).alias("j"),
        find(F.lit("A.B A.B\nC A.B Cx"), literal_pattern(F.lit("A.B C"))).alias("k"),
    ).first()
    assert list(row)[:10] == [True, False, True, True, False, True, True, False, "елка и", "ооо"]
    assert [(x["start"], x["end"]) for x in row["k"]] == [(4, 9)]


def test_masked_texts_hold_no_value(spark):
    text = "Поставщик: ООО «Ромашка», ИНН 7707083893, тел. +7 (495) 123-45-67, info@example.ru"
    blocks = spark.createDataFrame([(1, 0, text), (1, 1, None), (2, 0, "")], "doc_id long, block_ord int, text string")
    p = propose(blocks)
    found = [r["text"] for r in p.matches.collect()]
    assert sorted(found) == ["+7 (495) 123-45-67", "7707083893", "info@example.ru", "ООО «Ромашка»"]
    for style in ("full", "short", "none"):
        done = mask(p, style=style).orderBy("doc_id", "block_ord").collect()
        assert len(done) == 3 and all(r["complete"] for r in done)
        assert not any(v in done[0]["masked"] for v in found)
    assert {r["party_role"] for r in p.matches.where("entity_type = 'organization'").collect()} == {"supplier"}


def test_model_spans_yield_to_rules_and_are_checked(spark):
    span = "struct<entity_type:string,start:int,end:int,text:string,source:string,confidence:double,party_role:string,is_rule:boolean>"
    given = [("organization", 0, 5, "Альфа", "llm", 0.9, "buyer", False), ("organization", 0, 4, "xxxx", "llm", 0.9, "buyer", False), ("organization", 2, 5, "ьфа", "llm", 0.95, "buyer", False), ("person_name", -1, 5, "x", "llm", 0.9, "buyer", False)]
    blocks = spark.createDataFrame([(1, 0, "Альфа и ИНН 7707083893", given)], f"doc_id long, block_ord int, text string, model_spans array<{span}>")
    spans = detect(blocks, ("organization",)).first()["spans"]
    assert [(s["entity_type"], s["text"]) for s in spans] == [("organization", "ьфа"), ("inn", "7707083893")]
    numbered = matches(detect(blocks, ("organization",)), ("organization",)).collect()
    assert [m["replacement"] for m in numbered] == ["[ОРГАНИЗАЦИЯ_1]"]


def test_aliases_and_numbers_join_organizations(spark):
    blocks = spark.createDataFrame([(1, 0, "ООО «Альфа», ИНН 7707083893"), (1, 1, "Общество с ограниченной ответственностью «Альфа», ИНН 7707083893"), (1, 2, "АО «Бета» (ООО «Гамма»)"), (2, 0, "ООО «Альфа»")], "doc_id long, block_ord int, text string")
    found = matches(detect(blocks, ("organization",)), ("organization",)).orderBy("doc_id", "block_ord", "start").collect()
    assert [m["replacement"] for m in found] == ["[ОРГАНИЗАЦИЯ_1]", "[ОРГАНИЗАЦИЯ_1]", "[ОРГАНИЗАЦИЯ_2]", "[ОРГАНИЗАЦИЯ_2]", "[ОРГАНИЗАЦИЯ_1]"]


def test_bad_masks_are_reported_and_quality_counts(spark):
    blocks = spark.createDataFrame([(1, 0, "abcdef")], "doc_id long, block_ord int, text string")
    schema = "doc_id long, block_ord int, start int, end int, text string, replacement string, entity_type string"
    bad = spark.createDataFrame([(1, 0, 0, 2, "ab", "[X]", "inn"), (1, 0, 1, 3, "bc", "[Y]", "inn")], schema)
    row = masked(blocks, bad).first()
    assert (row["masked"], row["complete"]) == ("[X]cdef", False)
    gold = spark.createDataFrame([(1, 0, "inn", 0, 4), (1, 0, "inn", 1, 3), (1, 0, "inn", 8, 9)], "doc_id long, block_ord int, entity_type string, start int, end int")
    assert quality(gold, bad.select("doc_id", "block_ord", "entity_type", "start", "end")).first().asDict() == {"doc_id": 1, "expected": 2, "covered": 0, "extra": 0}


def test_no_types_is_an_error(spark):
    with pytest.raises(ValueError):
        propose(spark.createDataFrame([], "doc_id long, block_ord int, text string"), ())
