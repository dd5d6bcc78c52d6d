"""Record types, dimensions and fixed values of the data model."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, marker prefixes and labels that results must show as they are.
ENTITY_TYPES = ("person_name", "organization", "address", "amount", "inn", "kpp", "ogrn", "phone", "email", "bank_account", "bik", "contract_number")
PREFIXES = {
    "person_name": "ФИО", "organization": "ОРГАНИЗАЦИЯ", "address": "АДРЕС", "amount": "СУММА", "inn": "ИНН", "kpp": "КПП", "ogrn": "ОГРН",
    "phone": "ТЕЛЕФОН", "email": "ЭЛЕКТРОННАЯ_ПОЧТА", "bank_account": "РАСЧЁТНЫЙ_СЧЁТ", "bik": "БИК", "contract_number": "НОМЕР_ДОГОВОРА",
}
SHORT_PREFIXES = {"organization": "ОРГ", "phone": "ТЕЛ", "email": "ПОЧТА", "bank_account": "СЧЁТ", "contract_number": "ДОГ"}
DISPLAY_NAMES = {
    "person_name": "ФИО", "organization": "Организация", "address": "Адрес", "amount": "Сумма", "inn": "ИНН", "kpp": "КПП", "ogrn": "ОГРН",
    "phone": "Телефон", "email": "Электронная почта", "bank_account": "Расчётный счёт", "bik": "БИК", "contract_number": "Номер договора",
}
ROLE_NAMES = {"supplier": "Поставщик", "buyer": "Покупатель", "unknown": "Не определено"}
#: Types that rules find, those that rules only propose, and those that a model may name.
RULE_TYPES = ("amount", "inn", "kpp", "ogrn", "phone", "email", "bank_account", "bik", "contract_number")
FALLBACK_TYPES = ("person_name", "organization", "address")
MODEL_TYPES = ("person_name", "organization", "address", "amount")
AUXILIARY_TYPES = ("organization", "inn", "kpp", "ogrn")

SPAN = "entity_type string, start int, end int, text string, source string, confidence double, party_role string, is_rule boolean"
SPAN_ARRAY = "array<struct<entity_type:string,start:int,end:int,text:string,source:string,confidence:double,party_role:string,is_rule:boolean>>"
CELL_SPANS = "array<struct<start:int,end:int,cell_table:int,cell_row:int,cell_column:int>>"
#: What a table of blocks may have besides doc_id, block_ord and text; absent columns count as null.
OPTIONAL = {"kind": "string", "column_header": "string", "cell_spans": CELL_SPANS, "money_spans": "array<struct<start:int,end:int>>", "table_index": "int", "model_spans": SPAN_ARRAY}


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a dimension; null for others."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def analysed(types: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Requested types with those that linking organizations needs, in the order of the types."""
    wanted = set(types)
    if wanted & {"organization", "person_name"}:
        wanted |= set(AUXILIARY_TYPES)
    if unknown := wanted - set(ENTITY_TYPES):
        raise ValueError(f"unknown entity types: {sorted(unknown)}")
    return tuple(t for t in ENTITY_TYPES if t in wanted)
