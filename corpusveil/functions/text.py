"""Column functions: spans of pattern matches, clauses, names, checksums and labels.

All of them are built from Spark's own functions, so that a detector is a projection of the scan. Offsets
count code points from zero; an end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PREFIXES, SHORT_PREFIXES, lookup
from .patterns import LEGAL_FORMS, LONG_FORMS
from .ranges import RANGES, find, let, piece

__all__ = ["RANGES", "clause_end", "clause_start", "find", "inn_valid", "label", "legal_form", "let", "literal_pattern", "normalize_name", "ogrn_valid", "only_digits", "phone_valid", "piece", "squeeze", "token_estimate"]


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clause_start(text: Column, start: Column, limits: str) -> Column:
    """Where the clause around a position begins: after the last limit character before it."""
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), start), rf"(?s)\A(.*[{limits}])?", 1))


def clause_end(text: Column, end: Column, limits: str) -> Column:
    """Where the clause ends: before the first limit character from there on."""
    return end + F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), rf"\A([^{limits}]*)", 1))


def normalize_name(name: Column) -> Column:
    """Lower case without legal forms, punctuation and doubled spaces; ё is е."""
    lower = F.regexp_replace(F.lower(name), "ё", "е")
    return squeeze(F.regexp_replace(F.regexp_replace(lower, LEGAL_FORMS, " "), r"[«»\"'`.,;:()\[\]{}]", " "))


def legal_form(name: Column) -> Column:
    """The short form of the first legal form in a name; empty without one."""
    form = squeeze(F.lower(F.regexp_extract(name, LEGAL_FORMS, 0)))
    return F.coalesce(lookup(LONG_FORMS, form), form)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def phone_valid(value: Column) -> Column:
    """Ten digits, or eleven that begin with 7 or 8."""
    return let(only_digits(value), lambda d: (F.length(d) == 10) | ((F.length(d) == 11) & F.substring(d, 1, 1).isin("7", "8")))


def _control(digits: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return total % 11 % 10


def inn_valid(value: Column) -> Column:
    """The control digits of taxpayer numbers of 10 or 12 digits."""
    # Weights of the control digits.
    ten, eleven, twelve = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    at = lambda d, i: F.substring(d, i, 1).cast("int")

    def check(d: Column) -> Column:
        short = _control(d, ten) == at(d, 10)
        long = (_control(d, eleven) == at(d, 11)) & (_control(d, twelve) == at(d, 12))
        return F.when(F.rlike(d, F.lit(r"\A[0-9]{10}\z")), short).when(F.rlike(d, F.lit(r"\A[0-9]{12}\z")), long).otherwise(False)

    return let(F.regexp_replace(value, r"(?U)\s", ""), check)


def ogrn_valid(value: Column) -> Column:
    """The control digit of registration numbers of 13 or 15 digits."""

    def check(d: Column) -> Column:
        rest = lambda n: F.substring(d, 1, n).cast("bigint") % (n - 1) % 10 == F.substring(d, n + 1, 1).cast("bigint")
        return F.when(F.rlike(d, F.lit(r"\A[0-9]{13}\z")), rest(12)).when(F.rlike(d, F.lit(r"\A[0-9]{15}\z")), rest(14)).otherwise(False)

    return let(F.regexp_replace(value, r"(?U)\s", ""), check)


def token_estimate(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 2)).cast("int")


def label(replacement: Column, entity_type: Column, style: str) -> Column:
    """A marker in the style full, short (shorter prefix) or none (empty)."""
    if style not in ("full", "short", "none"):
        raise ValueError(f"unknown label style: {style}")
    if style == "none":
        return F.lit("")
    if style == "full":
        return replacement
    full = lookup(PREFIXES, entity_type)
    short = F.coalesce(lookup(SHORT_PREFIXES, entity_type), full)
    at = F.instr(replacement, full)
    return F.when(at > 0, F.concat(F.substring(replacement, F.lit(1), at - 1), short, F.substring(replacement, at + F.length(full), F.length(replacement)))).otherwise(replacement)


def literal_pattern(value: Column) -> Column:
    """A pattern that finds a value whatever its white space, not inside a longer word; the value is group 2."""
    words = F.transform(F.split(squeeze(value), " "), lambda w: F.concat(F.lit(r"\Q"), F.regexp_replace(w, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E")))
    edge = lambda c: F.rlike(c, F.lit(r"(?U)\A[\p{L}\p{N}]\z"))
    first, last = F.substring(squeeze(value), 1, 1), F.substring(squeeze(value), -1, 1)
    return F.concat(F.lit("(?U)()("), F.when(edge(first), F.lit(r"(?<!\w)")).otherwise(F.lit("")), F.array_join(words, r"\s+"), F.when(edge(last), F.lit(r"(?!\w)")).otherwise(F.lit("")), F.lit(")"))
