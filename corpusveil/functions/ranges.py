"""Column functions that others are made of: a value bound once, slices, and ranges of pattern matches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Matcher(Protocol):
    """Something with a pattern for java.util.regex that has its value in group 2."""

    @property
    def java(self) -> str: ...


#: Private-use characters that mark where a value begins and ends.
_OPEN, _CLOSE = "\ue000", "\ue001"
RANGES = "array<struct<start:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def find(text: Column, pattern: Matcher | Column, marks: bool = True) -> Column:
    """Ranges of all matches of a pattern's value in a text, in order. A column as pattern has its value in group 2. Without `marks` the text is known to have none of the two marks."""
    java = pattern if isinstance(pattern, Column) else F.lit(pattern.java)
    clean = F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd") if marks else text

    def ranges(marked: Column) -> Column:
        pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(RANGES).alias("out"))
        step = lambda a, p: F.struct(
            (a["at"] + F.length(p)).alias("at"),
            (a["i"] + 1).alias("i"),
            F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p)).alias("end"))))).otherwise(a["out"]).alias("out"),
        )
        return F.aggregate(pieces, zero, step, lambda a: a["out"])

    marked = F.regexp_replace(clean, java, F.lit(f"$1{_OPEN}$2{_CLOSE}"))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), ranges(m)).otherwise(F.array().cast(RANGES)))
