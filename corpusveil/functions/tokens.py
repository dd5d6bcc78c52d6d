"""Texts as typed tokens, and sequences of tokens found in them, as column expressions.

A text falls into runs of letters, of digits, of blanks and of line breaks, and single other characters. Each
token becomes one character of a second string, its code: what word class it is of and how it is written, how
many digits it has, or which sign it is. Rules are sequences of codes, looked for in that string; the number
of a token then gives its place in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import RANGES, find, let, piece

_IN_WORD = r"[\p{L}\p{M}_]"
TOKEN = rf"(?s){_IN_WORD}+|\d+|[ \t\u00a0\u202f]+|[\r\n]+|(?U:[\s&&[^ \t\r\n\u00a0\u202f]])+|."
#: Codes are in a private area of Unicode: words from here on, SHAPES for each class; digits; kinds of white space.
_WORDS, _DIGITS, _BLANKS, _MOST = 0xE400, 0xE200, 0xE300, 40
#: How a word is written. In Cyrillic letters: small ones, a capital and small ones, one capital, capitals, a capital and then
#: both, one small letter, any others. Else: from a Cyrillic capital on, or any other way. Patronymics are known by their ends.
SMALL, PATRONYMIC, PROPER, INITIAL, CAPITALS, MIXED, LETTER, LETTERS, TITLED, OTHER = range(10)
_SHAPED = (r"\A[а-яё]{2,}\z", r"\A[А-ЯЁ][а-яё]*(?:вич|вна|вича|вны)\z", r"\A[А-ЯЁ][а-яё]+\z", r"\A[А-ЯЁ]\z", r"\A[А-ЯЁ]{2,}\z", r"\A[А-ЯЁ][А-ЯЁа-яё]+\z", r"\A[а-яё]\z", r"\A[А-ЯЁа-яё]+\z", r"\A[А-ЯЁ]")
SHAPES = 10
#: Signs that are their own code, as are all others; these are told without a pattern.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~«»№₽–—"
#: Kinds of white space: one blank, several or a tab, line breaks, other.
_ONE, _SEVERAL, _BREAK, _ELSE = (chr(_BLANKS + i) for i in range(4))


def one_of(numbers: Iterable[int]) -> str:
    """A character class of code points, written in ranges: a matcher tests ranges one after the other, and single characters too."""
    runs: list[list[int]] = []
    for n in sorted(set(numbers)):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "[" + "".join(chr(a) if a == e else f"{chr(a)}-{chr(e)}" for a, e in runs) + "]"


class Alphabet:
    """Word classes by name; a word may be in one class."""

    def __init__(self, classes: dict[str, str]):
        self.names = ["", *classes]
        self.of = {w: i for i, words in enumerate(classes.values(), 1) for w in words.split()}

    def word(self, *classes: str, shapes: tuple[int, ...] = tuple(range(SHAPES))) -> str:
        """Codes of words of these classes, or of all without a name, written in one of these ways."""
        of = [self.names.index(c) for c in classes] or range(len(self.names))
        return one_of(_WORDS + SHAPES * c + s for c in of for s in shapes)

    def standing(self, classes: Iterable[str]) -> str:
        """A pattern for texts in small letters in which a word of these classes stands as a token."""
        numbers = {self.names.index(c) for c in classes}
        return f"(?<!{_IN_WORD})(?:{'|'.join(w for w, i in self.of.items() if i in numbers)})(?!{_IN_WORD})"


def number(*lengths: int) -> str:
    """Codes of digit runs of these lengths; of any length without one."""
    return one_of(_DIGITS + min(n, _MOST) for n in lengths or range(1, _MOST + 1))


BLANK, ONE_BLANK, LINE, SPACE = f"[{_ONE}{_SEVERAL}]", _ONE, f"[{_ONE}{_SEVERAL}{_BREAK}]", f"[{_ONE}{_SEVERAL}{_BREAK}{_ELSE}]"
BREAK = _BREAK


class Rule(NamedTuple):
    """Codes that stand before a value, the value's, and those that follow it. Of the value's text, what `check` matches counts, if it does.

    No match is without a word of the classes in `needs`, if it names any.
    """

    before: str
    value: str
    after: str = ""
    check: str = ""
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        return f"({self.before})({self.value}){self.after}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def codes(found: Column, alphabet: Alphabet) -> Column:
    """The code of each token, as one string. A map is looked through from its start, a set isn't, so most words never get to the map."""
    classes = F.create_map(*(F.lit(x) for pair in alphabet.of.items() for x in pair))
    letters = F.lit("".join(chr(_WORDS + i) for i in range(SHAPES * len(alphabet.names))))

    def one(t: Column) -> Column:
        shape = F.lit(OTHER)
        for s, pattern in reversed(list(enumerate(_SHAPED))):
            shape = F.when(F.rlike(t, F.lit(pattern)), s).otherwise(shape)
        word = let(F.lower(t), lambda low: F.substring(letters, SHAPES * F.when(low.isin(*alphabet.of), F.try_element_at(classes, low)).otherwise(0) + shape + 1, F.lit(1)))
        digits = F.substring(F.lit("".join(chr(_DIGITS + i) for i in range(_MOST + 1))), F.least(F.length(t), F.lit(_MOST)) + 1, F.lit(1))
        blank = F.when(F.length(t) == 1, F.when(t == "\t", _SEVERAL).otherwise(_ONE)).otherwise(_SEVERAL)
        return F.when(t == " ", _ONE).when(t.isin(*_SIGNS), t).when(F.rlike(t, F.lit(r"\A[\p{L}\p{M}_]")), word).when(F.rlike(t, F.lit(r"\A\d")), digits).when(F.rlike(t, F.lit(r"\A[ \t\u00a0\u202f]")), blank).when(F.rlike(t, F.lit(r"\A[\r\n]")), _BREAK).when(F.rlike(t, F.lit(r"(?U)\A\s")), _ELSE).when(F.rlike(t, F.lit(r"\A\p{Co}")), "\ufffd").otherwise(t)

    return F.array_join(F.transform(found, one), "")


#: Tokens that one step of the fold over their lengths takes together.
_STEP = 256


def begins(found: Column) -> Column:
    """Where each token begins, and at last where the text ends."""
    zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))
    add = lambda a, t: let(a["at"] + F.length(t), lambda e: F.struct(e.alias("at"), F.concat(a["out"], F.array(e)).alias("out")))
    fresh = lambda a: F.struct(a["at"].alias("at"), F.array().cast("array<int>").alias("out"))
    many = lambda a, part: let(F.aggregate(part, fresh(a), add), lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], x["out"]).alias("out")))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / _STEP).cast("int")), lambda i: F.slice(found, i * _STEP + 1, F.lit(_STEP)))
    return F.aggregate(parts, zero, many, lambda a: a["out"])


def find_tokens(text: Column, rules: dict[str, tuple[Rule, ...]], alphabet: Alphabet) -> Column:
    """Ranges of all matches of the rules in a text, with the number of the rule's name as `kind`."""
    kinds = "array<struct<kind:int,start:int,end:int>>"

    def placed(ranges: Column, kind: int, check: str, at: Callable[[Column], Column]) -> Column:
        where = lambda r: F.struct(F.lit(kind).alias("kind"), at(r["start"]).alias("start"), at(r["end"]).alias("end"))
        out = F.transform(ranges, where)
        if check:
            kept = lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), (r["start"] + F.length(F.regexp_extract(piece(text, r["start"], r["end"]), check, 0))).alias("end"))
            out = F.filter(F.transform(out, kept), lambda r: r["end"] > r["start"])
        return out.cast(kinds)

    def of_tokens(found: Column) -> Column:
        def of_codes(code: Column) -> Column:
            flat = [(i, r) for i, rs in enumerate(rules.values()) for r in rs]
            hits = F.array(*(find(code, F.lit(r.java), marks=False).cast(RANGES) for _, r in flat))
            every = lambda h, at: F.concat(*(placed(F.get(h, F.lit(j)), i, r.check, at) for j, (i, r) in enumerate(flat)))
            # In few tokens, the length of what stands before a token costs less than a fold over all of them.
            before = lambda i: F.length(F.array_join(F.slice(found, 1, i), ""))
            given = lambda h: F.when(F.size(found) <= _STEP, every(h, before)).otherwise(let(begins(found), lambda at: every(h, lambda i: F.get(at, i))))
            return let(hits, lambda h: F.when(F.exists(h, lambda x: F.size(x) > 0), given(h)).otherwise(F.array().cast(kinds)))

        return let(codes(found, alphabet), of_codes)

    return let(tokens(text), of_tokens)
