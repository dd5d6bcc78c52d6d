"""Where a document's values stand in its blocks: one trie of values, walked once along each block."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that count as white space, as in the SQL functions' patterns (fixed values of Unicode's White_Space).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{SPACES}]+")
_MARKS = {"Mn", "Mc", "Me", "Nd", "Nl", "Pc"}


def in_word(c: str) -> bool:
    """Whether a character goes on with a word: letters, marks, decimal digits, connectors."""
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind in _MARKS or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ"


def _edge(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def places(text: str, values: list[str]) -> Iterator[tuple[int, int, int]]:
    """Begin, end and number of each place of the values, by value and place.

    White space counts as one space, whatever and however much it is. A value that begins or ends with a
    letter or digit stands only where no word goes on there. Places of one value don't overlap.
    """
    trie, known = ahocorasick.Automaton(), {}
    for i, v in enumerate(values):
        known.setdefault(" ".join(_WORD.findall(v)), []).append(i)
    for v, numbers in known.items():
        if v:
            trie.add_word(v, (len(v), _edge(v[0]), _edge(v[-1]), numbers))
    if not len(trie):
        return
    trie.make_automaton()
    words = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    plain = " ".join(w for _, w in words)
    starts, at = [], 0
    for _, w in words:
        starts.append(at)
        at += len(w) + 1
    origin = lambda i: words[k := bisect_right(starts, i) - 1][0] + i - starts[k]
    found: list[list[tuple[int, int]]] = [[] for _ in values]
    for last, (n, left, right, numbers) in trie.iter(plain):
        a, b = last - n + 1, last + 1
        if (left and a and in_word(plain[a - 1])) or (right and b < len(plain) and in_word(plain[b])):
            continue
        where = origin(a), origin(last) + 1
        for i in numbers:
            if not found[i] or where[0] >= found[i][-1][1]:
                found[i].append(where)
    for i, spans in enumerate(found):
        yield from ((a, b, i) for a, b in spans)


class Taken:
    """Disjoint spans, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(a for a, _ in spans)
        self.ends = sorted(b for _, b in spans)

    def add(self, a: int, b: int) -> bool:
        """Take a span, if it overlaps none."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def free_places(blocks: DataFrame) -> DataFrame:
    """Of blocks (doc_id, block_ord, text, taken, values), the values' places that are free: doc_id, block_ord, more.

    `taken` are disjoint ranges (start, end), `values` (value, entity_type, confidence) in the order in which
    they may take a place; `more` has start, end, entity_type and confidence.
    """
    more = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, taken, values in zip(*(b.column(c).to_pylist() for c in ("text", "taken", "values")), strict=True):
                held = Taken([(t["start"], t["end"]) for t in taken])
                out.append([{"start": s, "end": e, "entity_type": values[i]["entity_type"], "confidence": values[i]["confidence"]} for s, e, i in places(text, [v["value"] for v in values]) if held.add(s, e)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block_ord"), pa.array(out, more)], names=["doc_id", "block_ord", "more"])

    kinds = dict(blocks.dtypes)
    return blocks.select("doc_id", "block_ord", "text", "taken", "values").mapInArrow(run, f"doc_id {kinds['doc_id']}, block_ord {kinds['block_ord']}, more array<struct<start:int,end:int,entity_type:string,confidence:double>>")
