"""Fill-in-the-middle forms of texts, cut by an automaton over their bytes.

The automaton's table tells for each state and class of bytes the next state and what the byte begins or
ends: a unit (white space with the run behind it), a code point (any byte but UTF-8 continuation), a
sentinel. It is made from the sentinels' prefixes and then made minimal. A batch's texts are one run of
bytes, dealt to lanes that step together; a lane is stepped from every state, and which of them is the true
one is known once the lanes before it have ended. So one scan gives all counts, however long a text is, and
a second pass over the units' places locates the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, tune

#: The strings before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UNIT, POINT, SENTINEL = 1, 2, 4
#: Bytes that are scanned at once.
PIECE = 4 << 20


class Automaton:
    """Classes of bytes, and by state and class the next state and the marks of a byte.

    A class counts twice: bytes that begin a text are in the second half and leave every state alike.
    """

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode() for s in sentinels]
        if any(not w or set(w) & set(SPACES) for w in words):
            raise ValueError("a sentinel must have characters, and none of them white space")
        letters = sorted(set(b"".join(words)))
        # Classes: white space, continuation bytes, any others, and each byte of a sentinel.
        self.classes = np.full(256, 2, dtype=np.uint8)
        self.classes[0x80:0xC0] = 1
        self.classes[list(SPACES)] = 0
        self.classes[letters] = np.arange(3, 3 + len(letters))
        self.n = 3 + len(letters)
        # States: white space, and the longest sentinel prefix that the text ends with.
        prefixes = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))
        states: list[bytes | None] = [None, *prefixes]

        def after(prefix: bytes, byte: int) -> bytes:
            whole = prefix + bytes([byte])
            return next(whole[i:] for i in range(len(whole) + 1) if whole[i:] in prefixes)

        step, marks = np.zeros((len(states), self.n), dtype=np.int64), np.zeros((len(states), self.n), dtype=np.uint8)
        for s, prefix in enumerate(states):
            step[s], marks[s] = states.index(b""), POINT
            step[s, 0], marks[s, 0] = 0, POINT | (UNIT if prefix is not None else 0)
            marks[s, 1] = 0
            for c, byte in enumerate(letters, 3):
                ended = after(prefix or b"", byte)
                step[s, c] = states.index(ended)
                marks[s, c] = (0 if 0x80 <= byte < 0xC0 else POINT) | (SENTINEL if any(ended.endswith(w) for w in words) else 0)
        step, marks = _minimal(step, marks)
        # A text's first byte is as after white space, and begins a unit whatever it is.
        first = np.tile(step[0], (len(step), 1)), np.tile(marks[0] | UNIT, (len(step), 1))
        self.states = len(step)
        self.step, self.marks = np.hstack([step, first[0]]), np.hstack([marks, first[1]])
        if self.states * 2 * self.n > 0xFFFF:
            raise ValueError("the sentinels are too long")

    def scan(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The marks of all bytes; texts begin at `starts`."""
        out, state = np.empty(len(data), dtype=np.uint8), 0
        for at in range(0, len(data), PIECE):
            here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + PIECE)] - at
            out[at : at + PIECE], state = self._piece(data[at : at + PIECE], here, state)
        return out

    def _piece(self, data: np.ndarray, starts: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        n, k = len(data), 2 * self.n
        width = max(32, int(n**0.5) // 2)
        lanes = -(-n // width)
        kinds = np.full(lanes * width, 2, dtype=np.uint16)
        kinds[:n] = self.classes[data]
        kinds[starts] += self.n
        kinds = np.ascontiguousarray(kinds.reshape(lanes, width).T)
        ahead, marks = (self.step * k).astype(np.uint16).ravel(), self.marks.ravel()
        now = np.repeat(np.arange(self.states, dtype=np.uint16) * np.uint16(k), lanes).reshape(self.states, lanes)
        seen = np.empty((width, self.states, lanes), dtype=np.uint8)
        stop, last = None, (n - 1) % width
        for i in range(width):
            at = now + kinds[i]
            np.take(marks, at, out=seen[i], mode="clip")
            now = np.take(ahead, at)
            if i == last:
                stop = now[:, -1].copy()
        ends, true = (now // k).T.tolist(), []
        for end in ends:
            true.append(state)
            state = end[state]
        chosen = seen[:, np.array(true), np.arange(lanes)]
        return np.ascontiguousarray(chosen.T).ravel()[:n], int(stop[true[-1]]) // k


def _minimal(step: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table with states that nothing can tell apart as one; state 0 stays 0."""
    group = np.zeros(len(step), dtype=np.int64)
    while True:
        rows = [(tuple(marks[s]), tuple(group[step[s]])) for s in range(len(step))]
        known: dict[tuple, int] = {}
        new = np.array([known.setdefault(r, len(known)) for r in rows])
        if len(known) == len(set(group.tolist())):
            break
        group = new
    one = [int(np.flatnonzero(new == g)[0]) for g in range(len(known))]
    return new[step[one]], marks[one]


@lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


def draws(key: Column, seed: int, many: int) -> list[Column]:
    """Unsigned 32-bit numbers from the sha256 of seed and key; a null key hashes as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(many)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """k, n (units), form, prefix_chars, middle_chars and output of each row.

    Two draws from the key cut a text between units into prefix, middle and suffix. `rate` of 100 texts are
    changed: `spm_rate` of 100 of these put the suffix first (spm), the others the prefix (psm). Empty and
    null texts and those that hold a sentinel stay plain, with null counts. Rows that repeat a key get the
    same draws; of rows without a key all do.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton(tuple(sentinels))
        before, behind, inside = (s.encode() for s in sentinels)
        for b in batches:
            whole = b.column("t").cast(pa.large_binary())
            offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
            offsets = offsets - offsets[0]
            marks = table.scan(data, offsets[:-1][np.diff(offsets) > 0])
            units, ends = np.flatnonzero(marks & UNIT), np.flatnonzero(marks & SENTINEL)
            first = np.searchsorted(units, offsets)
            n, marked = np.diff(first), np.diff(np.searchsorted(ends, offsets)) > 0
            u = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
            one, two = u[0] % (n + 1), u[1] % (n + 1)
            plain = (n == 0) | marked | (u[2] % 100 >= rate)
            places = np.append(units, len(data))
            rows = []
            for i in range(len(n)):
                start, stop = int(offsets[i]), int(offsets[i + 1])
                if plain[i]:
                    rows.append((int(n[i]), "plain", None, None, data[start:stop].tobytes()))
                    continue
                a, c = (int(places[first[i] + x]) if x < n[i] else stop for x in sorted((one[i], two[i])))
                parts = [data[x:y].tobytes() for x, y in ((start, a), (a, c), (c, stop))]
                spm = u[3][i] % 100 < spm_rate
                joined = (behind, parts[2], before, parts[0], inside, parts[1]) if spm else (before, parts[0], behind, parts[2], inside, parts[1])
                points = [int(np.count_nonzero(marks[x:y] & POINT)) for x, y in ((start, a), (a, c))]
                rows.append((int(n[i]), "spm" if spm else "psm", *points, b"".join(joined)))
            yield batch(schema, k=b.column("k"), **dict(zip(schema.names[1:], zip(*rows, strict=True) if rows else [()] * 5, strict=True)))

    one = F.col(f"`{key}`").cast("long")
    own = docs.select(one.alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), *(h.alias(f"h{i}") for i, h in enumerate(draws(one, seed, 4), 1)))
    found = own.mapInArrow(run, "k long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was put into a form. Sentinels can stand only where they were put, since no other text was changed."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    joined = lambda *places: F.concat(*(F.get(parts, F.lit(i)) for i in places))
    order = F.when(form == "spm", joined(2, 3, 1)).otherwise(joined(1, 3, 2))
    return F.when(form == "plain", output).otherwise(order)
