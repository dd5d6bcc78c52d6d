"""Sampled segmentations with a SentencePiece vocabulary: forward filtering and backward sampling, and lossless decoding.

A text's lattice has an edge for each piece that fits a place. Spaces stand before words, and no piece goes
on after a letter into a space, so the lattice falls into words. Forward sums are computed once for each
distinct word of a batch; backward sampling runs for all its occurrences at once. The random numbers are a
hash of seed, row key, word number and step, so a row's segmentation does not depend on its partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, texts, tune

#: The sign for a space in pieces, and what stands for that sign if a text has it.
SPACE, LITERAL = 0x2581, 0x110000
#: Log weight of one byte of a character that has no piece.
BYTE_WEIGHT = -12.0
SLOTS, PREFIX, NOTHING = 1 << 20, -1, -2

_UNIT = re.compile(r" *[^ ]+| +", re.S)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a model file with log weights, found by hashes of their characters."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.text, usable = np.zeros(256, dtype=np.int64), [b""] * model.get_piece_size(), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable.append(i)
                self.text[i] = piece.replace("▁", " ").encode()
        pieces = {i: np.frombuffer(model.id_to_piece(i).encode("utf-32-le"), dtype=np.uint32) for i in usable}
        self.longest = max(map(len, pieces.values()))
        # Scores of BPE files are ranks below zero; those of unigram files are log probabilities.
        scores = {i: model.get_score(i) for i in usable}
        ranks = min(scores.values()) < -1000
        self.weight = np.zeros(len(self.text))
        self.weight[usable] = [alpha * (-np.log(2 - scores[i]) if ranks else scores[i]) for i in usable]
        hashes: dict[int, int] = {}
        for i, p in pieces.items():
            h = 0
            for c in p.tolist():
                h = (h * int(_MUL) + c + 1) & 0xFFFFFFFFFFFFFFFF
                hashes.setdefault(h, PREFIX)
            hashes[h] = i
        self.keys, self.ids, self.probes = np.zeros(SLOTS, dtype=np.uint64), np.full(SLOTS, NOTHING, dtype=np.int32), 1
        places = self.place(np.array(list(hashes), dtype=np.uint64))
        for at, (h, i) in zip(places.tolist(), hashes.items(), strict=True):
            n = 1
            while self.ids[at] != NOTHING:
                at, n = (at + 1) % SLOTS, n + 1
            self.keys[at], self.ids[at], self.probes = h, i, max(self.probes, n)

    @staticmethod
    def place(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * _MUL >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; PREFIX where one only begins so, NOTHING where none does."""
        at = self.place(h)
        out = self.ids[at]
        left = np.flatnonzero((out != NOTHING) & (self.keys[at] != h))
        while len(left):
            at[left] = (at[left] + 1) % SLOTS
            out[left] = self.ids[at[left]]
            left = left[(out[left] != NOTHING) & (self.keys[at[left]] != h[left])]
        return out


class Lattice:
    """Edges of many words, by the node they end in, with their probabilities given that node."""

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary):
        """`chars` holds the words' characters one word after the other, `sizes` their numbers."""
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        chars = chars.astype(np.uint64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        node = np.arange(len(chars)) + word
        room = self.last[word] - node
        start, end, ids = [], [], []
        alive, h = np.arange(len(chars)), np.zeros(len(chars), dtype=np.uint64)
        for length in range(1, vocabulary.longest + 1):
            keep = room[alive] >= length
            alive, h = alive[keep], h[keep]
            if not len(alive):
                break
            h = h * _MUL + chars[alive + length - 1] + np.uint64(1)
            found = vocabulary.find(h)
            if length == 1:
                lone = np.flatnonzero(found < 0)
                start.append(node[lone])
                end.append(node[lone] + 1)
                ids.append(-chars[lone].astype(np.int64) - 1)
            hit = np.flatnonzero(found >= 0)
            start.append(node[alive[hit]])
            end.append(node[alive[hit]] + length)
            ids.append(found[hit].astype(np.int64))
            more = found != NOTHING
            alive, h = alive[more], h[more]
        start, end, ids = np.concatenate(start), np.concatenate(end), np.concatenate(ids)
        depth = np.arange(int(self.last[-1]) + 1) - np.repeat(self.first, sizes + 1)
        order = np.argsort(depth[end] * len(depth) + end, kind="stable")
        start, end, ids = start[order], end[order], ids[order]
        code = -ids - 1
        n_bytes = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + ((code > 0xFFFF) & (code != LITERAL))
        weight = np.where(ids >= 0, vocabulary.weight[np.maximum(ids, 0)], BYTE_WEIGHT * n_bytes)
        total = np.zeros(len(depth))
        value = np.zeros(len(end))
        cuts = np.searchsorted(depth[end], np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            v = total[start[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
            most = np.maximum.reduceat(v, heads)
            counts = np.diff(np.append(heads, b - a))
            sums = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, counts)), heads))
            total[end[a:b][heads]] = sums
            value[a:b] = v - np.repeat(sums, counts)
        heads = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(heads, len(end)))
        self.start, self.ids = start, ids
        self.low, self.high, self.rank = (np.zeros(len(depth), dtype=np.int64) for _ in range(3))
        self.low[end[heads]], self.high[end[heads]], self.rank[end[heads]] = heads, heads + counts - 1, np.arange(len(heads))
        share = np.exp(value)
        within = np.cumsum(share)
        within -= np.repeat(within[heads] - share[heads], counts)
        self.cumulated = within + np.repeat(np.arange(len(heads)), counts)

    def sample(self, word: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each occurrence's pieces, one occurrence after the other, and how many each has."""
        at, live = self.last[word].copy(), np.arange(len(word))
        number, step = np.zeros(len(word), dtype=np.int64), 0
        who, got = [], []
        while len(live):
            u = (mix(seeds[live] + np.uint64(step * int(_MUL) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            node = at[live]
            e = np.clip(np.searchsorted(self.cumulated, self.rank[node] + u, side="right"), self.low[node], self.high[node])
            who.append(live)
            got.append(self.ids[e])
            number[live] += 1
            at[live] = self.start[e]
            live = live[at[live] > self.first[word[live]]]
            step += 1
        offset = np.cumsum(number) - number
        out = np.zeros(int(number.sum()), dtype=np.int64)
        for s, (w, ids) in enumerate(zip(who, got, strict=True)):
            out[offset[w] + number[w] - 1 - s] = ids
        return out, number


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    return _vocabularies.get((path, alpha)) or _vocabularies.setdefault((path, alpha), Vocabulary(path, alpha))


def encode(rows: list[str], keys: list[int], vocab: Vocabulary, seed: int) -> list[np.ndarray]:
    """Sampled ids of each text, in the order of the texts. An empty text has none."""
    kinds: dict[str, int] = {}
    split = [_UNIT.findall(f" {t}") if t else [] for t in rows]
    word = np.array([kinds.setdefault(w, len(kinds)) for ws in split for w in ws], dtype=np.int64)
    if not len(word):
        return [np.zeros(0, dtype=np.int64) for _ in rows]
    chars = np.frombuffer("".join(kinds).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.where(chars == 32, SPACE, np.where(chars == SPACE, LITERAL, chars))
    lengths = np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds))
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    base = mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], dtype=np.uint64) + np.uint64(seed * int(_MUL) & 0xFFFFFFFFFFFFFFFF))
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids, number = Lattice(chars, lengths, vocab).sample(word, mix(np.repeat(base, sizes) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    owner = np.repeat(np.repeat(np.arange(len(rows)), sizes), number)
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        spelled = [vocab.bytes[list(chr(SPACE if -i - 1 == LITERAL else -i - 1).encode("utf-8", "surrogatepass"))] for i in ids[lone].tolist()]
        more = np.ones(len(ids), dtype=np.int64)
        more[lone] = [len(x) for x in spelled]
        at = (np.cumsum(more) - more)[lone]
        owner, ids = np.repeat(owner, more), np.repeat(ids, more)
        ids[np.concatenate([np.arange(i, i + len(x)) for i, x in zip(at.tolist(), spelled, strict=True)])] = np.concatenate(spelled)
    counts = np.bincount(owner, minlength=len(rows))
    return np.split(ids, np.cumsum(counts)[:-1])


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; the space before the first word goes."""
    return b"".join(map(vocab.text.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model: str, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """k, ids, and decoded: a sampled segmentation of each text and what it decodes to. A null text is as an empty one; a null key counts as 0."""
    tune(docs.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for b in batches:
            rows, keys = [t or "" for t in b.column("t").to_pylist()], b.column("k").to_pylist()
            found = encode(rows, [k or 0 for k in keys], vocab, seed) if rows else []
            yield batch(schema, k=keys, ids=[x.astype(np.int32) for x in found], decoded=[decode(x, vocab) for x in found])

    return texts(docs, key, text).mapInArrow(run, "k long, ids array<int>, decoded string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model: str, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """k, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_chars and lossless (whether decoding gave the text)."""
    tune(docs.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("n_chars", pa.int64()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for b in batches:
            rows, keys = [t or "" for t in b.column("t").to_pylist()], b.column("k").to_pylist()
            found = encode(rows, [k or 0 for k in keys], vocab, seed) if rows else []
            yield batch(schema, k=keys, n_pieces=[len(x) for x in found], ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in found], n_chars=[len(t) for t in rows], lossless=[decode(x, vocab) == t for x, t in zip(found, rows, strict=True)])

    return texts(docs, key, text).mapInArrow(run, "k long, n_pieces long, ids_crc32 long, n_chars long, lossless boolean")
