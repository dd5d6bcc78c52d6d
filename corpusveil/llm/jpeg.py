"""Progressive JPEG: a decoder to full-resolution RGB tensors, and a lossless store of bytes as coefficients.

The decoder accumulates the scans of a file (spectral selection and successive approximation, with restart
intervals) into coefficient arrays, inverts the transform with numpy, repeats chroma to full resolution and
converts to RGB. Restart intervals of all files of a batch are decoded side by side, one symbol of each at a time.

The store puts each byte of a payload into a quantised coefficient (quantiser 1, 4:2:0, values 2 to 129 of
either sign, small ones for bytes that are frequent in texts), so decoding the coefficients gives the bytes back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, texts, tune

#: MCUs, or blocks of a one-component scan, in a restart interval of stored payloads; most MCU rows of an image.
INTERVAL, MOST_ROWS = 8, 4000
#: Payloads that are coded together, in bytes.
TOGETHER = 4 << 20
UNIT = 576

#: Places of the zigzag order in a block, by rows.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)), dtype=np.int64)
#: The inverse transform's basis in units of 2^-11: whole numbers, so that sums are exact in any order.
BASIS = np.round(2048 * np.array([[(0.5**0.5 if u == 0 else 1) * 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))
#: Scans of a stored payload: components, band, and bit positions before and after.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0, 1, 2), 0, 0, 1, 0))
#: Huffman tables of stored payloads: numbers of codes by length, symbols.
DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
AC_TABLE = (bytes([0, 3, 1, 1, 1, 1, 1] + [0] * 9), bytes([2, 3, 1, 4, 5, 6, 7, 0]))
#: Bytes from the most frequent one; the others follow in natural order. Byte number r has the magnitude 2 + r // 2, and a minus sign if r is odd.
FREQUENT = b"\xff etnaoirshldcupm\xc3gfyvwb\xa9.,\n-'qkxjz"
RANKED = np.frombuffer(FREQUENT + bytes(x for x in range(256) if x not in FREQUENT), dtype=np.uint8)
VALUE = np.zeros(256, dtype=np.int64)
VALUE[RANKED] = (2 + np.arange(256) // 2) * np.where(np.arange(256) % 2, -1, 1)
#: The byte of each coefficient from -129 to 129.
BYTE = np.zeros(259, dtype=np.uint8)
BYTE[VALUE + 129] = np.arange(256)


def codes(table: tuple[bytes, bytes]) -> list[tuple[int, int, int]]:
    """Code, length and symbol of a Huffman table's entries."""
    out, code, at = [], 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out.append((code, length, table[1][at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=256)
def decoding_table(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits: the length of the code they begin with times 256, plus its symbol; 0 if there is none."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for code, length, symbol in codes(table):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@lru_cache(maxsize=64)
def value_table(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits: 64 times the value that follows a code without a run of zeros, plus the bits of both; 0 for all else."""
    found, bits = decoding_table(table), np.arange(1 << 16, dtype=np.int64)
    length, size = found >> 8, found & 255
    plain = (size > 0) & (size < 16) & (length + size <= 16)
    size = np.where(plain, size, 1)
    raw = (bits >> np.where(plain, 16 - length - size, 0)) & ((1 << size) - 1)
    value = np.where(raw < (1 << (size - 1)), raw - (1 << size) + 1, raw)
    return np.where(plain, value * 64 + length + size, 0).astype(np.int32)


def pack_bits(values: np.ndarray, lengths: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    """The bits of each segment as bytes, filled up with ones. Values of at most 57 bits come in order of their segments."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    bits = np.diff(ends[np.searchsorted(segment, np.arange(n), side="right") - 1], prepend=0) if len(values) else np.zeros(n, dtype=np.int64)
    words = (bits + 63) // 64
    base = np.cumsum(words) - words
    at = ends - lengths + (64 * base - np.cumsum(bits) + bits)[segment]
    shift = 64 - (at & 63) - lengths
    whole = np.zeros(int(words.sum()) + 2, dtype=np.uint64)
    over = shift < 0
    high = np.where(over, values >> np.where(over, -shift, 0).astype(np.uint64), values << np.where(over, 0, shift & 63).astype(np.uint64))
    place = at >> 6
    if len(values):
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        whole[place[first]] = np.bitwise_or.reduceat(high, first)
        spill = np.flatnonzero(over)
        whole[place[spill] + 1] |= values[spill] << (64 + shift[spill]).astype(np.uint64)
    fill = -bits % 8
    some = np.flatnonzero(fill)
    whole[base[some] + (bits[some] >> 6)] |= ((1 << fill[some]) - 1).astype(np.uint64) << (64 - (bits[some] & 63) - fill[some]).astype(np.uint64)
    data = whole.astype(">u8").tobytes()
    return [data[8 * b : 8 * b + (k + 7) // 8] for b, k in zip(base.tolist(), bits.tolist(), strict=True)]


def joined(values: np.ndarray, lengths: np.ndarray, many: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Values of `many` columns each as one value of their lengths' sum; the last columns may be fewer."""
    out_v, out_l = [], []
    for i in range(0, values.shape[1], many):
        v, n = values[:, i], lengths[:, i]
        for j in range(i + 1, min(i + many, values.shape[1])):
            v, n = v << lengths[:, j] | values[:, j], n + lengths[:, j]
        out_v.append(v)
        out_l.append(n)
    return np.stack(out_v, axis=1), np.stack(out_l, axis=1)


def grid(payload_bytes: int) -> tuple[int, int]:
    """MCU columns and rows of a payload's image."""
    mcus = max(1, -(-payload_bytes // 384))
    columns = -(-mcus // MOST_ROWS)
    return columns, -(-mcus // columns)


def mcu_order(columns: int, rows: int) -> np.ndarray:
    """Luma blocks (by rows of the whole component) in the order of MCUs, four each."""
    y, x = np.divmod(np.arange(columns * rows), columns)
    return ((2 * y[:, None] + np.array([0, 0, 1, 1])) * 2 * columns + 2 * x[:, None] + np.array([0, 1, 0, 1])).reshape(-1)


def _size(x: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.where(x > 0, np.frexp(np.maximum(x, 1).astype(np.float64))[1], 0).astype(np.int64)


def _signed_bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x + (1 << size) - 1, x)


def _first_bits() -> tuple[np.ndarray, np.ndarray]:
    """By byte: the code and value of its coefficient without the last bit, and their length."""
    ac = {symbol: (code, length) for code, length, symbol in codes(AC_TABLE)}
    high = np.sign(VALUE) * (np.abs(VALUE) >> 1)
    size = _size(np.abs(high))
    code, length = (np.array([ac[int(x)][i] for x in size], dtype=np.int64) for i in (0, 1))
    return (code << size | _signed_bits(high, size)).astype(np.uint64), (length + size).astype(np.uint64)


_FIRST = _first_bits()
_LAST = (np.abs(VALUE) & 1).astype(np.uint8)
_END = next((code, length) for code, length, symbol in codes(AC_TABLE) if symbol == 0)


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload."""
    grids = [grid(len(p)) for p in payloads]
    mcus = np.array([c * r for c, r in grids], dtype=np.int64)
    parts: list[list[np.ndarray]] = [[], [], []]
    for p, m in zip(payloads, mcus.tolist(), strict=True):
        raw = np.full(384 * m, 255, dtype=np.uint8)
        raw[: len(p)] = np.frombuffer(p, dtype=np.uint8)
        raw = raw.reshape(-1, 64)
        for c, (a, b) in enumerate(((0, 4 * m), (4 * m, 5 * m), (5 * m, 6 * m))):
            parts[c].append(raw[a:b])
    blocks = [np.concatenate(x) for x in parts]
    counts = [4 * mcus, mcus, mcus]
    dc = {s: (c, n) for c, n, s in codes(DC_TABLE)}
    dc_code, dc_len = (np.array([dc[s][i] for s in range(12)], dtype=np.int64) for i in (0, 1))

    def segments(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment of each unit, and segments of each payload."""
        n = -(-per // INTERVAL)
        owner = np.repeat(np.arange(len(per)), per)
        within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        return (np.cumsum(n) - n)[owner] + within // INTERVAL, n

    ends = [np.cumsum(c) - c for c in counts]
    luma = np.concatenate([mcu_order(c, r) + a for (c, r), a in zip(grids, ends[0].tolist(), strict=True)])
    dcs = VALUE[np.concatenate([blocks[0][luma, 0].reshape(-1, 4), blocks[1][:, :1], blocks[2][:, :1]], axis=1)]
    scans: list[list[bytes]] = [[] for _ in payloads]
    for comps, ss, se, ah, al in SCANS:
        if ss == 0:
            seg, n = segments(mcus)
            if ah:
                values, lengths = joined((dcs & 1).astype(np.uint64), np.ones(dcs.shape, dtype=np.uint64), 6)
            else:
                high = dcs >> al
                first = np.append(True, seg[1:] != seg[:-1])
                before = np.empty_like(high)
                before[:, 1:4] = high[:, 0:3]
                for k, last in ((0, 3), (4, 4), (5, 5)):
                    before[1:, k] = high[:-1, last]
                    before[first, k] = 0
                diff = high - before
                size = _size(np.abs(diff))
                values, lengths = joined((dc_code[size] << size | _signed_bits(diff, size)).astype(np.uint64), (dc_len[size] + size).astype(np.uint64), 3)
        else:
            seg, n = segments(counts[comps[0]])
            band = blocks[comps[0]][:, ss : se + 1]
            if ah:
                bits = np.zeros((len(band), 64), dtype=np.uint8)
                bits[:, 64 - band.shape[1] :] = _LAST[band]
                word = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
                values = np.concatenate([np.full((len(band), 1), _END[0], dtype=np.uint64), word >> np.uint64(31), word & np.uint64((1 << 31) - 1)], axis=1)
                lengths = np.tile(np.array([_END[1], band.shape[1] - 31, 31], dtype=np.uint64), (len(band), 1))
            else:
                values, lengths = joined(_FIRST[0][band], _FIRST[1][band])
        got = pack_bits(values.reshape(-1), lengths.reshape(-1), np.repeat(seg, values.shape[1]), int(n.sum()))
        head = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps)) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([ss, se, ah << 4 | al])
        at = 0
        for out, k in zip(scans, n.tolist(), strict=True):
            out.append(head + b"".join(x for i, part in enumerate(got[at : at + k]) for x in ((bytes([255, 0xD0 + (i - 1) % 8]) if i else b""), part.replace(b"\xff", b"\xff\x00"))))
            at += k
    tables = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64 + b"".join(b"\xff\xc4" + struct.pack(">HB", 19 + len(s), kind) + n + s for kind, (n, s) in ((0, DC_TABLE), (16, AC_TABLE))) + b"\xff\xdd" + struct.pack(">HH", 4, INTERVAL)
    return [b"\xff\xd8\xff\xfe" + struct.pack(">HQ", 10, len(p)) + struct.pack(">BBHBHHB", 255, 0xC2, 17, 8, 16 * r, 16 * c, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]) + tables + b"".join(x) + b"\xff\xd9" for p, (c, r), x in zip(payloads, grids, scans, strict=True)]


@dataclass
class Image:
    """A file's frame, tables and, by component, coefficients in zigzag order (blocks by rows of the padded component)."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quantisers: list[np.ndarray] = field(default_factory=list)
    shape: list[tuple[int, int]] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)

    def used(self, c: int) -> tuple[int, int]:
        """Block columns and rows that a scan of one component has."""
        h, v = self.sampling[c]
        most = max(x for x, _ in self.sampling), max(y for _, y in self.sampling)
        return -(-(-(-self.width * h // most[0])) // 8), -(-(-(-self.height * v // most[1])) // 8)


_MARKER = re.compile(b"\xff([\x01-\xcf\xd8-\xfe])", re.S)
_RESTART = re.compile(b"\xff[\xd0-\xd7]")


def read(data: bytes) -> Image:
    """Frame, tables and the scans' restart intervals of a progressive file."""
    image, at, tables, quantisers, ids, interval, chosen = Image(), 2, {}, {}, [], 0, []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                k = sum(body[1:17])
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + k]))
                body = body[17 + k :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xC2:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                ids.append(c)
                image.sampling.append((hv >> 4, hv & 15))
                chosen.append(q)
            across, down = (-(-x // (8 * max(s[i] for s in image.sampling))) for i, x in enumerate((image.width, image.height)))
            image.shape = [(across * h, down * v) for h, v in image.sampling]
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("not a progressive JPEG file")
        elif kind == 0xDA:
            comps = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
            picks = [body[2 + 2 * i] for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = m.start() if (m := _MARKER.search(data, at)) else len(data)
            parts = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:end])]
            at = end
            used = tuple(tables.get(16 + p & 15 | 16 if ss else p >> 4) for p in picks)
            image.scans.append((tuple(comps), ss, se, a >> 4, a & 15, used, interval, parts))
    image.quantisers = [quantisers[q] for q in chosen]
    return image


class Bits:
    """The bits of many segments in one array; positions are bit numbers."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) + 8 for p in parts], dtype=np.int64)
        self.start = (np.cumsum(sizes) - sizes) * 8
        self.raw = np.frombuffer(b"".join([x for p in parts for x in (p, b"\xff" * 8)]) + b"\xff" * 8, dtype=np.uint8)

    @cached_property
    def words(self) -> np.ndarray:
        """The 64 bits from each byte."""
        return np.lib.stride_tricks.sliding_window_view(self.raw, 8).copy().view(">u8").reshape(-1).astype(np.uint64)

    @cached_property
    def short(self) -> np.ndarray:
        """The 24 bits from each byte."""
        raw = self.raw.astype(np.int32)
        return raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, the first bit on top."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def row(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n bits from each position, as rows of a matrix."""
        many = (n + 14) // 8
        found = np.unpackbits(self.raw[np.minimum((at >> 3)[:, None] + np.arange(many), len(self.raw) - 1)], axis=1)
        out = np.empty((len(at), n), dtype=np.uint8)
        for s in range(8):
            mine = np.flatnonzero((at & 7) == s)
            out[mine] = found[mine, s : s + n]
        return out


def _value(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of `size` bits after `skip` bits."""
    some = size > 0
    raw = ((window << skip.astype(np.uint64)) >> np.where(some, 64 - size, 63).astype(np.uint64)).astype(np.int64)
    return np.where(some, np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw), 0)


def _dc_first(out: np.ndarray, bits: Bits, where: np.ndarray, count: np.ndarray, kinds: list[int], tables: list[np.ndarray], al: int) -> None:
    at, last = bits.start.copy(), np.zeros((len(count), max(kinds) + 1), dtype=np.int64)
    for j in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > j)
        kind = kinds[j % len(kinds)]
        w = bits.window(at[live])
        found = tables[j % len(kinds)][(w >> np.uint64(48)).astype(np.int64)]
        length, size = found >> 8, found & 255
        last[live, kind] += _value(w, length, size)
        at[live] += length + size
        out[where[live, j], 0] = last[live, kind] << al


def _dc_refine(out: np.ndarray, bits: Bits, where: np.ndarray, count: np.ndarray, al: int) -> None:
    for j in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > j)
        out[where[live, j], 0] |= bits.bit(bits.start[live] + j).astype(out.dtype) << al


def _in_step(out: np.ndarray, bits: Bits, where: np.ndarray, count: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decode while every code stands for a value without zeros before it, so that all segments are at the same place of their blocks.

    Returns bit position, block and place of each segment where that ends.
    """
    at, j, k = bits.start.copy(), np.zeros(len(count), dtype=np.int64), np.full(len(count), ss, dtype=np.int64)
    live = np.flatnonzero(count > 0)
    here, block, short = at[live], 0, bits.short
    while len(live):
        rows = where[live, block]
        for place in range(ss, se + 1):
            found = table[(short[here >> 3] >> (8 - (here & 7))) & 0xFFFF]
            if not found.all():
                at[live], j[live], k[live] = here, block, place
                return at, j, k
            out[rows, place] = (found >> 6) << al
            here += found & 63
        block += 1
        at[live], j[live] = here, block
        more = count[live] > block
        live, here = live[more], here[more]
    return at, j, k


def _ac_first(out: np.ndarray, bits: Bits, where: np.ndarray, count: np.ndarray, code: tuple[bytes, bytes], ss: int, se: int, al: int) -> None:
    at, j, k = _in_step(out, bits, where, count, value_table(code), ss, se, al)
    table, live = decoding_table(code), np.flatnonzero(j < count)
    while len(live):
        w = bits.window(at[live])
        found = table[(w >> np.uint64(48)).astype(np.int64)]
        length, run, size = found >> 8, (found >> 4) & 15, found & 15
        if not length.all():
            raise ValueError("a code that no table has")
        end = (size == 0) & (run < 15)
        extra = np.where(run > 0, ((w << length.astype(np.uint64)) >> np.where(run > 0, 64 - run, 63).astype(np.uint64)).astype(np.int64), 0)
        blocks = np.where(end, (1 << run) + extra, 0)
        at[live] += length + np.where(end, run, size)
        place = np.where(end, se + 1, k[live] + run)
        some = np.flatnonzero(size > 0)
        rows = live[some]
        out[where[rows, j[rows]], place[some]] = _value(w[some], length[some], size[some]) << al
        over = place >= se
        k[live] = np.where(over, ss, place + 1)
        j[live] += np.where(end, blocks, over)
        if over.any():
            live = live[j[live] < count[live]]


def _ac_refine(out: np.ndarray, bits: Bits, where: np.ndarray, count: np.ndarray, code: tuple[bytes, bytes], ss: int, se: int, al: int) -> None:
    n, width, table = len(count), se - ss + 1, decoding_table(code)
    at, j, k, rest = bits.start.copy(), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    places = np.arange(width)
    live = np.flatnonzero(count > 0)
    plain = True
    while len(live):
        w = bits.window(at[live])
        if plain:
            # Blocks that end at once and have no zeros: one bit for each place.
            found = table[(w >> np.uint64(48)).astype(np.int64)]
            row = where[live, j[live]]
            band = out[row, ss : se + 1]
            plain = bool(((found & 255) == 0).all() and (found > 0).all() and band.all())
            if plain:
                here = at[live] + (found >> 8)
                more = bits.row(here, width).astype(band.dtype) << al
                out[row, ss : se + 1] = np.where(band > 0, band + more, band - more)
                at[live] = here + width
                j[live] += 1
                live = live[j[live] < count[live]]
                continue
        found = np.where(rest[live] > 0, 0, table[(w >> np.uint64(48)).astype(np.int64)])
        length, run, size = found >> 8, (found >> 4) & 15, found & 15
        ends = (rest[live] == 0) & (size == 0) & (run < 15)
        more = np.where(ends & (run > 0), ((w << length.astype(np.uint64)) >> np.where(run > 0, 64 - run, 63).astype(np.uint64)).astype(np.int64), 0)
        rest[live] += np.where(ends, (1 << run) + more, 0)
        positive = ((w << length.astype(np.uint64)) >> np.uint64(63)).astype(np.int64)
        at[live] += length + np.where(ends, run, size)
        row = where[live, j[live]]
        band = out[row, ss : se + 1]
        open_ = places[None, :] >= k[live][:, None]
        zeros = np.cumsum(open_ & (band == 0), axis=1)
        whole = rest[live] > 0
        target = np.where(whole, width, (zeros <= run[:, None]).sum(axis=1))
        fix = open_ & (band != 0) & (places[None, :] < target[:, None])
        order = np.cumsum(fix, axis=1)
        r, c = np.nonzero(fix)
        set_ = bits.bit(at[live][r] + order[r, c] - 1) == 1
        r, c = r[set_], c[set_]
        band[r, c] += np.where(band[r, c] > 0, 1 << al, -(1 << al)).astype(band.dtype)
        at[live] += order[:, -1]
        new = np.flatnonzero(~whole & (size > 0) & (target < width))
        band[new, target[new]] = np.where(positive[new] > 0, 1 << al, -(1 << al))
        out[row, ss : se + 1] = band
        over = target >= width - 1
        rest[live] -= whole
        k[live] = np.where(over | whole, 0, target + 1)
        j[live] += over | whole
        live = live[j[live] < count[live]]


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Frames of the files, and all their coefficients (block, zigzag place); an image's component c begins at its base[c]."""
    images, total = [read(f) for f in files], 0
    for im in images:
        for w, h in im.shape:
            im.base.append(total)
            total += w * h
    out = np.zeros((total, 64), dtype=np.int32)
    for step in range(max((len(im.scans) for im in images), default=0)):
        alike: dict[tuple, list[Image]] = {}
        for im in images:
            if step < len(im.scans):
                alike.setdefault((im.scans[step][:6], tuple(im.sampling)), []).append(im)
        for ((comps, ss, se, ah, al, tables), sampling), group in alike.items():
            parts, rows = [], []
            for im in group:
                order = _order(im, comps)
                interval = im.scans[step][6] * (sum(h * v for h, v in (sampling[c] for c in comps)) if len(comps) > 1 else 1) or len(order)
                mine = im.scans[step][7]
                parts += mine
                rows += [order[i * interval : (i + 1) * interval] for i in range(len(mine))]
            count = np.array([len(r) for r in rows], dtype=np.int64)
            where = np.zeros((len(rows), int(count.max(initial=0))), dtype=np.int64)
            where[np.arange(where.shape[1])[None, :] < count[:, None]] = np.concatenate(rows)
            bits = Bits(parts)
            if ss:
                (_ac_refine if ah else _ac_first)(out, bits, where, count, tables[0], ss, se, al)
            elif ah:
                _dc_refine(out, bits, where, count, al)
            else:
                kinds = [c for c in comps for _ in range(sampling[c][0] * sampling[c][1])] if len(comps) > 1 else list(comps)
                lookup = {c: decoding_table(t) for c, t in zip(comps, tables, strict=True)}
                _dc_first(out, bits, where, count, kinds, [lookup[c] for c in kinds], al)
    return images, out


def _order(im: Image, comps: tuple[int, ...]) -> np.ndarray:
    """Rows of the coefficient array in the order of a scan."""
    return im.base[0] + _rows(tuple(im.sampling), tuple(im.shape), comps, im.used(comps[0]) if len(comps) == 1 else None)


@lru_cache(maxsize=512)
def _rows(sampling: tuple, shape: tuple, comps: tuple[int, ...], used: tuple[int, int] | None) -> np.ndarray:
    """A scan's order in an image whose coefficients begin at 0."""
    base = np.cumsum([0, *(w * h for w, h in shape)])
    if used:
        w, h = used
        return (base[comps[0]] + np.arange(h)[:, None] * shape[comps[0]][0] + np.arange(w)).reshape(-1)
    across, down = shape[0][0] // sampling[0][0], shape[0][1] // sampling[0][1]
    y, x = np.divmod(np.arange(across * down), across)
    parts = [base[c] + (y[:, None] * v + np.repeat(np.arange(v), h)) * shape[c][0] + x[:, None] * h + np.tile(np.arange(h), v) for c, (h, v) in ((c, sampling[c]) for c in comps)]
    return np.concatenate(parts, axis=1).reshape(-1)


def samples(images: list[Image], found: np.ndarray) -> np.ndarray:
    """The inverse transform of all blocks: (block, row, column), 0 to 255."""
    out = np.empty((len(found), 8, 8), dtype=np.uint8)
    scale = np.ones((0, 64))
    owner = np.zeros(len(found), dtype=np.int64)
    known: dict[bytes, int] = {}
    for im in images:
        for c, (w, h) in enumerate(im.shape):
            q = im.quantisers[c]
            if (i := known.get(q.tobytes())) is None:
                i = known[q.tobytes()] = len(scale)
                scale = np.vstack([scale, q])
            owner[im.base[c] : im.base[c] + w * h] = i
    for a in range(0, len(found), 8192):
        block = np.zeros((len(found[a : a + 8192]), 64))
        block[:, ZIGZAG] = found[a : a + 8192] * (scale[owner[a : a + 8192]] if len(scale) > 1 else scale)
        columns = np.ascontiguousarray((block.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1))
        pixels = (columns.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        pixels = pixels * (1 / (1 << 22)) + 128.5
        np.clip(pixels, 0, 255.5, out=pixels)
        out[a : a + 8192] = pixels
    return out


def rgb(im: Image, pixels: np.ndarray) -> np.ndarray:
    """The image, from the samples of all blocks, as (height, width, 3) bytes with chroma repeated to full resolution; one component gives grey."""
    planes = []
    most = max(h for h, _ in im.sampling), max(v for _, v in im.sampling)
    for c, (w, h) in enumerate(im.shape):
        plane = pixels[im.base[c] : im.base[c] + w * h].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        if c and len(im.shape) == 3:
            planes.append((plane, most[1] // im.sampling[c][1], most[0] // im.sampling[c][0]))
        else:
            planes.append(plane.repeat(most[1] // im.sampling[c][1], axis=0).repeat(most[0] // im.sampling[c][0], axis=1)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    (b, *times), (r, *_) = planes[1:]

    def full(x: np.ndarray) -> np.ndarray:
        return x.repeat(times[0], axis=0).repeat(times[1], axis=1)[: im.height, : im.width]

    y, (cb, cr) = planes[0].astype(np.int32), (x.astype(np.int32) - 128 for x in (b, r))
    out = np.empty((im.height, im.width, 3), dtype=np.uint8)
    # The conversion's factors 1.402, 0.344136, 0.714136 and 1.772 in units of 2^-16. The chroma's share is
    # taken at its own resolution; luma is a whole number of units, so rounding it there gives the same.
    if planes[1][1:] != planes[2][1:]:
        cb, cr, times = full(cb), planes[2][0].astype(np.int32).repeat(planes[2][1], axis=0).repeat(planes[2][2], axis=1)[: im.height, : im.width] - 128, [1, 1]
    for i, part in enumerate(((91881 * cr + 32768) >> 16, (-22554 * cb - 46802 * cr + 32768) >> 16, (116130 * cb + 32768) >> 16)):
        np.clip(y + full(part.astype(np.int16)), 0, 255, out=out[:, :, i], casting="unsafe")
    return out


def payload(im: Image, found: np.ndarray) -> bytes:
    """The bytes that a stored image holds."""
    n = struct.unpack(">Q", im.comment)[0]
    values = found[im.base[0] : im.base[-1] + im.shape[-1][0] * im.shape[-1][1]].reshape(-1)[:n]
    return BYTE[values + 129].tobytes()


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The RGB tensor of each file."""
    images, found = coefficients(files)
    pixels = samples(images, found)
    return [rgb(im, pixels) for im in images]


def _decoded(files: list[bytes], most: int) -> list[tuple[np.ndarray | None, str | None]]:
    """The tensor of each file, or why there is none. Files are decoded together, and apart if one of them fails."""
    if not files:
        return []
    try:
        if any(im.height * im.width > most for im in map(read, files)):
            raise ValueError(f"more than {most} pixels")
        return [(x, None) for x in decode(files)]
    except Exception as e:  # noqa: BLE001 - whatever a file that is no image makes fail
        if len(files) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    return [x for f in files for x in _decoded([f], most)]


def decode_media(media: DataFrame, key: str = "k", column: str = "media", most_pixels: int = 1 << 26) -> DataFrame:
    """k, height, width, rgb (bytes by rows) and reason of progressive JPEG files.

    A null file gives nulls. A file that is no progressive JPEG, is broken, or claims more pixels than
    `most_pixels`, gives nulls and the reason.
    """
    tune(media.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _together(list(zip(b.column("k").to_pylist(), b.column("m").to_pylist(), strict=True)), lambda r: len(r[1] or b"")):
                found = iter(_decoded([m for _, m in rows if m is not None], most_pixels))
                got, why = zip(*((None, None) if m is None else next(found) for _, m in rows), strict=True)
                yield batch(schema, k=[k for k, _ in rows], height=[None if x is None else x.shape[0] for x in got], width=[None if x is None else x.shape[1] for x in got], rgb=[None if x is None else x.tobytes() for x in got], reason=list(why))

    return media.selectExpr(f"cast(`{key}` as long) as k", f"cast(`{column}` as binary) as m").mapInArrow(run, "k long, height int, width int, rgb binary, reason string")


def _together(rows: list[tuple], weight) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, n_bytes and media: each text as UTF-8, filled up with 255 to a positive multiple of UNIT, as a progressive JPEG. A null text is as an empty one."""
    tune(docs.sparkSession, rows=1024)
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(k, (t or "").encode("utf-8", "surrogatepass")) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True)]
            for rows in _together(raw, lambda r: len(r[1])):
                media = store([x + b"\xff" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)) for _, x in rows])
                yield batch(schema, k=[k for k, _ in rows], n_bytes=[len(x) for _, x in rows], media=media)

    return texts(docs, key, text).mapInArrow(run, "k long, n_bytes long, media binary")


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`stored` media, written to the shared folder and read back."""
    return cut(stored(docs, key, text), "media", "zstd")


def read_media(media: DataFrame) -> DataFrame:
    """Decodes stored media: k, n_bytes, digests of the payload and of the file, and the tensor as height, width and rgb (bytes by rows).

    Every row of the media gives one; equal files give equal rows. A null key stays null.
    """
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _together(list(zip(b.column("k").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True)), lambda r: len(r[2])):
                images, found = coefficients([m for _, _, m in rows])
                pixels = samples(images, found)
                out = []
                for (k, n, m), im in zip(rows, images, strict=True):
                    p, tensor = payload(im, found), rgb(im, pixels)
                    out.append((k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), *tensor.shape[:2], tensor.tobytes()))
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return media.mapInArrow(run, "k long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, rgb binary")


def features(decoded: DataFrame) -> DataFrame:
    """Adds a feature to decoded media: the tensor's shape and checksum."""
    return decoded.withColumn("feature", F.concat_ws(":", F.concat_ws("x", "height", "width"), F.lpad(F.lower(F.hex(F.crc32("rgb"))), 8, "0")))
