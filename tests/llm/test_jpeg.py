"""The progressive JPEG decoder against a scalar encoder of its own, and the store of payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.llm import jpeg

SYMBOLS = [*range(0, 0xF0, 0x10), *sorted({run << 4 | size for run in range(16) for size in range(1, 11)} - set(range(0, 0xF0, 0x10))), 0xF0]


class Writer:
    """Bits of one scan, with canonical codes of 4 (DC) and 9 (AC) bits."""

    def __init__(self, al, end_of_bands):
        self.bits, self.al, self.run, self.corrections, self.end_of_bands = [], al, 0, [], end_of_bands
        self.parts = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def value(self, x, size):
        self.put(x if x > 0 else x + (1 << size) - 1, size)

    def symbol(self, s):
        self.put(SYMBOLS.index(s), 9)

    def end_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.put(self.run - (1 << n), n)
            self.run = 0
        self.bits += self.corrections
        self.corrections = []

    def restart(self):
        self.end_run()
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        self.parts.append(raw.replace(b"\xff", b"\xff\x00"))
        self.bits = []

    def first(self, band):
        zeros = 0
        for x in band:
            x = int(np.sign(x)) * (abs(int(x)) >> self.al)
            if not x:
                zeros += 1
                continue
            self.end_run()
            while zeros > 15:
                self.symbol(0xF0)
                zeros -= 16
            self.symbol(zeros << 4 | abs(x).bit_length())
            self.value(x, abs(x).bit_length())
            zeros = 0
        if zeros:
            self.run += 1
            if self.run >= self.end_of_bands:
                self.end_run()

    def refine(self, band):
        sizes = [abs(int(x)) >> self.al for x in band]
        last = max((i for i, s in enumerate(sizes) if s == 1), default=-1)
        zeros, own = 0, []
        for i, (x, s) in enumerate(zip(band, sizes, strict=True)):
            if s == 0:
                zeros += 1
                continue
            while zeros > 15 and i <= last:
                self.end_run()
                self.symbol(0xF0)
                self.bits += own
                zeros, own = zeros - 16, []
            if s > 1:
                own.append(s & 1)
                continue
            self.end_run()
            self.symbol(zeros << 4 | 1)
            self.put(int(x > 0), 1)
            self.bits += own
            zeros, own = 0, []
        if zeros or own:
            self.run += 1
            self.corrections += own
            if self.run >= self.end_of_bands or len(self.corrections) > 500:
                self.end_run()


def encode(blocks, sampling, width, height, scans, restart, end_of_bands):
    """A progressive file of coefficients (rows, columns, 64) by component, padded to whole MCUs."""
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    out = [b"\xff\xd8", b"\xff\xdb", struct.pack(">HB", 67, 0), bytes(range(1, 65)), b"\xff\xc2", struct.pack(">HBHHB", 8 + 3 * len(blocks), 8, height, width, len(blocks))]
    out += [bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)]
    for kind, counts, symbols in ((0, [0, 0, 0, 12] + [0] * 12, range(12)), (16, [0] * 8 + [len(SYMBOLS)] + [0] * 7, SYMBOLS)):
        out += [b"\xff\xc4", struct.pack(">HB", 19 + len(symbols), kind), bytes(counts), bytes(symbols)]
    out += [b"\xff\xdd", struct.pack(">HH", 4, restart)]
    for comps, ss, se, ah, al in scans:
        w = Writer(al, end_of_bands)
        if len(comps) == 1:
            h, v = sampling[comps[0]]
            down, across = -(-(-(-height * v // most[1])) // 8), -(-(-(-width * h // most[0])) // 8)
            units = [[(comps[0], y, x)] for y in range(down) for x in range(across)]
        else:
            rows, columns = blocks[0].shape[0] // sampling[0][1], blocks[0].shape[1] // sampling[0][0]
            units = [[(c, y * v + j, x * h + i) for c, (h, v) in ((c, sampling[c]) for c in comps) for j in range(v) for i in range(h)] for y in range(rows) for x in range(columns)]
        before = dict.fromkeys(comps, 0)
        for at, unit in enumerate(units):
            if restart and at and at % restart == 0:
                w.restart()
                before = dict.fromkeys(comps, 0)
            for c, y, x in unit:
                block = blocks[c][y, x]
                if ss:
                    (w.refine if ah else w.first)(block[ss : se + 1])
                elif ah:
                    w.put(int(block[0]) >> al & 1, 1)
                else:
                    diff, before[c] = (int(block[0]) >> al) - before[c], int(block[0]) >> al
                    size = abs(diff).bit_length()
                    w.put(size, 4)
                    if size:
                        w.value(diff, size)
        w.restart()
        out += [b"\xff\xda", struct.pack(">HB", 6 + 2 * len(comps), len(comps)), *(bytes([c + 1, 0]) for c in comps), bytes([ss, se, ah << 4 | al])]
        out += [x for i, part in enumerate(w.parts) for x in ((bytes([255, 0xD0 + (i - 1) % 8]) if i else b""), part)]
    return b"".join([*out, b"\xff\xd9"])


def coefficients(rng, sampling, width, height, dense):
    """Random blocks; those that no scan of one component reaches have a DC value alone."""
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    out = []
    for h, v in sampling:
        x = rng.integers(-40, 41, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < dense)
        x[rng.random(x.shape[:2]) < 0.4, 1:] = 0
        used = -(-(-(-height * v // most[1])) // 8), -(-(-(-width * h // most[0])) // 8)
        x[used[0] :, :, 1:] = 0
        x[:, used[1] :, 1:] = 0
        x[:, :, 0] = rng.integers(-200, 200, x.shape[:2])
        out.append(x)
    return out


SAMPLINGS = {"4:4:4": [(1, 1)] * 3, "4:2:2": [(2, 1), (1, 1), (1, 1)], "4:2:0": [(2, 2), (1, 1), (1, 1)], "grey": [(1, 1)]}


@pytest.mark.parametrize("kind", SAMPLINGS)
@pytest.mark.parametrize("restart", [0, 3])
def test_scans_accumulate_to_the_coefficients(kind, restart):
    rng = np.random.default_rng(5)
    sampling = SAMPLINGS[kind]
    everyone = tuple(range(len(sampling)))
    scans = [(everyone, 0, 0, 0, 2)]
    for c in everyone:
        scans += [((c,), 1, 5, 0, 2), ((c,), 6, 63, 0, 2), ((c,), 1, 63, 2, 1)]
    scans += [(everyone, 0, 0, 2, 1), (everyone, 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in everyone)]
    files, want = [], []
    for dense, width, height, ends in ((0.05, 50, 37, 1), (0.3, 33, 64, 4), (0.9, 70, 20, 1000), (0.0, 9, 9, 3)):
        blocks = coefficients(rng, sampling, width, height, dense)
        files.append(encode(blocks, sampling, width, height, scans, restart, ends))
        want.append(blocks)
    images, found = jpeg.coefficients(files)
    for im, blocks in zip(images, want, strict=True):
        for c, x in enumerate(blocks):
            assert (found[im.base[c] : im.base[c] + x.shape[0] * x.shape[1]].reshape(x.shape) == x).all(), (kind, c)


@pytest.mark.parametrize("kind", SAMPLINGS)
def test_tensors_equal_the_plain_formulas(kind):
    rng = np.random.default_rng(6)
    sampling, width, height = SAMPLINGS[kind], 21, 19
    blocks = [x // 2 for x in coefficients(rng, sampling, width, height, 0.1)]
    every = tuple(range(len(sampling)))
    file = encode(blocks, sampling, width, height, [(every, 0, 0, 0, 0), *(((c,), 1, 63, 0, 0) for c in every)], 0, 50)
    got = jpeg.decode([file])[0]
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    cosines = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5**0.5 if u == 0 else 1) / 2 for u in range(8)] for x in range(8)])
    planes = np.zeros((len(sampling), height, width))
    for c, (h, v) in enumerate(sampling):
        for y in range(height):
            for x in range(width):
                a, b = y * v // most[1], x * h // most[0]
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = blocks[c][a // 8, b // 8] * np.arange(1, 65)
                planes[c, y, x] = cosines[a % 8] @ block.reshape(8, 8) @ cosines[b % 8]
    planes = np.clip(np.floor(planes + 128.5), 0, 255)
    if len(sampling) == 1:
        want = np.repeat(planes[0][:, :, None], 3, axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.clip(np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255)
    assert got.shape == (height, width, 3) and np.abs(got.astype(int) - want).max() <= 2 and (np.abs(got - want) > 0).mean() < 0.05


def test_media_round_trip(spark):
    texts = ["", None, "a", "x" * 576, "x" * 577, "ж" * 5000, "same", "same", "\x7f\x80" * 400]
    docs = spark.createDataFrame([(i, t, b"other", 1.0) for i, t in enumerate(texts)] + [(None, "same", None, None)], "doc_id long, text string, media binary, k double")
    media = jpeg.write_media(docs)
    got = {r["k"]: r for r in jpeg.features(jpeg.read_media(media)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert len(r["rgb"]) == 3 * r["height"] * r["width"] and r["feature"] == f"{r['height']}x{r['width']}:{zlib.crc32(r['rgb']):08x}"
    alike = [tuple(got[i][c] for c in ("media_sha256", "rgb", "feature")) for i in (6, 7, None)]
    assert len(set(alike)) == 1 and got[0]["feature"] == got[1]["feature"]
    files = {r["k"]: r["media"] for r in media.collect()}
    tensors = {r["k"]: (r["height"], r["width"], r["rgb"]) for r in jpeg.decode_media(media).collect()}
    for i, data in files.items():
        one = jpeg.decode([bytes(data)])[0]
        assert tensors[i] == (*one.shape[:2], one.tobytes()) and got[i]["rgb"] == one.tobytes()
    nulls = jpeg.decode_media(spark.createDataFrame([(1, None)], "k long, media binary")).first()
    assert nulls["rgb"] is None and jpeg.read_media(jpeg.write_media(docs.where("false"))).count() == 0
    assert jpeg.decode_media(media).select(F.min("height")).first()[0] >= 16


def test_payloads_of_any_bytes_come_back():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 2, 30)] + [bytes(range(256)) * 9, b"\xff" * 576, b"\x00" * 1152]
    images, found = jpeg.coefficients(jpeg.store(payloads))
    assert [jpeg.payload(i, found) for i in images] == payloads
    with pytest.raises(ValueError):
        jpeg.read(b"no picture at all")
