"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a sequence of frames: the payload's length (8 bytes), that length's masked CRC-32C (4 bytes),
the payload, and its masked CRC-32C (4 bytes), all little-endian. A payload is a key (8 bytes), a byte with
the bytes of an id (2 or 4; 128 more for a null key) and the ids. Shards follow the order of the keys.
The index is a Parquet table beside the shards: shard, k, offset, n_bytes, n_tokens, before (tokens before it in the shard).

Each task streams its range of keys to a file of its own name and renames it when whole, so a repeated
task writes the same file again. Shards live in the folder that the cluster's machines share.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, fresh_dir, texts, tune
from .tokens import encoder

#: The reflected polynomial of CRC-32C and the constant of the mask: fixed values of the record format.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
WIDTH = 64
#: Bytes of input for a shard, and most shards (the estimate of a derived table can be far too large).
SHARD_BYTES, MOST_SHARDS = 256 << 20, 500_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """places[j][b]: the register after byte b and j zero bytes. turns[i][b]: after WIDTH zero bytes, of a register whose byte i is b."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    places = [byte]
    for _ in range(WIDTH - 1):
        places.append(byte[places[-1] & 255] ^ (places[-1] >> 8))
    return np.array(places), np.array([places[WIDTH - 1 - i] for i in range(4)])


_PLACES, _TURNS = _tables()


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload of 4 bytes or more."""
    blocks = np.array([(len(p) + WIDTH - 1) // WIDTH for p in payloads], dtype=np.int64)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * WIDTH if len(ends) else 0, dtype=np.uint8)
    for p, end in zip(payloads, ends.tolist(), strict=True):
        at = end * WIDTH - len(p)
        data[at : end * WIDTH] = np.frombuffer(p, dtype=np.uint8)
        data[at : at + 4] ^= 255
    rows = data.reshape(-1, WIDTH)
    part = np.zeros(len(rows), dtype=np.uint32)
    for j in range(WIDTH):
        part ^= _PLACES[WIDTH - 1 - j][rows[:, j]]
    state = np.zeros(len(payloads), dtype=np.uint32)
    for step in range(int(blocks.max()) if len(blocks) else 0, 0, -1):
        live = np.flatnonzero(blocks >= step)
        s = state[live]
        s = _TURNS[0][s & 255] ^ _TURNS[1][(s >> 8) & 255] ^ _TURNS[2][(s >> 16) & 255] ^ _TURNS[3][s >> 24]
        state[live] = s ^ part[ends[live] - step]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The frame of each payload."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = zip(heads, masked(crc32c(heads)).tolist(), payloads, masked(crc32c(payloads)).tolist(), strict=True)
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, a, p, b in sums]


def read_frames(stream, many: int = 256) -> Iterator[list[bytes]]:
    """Lists of payloads of a shard, with both checksums verified."""
    heads, sums, payloads = [], [], []

    def checked() -> list[bytes]:
        for want, have in zip(sums, zip(masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist(), strict=True), strict=True):
            if want != have:
                raise ValueError("a record's checksum is wrong")
        return payloads

    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("a shard ends inside a record")
        n, first = struct.unpack("<QI", head)
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("a shard ends inside a record")
        heads.append(head[:8])
        payloads.append(body[:n])
        sums.append((first, struct.unpack("<I", body[n:])[0]))
        if len(heads) == many:
            yield checked()
            heads, sums, payloads = [], [], []
    if heads:
        yield checked()


def shard_name(part: int) -> str:
    return f"shard-{part:06d}.rec"


def write_records(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str, keeps_space: bool, end_id: int, wide: bool = False, path: str | None = None) -> str:
    """Encode the texts, append the end id, and write shards and index below a new folder, whose URI is returned.

    Ids have 2 bytes, or 4 if `wide`. A null text has the end id alone. Null keys come first; rows that
    repeat a key are all written. Many rows of one key, or without one, are dealt by a hash of their texts
    to several shards. There is a shard for each SHARD_BYTES of the input, by Spark's estimate of its size,
    and at least one for each shuffle partition.
    """
    spark = docs.sparkSession
    tune(spark)
    root = path or fresh_dir(spark, "records")
    kind, flags = ("<u4", 4) if wide else ("<u2", 2)
    schema = pa.schema([("shard", pa.int32()), ("k", pa.int64()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, part, at, before, out = encoder(tokenizer, keeps_space, large=True), task.partitionId(), 0, 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            if out is None:
                fs, base = pyarrow.fs.FileSystem.from_uri(f"{root}/shards")
                fs.create_dir(base, recursive=True)
                own = f"{base}/.{shard_name(part)}.{task.taskAttemptId()}"
                out = fs.open_output_stream(own, buffer_size=1 << 20)
            keys = b.column("k").to_pylist()
            ids = [np.append(np.frombuffer(x, dtype="<u4"), np.uint32(end_id)) for x in enc.encode([t or "" for t in b.column("t").to_pylist()])]
            if not wide and max(int(x.max()) for x in ids) > 0xFFFF:
                raise ValueError("ids do not fit 2 bytes; use wide=True")
            framed = frames([struct.pack("<qB", k or 0, flags + 128 * (k is None)) + x.astype(kind).tobytes() for k, x in zip(keys, ids, strict=True)])
            rows = []
            for k, x, f in zip(keys, ids, framed, strict=True):
                rows.append((part, k, at, len(f), len(x), before))
                at += len(f)
                before += len(x)
                out.write(f)
            yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
        if out is not None:
            out.close()
            fs.move(own, f"{base}/{shard_name(part)}")

    own = texts(docs, key, text).withColumn("h", F.xxhash64("t"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = own.repartitionByRange(min(shards, MOST_SHARDS), "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    ordered.mapInArrow(run, "shard int, k long, offset long, n_bytes long, n_tokens long, before long").write.parquet(f"{root}/index")
    return root


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """All records of the shards in order: k, start (ids of all records before), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    tune(spark)
    index = spark.read.schema("shard int, k long, offset long, n_bytes long, n_tokens long, before long").parquet(f"{root}/index")
    sums = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    shards, starts = [s for s, _ in sums], np.concatenate([[0], np.cumsum([n for _, n in sums])]).astype(np.int64)
    schema = pa.schema([("k", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column("id").to_pylist()):
            fs, base = pyarrow.fs.FileSystem.from_uri(f"{root}/shards")
            start = int(starts[i])
            with fs.open_input_stream(f"{base}/{shard_name(shards[i])}", buffer_size=1 << 20) as stream:
                for payloads in read_frames(stream):
                    rows = []
                    for k, ids in map(parse, payloads):
                        rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long")


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Key and ids of a payload."""
    k, flags = struct.unpack_from("<qB", payload)
    return None if flags & 128 else k, np.frombuffer(payload, dtype="<u4" if flags & 127 == 4 else "<u2", offset=9)


def read_at(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Records at rows of the index, in any order: k and tokens. For shuffled reads; each task seeks in the shards."""
    schema = pa.schema([("k", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{root}/shards")
        for b in batches:
            got = []
            for shard, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_bytes")), strict=True):
                with fs.open_input_file(f"{base}/{shard_name(shard)}") as f:
                    got += [parse(p) for ps in read_frames(pa.BufferReader(f.read_at(n, offset))) for p in ps]
            yield batch(schema, k=[k for k, _ in got], tokens=[x.astype(np.int64) for _, x in got])

    return rows.select("shard", "offset", "n_bytes").mapInArrow(run, "k long, tokens array<long>")
