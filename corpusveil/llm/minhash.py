"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations make all coordinates of a signature: the first scatters the shingles over a circle of
LOCATIONS places, the second ranks those places, and coordinate k is the least rank that the set meets
when the second permutation is turned by k places. As a shingle's ranks under all turns are neighbours
in memory, a signature is a minimum over contiguous slices.

Scale: texts with equal sets are one node (the class of copies), so a group of copies costs one row.
The shingle sets of the nodes that share a band with another are written once; candidates that one bit of
each coordinate shows to be possible are verified on them, by joins. Bands are joined to one pivot of their bucket at a time, and only documents that
are not yet in the pivot's component are compared with it, so a bucket of n near copies costs about n
comparisons. Buckets that stay open (texts with a long common passage) are dealt anew by their rare
shingles, which loses no pair; what stays open even then (copies just short of the wanted similarity) is
compared in blocks of bounded size. New links merge whole components, so no link is walked twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import counted_components
from .common import batch, counted, cut, delete, fresh_dir, scratch, small_or_plain, tune

#: Places on the circle; a power of two.
LOCATIONS = 1 << 20
#: Bands and rows of a band. A pair at similarity 0.8 meets in no band with a chance of (1 - 0.8^6)^45, about 1e-6.
BANDS, ROWS = 45, 6
#: Rounds in which each open bucket takes one more pivot and each document tries one of its buckets' pivots, before what is
#: left goes to buckets of rare shingles.
PIVOT_ROUNDS, PREFIX_ROUNDS = 3, 2
#: Documents of an open bucket that are compared one by one; larger buckets are compared in blocks of about so many shingles
#: and documents at most. Either way all documents of a bucket are compared.
SMALL_BUCKET, BLOCK_SHINGLES, BLOCK_ROWS = 12, 1 << 18, 500
#: Most ids or pairs of ids, and most shingles of whole sets, that are broadcast; both are counted first.
ID_ROWS, SKETCH_ROWS, SET_SHINGLES = 500_000, 250_000, 2_000_000
#: Links that a task joins to trees at a time.
FOREST_LINKS = 100_000
#: Words of the cache from a word to its hash, per worker.
CACHE_WORDS = 300_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with 1 to size - 1 words has
    its whole sequence as one shingle; null or blank texts have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        out += h[i : n - size + 1 + i] * (_ODD[i % 8] + np.uint64(2 * (i // 8)))
    return np.unique(out)


class Circulant:
    """Signatures of `coordinates` values from two permutations."""

    def __init__(self, coordinates: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        rank = rng.permutation(LOCATIONS).astype(np.uint32)
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: coordinates - 1]]), coordinates)
        self.scatter = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self.coordinates = coordinates

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = ((shingles * self.scatter) >> np.uint64(44)).astype(np.int64)
        least = np.full(self.coordinates, LOCATIONS, dtype=np.uint32)
        for i in range(0, len(places), 1024):
            np.minimum(least, self.turned[places[i : i + 1024]].min(axis=0), out=least)
        return least


_circulant: dict[int, Circulant] = {}


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key for each band, whose coordinates stand `bands` places apart on the circle; and the sketch, one bit of each coordinate."""
    hasher = _circulant.get(bands * rows) or _circulant.setdefault(bands * rows, Circulant(bands * rows))
    sig = hasher.signature(shingles)
    bits = np.zeros(-(-len(sig) // 64) * 64, dtype=np.uint8)
    bits[: len(sig)] = sig & 1
    sig = sig.reshape(rows, bands).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[7]
    for i in range(rows):
        key = (key ^ sig[i]) * _ODD[i % 7]
        key ^= key >> np.uint64(29)
    return key.view(np.int64), np.packbits(bits).view(np.int64)


def most_different(coordinates: int, percent: int) -> int:
    """Bits in which the sketches of a pair at the wanted similarity differ at most, but for five standard deviations (a chance of 3e-7)."""
    p = (100 - percent) / 200
    return int(coordinates * p + 5 * (coordinates * p * (1 - p)) ** 0.5)


def signatures(rows: DataFrame, size: int, bands: int = BANDS, rows_of_band: int = ROWS) -> DataFrame:
    """r, k, n (size of the shingle set), f1 and f2 (a 128-bit hash of the set), bands (keys) and sketch (both empty for an empty set) of rows r, k, t."""
    schema = pa.schema([("r", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, keys, sketches = [], [], [], [], []
            for t in b.column("t").to_pylist():
                s = shingle_set(t, size)
                f = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                n.append(len(s))
                f1.append(int(f[0]))
                f2.append(int(f[1]))
                band, bits = band_keys(s, bands, rows_of_band) if len(s) else (np.zeros(0, np.int64),) * 2
                keys.append(band)
                sketches.append(bits)
            yield batch(schema, r=b.column("r"), k=b.column("k"), n=n, f1=f1, f2=f2, bands=lists(keys), sketch=lists(sketches))

    return rows.select("r", "k", "t").mapInArrow(run, "r long, k long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A column of lists of 64-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def shingle_sets(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, n and the shingles of the rows r, t with these ids (column rep, each once). If few, they are sent to the scan, so that other texts are not shuffled."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, size).view(np.int64) for t in b.column("t").to_pylist()]
            yield batch(schema, rep=b.column("rep"), n=[len(x) for x in found], shingles=lists(found))

    own = rows.select(F.col("r").alias("rep"), "t").join(ids, "rep", "left_semi")
    return cut(own.mapInArrow(run, "rep long, n long, shingles array<long>"), "sets")


def verified(pairs: DataFrame, many: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), so many, whose full shingle sets have 100 * |both| >= percent * |either|. Repeated ids should stand in b."""
    wanted, seen = counted(pairs.select(F.col("b").alias("rep")).distinct().join(sets.select("rep", "n"), "rep"), "wanted", total=F.sum("n"))
    right = sets.join(small_or_plain(wanted.select("rep"), ID_ROWS, seen["rows"]), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).join(small_or_plain(pairs, ID_ROWS, many), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    found = left.join(F.broadcast(right) if (seen["total"] or 0) <= SET_SHINGLES else right, "b").select("a", "b", "na", "nb", both.alias("both"))
    return found.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Buckets that hold every pair of `sets` at the wanted similarity.

    With the shingles of each set in one order, rarest first, two sets that similar share one of the first
    n - ceil(percent * n / 100) + 1 of their n shingles. So a common passage in otherwise different texts
    makes no bucket. Of buckets with the same documents (the shingles of one passage) one is enough. Returns
    band (a shingle), rep, n.
    """
    each = sets.select("rep", F.explode("shingles").alias("band"))
    common = cut(each.groupBy("band").agg(F.count("*").alias("df")).where("df > 1"), "common")
    # Shingles of one set alone come first and make no bucket, so only the others are counted off, from where those end.
    shared = each.join(common, "band")
    order = Window.partitionBy("rep").orderBy("df", "band")
    placed = shared.select("rep", "band", F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("rep")).alias("shared"))
    first = placed.join(sets.select("rep", "n"), "rep").where(f"n - shared + place <= n - (({percent} * n + 99) div 100) + 1")
    buckets = cut(first.select("band", "rep", "n"), "buckets")
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    alike = buckets.groupBy("band").agg(F.count("*").alias("many"), *members).where("many > 1").groupBy("many", "x1", "x2").agg(F.min("band").alias("band"))
    alike, seen = counted(alike.select("band"), "alike")
    return buckets.join(small_or_plain(alike, ID_ROWS, seen["rows"]), "band", "left_semi")


def linked_in_group(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different labels, as many as are needed to connect what they connect."""
    reps, n, labels = (rows.column(c).to_numpy() for c in ("rep", "n", "label"))
    column = rows.column("shingles").combine_chunks()
    owner = np.repeat(np.arange(len(reps), dtype=np.int32), np.diff(column.offsets.to_numpy()))
    _, place, counts = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    use = counts[place] > 1
    owner, place = owner[use], (np.cumsum(counts > 1) - 1)[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(reps), len(reps)), dtype=np.float32)
    width = max(64, (1 << 21) // max(1, len(reps)))
    for start in range(0, int((counts > 1).sum()), width):
        lo, hi = np.searchsorted(place, (start, start + width))
        part = np.zeros((len(reps), width), dtype=np.float32)
        part[owner[lo:hi], place[lo:hi] - start] = 1
        both += part @ part.T
    near = (100 + percent) * both.astype(np.int64) >= percent * (n[:, None] + n[None, :])
    del both
    return spanning(near, reps, labels)


def spanning(near: np.ndarray, reps: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs marked in a symmetric matrix, links that connect the same labels. Rows of one label count as connected."""
    _, own = np.unique(labels, return_inverse=True)
    open_, out = np.ones(len(reps), dtype=bool), []
    while open_.any():
        front = np.flatnonzero(own == own[open_.argmax()])
        while len(front):
            open_[front] = False
            hit = near[front] & open_
            new = np.flatnonzero(hit.any(axis=0))
            _, first = np.unique(own[new], return_index=True)
            out += [(int(reps[front[hit[:, j].argmax()]]), int(reps[j])) for j in new[first]]
            front = np.flatnonzero(np.isin(own, own[new]))
    return out


def trees(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """The least node that each node of these links reaches over them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def joined(links: DataFrame) -> tuple[DataFrame, int]:
    """node, label (the least node that it reaches over the links a, b), and the number of rows.

    Each task first joins its own links to trees, FOREST_LINKS at a time. Only if there was more than one such part do rounds
    of joins connect them.
    """
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, many = TaskContext.get().partitionId() << 32, [], 0

        def grown() -> pa.RecordBatch:
            found = trees(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in "ab"))
            return batch(schema, node=list(found), label=list(found.values()), part=[part] * len(found))

        for b in batches:
            held.append(b)
            many += b.num_rows
            if many >= FOREST_LINKS:
                yield grown()
                part, held, many = part + 1, [], 0
        if many:
            yield grown()

    forest, seen = counted(links.select("a", "b").distinct().mapInArrow(run, "node long, label long, part long"), "forest", least=F.min("part"), most=F.max("part"))
    if seen["least"] == seen["most"]:
        return forest.select("node", "label"), seen["rows"]
    return counted_components(forest.select(F.col("node").alias("a"), F.col("label").alias("b")), None)


class _Links:
    """The pairs tried, and the components that the links found so far make.

    Each table's rows are counted as it is written: jobs that only count cost the driver, which keeps the plans, threads and
    broadcasts of hundreds of short jobs, more than the tables do.
    """

    def __init__(self, sets: DataFrame, sketches: DataFrame, percent: int, different: int):
        spark = sets.sparkSession
        self.sets, self.sketches, self.percent, self.different = sets, sketches, percent, different
        self.tried = spark.createDataFrame([], "lo long, hi long")
        self.labels, self.many = spark.createDataFrame([], "node long, label long"), 0

    def merge(self, new: DataFrame) -> None:
        """Join the components of each link's ends; only components that the new links touch are worked on."""
        known = self.known()
        a = new.join(known, F.col("a") == F.col("node"), "left").select(F.coalesce("label", "a").alias("a"), "b")
        ends = a.join(known, F.col("b") == F.col("node"), "left").select("a", F.coalesce("label", "b").alias("b")).where("a <> b")
        moved, rows = joined(ends)
        step = small_or_plain(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), ID_ROWS, rows)
        old = self.labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        self.labels, seen = counted(old.union(moved.join(self.labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
        self.many = seen["rows"]

    def known(self) -> DataFrame:
        return small_or_plain(self.labels, ID_ROWS, self.many)

    def labelled(self, members: DataFrame) -> DataFrame:
        return members.join(self.known(), F.col("rep") == F.col("node"), "left").select("band", "rep", "n", F.coalesce("label", "rep").alias("label"))

    def open_buckets(self, members: DataFrame) -> DataFrame | None:
        """The rows of buckets that still hold documents of different components."""
        mixed = self.labelled(members).groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("band", "rows")
        mixed, seen = counted(mixed, "mixed")
        return cut(members.select("band", "rep", "n").join(small_or_plain(mixed, ID_ROWS, seen["rows"]), "band"), "open") if seen["rows"] else None

    def pivots(self, members: DataFrame, turn: int) -> bool:
        """Compare one document of each open bucket with those of other components; False if there was nothing to compare."""
        at = self.labelled(members)
        chosen = at.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "label", "n")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        pivots, seen = counted(chosen.select("band", F.col("p.rep").alias("prep"), F.col("p.n").alias("pn"), F.col("p.label").alias("plabel")), "pivots")
        return bool(seen["rows"]) and self._try(at, small_or_plain(pivots, ID_ROWS, seen["rows"]), "rep <> prep", turn)

    def all_pairs(self, members: DataFrame) -> bool:
        """Compare all documents of a bucket that are in different components."""
        at = self.labelled(members)
        return self._try(at, at.select("band", F.col("rep").alias("prep"), F.col("n").alias("pn"), F.col("label").alias("plabel")), "rep < prep")

    def in_blocks(self, members: DataFrame) -> None:
        """Compare all documents that share a large open bucket, one block with another in each task.

        Buckets that share documents make a cluster, whose documents are dealt to blocks, so that a set is sent
        once for each block that it has to be compared with, however many buckets it stands in.
        """
        percent = self.percent
        heads, seen = counted(members.groupBy("band").agg(F.min("rep").alias("b")), "heads")
        heads = small_or_plain(heads, ID_ROWS, seen["rows"])
        clusters = joined(members.join(heads, "band").select(F.col("rep").alias("a"), "b"))[0].select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
        own = self.labelled(members).dropDuplicates(["rep"]).join(clusters, "rep", "left").select("rep", "n", "label", F.coalesce("cluster", "rep").alias("cluster"))
        own = cut(own, "clustered")
        sizes = own.groupBy("cluster").agg(F.expr(f"cast(ceil(greatest(sum(n) / {BLOCK_SHINGLES}, count(*) / {BLOCK_ROWS})) as int)").alias("blocks"))
        sizes, seen = counted(sizes, "sizes")
        own, dealt = counted(own.join(small_or_plain(sizes, ID_ROWS, seen["rows"]), "cluster").select("cluster", F.expr("cast(pmod(xxhash64(rep), blocks) as int)").alias("block"), "rep", "label"), "dealt")
        at = members.select("band", "rep").join(small_or_plain(own, ID_ROWS, dealt["rows"]), "rep").select("band", "cluster", "block").distinct()
        meets = at.groupBy("band", "cluster").agg(F.array_sort(F.collect_set("block")).alias("blocks")).select("cluster", "blocks").distinct()
        meets = meets.select("cluster", "blocks", F.explode("blocks").alias("i")).select("cluster", "i", F.explode(F.filter("blocks", lambda x: x >= F.col("i"))).alias("j")).distinct()
        sides, seen = counted(meets.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "meets")
        dealt = own.join(small_or_plain(sides, ID_ROWS, seen["rows"]), ["cluster", "block"]).select("cluster", "i", "j", "rep", "label").join(self.sets, "rep")

        def run(rows: pa.Table) -> pa.Table:
            found = linked_in_group(rows, percent)
            return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

        new, seen = counted(dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long").distinct(), "links")
        if seen["rows"]:
            self.merge(new)

    def _try(self, at: DataFrame, other: DataFrame, which: str, turn: int | None = None) -> bool:
        """Verify the pairs of `at` and `other` in a band that are not in one component; with a turn, one for each document."""
        found = at.join(other, "band").where(f"{which} and label <> plabel and 100 * least(n, pn) >= {self.percent} * greatest(n, pn)")
        pairs = found.select(F.least("rep", "prep").alias("lo"), F.greatest("rep", "prep").alias("hi"), F.col("rep").alias("a"), F.col("prep").alias("b"))
        pairs = pairs.distinct().join(self.tried, ["lo", "hi"], "left_anti")
        if turn is not None:
            pairs = pairs.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)), "b", "lo", "hi")).alias("p")).select("a", "p.b", "p.lo", "p.hi")
        pairs, seen = counted(pairs.groupBy("lo", "hi").agg(F.min(F.struct("a", "b")).alias("p")).select("lo", "hi", "p.a", "p.b"), "pairs")
        if not seen["rows"]:
            return False
        self.tried = self.tried.union(pairs.select("lo", "hi"))
        for c in "ab":
            pairs = pairs.join(self.sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")), c)
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        pairs, seen = counted(pairs.where(apart <= self.different).select("a", "b"), "pairs")
        if seen["rows"]:
            new, seen = counted(verified(pairs, seen["rows"], self.sets, self.percent), "links")
            if seen["rows"]:
                self.merge(new)
        return True


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, pivot_rounds: int = PIVOT_ROUNDS, row: str | None = None) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    Returns one row for each row of `docs`: r (the row's number, from the column `row` if there is one), k
    (the key), n_shingles, component (the smallest key that can be reached over links, its own included),
    kept (k = component) and first (one row of each group: the smallest key, null keys last, and of repeated
    ones the smallest row number). Null and blank texts have no shingles, link with nothing and are each
    first. Every row is compared by its own text, so rows that repeat a key may be in different groups. A
    group of null keys alone has a null component, and its rows are kept. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _grouped(docs, key, text, size, percent, bands, rows, pivot_rounds, row)


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int, bands: int, rows: int, pivot_rounds: int, row: str | None) -> DataFrame:
    spark = docs.sparkSession
    number = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    own = docs.select(number.alias("r"), F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    path = fresh_dir(spark, "rows")
    own = own if row else cut(own, "rows", "zstd", path=path)
    marks = cut(signatures(own, size, bands, rows), "marks", "zstd", keep=True)
    some = marks.where("n > 0")
    classes, seen = counted(some.groupBy("f1", "f2").agg(F.min("r").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("k").alias("least")), "classes", again=F.count_if(F.expr("copies > 1")))
    again = small_or_plain(classes.where("copies > 1").select("f1", "f2", "rep"), ID_ROWS, seen["again"])
    single = some.join(again, ["f1", "f2"], "left").where("rep is null or rep = r").select(F.col("r").alias("rep"), "n", "bands", "sketch")
    banded = single.select("rep", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band")
    shared, seen = counted(shared, "shared")
    members = cut(banded.join(small_or_plain(shared, ID_ROWS, seen["rows"]), "band"), "members")
    ids, seen = counted(members.select("rep").distinct(), "ids")
    ids = small_or_plain(ids, ID_ROWS, seen["rows"])
    sets = shingle_sets(own, ids, size)
    delete(spark, [path])
    sketches, seen = counted(single.join(ids, "rep", "left_semi").select("rep", "sketch"), "sketches")
    state = _Links(sets, small_or_plain(sketches, SKETCH_ROWS, seen["rows"]), percent, most_different(bands * rows, percent))
    for turn in range(pivot_rounds):
        if not state.pivots(members, turn):
            break
    rest = state.open_buckets(members)
    if rest is not None:
        mine, seen = counted(rest.select("rep").distinct(), "mine")
        mine = sets.join(small_or_plain(mine, ID_ROWS, seen["rows"]), "rep", "left_semi")
        rest = cut(rare_prefixes(mine, percent), "prefixes")
        for turn in range(PREFIX_ROUNDS):
            if not state.pivots(rest, pivot_rounds + turn):
                break
        rest = state.open_buckets(rest)
        if rest is not None:
            state.all_pairs(rest.where(f"rows <= {SMALL_BUCKET}"))
            rest = state.open_buckets(rest.where(f"rows > {SMALL_BUCKET}"))
        if rest is not None:
            state.in_blocks(rest)
    grouped, seen = counted(classes.where("n > 0").join(state.known(), F.col("rep") == F.col("node"), "left").where("copies > 1 or label is not null").select("f1", "f2", F.coalesce("label", "rep").alias("label"), "least"), "grouped")
    groups = some.select("r", "k", "f1", "f2").join(small_or_plain(grouped, ID_ROWS, seen["rows"]), ["f1", "f2"]).groupBy("label").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "r")).alias("head"))
    heads, seen = counted(grouped.join(groups, "label").select("f1", "f2", F.col("head.k").alias("component"), F.col("head.r").alias("first")), "heads", keep=True)
    out = marks.select("r", "k", "n", "f1", "f2").join(small_or_plain(heads, ID_ROWS, seen["rows"]), ["f1", "f2"], "left")
    linked = (F.col("n") > 0) & F.col("first").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("k"))
    out = out.select("r", "k", F.col("n").alias("n_shingles"), component.alias("component"), F.when(linked, F.col("first") == F.col("r")).otherwise(True).alias("first"))
    return out.withColumn("kept", F.col("k").eqNullSafe(F.col("component")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row, as it is, of each group of near-duplicate rows of `docs`: the smallest key, null keys last, of repeated ones any one.

    Rows that repeat key and text are one group, of which one stays. Rows without a word link with nothing
    and all stay. Rows are written once with a number, so that keys need not be unique or known.
    """
    spark = docs.sparkSession
    with scratch(spark):
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        rows = cut(docs.select(F.monotonically_increasing_id().alias("r"), whole.alias("d")), "numbered", "zstd", keep=True)
        own = rows.select("r", F.col("d").getField(key).alias("k"), F.col("d").getField(text).alias("t"))
        dropped, seen = counted(near_duplicates(own, "k", "t", size, percent, row="r").where("not first").select("r"), "dropped", keep=True)
        return rows.join(small_or_plain(dropped, ID_ROWS, seen["rows"]), "r", "left_anti").select("d.*")
