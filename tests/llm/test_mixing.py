"""Mixing: targets and draws against a plain version, sums kept, shares right on average."""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusveil.llm.mixing import copies, mixed, ranked, targets

SCHEMA = "doc_id long, text string, source string, size string, k double, s int, copies string, n string"


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = Fraction(total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and left * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in full else float(left * weight[s]) for s in names}
        full |= more


def hashed(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(v, np.int32) else "<q", v), h)
    return h


def plain(rows, seed=13, group=4):
    """Copies by (key, source, size), group by group and level by level."""
    seed32 = lambda x: np.int32(x)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    sized = Counter((k, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, s in rows)
    sizes = defaultdict(int)
    for (_, s, z), n in sized.items():
        sizes[s] += z * n
    goal, out, rest = plain_targets(sizes), defaultdict(list), []
    for (k, s, z), n in sized.items():
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        base = int(rate)
        whole = int((rate - base) * n)
        mass = ((rate - base) * n - whole) * z
        out[k, s, z] = [base + (i < whole) for i in range(n)]
        if mass > 0:
            rest.append([-z, signed(hashed(seed32(seed), k, z)), k, z, s, whole, mass])
    buckets = max(1, -(-len(rest) // group))
    placed = [(signed(hashed(seed32(seed + 1), r[2], r[3])) % buckets, r) for r in rest]
    level = 0
    while True:
        held = defaultdict(list)
        for b, r in placed:
            held[r[4], b].append(r)
        placed = []
        for (_, b), items in held.items():
            items.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
            c = items[0]
            for d in items[1:]:
                gain, give = min(c[3] - c[6], d[6]), min(c[6], d[3] - d[6])
                u = (hashed(seed32(seed + level), c[2], c[3], d[2], d[3]) >> 11) * 2.0**-53
                up = u * (gain + give) < give
                first = c[3] - c[6] <= d[6] if up else c[6] <= d[3] - d[6]
                done, left = (c, d) if first else (d, c)
                if first == up:
                    out[done[2], done[4], done[3]][done[5]] += 1
                left = [*left[:6], max(0.0, min(c[6] + d[6] - (done[3] if first == up else 0), float(left[3])))]
                c = left
            placed.append((b // group, c))
        if buckets == 1:
            break
        buckets, level = -(-buckets // group), level + 1
    for _, c in placed:
        if (hashed(seed32(seed - 1), c[2], c[3]) >> 11) * 2.0**-53 * c[3] < c[6]:
            out[c[2], c[4], c[3]][c[5]] += 1
    return Counter((k, s, z, sizes[s], x) for (k, s, z), xs in out.items() for x in xs), goal


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5, 1, "x", "y") for r in rows], SCHEMA)


def made(seed, n=300):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", "Z", "日", None]
    return [(i, "w " * int(rng.integers(0, 40) ** 2 // 10 if i % 50 else 900), names[min(5, int(rng.exponential(1.5)))]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    rows = made(seed) + [(None, "a b c", "b"), (None, "a b c", "b"), (None, "a b c", "b"), (None, None, None), (3, "", "only empty"), (5, "x y", "b"), (5, "x y", "b"), (6, None, "b")]
    got = copies(docs(spark, rows).repartition(5), group=4)
    want, goal = plain(rows)
    found = got.collect()
    assert Counter((r["k"], r["s"], r["size"], r["source_size"], r["copies"]) for r in found) == want
    assert all(r["target"] == pytest.approx(goal[r["s"]], rel=1e-12) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in found)
    for s in goal:
        own = [r for r in found if r["s"] == s]
        assert abs(sum(r["taken"] for r in own) - goal[s]) < max(r["size"] for r in own) + 1e-6
    again = copies(docs(spark, rows[::-1]).repartition(2), group=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_every_document_has_its_share_on_average(spark):
    rows = [(i, "w " * z, s) for s, zs in (("a", [1, 2, 3, 50, 7]), ("b", [4] * 9 + [100])) for i, z in enumerate(zs)]
    seen = defaultdict(list)
    for seed in range(100, 124):
        for r in copies(docs(spark, rows), seed=seed, group=4).collect():
            seen[r["s"], r["k"]].append((r["copies"], r["target"] / r["source_size"]))
    gaps = [np.mean([c - t for c, t in xs]) for xs in seen.values()]
    assert abs(np.mean(gaps)) < 0.08 and max(map(abs, gaps)) < 0.36 and all(int(t) <= c <= int(t) + 1 for xs in seen.values() for c, t in xs)


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:05d}": int(x) for i, x in enumerate(np.random.default_rng(4).pareto(0.8, 700) * 10)} | {None: 40}
    table = spark.createDataFrame(list(sizes.items()), "s string, source_size long")
    got = {r["s"]: r["target"] for r in targets(table).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)
    assert sorted(r["place"] for r in ranked(table).collect()) == list(range(701)) and ranked(table).where("s is null").first()["place"] == 700


def test_odd_tables_and_the_mix_itself(spark):
    assert copies(docs(spark, [])).count() == 0
    assert {(r["copies"], r["target"]) for r in copies(docs(spark, [(1, None, "a"), (None, " ", None)])).collect()} == {(0, 0.0)}
    rows = [*made(5, 120), (None, "p q", "b"), (None, "r s", "b"), (None, "r s", "b"), (7, "w w", None)]
    table = docs(spark, rows)
    plan = copies(table)
    out = mixed(table, plan)
    assert out.columns == table.columns
    many = Counter((r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in out.collect())
    assert many == Counter({(r["k"], r["n"], r["s"]): r["c"] for r in plan.groupBy("k", "s", F.col("size").alias("n")).agg(F.sum("copies").alias("c")).collect() if r["c"]})
