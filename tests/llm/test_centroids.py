"""Clusters by annulus search against plain distances to all centroids."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from corpusveil.llm.centroids import clusters, integers, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster int, k string, v double, distance string"


def plain(rows, dims, k, rounds):
    """Every distance, as Python integers: key -> (cluster, distance), inertia by cluster, hashes of the centroids."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) and abs(1024 * c) < 1 << 27 for c in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)][:k]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[place(v)[1]].append(v)
        centroids = [[sum(col) // len(col) for col in zip(*vs, strict=True)] if vs else c for vs, c in zip(held, centroids, strict=True)]
    found = [(i, place(v)[1], place(v)[0]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def run(spark, rows, dims, k, rounds):
    got = clusters(spark.createDataFrame([(i, v, 7, "x", 0.5, "y") for i, v in rows], SCHEMA).repartition(3), k=k, rounds=rounds, dims=dims).collect()
    return sorted((str(r["k"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)


@pytest.mark.parametrize(("dims", "k", "rounds", "grid"), [(2, 5, 4, True), (3, 8, 10, False), (1, 3, 2, True)])
def test_equals_distances_to_all(spark, dims, k, rounds, grid):
    rng = np.random.default_rng(dims)
    points = rng.integers(-3, 4, (60, dims)) / 1024 if grid else rng.normal(0, 1, (60, dims)) * rng.choice([0.01, 1, 50], (60, 1))
    rows = [(i, [float(np.float32(c)) for c in p]) for i, p in enumerate(points)]
    assert run(spark, rows, dims, k, rounds) == plain(rows, dims, k, rounds)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 0.0]), (9, [1e30, 0.0]), (10, [-0.0001, 0.0]), (11, [100000.0, -100000.0])]
    got = run(spark, rows, 2, 8, 3)
    assert got == plain(rows, 2, 8, 3) and [r[0] for r in got] == ["1", "1", "10", "11", "None"]
    assert run(spark, rows[3:10], 2, 8, 3) == []
    assert integers(spark.createDataFrame([(10, [-0.0001, 0.0])], "vec_id long, embedding array<float>"), dims=2).first()["v"] == [-1, 0]


def test_ties_go_to_the_smaller_number_whatever_the_norms():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, c = rng.integers(-4, 5, (30, 2)), rng.integers(-4, 5, (rng.integers(1, 9), 2))
        all_of = ((x[:, None] - c[None]) ** 2).sum(2)
        label, distance = nearest(x, c)
        assert (label == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()
