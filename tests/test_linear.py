"""What must stay linear, against plain versions on small inputs and by time on large ones."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from corpusveil.functions.text import find, literal_pattern
from corpusveil.operators.detect import keep_disjoint
from corpusveil.operators.masking import quality
from corpusveil.operators.places import Taken, places
from corpusveil.operators.registry import organizations
from corpusveil.schema import SPAN_ARRAY


def test_places_equal_one_pattern_for_each_value(spark):
    rng = random.Random(1)
    words = ["ab", "a", "b", "Ва", "ва2", "«x»", "x", ".", "é", "á", "²", "_"]
    join = lambda n, gaps: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    rows = []
    for i in range(60):
        text = join(rng.randint(0, 25), [" ", "  ", "\n", "", " ", " "])
        values = sorted({v for v in (join(rng.randint(1, 3), [" ", ""]).strip() for _ in range(5)) if v})
        rows += [(i, text, v) for v in values]
    want = {(r["i"], r["v"]): [(x["start"], x["end"]) for x in r["r"]] for r in spark.createDataFrame(rows, "i int, t string, v string").select("i", "v", find(F.col("t"), literal_pattern(F.col("v"))).alias("r")).collect()}
    for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
        group = list(group)
        values = [v for _, _, v in group]
        got = list(places(group[0][1], values))
        for j, v in enumerate(values):
            assert [(a, b) for a, b, n in got if n == j] == want[group[0][0], v], (group[0][1], v)


def test_many_values_are_found_in_one_walk():
    values = [f"ООО «Луч {i}»" for i in range(10_000)]
    text = " и ".join(f"ООО  «Луч {i * 7 % 20_000}»" for i in range(10_000))
    began = time.time()
    got = list(places(text, values))
    assert len(got) == sum(i * 7 % 20_000 < 10_000 for i in range(10_000)) and all(text[a:b].replace("  ", " ") == values[n] for a, b, n in got)
    held = Taken([(a, b) for a, b, _ in got])
    assert not any(held.add(a, b) for a, b, _ in got) and held.add(len(text), len(text) + 1) and time.time() - began < 20


def spans(rows):
    return [("inn", a, b, "x" * (b - a), "rule", c, "unknown", False) for a, b, c in rows]


def test_greedy_choice_equals_a_plain_one_and_bears_large_blocks(spark):
    rng = random.Random(2)
    cases = [[(a := rng.randint(0, 60), a + rng.randint(1, 9), rng.choice([0.2, 0.5, 0.9])) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    key = lambda s: F.struct((-s["confidence"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"))
    df = spark.createDataFrame([(i, spans(c)) for i, c in enumerate(cases)], f"i int, s {SPAN_ARRAY}")
    got = {r["i"]: [(s["start"], s["end"], s["confidence"]) for s in r["k"]] for r in df.select("i", keep_disjoint(F.col("s"), key).alias("k")).collect()}
    for i, c in enumerate(cases):
        kept = []
        for a, b, p in sorted(c, key=lambda x: (-x[2], x[0] - x[1], x[0])):
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, p))
        assert got[i] == sorted(kept)
    big = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct(F.lit("inn").alias("entity_type"), (i * 4).alias("start"), (i * 4 + F.when(i % 3 == 0, 6).otherwise(3)).alias("end"), F.lit("x").alias("text"), F.lit("rule").alias("source"), F.when(i % 2 == 0, 0.5).otherwise(0.7).alias("confidence"), F.lit("unknown").alias("party_role"), F.lit(False).alias("is_rule"))).cast(SPAN_ARRAY).alias("s"))
    began = time.time()
    n = big.select(F.size(keep_disjoint(F.col("s"), key)).alias("n")).first()["n"]
    assert 60_000 < n < 100_000 and time.time() - began < 60


def test_quality_meets_by_bins(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randint(0, 2), 0, rng.choice(["inn", "kpp"]), a := rng.randint(0, 900), a + rng.choice([1, 5, 300, 700])) for _ in range(n)]
    gold, found = set(make(40)), set(make(60))
    schema = "doc_id long, block_ord int, entity_type string, start int, end int"
    got = {r["doc_id"]: (r["expected"], r["covered"], r["extra"]) for r in quality(spark.createDataFrame(list(gold), schema), spark.createDataFrame(list(found), schema)).collect()}
    inside = lambda a, b: a[:3] == b[:3] and b[3] <= a[3] and a[4] <= b[4]
    least = [g for g in gold if not any(inside(g, h) and g != h for h in gold)]
    for d in {r[0] for r in gold | found}:
        mine, theirs = [g for g in least if g[0] == d], [f for f in found if f[0] == d]
        assert got[d] == (len(mine), sum(any(inside(g, f) for f in theirs) for g in mine), sum(not any(g[:3] == f[:3] and f[3] < g[4] and f[4] > g[3] for g in mine) for f in theirs))


def test_variants_of_a_name_are_linked_without_pairs(spark):
    rng = random.Random(4)
    rows = []
    for d in range(25):
        for b in range(rng.randint(1, 7)):
            name, at = rng.choice(["ООО «Луч»", "ООО «Мир»"]), 0
            text = name + "".join(f", {label} {rng.choice(['7707083893', '7707083894'] if label == 'ИНН' else ['1027700132195', '1027700132196'])}" for label in ("ИНН", "ОГРН") if rng.random() < 0.4)
            rows.append((d, b, text, "organization", 0, len(name), name))
            for kind, n in (("inn", 10), ("ogrn", 13)):
                if (at := text.find({"inn": "ИНН ", "ogrn": "ОГРН "}[kind])) >= 0:
                    at = text.index(" ", at) + 1
                    rows.append((d, b, text, kind, at, at + n, text[at : at + n]))
    found = spark.createDataFrame(rows, "doc_id long, block_ord int, block_text string, entity_type string, start int, end int, text string").withColumn("party_role", F.lit("unknown"))
    got = {}
    for r in organizations(found).collect():
        got.setdefault((r["doc_id"], r["entity_id"], tuple(r["aliases"])), set()).add(r["block_ord"])
    for d in range(25):
        nodes = {b: (next(x[6] for x in rows if x[:2] == (d, b) and x[3] == "organization"), {x[6] for x in rows if x[:2] == (d, b) and x[3] == "inn"}, {x[6] for x in rows if x[:2] == (d, b) and x[3] == "ogrn"}) for b in {x[1] for x in rows if x[0] == d}}
        label = {b: b for b in nodes}
        linked = lambda x, y: bool(x[1] & y[1] or x[2] & y[2]) or (x[0] == y[0] and all(not p or not q or p & q for p, q in zip(x[1:], y[1:], strict=True)))
        for _ in nodes:
            for a, b in itertools.combinations(nodes, 2):
                if linked(nodes[a], nodes[b]):
                    label[a] = label[b] = min(label[a], label[b])
        want = sorted(sorted(b for b in nodes if label[b] == x) for x in set(label.values()))
        mine = sorted(sorted(v) for k, v in got.items() if k[0] == d)
        # Groups of one name and size share an id, so they may come as one; each must be a union of whole components.
        assert sorted(itertools.chain(*mine)) == sorted(nodes) and all(any(set(w) <= set(m) for m in mine) for w in want) and all(len({len(w) for w in want if set(w) <= set(m)}) == 1 for m in mine)
