"""Near-duplicate groups, packing, quality and language against brute force on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.llm import minhash, queries
from corpusveil.llm.langid import identify
from corpusveil.llm.minhash import near_duplicates, shingle_set
from corpusveil.llm.packing import best_fit, dearest, pack, solve
from corpusveil.llm.quality import judged
from corpusveil.llm.queries import tokenizer


def corpus(n=60, seed=3):
    """Texts with copies and edited copies, a long common passage, and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(5, 120))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edited = list(base)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            out.append(" ".join(edited))
        if i % 3 == 0:
            out.append(f"{passage} {' '.join(rng.choices(words, k=rng.randint(5, 30)))}")
    return out + ["", "  \n", None, "a", "A", "a b c", "one two three four", "x " * 3000]


def brute_groups(texts, size, percent):
    sets = [set(shingle_set(t, size).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_equal_brute_force(spark, size):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r["k"]: r for r in near_duplicates(docs, size=size).collect()}
    label, sizes = brute_groups(texts, size, 80)
    assert [got[i]["component"] for i in range(len(texts))] == label
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (label[i] == i) for i in range(len(texts)))


def test_large_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    from corpusveil.llm import minhash

    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(2, 6)):
            t[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["k"]: r["component"] for r in near_duplicates(docs, size=4, pivot_rounds=1).collect()}
    assert [got[i] for i in range(60)] == brute_groups(texts, 4, 80)[0]


def test_groups_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = [(None, "same words here again and again"), (4, "same words here again and again"), (4, "same words here again and again"), (4, "another text under a key that repeats"), (7, None), (None, "of nobody at all but twice"), (None, "of nobody at all but twice")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, r string, component int")
    found = near_duplicates(docs).collect()
    got = Counter((r["k"], r["n_shingles"], r["component"], r["kept"]) for r in found)
    assert got == {(4, 2, 4, True): 2, (4, 3, 4, True): 1, (None, 2, 4, False): 1, (7, 0, 7, True): 1, (None, 2, None, True): 2}
    assert Counter((r["n_shingles"], r["component"]) for r in found if r["first"]) == {(2, 4): 1, (3, 4): 1, (0, 7): 1, (2, None): 1}


def test_links_of_a_group_span_its_components():
    import pyarrow as pa

    from corpusveil.llm.minhash import linked_in_group

    rng = random.Random(8)
    sets = [set(rng.sample(range(60), 50)) for _ in range(200)] + [set(rng.sample(range(10**6), 30)) for _ in range(50)]
    labels = [rng.randrange(40) if i < 80 else 1000 + i for i in range(len(sets))]
    rows = pa.table({"rep": list(range(len(sets))), "n": [len(x) for x in sets], "label": labels, "shingles": pa.array([sorted(x) for x in sets], pa.list_(pa.int64()))})

    def parts(links):
        top = list(range(len(sets)))
        for i, j in [*links, *((labels.index(x), i) for i, x in enumerate(labels))]:
            a, b = top[i], top[j]
            top = [min(a, b) if x in (a, b) else x for x in top]
        return top

    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    found = linked_in_group(rows, 80)
    assert {(min(x), max(x)) for x in found} <= {(min(x), max(x)) for x in near}
    assert parts(found) == parts(near) and len(found) < len(near)


def test_configurations_cover_the_histogram():
    rng = random.Random(1)
    for _ in range(5):
        need = Counter(rng.randint(1, 50) for _ in range(rng.randint(0, 400)))
        plan, bound = solve(dict(need), 50, rounds=20)
        held = Counter()
        for config, n in plan:
            assert sum(config) <= 50 and n > 0
            for x in config:
                held[x] += n
        assert held == need
        assert bound <= sum(n for _, n in plan) <= max(bound * 1.1, bound + 2)
    assert sum(best_fit({10: 10**12}, 50).values()) == 2 * 10**11
    assert sum(dearest(np.array([0, 1.0, 0, 3.5, 0]), 4)) <= 4


def jobs(spark):
    return spark._jsc.sc().dagScheduler().numTotalJobs()


def test_a_run_takes_few_jobs(spark):
    """The driver's memory follows the number of its jobs and broadcasts."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    before = jobs(spark)
    near_duplicates(docs, size=5).write.format("noop").mode("overwrite").save()
    assert jobs(spark) - before <= 200


@pytest.mark.parametrize("part", [100_000, 3])
def test_links_of_many_parts_are_joined(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "FOREST_LINKS", part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (5, 5)]
    found, rows = minhash.joined(spark.createDataFrame(links, "a long, b long").repartition(5))
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = [(r["node"], r["label"]) for r in found.collect()]
    want = {x: y for x, y in label.items() if any(x in link and link[0] != link[1] for link in links)}
    assert {x: y for x, y in got if x in want} == want and len(got) == rows == len(dict(got))
    none, rows = minhash.joined(spark.createDataFrame([], "a long, b long"))
    assert none.count() == rows == 0


def test_packing_is_exact(spark):
    texts = ["", None, "hello world", "the cat " * 900, "short one", "😀 b"] + [f"word{i} " * (i % 60) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = tokenizer("byte_bpe_50k.json")
    rows = pack(docs, tokenizer=path, capacity=64).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        mine = rows[rows.k == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.start) == [0, *mine.length.cumsum()[:-1]]
        assert all(mine.length.iloc[1:] == 64)
        assert [zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == list(mine.ids_crc32)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 64
    assert rows.sequence_id.nunique() <= 1.05 * rows.length.sum() / 64 + 1
    assert pack(docs.where("false"), tokenizer=path).count() == 0


def test_a_large_cache_packs_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and more " * (i % 40)) for i in range(100)], "doc_id long, text string")
    rows = lambda large: sorted(map(tuple, pack(docs, tokenizer=tokenizer("byte_bpe_50k.json"), capacity=64, large=large).collect()))
    assert rows(True) == rows(False)
    seen = {}
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    monkeypatch.setattr(queries, "pack", lambda df, **how: seen.update(how) or pack(df, **how))
    assert queries.op8_best_fit_packing(spark, "").count() >= 100 and seen["large"]


def test_rules_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 90))) for _ in range(60)] + ["", None, "a\nb\na\n \na", "#*x $%", "x y z " * 40, "слово  \t\x0b дом", "q r s t u v w " * 30 + "\n\n"]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r["k"]: r for r in judged(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_bad_hosts_fall_and_the_prior_shrinks(spark):
    good = [(i, "good words that differ " + " ".join(f"w{i}x{j}" for j in range(60)), "good") for i in range(40)]
    bad = [(100 + i, "bad", "bad") for i in range(38)] + [(200, good[0][1], "bad"), (201, "one", "tiny")]
    got = {r["k"]: r["kept"] for r in judged(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(40)) and not got[200] and judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_held_out_languages(spark):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi ne", "bb": "zut pry vex gom", "cc": "ßa öü äh üb"}
    rows = [(i, " ".join(rng.choices(parts[(lang := list(parts)[i % 3])].split(), k=rng.randint(3, 30))), lang) for i in range(240)] + [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "ka lo", None), (None, "ka lo", "aa")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {r["k"]: r for r in got.collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:240])
    assert (found[1000]["lang_pred"], found[1001]["lang_pred"], found[1002]["lang_pred"]) == ("und", "und", "aa")
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[1]["held_out"] == (zlib.crc32(b"1") % 4 == 2)
    assert identify(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).select(F.count("*")).first()[0] == 0
