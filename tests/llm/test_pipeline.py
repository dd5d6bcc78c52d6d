"""The pipeline against an independent computation of each stage's rows."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from corpusveil.llm.langid import decided, identify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r string, component int, k double, kept boolean"


def rows_of(rng):
    """Two languages; near copies above and below 0.8, exact copies, repeated rows, null keys, long texts, and a host whose texts mostly fail."""
    parts = {"aa": "ka lo mi ne pu".split(), "bb": "zut pry vex gom wyd".split()}
    word = lambda lang: rng.choice(parts[lang]) + rng.choice(parts[lang]) + rng.choice(parts[lang])
    text = lambda lang, n: [word(lang) for _ in range(n)]
    out = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        base = text(lang, rng.randint(60, 150) if i else 2500)
        out.append((i, " ".join(base), lang, "good"))
        for j, edits in enumerate((1, 2, 30) if i % 6 == 0 else ()):
            near = list(base)
            for at in rng.sample(range(len(near)), edits):
                near[at] = word(lang)
            out.append((100 + 10 * i + j, " ".join(near), lang, "good"))
    out += [(900 + i, out[3 * i][1].upper() if i % 2 else out[3 * i][1], None, "good") for i in range(8)]
    out += [(1, out[1][1], "bb", "good"), (None, " ".join(text("aa", 80)), "aa", "good"), (None, out[5][1], "bb", "good"), (2, " ".join(text("aa", 70)), "aa", None), (2, "ka lo", "aa", None)]
    out += [(2000 + i, "ka", "aa", "bad") for i in range(30)] + [(2100 + i, " ".join(text("aa", 75)), "aa", "bad") for i in range(3)]
    out += [(2200, "12 34 !! ½", "aa", "good"), (2201, None, None, None), (2202, "", "bb", "good"), (2203, "x y z " * 40, "aa", "good")]
    return [(*r, 0, "odd", 1, None, None) for r in out]


def good(text, kept_hosts, host):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and host in kept_hosts


def groups(texts):
    """The group of each text, by its smallest place: five-word shingles, 0.8."""
    sets = []
    for t in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return top


def test_each_stage_and_all_of_it(spark, tmp_path):
    rows = rows_of(random.Random(1))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    back = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    verdict = {(r["k"], r["score"]): r["lang_pred"] for r in identify(docs).collect()}
    first = corpus_pipeline.language(spark, docs, "")
    assert first.columns == docs.columns and first.dtypes == docs.dtypes
    held = [r for r in rows if r[1] and re.search("[^\\W\\d_½]", r[1])]
    assert len(verdict) > 50 and back(first) == Counter((r[0], r[1], r[3]) for r in held)
    first.write.parquet(str(tmp_path / "a"))
    second = corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "a")), "")
    held = [r for r in held if good(r[1], {"good", None}, r[3])]
    assert second.dtypes == docs.dtypes and back(second) == Counter((r[0], r[1], r[3]) for r in held)
    second.write.parquet(str(tmp_path / "b"))
    third = corpus_pipeline.near_duplicate(spark, spark.read.parquet(str(tmp_path / "b")), "")
    held.sort(key=lambda r: (r[0] is None, r[0]))
    top = groups([r[1] for r in held])
    kept = [r for i, r in enumerate(held) if top[i] == i]
    assert third.dtypes == docs.dtypes and back(third) == Counter((r[0], r[1], r[3]) for r in kept) and 60 <= len(kept) < len(held) - 20
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(corpus_pipeline.tokenizer("byte_bpe_50k.json"))
    want = Counter()
    for r in kept:
        ids = [*tok.encode(r[1], add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if at == 0 else 1024
            want[r[0], at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
            at += n
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert Counter(zip(out.doc_id.astype("object").where(out.doc_id.notna(), None), out.start, out.length, out.ids_crc32, strict=True)) == want
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 1024
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decided(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).count() == 0
