"""Main text, records, rollups, toxicity, segmentation and media on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.llm import rollups, sampling
from corpusveil.llm.html import extract, main_text
from corpusveil.llm.queries import tokenizer
from corpusveil.llm.records import crc32c, frames, read_at, read_frames, read_records, write_records
from corpusveil.llm.tokens import CachedEncoder

ODD = ["", " ", "a", "don't stop's", "İ'll ²½Ⅷ", "é x", "tab\t\x1c\x85 nbsp\xa0end  ", "<|endoftext|> 's", "日本 😀\n\n  x", "a__*b ''s 1's ٣", "Σίσυφος ς"]


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_ids_equal_the_librarys(name, keeps):
    from tokenizers import Tokenizer

    e, plain = CachedEncoder(tokenizer(name), keeps), Tokenizer.from_file(tokenizer(name))
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("".join(ODD), k=rng.randint(0, 40))) for _ in range(2000)]
    texts += ["<|startoftext|>", "a<|endoftext|>b", " <|endoftext|>  word <|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "long " * 50 + "<|startoftext|>é"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want


def test_records_round_trip(spark, tmp_path):
    texts = [*ODD, None, "word " * 3000]
    docs = spark.createDataFrame([(i * 7 % 13, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    root = write_records(docs, tokenizer=tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=1)
    got = read_records(spark, root).orderBy("start").collect()
    assert [r["k"] for r in got] == sorted(i * 7 % 13 for i in range(len(texts)))
    e, start = CachedEncoder(tokenizer("word_bpe_49k.json"), False), 0
    by_key = {i * 7 % 13: t for i, t in enumerate(texts)}
    for r in got:
        ids = e.encode([by_key[r["k"]] or ""])[0] + (1).to_bytes(4, "little")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    index = spark.read.parquet(f"{root}/index").where("k in (3, 5)")
    assert {r["k"]: len(r["tokens"]) for r in read_at(spark, root, index).collect()} == {r["k"]: r["n_tokens"] for r in got if r["k"] in (3, 5)}
    none = write_records(docs.where("false"), tokenizer=tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=1)
    assert read_records(spark, none).count() == 0


def test_frames_show_damage():
    import io

    assert [hex(x) for x in crc32c([b"123456789", bytes(32), b"\xff" * 32]).tolist()] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43"]
    data = b"".join(frames([b"12345678", b"x" * 200]))
    assert [p for ps in read_frames(io.BytesIO(data)) for p in ps] == [b"12345678", b"x" * 200]
    with pytest.raises(ValueError):
        list(read_frames(io.BytesIO(data[:-30] + b"?" + data[-29:])))
    with pytest.raises(ValueError):
        list(read_frames(io.BytesIO(data[:-5])))


def test_repeated_commits_change_nothing(spark, tmp_path):
    schema = "source string, lang string, version string, op string, tokens long, old_tokens long, n_docs int"
    first = spark.createDataFrame([("a", "x", "1", "insert", 5, None, 0), ("a", "x", "1", "insert", 7, None, 0), (None, "x", "1", "insert", 1, None, 0), ("b", "x", "1", "insert", 3, None, 0)], schema)
    second = spark.createDataFrame([("a", "x", "1", "revise", 9, 5, None), ("b", "x", "1", "delete", 3, None, None), ("a", "x", "1", None, 3, None, None), ("a", "x", "1", "insert", None, None, None)], schema)
    root = f"file://{tmp_path}/r"
    found = lambda: {(r["source"], r["n_docs"], r["n_tokens"]) for r in rollups.totals(spark, root).collect()}
    assert found() == set()
    rollups.compact(spark, root)
    assert rollups.commit(root, "1", first) and not rollups.commit(root, "1", first)
    assert found() == {("a", 2, 12), (None, 1, 1), ("b", 1, 3)}
    assert rollups.commit(root, "2/b", second) and not rollups.commit(root, "2/b", second)
    want = {("a", 3, 16), (None, 1, 1)}
    assert found() == want
    for _ in range(2):
        rollups.compact(spark, root)
        assert found() == want and not rollups.commit(root, "1", first) and not rollups.commit(root, "2/b", second) and found() == want
    assert rollups.commit(root, "3", first) and found() == {("a", 5, 28), (None, 2, 2), ("b", 1, 3)}
    rollups.compact(spark, root)
    assert not rollups.commit(root, "2/b", second) and found() == {("a", 5, 28), (None, 2, 2), ("b", 1, 3)}
    assert rollups.commit(root, "4", first.where("false")) and found() == {("a", 5, 28), (None, 2, 2), ("b", 1, 3)}


def test_a_compaction_that_was_cut_off_counts_nothing_twice(spark, tmp_path, monkeypatch):
    schema = "source string, lang string, version string, op string, tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "x", "1", "insert", 5, None)], schema)
    root = f"file://{tmp_path}/r"
    rollups.commit(root, "1", rows)
    monkeypatch.setattr(rollups, "delete", lambda *a: None)
    rollups.compact(spark, root)
    assert [r["n_tokens"] for r in rollups.totals(spark, root).collect()] == [5] and not rollups.commit(root, "1", rows)


def test_token_counts_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i, t, "s", None, 3) for i, t in enumerate([*ODD, None, "word " * 2000])], "doc_id long, text string, source string, lang string, byte_bpe_50k int")
    files = {"word_bpe_49k": (tokenizer("word_bpe_49k.json"), False), "byte_bpe_50k": (tokenizer("byte_bpe_50k.json"), True)}
    got = rollups.token_counts(docs, files).collect()
    texts = [r["text"] or "" for r in docs.collect()]
    for v, (path, _) in files.items():
        plain = Tokenizer.from_file(path)
        assert [r[v] for r in got] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {(r["source"], r["lang"]) for r in got} == {("s", None)} and rollups.token_counts(docs.where("false"), files).count() == 0


def test_main_text_of_single_pages():
    page = "<html><body><nav>menu</nav><div class='cookie-notice'>ok?</div><article><h1>T&amp;t</h1><p><b>one<br>two<p>three &lt;x&gt;<script>var a='</p>'</script><div class=ad>buy</div><ul><li>i<li>j</ul></article><aside>side</aside><div id=comments><article>me too</article></div><footer>f</footer>"
    assert main_text(page) == "T&t\n\none two\n\nthree <x>\n\ni\n\nj"
    assert main_text(None) == main_text("  ") == main_text("<p") .replace("<p", "") == ""
    assert main_text("<div>a\n b</div>c") == "a b\n\nc"


def test_branches_that_repeat_on_a_host_go(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=x>Same line everywhere</div><div class=y><p>text number {i}</p></div></body>") for i in range(8)] + [(9, None, None), (10, "http://o.example/", "<div class=x>Same line everywhere</div>")]
    got = {r["k"]: r["text"] for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text number {i}" for i in range(8)} | {9: "", 10: "Same line everywhere"}
    copies = [(i, f"http://h.example/{i}", "<div class=x>Same line everywhere</div>") for i in range(8)]
    assert {r["text"] for r in extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"Same line everywhere"}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_segmentations_are_lossless_and_seeded(spark):
    texts = [*ODD, None, "▁ literal", "internationalisation " * 50, "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda df, seed: {r["k"]: r for r in sampling.segment(df, model=tokenizer("piece_bpe_32k.model"), seed=seed).collect()}
    a, b, c = run(docs, 1), run(docs.repartition(5), 1), run(docs, 2)
    assert all(a[i]["decoded"] == (t or "") for i, t in enumerate(texts))
    assert all(a[i]["ids"] == b[i]["ids"] for i in a) and any(a[i]["ids"] != c[i]["ids"] for i in a)


def test_sampling_follows_the_lattice():
    v = sampling.vocabulary(tokenizer("piece_bpe_32k.model"), 1.0)
    got = sampling.encode(["abc"] * 4000, list(range(4000)), v, 3)
    index = {b: i for i, b in enumerate(v.text) if i > 258 and b}
    splits = [(" abc",), (" ab", "c"), (" a", "bc"), (" a", "b", "c"), (" ", "abc"), (" ", "ab", "c"), (" ", "a", "bc"), (" ", "a", "b", "c")]
    known = {s: sum(v.weight[index[p.encode()]] for p in s) for s in splits if all(p.encode() in index for p in s)}
    total = np.logaddexp.reduce(list(known.values()))
    for s, w in known.items():
        share = sum([v.text[i].decode() for i in ids] == list(s) for ids in got) / 4000
        assert abs(share - np.exp(w - total)) < 0.03
