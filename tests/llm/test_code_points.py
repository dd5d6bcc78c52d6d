"""Ids of every code point against the tokenizers library's own."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusveil.llm import tokens
from corpusveil.llm.queries import tokenizer
from corpusveil.llm.tokens import CachedEncoder


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_code_point_is_encoded_as_by_the_library(name, keeps):
    mine, theirs = CachedEncoder(tokenizer(name), keeps), Tokenizer.from_file(tokenizer(name))
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0x2FA1E, 0x30000, 0x323B0, 0xE0100, 0x10FFFF)]
    for made in (lambda c: f"a{c}b", lambda c: f"{c}'sa"):
        for i in range(0, len(points), 8192):
            texts = [made(c) for c in points[i : i + 8192]]
            want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
            for _ in range(2):
                assert [np.frombuffer(x, dtype="<u4").tolist() for x in mine.encode(texts)] == want
                assert mine.count(texts) == list(map(len, want))


@pytest.mark.parametrize(("limit", "large"), [(3, False), (50, False), (3, True), (50, True)])
def test_a_full_cache_changes_nothing(monkeypatch, limit, large):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", limit)
    monkeypatch.setattr(tokens, "LARGE_CACHE", limit)
    texts = ["the cat sat", "the dog sat on the mat", "", "zq " * 40, "a b c d e f g the cat", "x" * 100] * 3
    mine, theirs = CachedEncoder(tokenizer("byte_bpe_50k.json"), True, large), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in mine.encode(texts[i : i + 2])] == want[i : i + 2] and mine.count(texts[i : i + 2]) == list(map(len, want[i : i + 2]))
        assert len(mine.cache) <= limit and len(mine.counts) <= limit
