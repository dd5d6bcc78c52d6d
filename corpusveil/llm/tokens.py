"""Token ids of whole texts, with a cache from chunks of text to their ids."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

#: Chunks that a worker keeps, the longest chunk that is kept, and places in which chunks that came once are noted.
CACHE_CHUNKS, CACHE_CHARS, CACHE_NOTES = 500_000, 32, 1 << 22
#: Chunks of a worker that keeps them when they first come, for operators that have its memory to themselves.
LARGE_CACHE = 1_000_000

#: Chunks are splits of the tokenizers' own patterns, or unions of neighbouring ones.
_DROP = re.compile(r"'[^\W_]+|[^\W_]+|(?:[^\w\s]|_)+")
_KEEP = re.compile(r"'[^\W_]+| ?[^\W_]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: White space on which the two regular expression engines differ.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e]")
#: Code points that this Python doesn't know, and the library may; above U+FFFF they are looked up one by one.
_UNKNOWN = re.compile(f"[{''.join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == 'Cn')}]")
_HIGH = re.compile("[\U00010000-\U0010ffff]")


def _unknown(text: str) -> bool:
    return bool(_UNKNOWN.search(text)) or any(unicodedata.category(c) == "Cn" for c in set(_HIGH.findall(text)))


def _dropping(text: str) -> list[str]:
    """Chunks for a tokenizer that composes characters, lower-cases and drops white space."""
    if text.isascii():
        return re.split("[ \n]+", text) if _ODD_SPACE.search(text) else _DROP.findall(text.lower())
    if _unknown(text):
        return [text]
    if _ODD_SPACE.search(text) or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return re.split("[ \n]+", text)
    return _DROP.findall(text)


def _keeping(text: str) -> list[str]:
    """Chunks for byte-level tokenizers that give a word the space before it."""
    return [text] if _ODD_SPACE.search(text) or not text.isascii() and _unknown(text) else _KEEP.findall(text)


class CachedEncoder:
    """Encodes texts with a tokenizer file of the tokenizers library.

    A text falls into chunks that the tokenizer treats one by one, so ids can be kept by chunk. The ids
    come from the library alone, as it gives them by itself: a text that has the string of a special token
    goes to it whole, and that string becomes the token. So does a text with a code point that is unassigned
    here, since the library's tables may say what kind of character it is.
    """

    def __init__(self, path: str, keeps_space: bool, large: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = _keeping if keeps_space else _dropping
        self.large = large
        self.cache: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.noted = bytearray(CACHE_NOTES)

    def _cut(self, text: str) -> list[str]:
        return [text] if any(s in text for s in self.special) else self.chunks(text)

    def _encoded(self, chunks: set[str]) -> Iterator[tuple[str, list[int]]]:
        """The library's ids of each chunk."""
        wanted = list(chunks)
        for i in range(0, len(wanted), 4096):
            part = wanted[i : i + 4096]
            yield from zip(part, (e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True)

    def _keep(self, cache: dict, new: dict) -> None:
        """Keep chunks that came before; most that come once don't come again. A full cache starts anew."""
        if len(cache) + len(new) > CACHE_CHUNKS:
            cache.clear()
            self.noted = bytearray(CACHE_NOTES)
        for c, x in new.items():
            at = hash(c) % CACHE_NOTES
            if self.noted[at] and len(c) <= CACHE_CHARS:
                cache[c] = x
            self.noted[at] = 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.large:
            return self._encode_keeping(texts)
        known, cut, got, missing = self.cache.get, [], [], set()
        for t in texts:
            chunks = self._cut(t)
            ids = list(map(known, chunks))
            if None in ids:
                missing.update(c for c, x in zip(chunks, ids, strict=True) if x is None)
            cut.append(chunks)
            got.append(ids)
        if not missing:
            return [b"".join(ids) for ids in got]
        new = {c: array("I", ids).tobytes() for c, ids in self._encoded(missing)}
        out = [b"".join([new[c] if x is None else x for c, x in zip(chunks, ids, strict=True)] if None in ids else ids) for chunks, ids in zip(cut, got, strict=True)]
        self._keep(self.cache, new)
        return out

    def _encode_keeping(self, texts: list[str]) -> list[bytes]:
        """The same with a large cache, which takes all chunks of the texts first and then gives them."""
        cut = [self._cut(t) for t in texts]
        new = {c: array("I", ids).tobytes() for c, ids in self._encoded(set().union(*cut).difference(self.cache))}
        self.cache.update(new)
        out = [b"".join(map(self.cache.__getitem__, chunks)) for chunks in cut]
        if len(self.cache) > LARGE_CACHE:
            self.cache.clear()
        else:
            for c in (c for c in new if len(c) > CACHE_CHARS):
                del self.cache[c]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        cut = [self._cut(t) for t in texts]
        missing = set().union(*cut).difference(self.counts)
        new = {c: len(ids) for c, ids in self._encoded(missing)}
        known = self.counts
        known.update(new)
        out = [sum(map(known.__getitem__, chunks)) for chunks in cut]
        for c in new:
            del known[c]
        self._keep(self.counts, new)
        return out


_encoders: dict[tuple[str, bool, bool], CachedEncoder] = {}


def encoder(path: str, keeps_space: bool, large: bool = False) -> CachedEncoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, keeps_space, large)
    return _encoders.get(key) or _encoders.setdefault(key, CachedEncoder(*key))
