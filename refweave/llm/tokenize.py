"""Encoding of texts with a public byte-level tokenizer, as a reduction over a tree of text pieces."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = os.environ.get("REFWEAVE_TOKENIZERS", "/opt/tokenizers")
#: How the byte-level vocabularies split a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters of a leaf: longer texts are halved.
LEAF = 8192

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kind(c: str) -> int:
    """The class of a character in PATTERN."""
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return _SPACE
    import unicodedata

    k = unicodedata.category(c)[0]
    return _LETTER if k == "L" else _NUMBER if k == "N" else _OTHER


def safe_cut(text: str, at: int) -> bool:
    """True where every way to split ``text`` by PATTERN has a bound before character ``at``.

    No alternative holds a character that isn't space and then one of another class, but for an apostrophe and the
    letters of a contraction. Unassigned characters may be classed otherwise by other versions of Unicode and count as
    no cut.
    """
    a, b = text[at - 1], text[at]
    if a == "'" or not (a.isascii() and b.isascii()):
        import unicodedata

        if a == "'" or "C" in unicodedata.category(a) + unicodedata.category(b):
            return False
    ka = _kind(a)
    return ka != _SPACE and ka != _kind(b)


class TreeTokenizer:
    """encode(x + y) from encode(x) and encode(y); (token lists with their text, join) is a monoid with '' as unit."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.leaf = leaf

    def join(self, text: str, left: list[int], right: list[int], lo: int, mid: int, hi: int) -> list[int]:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi].

        The window around mid grows until it ends at safe cuts; tokens outside it are those of the halves, as what is
        before a safe cut is split and merged without regard to what is behind it. Without a cut it grows to the end.
        """
        size, a, b = 16, mid, mid
        while True:
            below, above = max(lo, mid - size), min(hi, mid + size)
            a = next((x for x in range(a, below, -1) if lo < x < mid and safe_cut(text, x)), None) if a == mid else a
            b = next((x for x in range(b, above) if mid < x < hi and safe_cut(text, x)), None) if b == mid else b
            a = mid if a is None else a
            b = mid if b is None else b
            if (a < mid or below == lo) and (b > mid or above == hi):
                break
            size *= 2
        a, b = lo if a == mid else a, hi if b == mid else b
        middle = self.encoding.encode_ordinary(text[a:b])
        return self._keep(left, len(text[a:mid].encode()), True) + middle + self._keep(right, len(text[mid:b].encode()), False)

    def _keep(self, tokens: list[int], drop: int, end: bool) -> list[int]:
        """``tokens`` without those of the last (or first) ``drop`` bytes."""
        at, step = (len(tokens) - 1, -1) if end else (0, 1)
        while drop > 0:
            drop -= int(self.sizes[tokens[at]])
            at += step
        if drop:
            raise AssertionError("a token lies across a safe cut")
        return tokens[: at + 1] if end else tokens[at:]

    def encode(self, text: str | None) -> list[int]:
        """Token ids; none for an empty or null text."""
        if not text:
            return []
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, self._encode(text, lo, mid), self._encode(text, mid, hi), lo, mid, hi)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together up a tree of halves, and read as UTF-8 at its root."""
        return self._bytes(ids).decode()

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        return self._bytes(ids[: len(ids) // 2]) + self._bytes(ids[len(ids) // 2 :])


_loaded: dict[tuple[str, int], TreeTokenizer] = {}


def tokenizer(path: str, leaf: int = LEAF) -> TreeTokenizer:
    """The tokenizer of a ``.tiktoken`` vocabulary file, loaded once a Python worker."""
    if (path, leaf) not in _loaded:
        _loaded[path, leaf] = TreeTokenizer(path, leaf)
    return _loaded[path, leaf]


def encode(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens; an empty list for an empty or null text.

    Nothing is shuffled; each row gives a row, repeated and null doc_ids too. The vocabulary file must be at the same
    path on every executor.
    """
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, leaf)
        for b in batches:
            lists = [t.encode(x) for x in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=offsets[1:])
            # pieces of at most 2**31 ids, as list offsets are 32 bits
            start = 0
            while start < len(lists):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + 2**30, "right")) - 1)
                flat = np.fromiter(chain.from_iterable(lists[start:stop]), np.int32, int(offsets[stop] - offsets[start]))
                ids = pa.ListArray.from_arrays(pa.array((offsets[start : stop + 1] - offsets[start]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), ids], ["doc_id", "ids"])
                start = stop

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, leaf)
        for b in batches:
            texts = [t.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
