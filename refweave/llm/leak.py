"""Evaluation passages inside training texts: an FM-index per shard, then an exact check by alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refweave.llm.fm_index import FMIndex
from refweave.llm.words import words

RUN, SHARE = 30, 10  # running words; one in so many may differ
SEED = 7  # words of a search phrase where the run is RUN long
SHARD_WORDS = 1_000_000
#: About so many characters of items go to a task at a time; of more, the documents are gone through in several passes.
BLOCK_CHARACTERS = 10_000_000
_STEP, _REACH, _BAND = 4, 9, 17  # diagonals: bucket step, reach of a bucket's hits, width of the alignment


class Passages:
    """The items' passages as word numbers, and the phrases to search.

    With at most e = m // 10 changes in m = min(30, length) running words, an unchanged run of ceil((m - e) / (e + 1))
    words remains, and at least m - k + 1 - k e phrases of k words are whole.
    """

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        carried: dict[str, list[str]] = {}
        for item, passage in rows:
            if item is not None and (w := words(passage)):
                carried.setdefault(" ".join(w), []).append(item)
        self.items = list(carried.values())  # items that carry the same passage
        parsed = [p.split(" ") for p in carried]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for p in parsed for x in p}))}  # 0: any other word
        self.length = np.array([len(p) for p in parsed], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.fromiter((self.vocabulary[x] for p in parsed for x in p), np.int32, int(self.begin[-1]))
        m = np.minimum(RUN, self.length)
        e = m // SHARE
        k = np.minimum(SEED, -(-(m - e) // (e + 1)))
        self.need = np.maximum(1, m - k + 1 - k * e)
        self.shortest = int(k.min(initial=SEED))
        self.by_length = [self._phrases(int(x), np.flatnonzero(k == x)) for x in np.unique(k)]

    def __len__(self) -> int:
        return len(self.items)

    def _phrases(self, k: int, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct phrases of k words, passage and place of each use, first use of each phrase and the end)."""
        n = self.length[passages] - k + 1
        passage = np.repeat(passages, n)
        place = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n)
        at = self.begin[passage] + place
        bits = max(1, len(self.vocabulary).bit_length())
        packed = []
        for s in range(0, k, per := max(1, 62 // bits)):
            key = np.zeros(len(at), np.int64)
            for x in range(s, min(k, s + per)):
                key = key << bits | self.flat[at + x]
            packed.append(key)
        order = np.lexsort(packed)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([key[order[1:]] != key[order[:-1]] for key in packed])
        starts = np.flatnonzero(fresh)
        return self.flat[at[order[starts], None] + np.arange(k)].astype(np.int64), passage[order], place[order], np.append(starts, len(order))


_parsed: dict[str, Passages] = {}


def _of_block(name: str, rows: list[tuple[str, str | None]]) -> Passages:
    """The block's passages, parsed once in a Python worker."""
    if name not in _parsed:
        _parsed.clear()
        _parsed[name] = Passages(rows)
    return _parsed[name]


def _segments(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the text to index: stretches of known words long enough for a phrase, each with one 0 behind."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= shortest
    mark = np.zeros(len(ids) + 2, np.int32)
    np.add.at(mark, begin[keep], 1)
    np.add.at(mark, end[keep] + 1, -1)
    return np.flatnonzero(np.cumsum(mark[: len(ids)]) > 0)


def _aligned(p: Passages, text: np.ndarray, lower: np.ndarray, upper: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(holds, first, last word in text) of candidates: text[lower:upper] against a passage near a diagonal.

    best[e, d, c]: the smallest start of a stretch of the passage that ends at the current word, on diagonal d, with e
    words replaced, dropped or added. A candidate holds when a stretch is 30 words long (or the whole passage) and e is
    at most a tenth of it; longer stretches than 59 needn't be tried, as one of their parts holds by itself. Without
    ``places`` only holds is worked out.
    """
    n, far = len(passage), 1 << 30  # above any word of a passage
    most = (2 * RUN - 1) // SHARE
    length = p.length[passage]
    goal = np.minimum(RUN, length)
    best = np.full((most + 1, _BAND, n), far, np.int32)
    begun = np.full((most + 1, _BAND, n), -1, np.int64) if places else None  # where in the text the stretch begins
    holds, first, last = np.zeros(n, bool), np.full(n, 1 << 60, np.int64), np.full(n, -1, np.int64)
    offs = np.arange(_BAND)[:, None]
    need = [np.maximum(goal, SHARE * e).astype(np.int32) for e in range(most + 1)]
    begin, last_word = p.begin[passage], len(p.flat) - 1
    around = text[np.clip(diagonal + offs, 0, len(text) - 1)]
    for i in range(int(length.max(initial=0))):
        at = diagonal + offs + i  # position in text of each diagonal
        if i:
            around = np.concatenate((around[1:], text[np.clip(at[-1:], 0, len(text) - 1)]))
        word = np.where(i < length, p.flat[np.minimum(begin + i, last_word)], -1)
        same = (around == word) & (at >= lower) & (at < upper)
        now = np.where(same, np.minimum(best, np.int32(i)), np.int32(far)) if not places else np.where(same, np.where(best >= far, np.int32(i), best), np.int32(far))
        where = np.where(same, np.where(best >= far, at, begun), -1) if places else None
        for e in range(1, most + 1):
            # replaced: same diagonal; dropped from the text: from one diagonal up; added to it: from one down
            options = [(slice(None), best[e - 1], begun[e - 1] if places else None)]
            options.append((slice(0, -1), best[e - 1][1:], begun[e - 1][1:] if places else None))
            options.append((slice(1, None), now[e - 1][:-1], where[e - 1][:-1] if places else None))
            # a stretch that so far is changed words only
            options.append((slice(None), np.full_like(best[0], max(0, i + 1 - e)), at + 1 if places else None))
            for to, o, o_at in options:
                if places:
                    less = o < now[e][to]
                    where[e][to] = np.where(less, o_at, where[e][to])
                np.minimum(now[e][to], o, out=now[e][to])
        for e in range(most + 1):
            ok = ((i + 1 - now[e]) >= need[e]) & (i < length)
            hit = ok.any(axis=0)
            if hit.any():
                holds |= hit
                if places:
                    first = np.where(hit, np.minimum(first, np.where(ok, where[e], 1 << 60).min(axis=0)), first)
                    last = np.where(hit, np.maximum(last, np.where(ok, np.minimum(at, upper - 1), -1).max(axis=0)), last)
        best, begun = now, where
    return holds, np.maximum(first, lower), last


def search_shard(p: Passages, docs: list[np.ndarray], sample: int = 4) -> pd.DataFrame:
    """(doc, passage, first, last): places where a document of the shard holds a passage, from which word to which."""
    none = pd.DataFrame({"doc": [], "passage": [], "first": [], "last": []}, dtype="int64")
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    if not len(docs) or not len(p):
        return none
    begin = np.concatenate(([0], np.cumsum(sizes)))
    text = np.zeros(begin[-1], np.int32)
    for d, at in zip(docs, begin):
        text[at : at + len(d)] = d
    keep = _segments(text, p.shortest)
    if not len(keep):
        return none
    index = FMIndex(text[keep].astype(np.int64), len(p.vocabulary) + 1, sample)
    found = []
    for phrases, passage, place, starts in p.by_length:
        lo, hi = index.search(phrases)
        which, pos = index.locate(lo, hi)
        pos = keep[pos]
        times = starts[which + 1] - starts[which]  # a phrase may stand in several passages
        rep = np.repeat(np.arange(len(which)), times)
        at = np.repeat(starts[which] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(rep)) if len(rep) else rep
        found.append((pos[rep], passage[at], pos[rep] - place[at]))
    pos, passage, diagonal = (np.concatenate(x) for x in zip(*found))
    if not len(pos):
        return none
    doc = np.searchsorted(begin, pos, "right") - 1
    # hits of one document and passage by diagonal; a bucket with enough hits in reach becomes a candidate
    relative = diagonal - begin[doc] + int(p.length.max())
    pairs, pair = np.unique(doc * len(p) + passage, return_inverse=True)
    key = np.sort(pair * np.int64(1 << 32) + relative)
    buckets = np.unique(key // _STEP)
    a = np.searchsorted(key, buckets * _STEP)
    b = np.searchsorted(key, np.minimum(buckets * _STEP + _REACH, (buckets * _STEP >> 32) + 1 << 32))
    pair = pairs[buckets * _STEP >> 32]
    enough = b - a >= p.need[pair % len(p)]
    buckets, pair = buckets[enough], pair[enough]
    # passages of about one length are aligned together
    order = np.argsort(p.length[pair % len(p)], kind="stable")
    buckets, doc, passage = buckets[order], pair[order] // len(p), pair[order] % len(p)
    diagonal = (buckets * _STEP & (1 << 32) - 1) - int(p.length.max()) + begin[doc] - (_BAND - _REACH) // 2
    out = []
    for s in range(0, len(doc), 4000):
        c = slice(s, s + 4000)
        args = (begin[doc[c]], begin[doc[c] + 1] - 1, passage[c], diagonal[c])
        holds = _aligned(p, text, *args, False)[0]
        args = tuple(x[holds] for x in args)
        _, first, last = _aligned(p, text, *args, True)
        d = doc[c][holds]
        out.append(pd.DataFrame({"doc": d, "passage": args[2], "first": first - begin[d], "last": last - begin[d]}))
    return pd.concat(out).drop_duplicates() if out else none


def leaks(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): places where documents hold 30 running words of an item's passage.

    At most one word in ten may be replaced, dropped or added; a passage of less than 30 words counts when it is there
    as a whole. Every item that carries the passage has its row. The words' numbers count from 0 in the document, in
    which words broken at a line end are joined where the whole is a word of the passages of a block.
    Null or empty texts and passages hold nothing; items without an id are left out; repeated rows give repeated rows.

    The items go to every task, by hash in blocks of about ``block_characters``: of one block at a time the driver and each
    Python worker hold the passages, whatever their number. Documents stay where they are: each task indexes its documents
    in shards of ``shard_words`` words, so nothing is shuffled.
    """
    items = items.select("item_id", "passage").where("item_id is not null")
    size = items.agg(F.sum(F.coalesce(F.length("passage"), F.lit(0)) + F.length("item_id"))).first()[0] or 0
    blocks = max(1, -(-size // block_characters))
    of_block = F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks))
    passes = [_pass(documents, [(r[0], r[1]) for r in items.where(of_block == k).collect()], shard_words) for k in range(blocks)]
    return reduce(DataFrame.unionByName, passes)


def _pass(documents: DataFrame, rows: list[tuple[str, str | None]], shard_words: int) -> DataFrame:
    """:func:`leaks` of one block of items."""
    rows.sort(key=lambda r: r[0])
    shared, name = documents.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _of_block(name, shared.value)
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            got = search_shard(p, docs)
            out = [(ids[d], item, f, l) for d, q, f, l in got.itertuples(index=False) for item in p.items[q]]
            ids.clear(), docs.clear()
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "first_word", "last_word"])

        get, vocabulary = p.vocabulary.get, p.vocabulary
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text, vocabulary)
                if len(w) < p.shortest:
                    continue
                ids.append(doc_id)
                docs.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
                held += len(w)
                if held >= shard_words:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id string, first_word long, last_word long")


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, n_items): overlapping or touching spans of a document merged into one."""
    w = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    reach = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("first_word") > reach + 1), 1).otherwise(0)
    spans = found.withColumn("starts", starts).withColumn("span", F.sum("starts").over(w))
    return spans.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.countDistinct("item_id").alias("n_items")).drop("span")
