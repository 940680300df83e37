"""What changed between full snapshots: a bucketed key-to-hash index of the last snapshot, probed by the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.normalize import norm_path
from refweave.session import partitions

#: Keys of one snapshot that a bucket holds, about: what a task needs memory for.
BUCKET_KEYS = 250_000


def latest_per_path(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, relative_path, updated_ms): one row per snapshot and path, combined map-side.

    The row with the latest time counts, a null time only where there is no other; times are cut to whole
    milliseconds. Rows without a snapshot number or with a null or blank path are of no snapshot and left out.
    """
    # cut downwards also before 1970
    ms = F.floor(F.unix_micros(F.col("updated_at").cast("timestamp")) / F.lit(1000)).cast("bigint")
    rows = snapshots.select("snapshot_no", norm_path("relative_path").alias("relative_path"), ms.alias("ms"))
    rows = rows.where(F.col("snapshot_no").isNotNull() & F.col("relative_path").isNotNull())
    return rows.groupBy("snapshot_no", "relative_path").agg(F.max("ms").alias("updated_ms"))


class BucketIndex:
    """Key to hash of the last snapshot, for one bucket of keys, with the old values aside.

    ``probe`` takes the whole next snapshot of the bucket, and swaps the index for that snapshot's. Only for keys
    whose hash differs are the old values fetched and compared.
    """

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.hashes, self.values, self.known = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
        self.keys = np.empty(0, object)

    def probe(self, keys: np.ndarray, values: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        """(relative_path, change_kind, old_ms, new_ms) of the keys that were added, removed or changed."""
        hashes = pd.util.hash_array(np.where(known, values, np.int64(0))) ^ np.where(known, np.uint64(0), np.uint64(0x9E3779B97F4A7C15))
        pos = np.fromiter(map(lambda k, get=self.at.get: get(k, -1), keys), np.int64, len(keys))
        old = pos >= 0
        differ = np.flatnonzero(old)[self.hashes[pos[old]] != hashes[old]]
        o = pos[differ]  # fetched for the changes only
        differ, o = (x[(self.known[o] != known[differ]) | (self.values[o] != values[differ])] for x in (differ, o))
        gone = np.ones(len(self.keys), bool)
        gone[pos[old]] = False
        ms = lambda v, k: pd.array(v, dtype="Int64") if k.all() else pd.array(np.where(k, v, 0), dtype="Int64").copy()

        def nullable(v: np.ndarray, k: np.ndarray) -> pd.Series:
            a = ms(v, k)
            a[~k] = pd.NA
            return pd.Series(a)

        new = ~old
        no = lambda n: pd.Series(pd.array([pd.NA] * n, dtype="Int64"))
        parts = [
            (keys[new], "added", no(int(new.sum())), nullable(values[new], known[new])),
            (self.keys[gone], "removed", nullable(self.values[gone], self.known[gone]), no(int(gone.sum()))),
            (keys[differ], "changed", nullable(self.values[o], self.known[o]), nullable(values[differ], known[differ])),
        ]
        out = pd.concat([pd.DataFrame({"relative_path": k, "change_kind": kind, "old_ms": a, "new_ms": b}) for k, kind, a, b in parts if len(k)] or [pd.DataFrame({"relative_path": [], "change_kind": [], "old_ms": [], "new_ms": []})])
        self.at, self.hashes, self.values, self.known, self.keys = dict(zip(keys, range(len(keys)))), hashes, values, known, keys
        return out


def _pass(numbers: list[int]) -> object:
    """Over a bucket's rows in the order of snapshot_no; ``numbers`` are all snapshots delivered, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, at, held, loaded = BucketIndex(), 0, [], False

        def load(no: int) -> pd.DataFrame:
            nonlocal loaded
            d = pd.concat(held) if held else pd.DataFrame({"relative_path": [], "updated_ms": []})
            held.clear()
            known = d["updated_ms"].notna().to_numpy()
            values = d["updated_ms"].fillna(0).to_numpy(dtype=np.int64)
            got = index.probe(d["relative_path"].to_numpy(dtype=object), values, known)
            first, loaded = not loaded, True
            return got.iloc[:0] if first else got.assign(snapshot_no=no)

        def upto(no: int | None) -> Iterator[pd.DataFrame]:
            """Close the snapshots before ``no``, also those without rows in this bucket."""
            nonlocal at
            while at < len(numbers) and (no is None or numbers[at] < no):
                got = load(numbers[at])
                if len(got):
                    yield got[["snapshot_no", "relative_path", "change_kind", "old_ms", "new_ms"]]
                at += 1

        for b in batches:
            for no, part in b.groupby("snapshot_no", sort=True):
                yield from upto(int(no))
                held.append(part)
        yield from upto(None)

    return run


def deliveries(snapshots: DataFrame) -> dict[int, int]:
    """Rows of every snapshot that was delivered, by its number: as many entries as there were deliveries."""
    rows = snapshots.select("snapshot_no", norm_path("relative_path").alias("relative_path")).where(F.col("snapshot_no").isNotNull() & F.col("relative_path").isNotNull())
    return dict(sorted((r[0], r[1]) for r in rows.groupBy("snapshot_no").count().collect()))


def snapshot_changes(latest: DataFrame, rows: dict[int, int] | None = None) -> DataFrame:
    """(snapshot_no, relative_path, change_kind, old_ms, new_ms) of every snapshot against the one delivered before.

    latest: (snapshot_no, relative_path, updated_ms), one row per snapshot and path; rows: its :func:`deliveries`, or at
    least as many. The paths of all snapshots are hashed into buckets once, as many as the largest snapshot needs for
    BUCKET_KEYS keys in each; each bucket then goes through the snapshots in order and holds two of them at a time.
    A path has one row a snapshot, so no bucket is hot. An empty table or a single snapshot gives no rows.
    """
    rows = deliveries(latest) if rows is None else rows
    n = max(partitions(latest.sparkSession), -(-max(rows.values(), default=0) // BUCKET_KEYS))
    buckets = latest.repartition(n, "relative_path").sortWithinPartitions("snapshot_no")
    return buckets.mapInPandas(_pass(sorted(rows)), "snapshot_no int, relative_path string, change_kind string, old_ms long, new_ms long")
