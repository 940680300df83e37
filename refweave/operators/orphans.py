"""References to records that do not exist: as-of match of reference keys against runs of parent keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.normalize import int_key, norm_id
from refweave.operators.liveness import symbol_liveness
from refweave.operators.skew import hot_keys, replicated, salted

OK, LATE, DELETED, MISSING = 0, 1, 2, 3
_NEVER = np.iinfo(np.int64).min


class RunMatcher:
    """Streams keys in order; holds the one run of contiguous parent keys that is open, and the last record.

    Rows are (space, hi, lo, is_ref, at, live, removed): what is known of a key (is_ref 0, at = first arrival, one row a
    key) comes before the references to it (is_ref 1, at = use). A run is a stretch of live parents whose integers follow
    each other; it keeps its end and the latest arrival in it. A reference is matched to the run that starts at or before
    it: beyond its end there is no live parent; used before the run's latest arrival, its own parent's arrival decides.
    """

    def __init__(self) -> None:
        self.end: tuple[int, int, int] | None = None
        self.arrived = _NEVER
        self.last: tuple[int, int, int, int, bool] | None = None  # key, arrival and removal of the last record

    def match(self, space: np.ndarray, hi: np.ndarray, lo: np.ndarray, is_ref: np.ndarray, at: np.ndarray, live: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the references, their state)."""
        known, refs = np.flatnonzero(is_ref == 0), np.flatnonzero(is_ref)
        p = known[live[known]]
        rs, rh, rl, used = space[refs], hi[refs], lo[refs], at[refs]
        # the record before each reference: that of its own key, if there is one
        own = np.cumsum(is_ref == 0)[refs]
        heads = [np.concatenate(([x], y[known])) for x, y in zip(self.last or (-1, 0, 0, 0, False), (space, hi, lo, at, removed))]
        same = (heads[0][own] == rs) & (heads[1][own] == rh) & (heads[2][own] == rl)
        ps, ph, pl, pa_ = space[p], hi[p], lo[p], at[p]
        held = int(self.end is not None)
        if self.end is not None:
            ps, ph, pl = (np.concatenate(([e], x)) for e, x in zip(self.end, (ps, ph, pl)))
            pa_ = np.concatenate(([self.arrived], pa_))
        state = np.where(same & heads[4][own], DELETED, MISSING).astype(np.int32)
        if len(ps):
            fresh = np.ones(len(ps), bool)
            fresh[1:] = ~((ps[1:] == ps[:-1]) & (ph[1:] == ph[:-1]) & ((pl[1:] == pl[:-1]) | ((pl[:-1] != np.iinfo(np.int64).max) & (pl[1:] == pl[:-1] + 1))))
            run = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(ps)) - 1
            arrived = np.maximum.reduceat(pa_, starts)
            before = held + np.cumsum((is_ref == 0) & live)[refs] - 1
            some = before >= 0
            r = run[np.maximum(before, 0)]
            es, eh, el = ps[ends][r], ph[ends][r], pl[ends][r]
            within = some & (es == rs) & ((eh > rh) | ((eh == rh) & (el >= rl)))
            state[within] = np.where((used < arrived[r]) & (used < heads[3][own]), LATE, OK)[within]
            self.end, self.arrived = (ps[-1], ph[-1], pl[-1]), arrived[-1]
        if len(known):
            self.last = tuple(x[known[-1]] for x in (space, hi, lo, at, removed))
        return refs, state


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = RunMatcher()
    salt = None
    for b in batches:
        salts = b.column(0).to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(b.num_rows), np.flatnonzero(salts[1:] != salts[:-1]) + 1):
            if not len(part):
                continue
            if salts[part[0]] != salt:  # each salt goes through the keys in order
                m, salt = RunMatcher(), salts[part[0]]
            t = b.slice(part[0], len(part))
            space, hi, lo, is_ref = (t.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            at = t.column(5).cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)
            live, removed = (t.column(i).fill_null(False).to_numpy(zero_copy_only=False) for i in (6, 7))
            refs, state = m.match(space, hi, lo, is_ref, at, live, removed)
            keep = state != OK
            out = t.take(pa.array(refs[keep]))
            yield pa.RecordBatch.from_arrays([out.column(8), out.column(9), pa.array(state[keep], pa.int32()), out.column(5)], ["ref_id", "ref_side", "state", "ref_at"])


def reference_ends(references: DataFrame) -> DataFrame:
    """(ref_id, ref_side, key, ref_at): the ends of the current row of each reference id.

    A null time is the oldest; ends whose identifier is null or blank aren't set and left out, as are rows without a
    reference id.
    """
    v = F.struct(F.col("indexed_at").cast("timestamp_ntz").alias("at"), norm_id("from_symbol_id").alias("f"), norm_id("to_symbol_id").alias("t"))
    cur = (
        references.select(F.nullif(F.btrim("id"), F.lit("")).alias("ref_id"), v.alias("v")).where(F.col("ref_id").isNotNull())
        .groupBy("ref_id").agg(F.max("v").alias("v"))
    )
    sides = F.explode(F.array(F.struct(F.lit("from").alias("ref_side"), F.col("v.f").alias("key")), F.struct(F.lit("to").alias("ref_side"), F.col("v.t").alias("key"))))
    ends = cur.select("ref_id", F.col("v.at").alias("ref_at"), sides.alias("e")).select("ref_id", "e.ref_side", "e.key", "ref_at").where(F.col("key").isNotNull())
    return ends.select("ref_id", "ref_side", "key", "ref_at")


def orphan_references(references: DataFrame, symbols: DataFrame, removals: DataFrame) -> DataFrame:
    """(ref_id, ref_side, ref_state, ref_at): every reference end that points at no live symbol, or at a later one.

    ref_state is ``late``, ``deleted`` or ``missing``. A reference without a time is before any arrival; a symbol whose
    rows have no time was always there. Extra columns don't matter; empty tables give no rows, or all ends as missing.

    Reference ends and what is known of their keys are range partitioned together, once, on the integer key by sampled
    quantiles, and matched as they stream by in order; nothing is joined back. Keys that a sample of the references finds
    hot are salted by their share of the rows, and what is known of them is there for each salt.
    """
    hot = hot_keys(references.select("from_symbol_id", "to_symbol_id"), ["key"], lambda d: d.select(F.explode(F.array(norm_id("from_symbol_id"), norm_id("to_symbol_id"))).alias("key")))
    space, hi, lo = int_key(F.col("key"))
    ends = salted(reference_ends(references), ["key"], hot, F.col("ref_id"))
    ends = ends.select("salt", space.alias("space"), hi.alias("hi"), lo.alias("lo"), F.lit(1).alias("is_ref"), F.col("ref_at").alias("at"), F.lit(False).alias("live"), F.lit(False).alias("removed"), "ref_id", "ref_side")
    none = F.lit(None).cast("string")
    known = replicated(symbol_liveness(symbols, removals).withColumnRenamed("id", "key"), ["key"], hot)
    known = known.select("salt", space.alias("space"), hi.alias("hi"), lo.alias("lo"), F.lit(0).alias("is_ref"), F.col("first_at").alias("at"), "live", "removed", none.alias("ref_id"), none.alias("ref_side"))
    keys = ["salt", "space", "hi", "lo"]
    ranged = known.unionByName(ends).repartitionByRange(*keys).sortWithinPartitions(*keys, "is_ref")
    found = ranged.mapInArrow(_match_batches, "ref_id string, ref_side string, state int, ref_at timestamp_ntz")
    states = F.array(F.lit("late"), F.lit("deleted"), F.lit("missing"))
    return found.select("ref_id", "ref_side", states[F.col("state") - 1].alias("ref_state"), "ref_at")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_side, month, ref_state, n): cases per end and month (``yyyy-MM``; null where the reference has no time)."""
    return orphans.groupBy("ref_side", F.date_format("ref_at", "yyyy-MM").alias("month"), "ref_state").agg(F.count(F.lit(1)).alias("n"))
