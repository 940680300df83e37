"""Per-key results where a few keys hold most records: range partition on key and second column, then stitch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.session import partitions

#: Rows that are combined before they are shuffled, at a time.
COMBINE_ROWS = 200_000
#: Rows that are sampled to find the keys that need more than one task.
SAMPLE_ROWS = 100_000
#: Rows that one task is never long over, so that no key of them is hot.
ONE_TASK_ROWS = 50_000


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side: equal (key_column, key_value, second) become one row with their count."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            held.clear()
            names = t.column_names[:3]
            g = t.group_by(names).aggregate([([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "n"])
            yield from g.combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= COMBINE_ROWS:
            yield from flush()
    yield from flush()


class _Partial:
    """The state of one key within one partition: rows, distinct seconds, first and last second."""

    __slots__ = ("key", "n", "distinct", "first", "last")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key_column, key_value, second): a partial state for each key, in order, with its number.

    pid is the partition; the rows of a key that reaches over batches are joined here, so that a partition gives one
    state a key. Only the first and the last key of a partition can go on in another.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    open_: _Partial | None = None
    fields = ["key_column", "key_value", "pid", "n", "n_distinct", "first", "last"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], fields)

    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        kc, kv, second, n = b.column(0), b.column(1), b.column(2), b.column(3).to_numpy(zero_copy_only=False)
        size = b.num_rows
        diff = lambda c: pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, size - 1)), False).to_numpy(zero_copy_only=False)
        null = second.is_null().to_numpy(zero_copy_only=False)
        new_key = np.ones(size, bool)
        new_key[1:] = diff(kc) | diff(kv)
        new_pair = new_key.copy()
        new_pair[1:] |= diff(second) | (null[:-1] != null[1:])
        counted = new_pair & ~null
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], size) - 1
        n_rows, n_distinct = np.add.reduceat(n, starts), np.add.reduceat(counted.astype(np.int64), starts)
        # nulls come first: the first second that isn't null is where counting begins
        firsts = np.minimum.reduceat(np.where(null, size, np.arange(size)), starts)
        rows = []
        cols, vals = kc.take(pa.array(starts)).to_pylist(), kv.take(pa.array(starts)).to_pylist()
        first = second.take(pa.array(np.where(firsts < size, firsts, 0), mask=firsts >= size)).to_pylist()
        last = second.take(pa.array(ends)).to_pylist()
        for c, v, x, d, f, l in zip(cols, vals, n_rows.tolist(), n_distinct.tolist(), first, last):
            if open_ is not None and open_.key == (c, v):
                open_.n += x
                open_.distinct += d - (f is not None and f == open_.last)
                open_.first = f if open_.first is None else open_.first
                open_.last = l if l is not None else open_.last
                continue
            if open_ is not None:
                rows.append((*open_.key, pid, open_.n, open_.distinct, open_.first, open_.last))
            open_ = _Partial()
            open_.key, open_.n, open_.distinct, open_.first, open_.last = (c, v), x, d, f, l
        yield out(rows)
    if open_ is not None:
        yield out([(*open_.key, pid, open_.n, open_.distinct, open_.first, open_.last)])


def key_profile(df: DataFrame, keys: dict[str, Column], second: Column) -> DataFrame:
    """(key_column, key_value, n_rows, n_distinct): rows and distinct ``second`` for every value of each key column.

    Rows are range partitioned by (key_column, key_value, second) with sampled quantiles, so a heavy key is cut over as
    many partitions as its share asks for. Each partition reduces its sorted rows to one partial state a key; states of
    keys that lie across a bound are stitched: counts add up, and a second that ends one part and begins the next
    counts once. Null and blank keys are no values and left out; a null second counts as a row but not as distinct.
    Repeated rows count. An empty table gives no rows.
    """
    pick = F.explode(F.array(*[F.struct(F.lit(name).alias("key_column"), c.alias("key_value"), second.alias("second")) for name, c in keys.items()]))
    rows = df.select(pick.alias("r")).select("r.*").where(F.col("key_value").isNotNull())
    pre = rows.mapInArrow(_combine, "key_column string, key_value string, second string, n long")
    order = ["key_column", "key_value", "second"]
    ranged = pre.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    states = ranged.mapInArrow(_states, "key_column string, key_value string, pid int, n long, n_distinct long, first string, last string")
    # A key has at most one state a partition: no more than the number of partitions meet here.
    parts = F.array_sort(F.collect_list(F.struct("pid", "n", "n_distinct", "first", "last")))
    st = states.groupBy("key_column", "key_value").agg(parts.alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("d"), F.lit(None).cast("string").alias("last"))
    fold = F.aggregate(
        "parts", start,
        lambda acc, x: F.struct(
            (acc["n"] + x["n"]).alias("n"),
            (acc["d"] + x["n_distinct"] - F.when(acc["last"] == x["first"], 1).otherwise(0)).cast("bigint").alias("d"),
            F.coalesce(x["last"], acc["last"]).alias("last"),
        ),
    )
    return st.select("key_column", "key_value", fold.alias("f")).select("key_column", "key_value", F.col("f.n").alias("n_rows"), F.col("f.d").alias("n_distinct"))


def heavy_keys(profile: DataFrame, total: int, percent: int = 4) -> DataFrame:
    """(key_column, key_value) of the values that hold at least ``percent`` of ``total`` rows."""
    return profile.where(F.col("n_rows") * 100 >= F.lit(total) * percent).select("key_column", "key_value")


def hot_keys(rows: DataFrame, keys: list[str], of: Callable[[DataFrame], DataFrame] = lambda d: d, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """(*keys, salts): keys that hold more than half of a shuffle partition's share of ``of(rows)``, and how many tasks each needs.

    Measured on a sample of about ``sample_rows`` of ``rows``, or on all where there are fewer; ``of`` makes the rows with
    the keys of them. No more than twice as many keys as there are shuffle partitions can be hot, whatever the data's
    size; None where none is, as among ONE_TASK_ROWS or less. Null keys join nothing and aren't hot.
    """
    spark, total = rows.sparkSession, rows.count()
    if total <= ONE_TASK_ROWS:
        return None
    sampled = of(rows if total <= sample_rows else rows.sample(sample_rows / total, 17))
    counted = sampled.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    share = (counted.agg(F.sum("n")).first()[0] or 0) / (2 * partitions(spark))
    found = [(*r[:-1], math.ceil(r["n"] / share)) for r in counted.where(F.col("n") > max(2.0, share)).collect()]
    kinds = ", ".join(f"`{k}` {sampled.schema[k].dataType.simpleString()}" for k in keys)
    return spark.createDataFrame(found, f"{kinds}, salts int") if found else None


def salted(rows: DataFrame, keys: list[str], hot: DataFrame | None, spread: Column) -> DataFrame:
    """``rows`` with ``salt``: 0, or for rows of a hot key by ``spread`` one of as many as the key needs."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    j = rows.join(F.broadcast(hot), keys, "left")
    return j.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def replicated(rows: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` with ``salt``: those of a hot key once for each of its salts, the others once."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    j = rows.join(F.broadcast(hot), keys, "left")
    return j.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", hot: DataFrame | None | bool = True) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, without a task for all rows of a hot key of ``left``.

    Hot keys are salted by their share of the rows. They are measured in ``left``, unless ``hot`` gives what :func:`hot_keys`
    found where that is cheaper to read. ``spread`` tells rows of one key apart. Null keys match nothing.
    """
    hot = hot_keys(left, keys) if hot is True else hot
    return salted(left, keys, hot, spread).join(replicated(right, keys, hot), [*keys, "salt"], how).drop("salt")
