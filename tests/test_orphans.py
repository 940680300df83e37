import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from refweave.operators import orphans, skew

REF = "id string, from_symbol_id string, to_symbol_id string, from_path string, to_path string, indexed_at timestamp_ntz, at string"
SYM = "id string, parent_id string, path string, start_line int, indexed_at timestamp_ntz, live boolean, state string"
REM = "symbol_id string, removed_at timestamp_ntz, at string"
T0 = datetime(2024, 1, 1)


def ident(n):
    return f"{n:08x}-0000-4000-8000-{n:012x}"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(-20, 20), st.tuples(st.integers(0, 3), st.booleans(), st.booleans())), st.lists(st.tuples(st.integers(-22, 22), st.integers(0, 3))), st.integers(1, 7))
def test_runs_agree_with_a_dictionary(known, refs, size):
    rows = sorted([(k, 0, *v) for k, v in known.items()] + [(k, 1, at, False, False) for k, at in refs], key=lambda r: r[:2])
    got, m = [], orphans.RunMatcher()
    for s in range(0, len(rows), size):
        lo, is_ref, at, live, removed = (np.array(c) for c in zip(*rows[s : s + size]))
        zero = np.zeros(len(lo), np.int64)
        where, state = m.match(zero, zero, lo, is_ref, at, live, removed)
        got += [(int(lo[a]), int(at[a]), int(x)) for a, x in zip(where, state)]

    def expected(key, at):
        first, live, removed = known.get(key, (0, False, False))
        return (orphans.LATE if at < first else orphans.OK) if live else orphans.DELETED if removed else orphans.MISSING

    assert sorted(got) == sorted((k, at, expected(k, at)) for k, at in refs)


def brute(refs, symbols, removals):
    norm = lambda x: (x or "").strip(" {}\t").lower() or None
    low = datetime.min
    rows, gone = {}, {}
    for r in symbols:
        if norm(r[0]):
            rows.setdefault(norm(r[0]), []).append(r[4] or low)
    for r in removals:
        if norm(r[0]):
            gone.setdefault(norm(r[0]), []).append(r[1])
    cur = {}
    for r in refs:
        key = (r[5] is not None, r[5] or low)
        if r[0] and (r[0] not in cur or key > cur[r[0]][0]):
            cur[r[0]] = (key, r)
    out = []
    for rid, (_, r) in cur.items():
        for side, x in (("from", norm(r[1])), ("to", norm(r[2]))):
            if x is None:
                continue
            live = x in rows and not any(g is not None and g >= max(rows[x]) for g in gone.get(x, []))
            if live:
                if min(rows[x]) > (r[5] or low):
                    out.append((rid, side, "late"))
            else:
                out.append((rid, side, "deleted" if x in gone else "missing"))
    return sorted(out)


def test_orphans_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 100)
    rnd = random.Random(5)
    when = lambda: rnd.choice([None] + [T0 + timedelta(days=d) for d in range(40)])
    spell = lambda s: rnd.choice([s, "{" + s.upper() + "}", "  " + s, s + "\t"])
    ids = [ident(n) for n in range(60)] + ["sym:1#2", "a_b", ident(10**9)]
    symbols = [(rnd.choice([spell(rnd.choice(ids[:55])), None, " "]), None, "p", 1, when(), True, "x") for _ in range(90)]
    removals = [(spell(rnd.choice(ids)), when(), "x") for _ in range(25)]
    hot = ids[58]
    refs = [(f"r{k}" if k % 31 else None, rnd.choice([None, "", spell(rnd.choice(ids))]), hot if k % 3 == 0 else rnd.choice([" ", spell(rnd.choice(ids))]), "a", "b", when(), "x") for k in range(400)]
    refs += rnd.choices([r for r in refs if r[5] is not None], k=30)
    got = orphans.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(symbols, SYM), spark.createDataFrame(removals, REM))
    assert rows(got.select("ref_id", "ref_side", "ref_state")) == brute(refs, symbols, removals)
    counts = orphans.orphan_counts(got)
    assert sum(r["n"] for r in counts.collect()) == got.count()


@pytest.mark.parametrize("with_refs", [False, True])
def test_empty_tables(spark, rows, with_refs):
    refs = spark.createDataFrame([("r", ident(1), None, None, None, T0, "")] if with_refs else [], REF)
    got = orphans.orphan_references(refs, spark.createDataFrame([], SYM), spark.createDataFrame([], REM))
    assert rows(got.select("ref_id", "ref_side", "ref_state")) == ([("r", "from", "missing")] if with_refs else [])


def test_a_key_with_half_of_the_rows_is_split(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 100)
    ids = [ident(n) for n in range(40)]
    symbols = [(ids[n], None, "p", 1, T0 + timedelta(days=n % 3), True, "x") for n in range(0, 40, 2)]
    refs = [(f"r{k}", ids[k % 40], ids[7] if k % 2 else ids[6], "a", "b", T0 + timedelta(days=1), "x") for k in range(4000)]
    df = spark.createDataFrame(refs, REF)
    hot = skew.hot_keys(df.select(F.col("to_symbol_id").alias("key")), ["key"])
    assert {(r.key, r.salts) for r in hot.collect()} == {(ids[6], 4), (ids[7], 4)}  # of 4 partitions, two tasks' worth each
    got = orphans.orphan_references(df, spark.createDataFrame(symbols, SYM), spark.createDataFrame([(ids[7], T0, "")], REM))
    assert rows(got.select("ref_id", "ref_side", "ref_state")) == brute(refs, symbols, [(ids[7], T0, "")])
