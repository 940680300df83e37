import random
from datetime import datetime, timedelta

import pytest

from refweave.operators.snapshots import latest_per_path, snapshot_changes

SCHEMA = "snapshot_no int, relative_path string, updated_at timestamp_ntz, change_kind string"


def brute(data):
    cur = {}
    for no, p, at, _ in data:
        if no is None or p is None or not p.strip():
            continue
        p = p.replace("\\", "/").removeprefix("./")
        ms = None if at is None else at.replace(microsecond=at.microsecond // 1000 * 1000)
        old = cur.setdefault(no, {}).get(p)
        cur[no][p] = ms if old is None else old if ms is None else max(ms, old)
    out, nos = [], sorted(cur)
    for a, b in zip(nos, nos[1:]):
        for p in cur[a].keys() | cur[b].keys():
            if p not in cur[a] or p not in cur[b]:
                out.append((b, p, "added" if p in cur[b] else "removed"))
            elif cur[a][p] != cur[b][p]:
                out.append((b, p, "changed"))
    return sorted(out)


def test_changes_against_brute_force(spark):
    rnd = random.Random(2)
    t = datetime(2024, 1, 1)
    data = []
    for no in (1, 2, 4, 7):
        for k in range(80):
            for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                p = rnd.choice([f"a/b{k}", f".\\a\\b{k}", f"./a/b{k}"])
                data.append((no, p, rnd.choice([None, t, t, t, t + timedelta(microseconds=400), t + timedelta(days=no)]), "x"))
    data += [(3, "only", t, ""), (None, "x", t, ""), (4, None, t, ""), (4, " ", t, "")]
    got = snapshot_changes(latest_per_path(spark.createDataFrame(data, SCHEMA)))
    assert sorted((r.snapshot_no, r.relative_path, r.change_kind) for r in got.collect()) == brute(data)
    old = {r.relative_path: r for r in got.where("snapshot_no = 3").collect()}
    assert old["only"].old_ms is None and old["only"].new_ms == 1704067200000


def test_single_and_empty(spark):
    assert snapshot_changes(latest_per_path(spark.createDataFrame([], SCHEMA))).count() == 0
    assert snapshot_changes(latest_per_path(spark.createDataFrame([(1, "a", None, "")], SCHEMA))).count() == 0


def test_kept_index(spark, tmp_path):
    from refweave.sources.snapshot_index import SnapshotIndex

    s = "relative_path string, updated_ms long"
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", None), ("e", 5)], s)
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4), ("f", None)], s)
    index = SnapshotIndex(spark, f"file://{tmp_path}/index", buckets=3)
    assert {r.change_kind for r in index.changes(old).collect()} == {"added"}
    index.swap(old)
    got = SnapshotIndex(spark, f"file://{tmp_path}/index", buckets=3).changes(new)
    assert sorted(tuple(r) for r in got.collect()) == [("b", "changed", 2, 3), ("d", "changed", None, 4), ("e", "removed", 5, None), ("f", "added", None, None)]
    index.swap(new)
    assert index.changes(new).count() == 0


def test_a_crash_before_the_pointer_moves(spark, tmp_path, monkeypatch):
    from refweave.schema import CODE_FILES
    from refweave.sources.pointer import Pointer
    from refweave.sources.snapshot_index import SnapshotIndex
    from refweave.sources.store import Store

    old, new = (spark.createDataFrame([(p, 1)], "relative_path string, updated_ms long") for p in "ab")
    index = SnapshotIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.swap(old)
    store = Store(spark, f"file://{tmp_path}/store")
    files = lambda p: spark.createDataFrame([(p, None)], CODE_FILES)
    store.publish({"code_files": files("a")})
    move = Pointer.move

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Pointer, "move", crash)
    for act in (lambda: index.swap(new), lambda: store.publish({"code_files": files("b")})):
        with pytest.raises(KeyboardInterrupt):
            act()
    monkeypatch.setattr(Pointer, "move", move)
    assert SnapshotIndex(spark, f"file://{tmp_path}/index", buckets=2).changes(old).count() == 0
    assert [r[0] for r in Store(spark, f"file://{tmp_path}/store").table("code_files").collect()] == ["a"]
    # a crash after it has moved, with the old pointer still there
    (tmp_path / "store" / "_versions" / "000000000000-gone").touch()
    assert [r[0] for r in Store(spark, f"file://{tmp_path}/store").table("code_files").collect()] == ["a"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("refweave_")]


def test_buckets_by_size(spark, monkeypatch):
    from refweave.operators import snapshots

    monkeypatch.setattr(snapshots, "BUCKET_KEYS", 5)
    df = spark.createDataFrame([(no, f"p{k}", None, "") for no in (1, 2) for k in range(100) if k % (no + 1)], SCHEMA)
    got = snapshot_changes(latest_per_path(df), snapshots.deliveries(df))
    assert got.rdd.getNumPartitions() == 14 and sorted((r.snapshot_no, r.relative_path, r.change_kind) for r in got.collect()) == brute([tuple(r) for r in df.collect()])
