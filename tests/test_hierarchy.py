import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refweave.operators import hierarchy

SCHEMA = "id string, parent_id string, path string, start_line int, depth int"


def brute(nodes):
    by = {n[0]: n for n in nodes}
    out = {}
    for n in nodes:
        chain, x, seen = [], n, set()
        while True:
            if x[0] in seen:
                out[n[0]] = ("", -1, "")
                break
            seen.add(x[0])
            chain.append(x[0])
            p = by.get(x[1])
            if p is None or p[2] is None or p[2] != x[2]:
                out[n[0]] = (x[0], len(chain) - 1, "/".join(reversed(chain)))
                break
            x = p
    return sorted((k, *v) for k, v in out.items())


def forest(rnd, n, paths):
    nodes = []
    for k in range(n):
        path = "hot" if k % 3 == 0 else rnd.choice(paths)
        parent = rnd.choice([None, "", "absent", *([f"n{rnd.randrange(n)}"] * 8)]) if rnd.random() < 0.15 else f"n{rnd.randrange(max(1, k))}"
        nodes.append((f"n{k}", parent, path, rnd.choice([None, k % 50]), 1))
    return nodes


@pytest.mark.parametrize("small", [2**24, 0])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(hierarchy, "BROADCAST_BYTES", small)
    nodes = forest(random.Random(3), 400, ["a", "b", None])
    got = hierarchy.hierarchies(spark.createDataFrame(nodes, SCHEMA).repartition(5), with_parents=True)
    by = {n[0]: n for n in nodes}
    parents = {n[0]: n[1] if n[1] in by and n[2] is not None and by[n[1]][2] == n[2] else None for n in nodes}
    assert {r.symbol_id: r.parent_id for r in got.collect()} == parents
    assert sorted((r.symbol_id, r.root_id, r.node_depth, r.chain) for r in got.collect()) == brute(nodes)


def test_long_chain_and_cycle_over_partitions(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)  # neighbours in the chain lie in different partitions
    nodes = [(f"c{k:03d}", f"c{k - 1:03d}" if k else None, "one", order[k], 1) for k in range(n)]
    ring = [(f"r{k:03d}", f"r{(k + 1) % 50:03d}", "one", order[k] + n, 1) for k in range(50)] + [("tail", "r007", "one", 5, 1), ("self", "self", "one", 6, 1)]
    got = hierarchy.hierarchies(spark.createDataFrame(nodes + ring, SCHEMA))
    assert sorted((r.symbol_id, r.root_id, r.node_depth, r.chain) for r in got.collect()) == brute(nodes + ring)
    pairs = hierarchy.descendants(got).where("symbol_id = 'c000'")
    assert pairs.count() == n - 1 and pairs.agg({"distance": "max"}).first()[0] == n - 1


def test_chain_of_ten_thousand(spark):
    """Chains add up to some 200 MB, which no broadcast may hold."""
    n = 10_000
    order = list(range(n))
    random.Random(5).shuffle(order)
    nodes = spark.createDataFrame([(f"{k}", f"{k - 1}" if k else None, "one", order[k], 1) for k in range(n)], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = hierarchy.hierarchies(nodes)
        right = (F.col("symbol_id") == F.col("node_depth")) & (F.col("root_id") == "0") & (F.size(F.split("chain", "/")) == F.col("node_depth") + 1)
        right &= F.element_at(F.split("chain", "/"), -1) == F.col("symbol_id")
        assert got.where(right).count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_forest_of_arrays():
    f = hierarchy.WeightedForest(np.array([-1, 0, 1, 4, 3, 4, -1]))
    assert f.cyclic.tolist() == [False, False, False, True, True, True, False]
    assert f.root[:3].tolist() == [0, 0, 0] and f.offset[:3].tolist() == [0, 1, 2]
    assert f.paths(np.array(list("abcdefg"), object)) == ["a", "a/b", "a/b/c", "", "", "", "g"]


def test_empty(spark):
    assert hierarchy.hierarchies(spark.createDataFrame([], SCHEMA)).count() == 0
