import random

import pytest
from pyspark.sql import functions as F

from refweave.operators import skew
from refweave.operators.skew import heavy_keys, hot_keys, key_profile, skew_join


def brute(data):
    out = {}
    for a, b, s in data:
        for col, v in (("a", a), ("b", b)):
            if v is not None:
                n, seen = out.get((col, v), (0, set()))
                out[col, v] = (n + 1, seen | ({s} if s is not None else set()))
    return sorted((c, v, n, len(x)) for (c, v), (n, x) in out.items())


def test_profile_against_brute_force(spark, rows):
    rnd = random.Random(1)
    # one key with a third of the rows, one pair with a sixth
    data = [("hot", rnd.choice("xyz"), rnd.choice([None, "s0", *[f"s{i}" for i in range(40)]])) if k % 3 == 0 else (rnd.choice([None, "k1", "k2"]), "hot" if k % 2 else None, "one") for k in range(3000)]
    df = spark.createDataFrame(data, "a string, b string, s string").repartition(7)
    got = key_profile(df, {"a": F.col("a"), "b": F.col("b")}, F.col("s"))
    assert rows(got) == sorted(brute(data), key=lambda t: tuple((True, str(x)) for x in t))
    assert rows(heavy_keys(got, len(data), 20)) == [("a", "hot"), ("a", "k1"), ("a", "k2"), ("b", "hot")]


def test_same_at_many_partitions(spark, rows):
    data = [("k", None, f"s{i % 50}") for i in range(2000)] + [("z", "z", None)] * 3
    df = spark.createDataFrame(data, "a string, b string, s string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert rows(key_profile(df, {"a": F.col("a"), "b": F.col("b")}, F.col("s"))) == [("a", "k", 2000, 50), ("a", "z", 3, 0), ("b", "z", 3, 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string, s string")
    assert key_profile(df, {"a": F.col("a")}, F.col("s")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, rows, monkeypatch, how):
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 100)
    left = spark.createDataFrame([("hot" if k % 2 else f"k{k % 37}" if k % 5 else None, k) for k in range(1000)], "a string, n int")
    right = spark.createDataFrame([(f"k{k}", k) for k in range(30)] + [("hot", -1)], "a string, v int")
    assert [r.a for r in hot_keys(left, ["a"]).collect()] == ["hot"] and hot_keys(right, ["a"]) is None
    assert rows(skew_join(left, right, ["a"], F.col("n"), how)) == rows(left.join(right, ["a"], how))
