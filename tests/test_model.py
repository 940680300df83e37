import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refweave.functions import encodings as enc
from refweave.functions import scalars as sc
from refweave.functions.normalize import norm_id, norm_path
from refweave.operators import catalog, graph
from refweave.operators.containment import innermost
from refweave.operators.hierarchy import hierarchies
from refweave.operators.ranking import numbered


def test_spellings(spark):
    ids = [" {ABC-1} ", "abc-1", "\tAbc-1", "{}", "  ", None, "{ x }"]
    got = spark.createDataFrame([(x,) for x in ids], "x string").select(norm_id("x")).collect()
    assert [r[0] for r in got] == ["abc-1"] * 3 + [None] * 3 + ["x"]
    paths = ["a\\b", "./a/b", ".\\a\\b", "A/b", " ", "", None, "./"]
    got = spark.createDataFrame([(x,) for x in paths], "x string").select(norm_path("x")).collect()
    assert [r[0] for r in got] == ["a/b", "a/b", "a/b", "A/b", None, None, None, None]


def first_seen(pairs):
    found = {}
    for f, t in pairs:
        key = (f, t) if (f, t) in found else (t, f) if (t, f) in found else (f, t)
        found[key] = found.get(key, 0) + 1
    return sorted((f, t, n) for (f, t), n in found.items())


def pairs_of(spark, pairs):
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(pairs)], "seq long, from_path string, to_path string").repartition(3)
    return sorted((r.from_path, r.to_path, r.relation_count) for r in graph.pair_relations(df, F.col("seq")).collect())


@pytest.mark.parametrize("pairs,expected", [
    ([("a", "b"), ("b", "a"), ("a", "b")], [("a", "b", 3)]), ([("b", "a"), ("a", "b")], [("b", "a", 2)]), ([("a", "a"), ("a", "a")], [("a", "a", 2)]),
    ([("a", None), (None, "b")], []), ([], []),
])
def test_pair_direction(spark, pairs, expected):
    assert pairs_of(spark, pairs) == expected


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), max_size=60))
def test_pairs_against_a_dictionary(spark, pairs):
    assert pairs_of(spark, pairs) == first_seen(pairs)


SYM = "id string, parent_id string, name string, kind int, path string, start_line int, end_line int"


def nodes_of(spark, data):
    df = spark.createDataFrame(data, SYM)
    return graph.file_nodes(df, hierarchies(df, False))


def test_node_quirks(spark):
    data = [
        ("f1", None, "x", 0, "d/a.ts", 0, 9), ("f2", "", "y", 0, "d/a.ts", 3, 9), ("c1", "f2", "c", 5, "d/a.ts", 4, 5), ("c2", "c1", "c", 5, "d/a.ts", 4, 5),
        ("orphan", "gone", "o", 5, "d/a.ts", 1, 1), ("r1", "r2", "r", 5, "d/a.ts", 1, 1), ("r2", "r1", "r", 5, "d/a.ts", 1, 1), ("self", "self", "s", 5, "d/a.ts", 1, 1),
        ("g", None, "g", 0, "b", 0, 0), ("far", "g", "far", 5, "other", 0, 0),
    ]
    got = sorted((r.id, r.label, r.symbol_count) for r in nodes_of(spark, data).collect())
    assert got == [("f2", "a.ts", 2), ("g", "b", 0)]
    rel = graph.pair_relations(spark.createDataFrame([(1, "d/a.ts", "b"), (2, "b", "none")], "seq int, from_path string, to_path string"), F.col("seq"))
    nodes = nodes_of(spark, data)
    e = graph.edges(rel, nodes)
    assert [(r.id, r.relation_count) for r in e.collect()] == [("file-relation-f2-g", 1)]
    assert [tuple(r) for r in graph.unresolved(rel, nodes).collect()] == [("b", "none", 1)]
    assert graph.edge_stats(e.where("1 = 0")).count() == 0
    assert {r.element for r in graph.elements(nodes, e).collect()} == {"node", "edge"}


def test_encodings(spark):
    df = spark.createDataFrame([(0, "😀"), (1, "a" * 20), (30, ""), (None, None)], "n int, label string")
    got = df.select(enc.node_width(F.col("label"), F.col("n")), enc.node_height(F.col("n")), enc.text_width(F.col("label")), enc.utf16_length(F.col("label")), enc.edge_colour(F.col("n")), enc.edge_width(F.col("n")), enc.edge_length(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        (140, 70, 100, 2, "rgb(87, 137, 209)", 1.0, 435), (183, 70, 160, 20, "rgb(87, 137, 209)", 1.0, 435),
        (140, 140, 100, 0, "rgb(231, 76, 60)", 10.0, 250), (140, 70, 100, 0, "rgb(87, 137, 209)", 1.0, 435),
    ]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/", 100, 0), ("c", 7, 99), ("/r/x\\y", None, None)], "p string, n int, k int")
    got = df.select(sc.basename(F.col("p")), sc.below(F.col("p"), "/r"), sc.pad2(F.col("n")), sc.kind_name(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("a/b/", "a/b/", "100", "File"), ("c", "c", "07", "Unknown"), ("x\\y", "x/y", None, "Unknown")]
    ids = df.select(sc.stable_id(F.col("p"), F.lit(None)), sc.stable_id(F.col("p"), F.lit(""))).first()
    assert ids[0] != ids[1]


def descend(spans, line):
    kids = {}
    for s in sorted(spans, key=lambda s: s[4]):
        kids.setdefault(s[2], []).append(s)
    at, found = None, None
    while hit := next((s for s in kids.get(at, []) if s[5] <= line <= s[6]), None):
        at = found = hit[1]
    return found


def test_innermost_against_descent(spark):
    rnd = random.Random(6)
    spans, depth = [], {}
    for k in range(60):
        parent = rnd.choice([None, *[s[1] for s in spans[:20]]])
        a = rnd.randrange(300)
        depth[f"s{k}"] = 0 if parent is None else depth[parent] + 1
        spans.append(("p", f"s{k}", parent, depth[f"s{k}"], k, a, a + rnd.randrange(-5, 150)))
    lines = [("p", rnd.randrange(350)) for _ in range(120)] + [("q", 3), (None, 1), ("p", None)]
    got = innermost(spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(spans, "path string, id string, parent_id string, depth int, ordinal int, start_line int, end_line int"))
    expected = {n: s for p, n in lines if p == "p" and n is not None and (s := descend(spans, n))}
    assert {r.line: r.symbol_id for r in got.collect()} == expected


def descend_at(spans, at):
    kids = {}
    for s in sorted(spans, key=lambda s: s[4]):
        kids.setdefault(s[2], []).append(s)
    found = None
    while hit := next((s for s in kids.get(found, []) if s[5:7] <= at <= s[7:9]), None):
        found = hit[1]
    return found


def test_innermost_by_characters(spark):
    rnd = random.Random(7)
    spans, depth = [], {}
    for k in range(40):  # all within two lines, so that only characters tell them apart
        parent = rnd.choice([None, *[s[1] for s in spans[:15]]])
        a, b = sorted((rnd.randrange(2), rnd.randrange(60)) for _ in range(2))
        depth[f"s{k}"] = 0 if parent is None else depth[parent] + 1
        spans.append(("p", f"s{k}", parent, depth[f"s{k}"], k, *a, *b))
    positions = [("p", rnd.randrange(2), rnd.randrange(62)) for _ in range(150)] + [("p", 1, None)]
    got = innermost(
        spark.createDataFrame(positions, "path string, line int, char int"),
        spark.createDataFrame(spans, "path string, id string, parent_id string, depth int, ordinal int, start_line int, start_char int, end_line int, end_char int"),
    )
    expected = {(n, c or 0): s for _, n, c in positions if (s := descend_at(spans, (n, c or 0)))}
    assert {(r.line, r.char): r.symbol_id for r in got.collect()} == expected and len(set(expected.values())) > 4


def test_numbered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "a int, b int").repartition(6)
    got = numbered(df, F.col("a").desc(), F.col("b").asc()).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in got] == sorted(((i % 7, i) for i in range(100)), key=lambda t: (-t[0], t[1]))
    assert [r.row_no for r in got] == list(range(1, 101)) and {r.row_count for r in got} == {100}
    assert numbered(df.where("a > 9"), F.col("a").asc()).count() == 0


def test_diff_of_listing(spark):
    t = lambda s: datetime.fromisoformat(s)
    listed = [("equal", t("2023-10-01T12:34:56.123")), ("add", t("2023-10-02T12:34:56.123")), ("update", t("2023-10-03T12:34:56.123")), ("older", t("2020-01-01")), ("micro", t("2023-10-01T12:34:56.123456")), ("null", None), ("to_null", None)]
    known = [("equal", t("2023-10-01T12:34:56.123")), ("update", t("2023-10-02T12:34:56.123")), ("remove", t("2023-10-04")), ("older", t("2021-01-01")), ("micro", t("2023-10-01T12:34:56.123999")), ("null", None), ("to_null", t("2020-01-01"))]
    s = "relative_path string, updated_at timestamp_ntz"
    a, b = spark.createDataFrame(listed, s), spark.createDataFrame(known, s)
    got = {r.relative_path: r.action for r in catalog.listing_diff(a, b).collect()}
    assert got == {"equal": "equal", "add": "add", "update": "update", "remove": "remove", "older": "update", "micro": "equal", "null": "equal", "to_null": "update"}
    assert [r[0] for r in catalog.removes(a, b).collect()] == ["remove"]


def test_replace_and_delete(spark):
    t = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", None, "x"), ("4", "c", "d")], "id string, from_path string, to_path string")
    new = spark.createDataFrame([("1", "n", "n", 1), ("1", "m", "m", 2), ("9", "z", "z", 1)], "id string, from_path string, to_path string, seq int")
    assert sorted(tuple(r) for r in catalog.replace_by_id(t, new, F.col("seq")).where("id in ('1', '9')").collect()) == [("1", "m", "m"), ("9", "z", "z")]
    gone = spark.createDataFrame([("b",), ("b",)], "relative_path string")
    assert sorted(r.id for r in catalog.delete_references(t, gone).collect()) == ["3", "4"]
