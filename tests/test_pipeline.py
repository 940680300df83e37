import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from refweave.plans.pipeline import build_graph, index, show_graph
from refweave.schema import CODE_FILES, PROVIDER_LOCATIONS, PROVIDER_SYMBOLS
from refweave.sinks.page import elements_json, page
from refweave.operators import extraction
from refweave.operators.graph import elements
from refweave.sources import crawl
from refweave.sources.python_symbols import outline, provider_errors, provider_symbols
from refweave.sources.store import Store
from refweave.streaming.incremental import follow

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
PROVIDER = [
    ("a.py", "0", None, 0, "A", 4, 0, 0, 9, 0, 0, 6), ("a.py", "0.0", "0", 0, "run", 5, 2, 4, 4, 0, 2, 8), ("a.py", "1", None, 1, "x", 7, 11, 0, 11, 5, 11, 0),
    ("b.py", "0", None, 0, "g", 11, 0, 0, 5, 0, 0, 4), ("c.py", "0", None, 0, "h", 11, 0, 0, 5, 0, 0, 4),
]
LOCATIONS = [("a.py", "0", "b.py", 3, 0), ("a.py", "0", "a.py", 3, 0), ("b.py", "0", "a.py", 3, 0), ("c.py", "0", "a.py", 0, 0), ("c.py", "0", "b.py", 77, 0)]


def run(spark, store, listed, strict=False):
    df = spark.createDataFrame(listed, CODE_FILES)
    counts = spark.createDataFrame([("a.py", 12), ("b.py", 6), ("c.py", 6)], "relative_path string, line_count int")
    return index(store, df, counts, spark.createDataFrame(PROVIDER, PROVIDER_SYMBOLS), spark.createDataFrame(LOCATIONS, PROVIDER_LOCATIONS), strict=strict)


def refs(store):
    return sorted((r.from_path, r.to_path) for r in store.table("symbol_references").collect())


def test_index_and_graph(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/store") as store:
        got = run(spark, store, [("a.py", T1), ("b.py", T1), ("c.py", T1), ("c.py", T1)])
        assert (got.upserts, got.removes) == (3, 0)
        names = sorted(r.name for r in store.table("symbols").collect())
        assert names == ["A", "a.py", "b.py", "c.py", "g", "h", "run"]  # the top-level field is of no indexed kind
        assert refs(store) == [("a.py", "b.py"), ("b.py", "a.py"), ("c.py", "a.py")]
        first = store.version()
        # a changes: the references that b and c have into it are found anew, or lost when strict
        run(spark, store, [("a.py", T2), ("b.py", T1), ("c.py", T1)])
        assert refs(store) == [("a.py", "b.py"), ("b.py", "a.py"), ("c.py", "a.py")] and store.version() != first
        run(spark, store, [("a.py", T1), ("b.py", T1), ("c.py", T1)], strict=True)
        assert refs(store) == [("a.py", "b.py")]
        got = run(spark, store, [("a.py", T1), ("c.py", T1)])
        assert (got.upserts, got.removes) == (0, 1) and refs(store) == []
        run(spark, store, [("a.py", T1), ("b.py", T2), ("c.py", T1)])
        nodes, edges, lost = build_graph(*(store.table(t) for t in ("code_files", "symbols", "symbol_references")))
        assert sorted((r.label, r.symbol_count) for r in nodes.collect()) == [("a.py", 2), ("b.py", 1), ("c.py", 1)]
        assert edges.count() == 1 and lost.count() == 0
        text = page("</script>", elements(nodes, edges))
        assert text.count("</script>") == 1 and '"label": "a.py"' in elements_json(elements(nodes, edges))


def test_store_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store(spark, f"file://{tmp_path}/none", create=False)
    with Store(spark, f"file://{tmp_path}/s") as store:
        kept = spark.range(3).cache()
        kept.count()
    assert kept.storageLevel.useMemory  # a store closes nothing but itself
    kept.unpersist()
    with pytest.raises(ValueError):
        store.table("symbols")


def test_graph_run(spark, tmp_path):
    at, out, told = f"file://{tmp_path}/store", f"file://{tmp_path}/graph.html", []
    with pytest.raises(FileNotFoundError):
        show_graph(spark, at, out)
    store = Store(spark, at)
    with pytest.raises(ValueError, match="no symbols"):
        show_graph(spark, at, out, limits={"files": 60, "references": 60})
    run(spark, store, [("a.py", T1), ("b.py", T1), ("c.py", T1)])
    got = show_graph(spark, at, out, "<a> & b", {"files": 60, "references": 60}, lambda percent, message: told.append(percent))
    assert (got.files, got.symbols, got.references, got.nodes, got.edges, got.symbols_below, got.skipped) == (3, 7, 3, 3, 2, 4, 0)
    assert got.relations == {"total": 3, "average": 1.5, "largest": 2, "smallest": 1} and told == [10, 20, 35, 50, 58, 100]
    text = (tmp_path / "graph.html").read_text()
    data = json.loads(text.split("const elements = ")[1].split(";\n")[0])
    assert "<title>&lt;a&gt; &amp; b</title>" in text and len(data) == 5 and {"width", "height"} <= data[0]["data"].keys() and "colour" in data[-1]["data"]
    with pytest.raises(TimeoutError):
        show_graph(spark, at, out, limits={"files": 0.0})


@pytest.mark.parametrize("path,root,seen", [
    ("/r/p/a/b.ts", "/r/p", "a/b.ts"), ("/r/q/b.ts", "/r/p/", "../q/b.ts"), ("/x", "/r/p", "../../x"), ("/r/p", "/r/p", ""), ("C:\\w\\a.ts", "C:\\w", "a.ts"), ("C:\\w\\a.ts", "C:\\w\\v", "../a.ts"),
    ("a/b", "/r", "a/b"), ("/r/a\\b", None, "/r/a\\b"), ("/r/pq/a", "/r/p", "../pq/a"), (None, "/r", None),
])
def test_relative_paths(spark, path, root, seen):
    from refweave.functions import scalars

    assert spark.createDataFrame([(path,)], "p string").select(scalars.relative(F.col("p"), root)).first()[0] == seen


def test_upsert_sequence(spark, tmp_path):
    from refweave.operators import catalog

    store = Store(spark, f"file://{tmp_path}/s")
    assert store.table("code_files").count() == 0
    for path, at, n in (("test1.txt", T1, 1), ("test1.txt", T2, 1), ("test2.txt", T1, 2)):
        store.publish({"code_files": catalog.upsert(store.table("code_files"), spark.createDataFrame([(path, at)], CODE_FILES), "relative_path")})
        assert store.table("code_files").count() == n
    assert [tuple(r) for r in store.table("code_files").where("relative_path = 'test1.txt'").collect()] == [("test1.txt", T2)]


def test_crawl(spark, tmp_path):
    for name, at in (("folder1/test1.rs", 1748609346.666), ("folder2/test2.go", 1748609371.429), ("pkg/__init__.py", 1e9), (".git/x.rs", 1e9), ("a.txt", 1e9)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("")
        os.utime(p, (at, at))
    got = sorted((r.relative_path, r.language_id, r.updated_at.isoformat()[:23]) for r in crawl.listing(spark, str(tmp_path), {"**/*.rs": "rust", "**/*.go": "golang", "folder2/*": "any", "**/*.py": "py"}).collect())
    assert got == [
        ("folder1/test1.rs", "rust", "2025-05-30T12:49:06.666"), ("folder2/test2.go", "any", "2025-05-30T12:49:31.429"),
        ("folder2/test2.go", "golang", "2025-05-30T12:49:31.429"), ("pkg/__init__.py", "py", "2001-09-09T01:46:40"),
    ]
    assert crawl.listing(spark, str(tmp_path), None).count() == 0
    root, listed = crawl.workspace(spark, [f"{tmp_path}/folder1", str(tmp_path)], {"**/*.rs": "rust"})
    assert root == str(tmp_path) and [r.relative_path for r in listed.collect()] == ["folder1/test1.rs"] and crawl.store_path("/a/") == "/a/.refweave/store"
    for folders, associations in (([], {"*": "x"}), (["/a"], {}), (["/a"], None)):
        with pytest.raises(ValueError):
            crawl.workspace(spark, folders, associations)
    (tmp_path / "folder1" / "full.rs").write_text("fn main() {}")
    assert [r.relative_path for r in crawl.list_remote(spark, str(tmp_path)).collect()] == ["folder1/full.rs"]
    assert crawl.shortest_root(["/a/b", "/a", "/b"]) == "/a" and crawl.shortest_root([]) is None


@pytest.mark.parametrize("glob,yes,no", [("**/*.ts", ["a.ts", "x/y/a.ts"], ["a.tsx"]), ("*.{js,ts}", ["a.js"], ["b/a.js"]), ("[!a]?.c", ["bc.c"], ["ab.c"]), ("a/**", ["a/b/c"], ["b/a"])])
def test_globs(glob, yes, no):
    import re

    r = re.compile(crawl.glob_regex(glob))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_python_provider(spark):
    text = "class A:\n    def run(self):\n        def inner(): pass\n\ndef f():\n    pass\n"
    assert outline(text) == [
        ("0", None, 0, "A", 4, 0, 0, 2, 25, 0, 6), ("0.0", "0", 0, "run", 5, 1, 4, 2, 25, 1, 8), ("0.0.0", "0.0", 0, "inner", 11, 2, 8, 2, 25, 2, 12), ("1", None, 1, "f", 11, 4, 0, 5, 8, 4, 4),
    ]
    assert outline("x = '😀'; \nif 1: \n  'ä'; 'z'\nclass Ü: a = '😀'")[0][4:] == (4, 3, 0, 3, 17, 3, 6)
    files = spark.createDataFrame([("a.py", text), ("bad.py", "def ("), ("none.py", None)], "path string, file_text string")
    assert provider_symbols(files).count() == 4
    assert provider_symbols(files).columns == [f.name for f in PROVIDER_SYMBOLS.fields]
    assert [(r.path, r.error.split(":")[0]) for r in provider_errors(files).collect()] == [("bad.py", "SyntaxError")]


def test_usages_on_one_line(spark):
    """Two usages of a symbol on one line are two rows, each of the symbol at its character; one that is told twice is one."""
    symbols = [("a", "0", None, 0, "f", 11, 0, 0, 3, 0, 0, 4), ("b", "0", None, 0, "first", 12, 5, 0, 5, 20, 5, 4), ("b", "1", None, 1, "second", 12, 5, 21, 5, 40, 5, 25), ("b", "2", None, 2, "late", 12, 5, 15, 5, 30, 5, 17)]
    provider = spark.createDataFrame(symbols, PROVIDER_SYMBOLS)
    places = [("a", "0", "b", 5, 7), ("a", "0", "b", 5, 7), ("a", "0", "b", 5, 16), ("a", "0", "b", 5, 25), ("a", "0", "b", 5, 41), ("a", "0", "a", 1, 1)]
    tops = extraction.top_levels(provider)
    at = extraction.located(provider, spark.createDataFrame(places, PROVIDER_LOCATIONS), tops)
    assert sorted((r.char, r.name) for r in at.collect()) == [(7, "first"), (7, "first"), (16, "first"), (25, "second")]
    files = spark.createDataFrame([("a", 4), ("b", 6)], "relative_path string, line_count int")
    rows, lost = extraction.reference_rows(at, extraction.symbol_rows(provider.where("name <> 'second'"), files))
    assert rows.count() == 2 and [(r.char, r.name) for r in lost.collect()] == [(25, "second")]


def test_stream_of_listings(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    src = f"{tmp_path}/in"
    for k, rows in enumerate(([("a", T1), ("a", T2), ("b", T1)], [("b", T2)])):
        spark.createDataFrame(rows, CODE_FILES).write.mode("append").parquet(src)
        follow(spark, src, store, f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(tuple(r) for r in store.table("code_files").collect()) == [("a", T2), ("b", T2)]


def test_time_limit(spark):
    import time

    from refweave.plans.control import within

    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)
    slow = spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(20) or b for b in it), "id long")
    with pytest.raises(TimeoutError):
        within(spark, 3, slow.count)


def test_open_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("one\ntwo\n")
    (tmp_path / "y.ts").write_text("one")
    texts = crawl.open_texts(spark, str(tmp_path))
    assert sorted(tuple(r) for r in crawl.line_counts(texts).collect()) == [("a/x.ts", 3), ("y.ts", 1)]
