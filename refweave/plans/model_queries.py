"""Queries of the code model over the domain tables, and their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import scalars as sc
from refweave.operators import catalog, extraction, graph
from refweave.operators.containment import innermost
from refweave.operators.hierarchy import hierarchies
from refweave.plans.problems import id_sql, path_sql
from refweave.operators.ranking import numbered
from refweave.operators.skew import hot_keys, skew_join
from refweave.plans.views import catalogue, current_references, line_counts, listing, live_symbols
from refweave.functions.normalize import norm_id
from refweave.schema import CODE_FILES, FILE, KIND_NAMES
from refweave.session import cut, own_folder, shared_table
from refweave.sources import crawl
from refweave.sources.store import Store
from refweave.sources.tables import table

ONE_PATH = "lattice-core/src/runtime/registry.ts"
MESSAGES = {"start": "Start", "stop": "Stop", "empty": "", "both": "Both"}
MESSAGES_JA = {"start": "開始", "both": ""}
TOP_KINDS = [4, 10, 11]
ROOT = "/work/lattice-core"
STORED = [("test1.txt", datetime(2023, 10, 1, 12, 34, 56, 123000)), ("test1.txt", datetime(2023, 10, 2, 12, 34, 56, 123000)), ("test2.txt", datetime(2023, 10, 3, 12, 34, 56, 123000))]
ASSOCIATIONS = {"**/*.ts": "typescript", "**/*.{py,go}": "script", "**/tests/**/*.ts": "test"}


def _seq() -> F.Column:
    return F.struct("indexed_at", "id")


def _tree(symbols: DataFrame) -> DataFrame:
    return hierarchies(symbols.select("id", "parent_id", "path", "start_line"), False)


def _visible(spark: SparkSession, sf: str) -> DataFrame:
    return live_symbols(spark, sf).join(catalogue(spark, sf).select(F.col("relative_path").alias("path")), "path", "left_semi")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    seen = cut(_visible(spark, sf).select("id", "parent_id", "name", "kind", "path", "start_line"))
    return graph.file_nodes(seen, _tree(seen))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pair_relations(current_references(spark, sf), _seq())


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(_relations(spark, sf), _nodes(spark, sf))


def pair_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).select("from_path", "to_path", "relation_count")


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf)


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("id", "source", "target", "reference_type", "relation_count")


def unresolved_refs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unresolved(_relations(spark, sf), _nodes(spark, sf))


def edge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_stats(_edges(spark, sf))


def edge_details_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_ranks(_edges(spark, sf))


def edge_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return graph.encode_edges(_edges(spark, sf))


def edge_encoding_spread(spark: SparkSession, sf: str) -> DataFrame:
    return graph.encode_edges(_edges(spark, sf), F.col("relation_count") % 15)


def node_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return graph.encode_nodes(_nodes(spark, sf))


def node_encoding_spread(spark: SparkSession, sf: str) -> DataFrame:
    return graph.encode_nodes(_nodes(spark, sf), F.col("symbol_count") % 5)


def graph_elements_union(spark: SparkSession, sf: str) -> DataFrame:
    nodes = cut(_nodes(spark, sf))
    return graph.elements(nodes, graph.edges(_relations(spark, sf), nodes))


def total_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).agg(F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("total"))


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What an index and a graph run count."""
    diff = catalog.listing_diff(listing(spark, sf), catalogue(spark, sf))
    nodes = cut(_nodes(spark, sf))
    parts = {
        "files": catalogue(spark, sf), "upserts": diff.where("action in ('add', 'update')"), "removes": diff.where("action = 'remove'"), "file_symbols": _visible(spark, sf).where(F.col("kind") == FILE),
        "references": current_references(spark, sf), "nodes": nodes, "edges": graph.edges(_relations(spark, sf), nodes),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


def symbol_roots(spark: SparkSession, sf: str) -> DataFrame:
    t = live_symbols(spark, sf)
    parents = t.select(F.col("id").alias("parent_id"), "path")
    return t.join(parents, ["parent_id", "path"], "left_anti").select("id", "path")


def symbols_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Root symbols, and references that begin there, of each file."""
    roots = symbol_roots(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n_roots"))
    used = current_references(spark, sf).where("from_path is not null").groupBy(F.col("from_path").alias("path")).agg(F.count(F.lit(1)).alias("n_references"))
    return roots.join(used, "path", "full_outer").select("path", F.coalesce("n_roots", F.lit(0)).alias("n_roots"), F.coalesce("n_references", F.lit(0)).alias("n_references"))


def symbol_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """All trees as one list in pre-order: by path, then each symbol before those below it, siblings by start_line and id."""
    symbols = cut(live_symbols(spark, sf).select("id", "parent_id", "path", "start_line"))
    # ids that sort as the siblings do, so that the order of the chains is the order of the list
    own = F.concat(F.lpad((F.coalesce("start_line", F.lit(-1)) + 1).cast("string"), 10, "0"), F.lit(":"), "id")
    parents = symbols.select(F.col("id").alias("parent_id"), "path", own.alias("parent"))
    linked = skew_join(symbols, parents, ["parent_id", "path"], F.col("id"), "left")
    tree = hierarchies(linked.select(own.alias("id"), F.col("parent").alias("parent_id"), "path", "start_line")).where("node_depth >= 0")
    placed = tree.join(symbols.select(own.alias("symbol_id"), "path"), "symbol_id")
    listed = numbered(placed.withColumn("chain", F.split("chain", "/")), F.col("path").asc_nulls_first(), F.col("chain").asc())
    return listed.select(F.substring("root_id", 12, 2147483647).alias("root_id"), F.substring("symbol_id", 12, 2147483647).alias("id"), F.col("node_depth").alias("depth"), F.col("row_no").alias("place"))


def _provider(spark: SparkSession, sf: str) -> DataFrame:
    """The live symbols as a provider tells them: by path, without the File roots, with the parent that is there."""
    symbols = cut(live_symbols(spark, sf).where(f"path is not null and (kind is null or kind <> {FILE})"))
    links = hierarchies(symbols.select("id", "parent_id", "path", "start_line"), False, True).select(F.col("symbol_id").alias("symbol_key"), F.col("parent_id").alias("parent_key"))
    rows = symbols.select("path", F.col("id").alias("symbol_key"), F.struct("start_line", "id").alias("ordinal"), "name", "kind", "start_line", "end_line")
    return cut(rows.join(links, "symbol_key"))


def kept_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """What an index run stores of catalogued files: their File roots, and the symbols whose top-level symbol is of a kept kind."""
    provider = _provider(spark, sf)
    kept = extraction.kept_symbols(provider, TOP_KINDS, extraction.top_levels(provider))
    files = catalogue(spark, sf).select("relative_path").join(line_counts(spark, sf), "relative_path", "left")
    return extraction.symbol_rows(kept, files).select("id", "parent_id", "name", "kind", "path", "start_line", "end_line")


def first_symbols(spark: SparkSession, sf: str) -> DataFrame:
    first = _visible(spark, sf).orderBy(*[F.col(c).asc_nulls_first() for c in ("path", "start_line", "id")]).limit(3)
    return first.select("id", "path", "name", sc.kind_name(F.col("kind")).alias("kind_name"))


def first_references(spark: SparkSession, sf: str) -> DataFrame:
    return current_references(spark, sf).orderBy(F.col("indexed_at").asc_nulls_first(), "id").limit(5).select("id", "from_path", "to_path")


def first_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).orderBy("first_seq", "id").limit(3).select("id", "from_label", "to_label", "relation_count")


def files_in_locale_order(spark: SparkSession, sf: str) -> DataFrame:
    files = catalogue(spark, sf).withColumn("sorted", F.collate("relative_path", "UNICODE"))
    return numbered(files, F.col("sorted").asc(), F.col("relative_path").asc()).select("relative_path", F.col("row_no").alias("place"))


def store_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """A store that is created empty and then upserted file by file, as it reads after each step."""
    with Store(spark, f"{own_folder(spark)}/store-{uuid.uuid4().hex}") as store:
        seen = [store.table("code_files").withColumn("step", F.lit(0))]
        for k, row in enumerate(STORED, 1):
            store.publish({"code_files": catalog.upsert(store.table("code_files"), spark.createDataFrame([row], CODE_FILES), "relative_path")})
            seen.append(store.table("code_files").withColumn("step", F.lit(k)))
    return reduce(DataFrame.unionByName, seen).select("step", "relative_path", "updated_at")


def relative_outside(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute paths as seen from a folder that only some of them are in."""
    whole = F.concat(F.lit("/work/"), "relative_path")
    return catalogue(spark, sf).select("relative_path", sc.relative(whole, ROOT).alias("seen"))


def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_files").select("relative_path", "updated_at")


def file_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue(spark, sf).where(F.col("relative_path") == ONE_PATH)


def reference_scan(spark: SparkSession, sf: str) -> DataFrame:
    r = current_references(spark, sf)
    return r.select("id", F.col("from_symbol_id").alias("fromSymbolId"), F.col("to_symbol_id").alias("toSymbolId"), F.col("from_path").alias("fromPath"), F.col("to_path").alias("toPath"), F.col("reference_type").alias("referenceType"), F.col("line_number").alias("lineNumber"))


def symbols_of_path_ordered(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    # one path of a stated name, whose rows are the result: bounded by that file
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return live_symbols(spark, sf).where(F.col("path") == ONE_PATH).select("id", "name", "start_line", F.row_number().over(w).cast("bigint").alias("place"))


def symbol_find_id(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.find_ids(live_symbols(spark, sf))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing_diff(listing(spark, sf), catalogue(spark, sf)).select("relative_path", "action")


def snapshot_removes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.removes(listing(spark, sf), catalogue(spark, sf))


def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.upsert(catalogue(spark, sf), listing(spark, sf), "relative_path")


def catalog_delete(spark: SparkSession, sf: str) -> DataFrame:
    known, listed = catalogue(spark, sf), listing(spark, sf)
    return catalog.delete(known, catalog.removes(listed, known), "relative_path")


def symbol_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A File root for each listed file, by its text's lines, and the live symbols."""
    roots = extraction.file_roots(listing(spark, sf).select("relative_path").join(line_counts(spark, sf), "relative_path", "left"))
    cols = ["id", "parent_id", "name", "kind", "path", "start_line", "end_line"]
    return roots.select(cols).unionByName(live_symbols(spark, sf).select(cols))


def cascade_delete_refs(spark: SparkSession, sf: str) -> DataFrame:
    gone = catalog.removes(listing(spark, sf), catalogue(spark, sf)).union(spark.createDataFrame([(ONE_PATH,)], "relative_path string"))
    return catalog.delete_references(current_references(spark, sf), gone).select("id", "from_path", "to_path")


def cascade_delete_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.delete_symbols(live_symbols(spark, sf), catalog.removes(listing(spark, sf), catalogue(spark, sf))).select("id", "path")


def reference_replace(spark: SparkSession, sf: str) -> DataFrame:
    """References as first indexed, replaced by all of their rows in turn."""
    t = table(spark, sf, "symbol_references").where("id is not null")
    first = t.groupBy("id").agg(F.min(F.struct("indexed_at", "line_number"))["line_number"].alias("line_number"))
    return catalog.replace_by_id(first, t.select("id", "line_number", "indexed_at"), F.col("indexed_at"))


def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    # as often in all rows as in the current ones, and there without a shuffle
    ends = lambda d: catalog.reference_ends(d.select(F.lit("").alias("id"), *[norm_id(c).alias(c) for c in ("from_symbol_id", "to_symbol_id")]))
    hot = hot_keys(table(spark, sf, "symbol_references").select("from_symbol_id", "to_symbol_id"), ["symbol_id"], ends)
    return catalog.fk_violations(current_references(spark, sf), live_symbols(spark, sf), hot).withColumnRenamed("column", "ref_column")


def visible_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _visible(spark, sf).select("id", "path")


def shortest_root(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue(spark, sf).agg(F.min(F.struct(F.length("relative_path"), "relative_path"))["relative_path"].alias("root"))


def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    return live_symbols(spark, sf).select("id", sc.label(F.col("kind"), F.col("name"), F.col("path")).alias("label"))


def relative_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_files").select("relative_path", sc.below(F.col("relative_path"), "lattice-core").alias("below_root"))


def line_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return live_symbols(spark, sf).select("id", sc.line_count(F.col("start_line"), F.col("end_line")).alias("line_count"))


def position_struct(spark: SparkSession, sf: str) -> DataFrame:
    p = sc.position(F.col("pos_x"), F.col("pos_y"))
    return live_symbols(spark, sf).select("id", p["x"].alias("x"), p["y"].alias("y"), p.isNotNull().alias("placed"))


def iso_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_files").select("relative_path", sc.iso_time(F.col("updated_at")).alias("iso"))


def kind_names(spark: SparkSession, sf: str) -> DataFrame:
    return live_symbols(spark, sf).groupBy(sc.kind_name(F.col("kind")).alias("kind_name")).agg(F.count(F.lit(1)).alias("n"))


def locale_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([("start",), ("stop",), ("empty",), ("both",), ("other",)], "key string")
    return keys.select("key", sc.message(F.col("key"), MESSAGES, MESSAGES_JA).alias("message"))


def association_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.associate(listing(spark, sf), ASSOCIATIONS).select("relative_path", "language_id")


def _spans(symbols: DataFrame) -> DataFrame:
    tree = hierarchies(symbols.select("id", "parent_id", "path", "start_line"), False, True).where("node_depth >= 0")
    links = tree.select(F.col("symbol_id").alias("id"), "parent_id", F.col("node_depth").alias("depth"))
    return symbols.drop("parent_id").join(links, "id").withColumn("ordinal", F.struct("start_line", "id"))


def innermost_symbol(spark: SparkSession, sf: str) -> DataFrame:
    positions = current_references(spark, sf).select(F.col("to_path").alias("path"), F.col("line_number").alias("line"))
    return innermost(positions, _spans(cut(live_symbols(spark, sf)))).drop("char")


def innermost_position(spark: SparkSession, sf: str) -> DataFrame:
    """As innermost_symbol, by line and character; these tables have no characters, so they are taken from the names' lengths."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    symbols = cut(live_symbols(spark, sf).withColumns({"start_char": size("name") % 5, "end_char": size("name") % 9 + 10}))
    positions = current_references(spark, sf).select(F.col("to_path").alias("path"), F.col("line_number").alias("line"), (size("from_path") % 23).alias("char"))
    return innermost(positions, _spans(symbols))


def _located(spark: SparkSession, sf: str, symbols: DataFrame) -> DataFrame:
    """Usages of other files' declarations, with the innermost of ``symbols`` there: each distinct position is resolved once."""
    used = current_references(spark, sf).where("line_number is not null").select(F.col("from_path").alias("decl_path"), F.col("id").alias("decl_key"), F.col("to_path").alias("target_path"), F.col("line_number").alias("line"))
    provider = _spans(symbols).select("path", F.col("id").alias("symbol_key"), F.col("parent_id").alias("parent_key"), "depth", "ordinal", "name", "start_line", "end_line")
    provider = cut(provider)
    return extraction.located(provider.drop("depth"), used, provider)


def extracted_references(spark: SparkSession, sf: str) -> DataFrame:
    """Usages resolved to the innermost symbol's id through path, name and start line, from the file that declares."""
    symbols = cut(live_symbols(spark, sf))
    rows, _ = extraction.reference_rows(_located(spark, sf, symbols), symbols)
    return rows.select("from_symbol_id", "to_symbol_id", "from_path", "to_path", "reference_type", "line_number")


def unresolved_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Usages whose symbol a store with the catalogued files' symbols only doesn't have."""
    symbols = cut(live_symbols(spark, sf))
    stored = symbols.join(catalogue(spark, sf).select(F.col("relative_path").alias("path")), "path", "left_semi")
    _, lost = extraction.reference_rows(_located(spark, sf, symbols), stored)
    return lost.drop("char")


def file_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.line_counts(table(spark, sf, "file_texts"))


def crawl_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The test data's own folder, listed by glob."""
    return crawl.listing(spark, sf, {"**/*.parquet": "parquet"}).select("relative_path", "language_id")


_ALL = [
    pair_aggregate, graph_nodes, graph_edges, unresolved_refs, edge_stats, edge_details_ranked, edge_encoding, edge_encoding_spread, node_encoding, node_encoding_spread,
    graph_elements_union, total_symbols, run_counters, symbol_roots, symbols_per_file, symbol_flatten, file_scan, file_point_lookup, reference_scan, symbols_of_path_ordered,
    symbol_find_id, snapshot_diff, snapshot_removes, catalog_upsert, catalog_delete, symbol_insert, cascade_delete_refs, cascade_delete_symbols, reference_replace, fk_violations,
    visible_symbols, shortest_root, path_labels, relative_path, line_metrics, position_struct, iso_timestamp, kind_names, locale_lookup, association_expansion, innermost_symbol,
    innermost_position, extracted_references, unresolved_usages, file_line_counts, kept_symbols, first_symbols, first_references, first_edges, files_in_locale_order, store_sequence,
    relative_outside, crawl_listing,
]
QUERIES = {f.__name__: f for f in _ALL}

_BASE = f"""
WITH RECURSIVE cat AS (SELECT {path_sql('relative_path')} AS relative_path, max(updated_at) AS updated_at FROM code_files WHERE {path_sql('relative_path')} IS NOT NULL GROUP BY 1),
lst AS (SELECT {path_sql('relative_path')} AS relative_path, max(updated_at) AS updated_at FROM code_file_snapshots
    WHERE {path_sql('relative_path')} IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM code_file_snapshots WHERE {path_sql('relative_path')} IS NOT NULL) GROUP BY 1),
lines AS (SELECT {path_sql('relative_path')} AS relative_path, max(coalesce(length(file_text) - length(replace(file_text, chr(10), '')) + 1, 0)) AS line_count FROM file_texts
    WHERE {path_sql('relative_path')} IS NOT NULL GROUP BY 1),
sym AS (SELECT {id_sql('id')} AS id, {id_sql('parent_id')} AS parent_id, {path_sql('path')} AS path, name, kind, start_line, end_line, pos_x, pos_y, indexed_at FROM symbols),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, parent_id DESC NULLS LAST, path DESC NULLS LAST, start_line DESC NULLS LAST, name DESC NULLS LAST) AS rn FROM sym WHERE id IS NOT NULL) WHERE rn = 1),
rem AS (SELECT {id_sql('symbol_id')} AS id, max(removed_at) AS gone FROM symbol_removals WHERE {id_sql('symbol_id')} IS NOT NULL GROUP BY 1),
live AS (SELECT cur.* FROM cur LEFT JOIN rem USING (id) WHERE gone IS NULL OR gone < indexed_at),
ref AS (SELECT * FROM (SELECT id, {id_sql('from_symbol_id')} AS from_symbol_id, {id_sql('to_symbol_id')} AS to_symbol_id, {path_sql('from_path')} AS from_path, {path_sql('to_path')} AS to_path,
    reference_type, line_number, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, {id_sql('from_symbol_id')} DESC NULLS LAST, {id_sql('to_symbol_id')} DESC NULLS LAST) AS rn FROM symbol_references WHERE id IS NOT NULL) WHERE rn = 1),
seen AS (SELECT * FROM live WHERE path IN (SELECT relative_path FROM cat)),
slink AS (SELECT c.id, p.id AS parent FROM seen c LEFT JOIN seen p ON p.id = c.parent_id AND p.path = c.path),
swalk AS (SELECT id, id AS root_id, 0 AS depth FROM slink WHERE parent IS NULL UNION ALL SELECT l.id, w.root_id, w.depth + 1 FROM swalk w JOIN slink l ON l.parent = w.id),
below AS (SELECT root_id, count(*) - 1 AS n FROM swalk GROUP BY 1),
node AS (SELECT id, regexp_extract(path, '[^/]*$') AS label, path, n AS symbol_count, 0 AS kind FROM (SELECT s.id, s.path, b.n,
    row_number() OVER (PARTITION BY s.path ORDER BY s.start_line DESC NULLS LAST, s.id DESC) AS rn FROM seen s JOIN below b ON b.root_id = s.id WHERE s.kind = 0 AND s.path IS NOT NULL) WHERE rn = 1),
rel AS (SELECT arg_min(from_path, (indexed_at, id)) AS from_path, arg_min(to_path, (indexed_at, id)) AS to_path, count(*) AS relation_count, min((indexed_at, id)) AS first_seq
    FROM ref WHERE from_path IS NOT NULL AND to_path IS NOT NULL GROUP BY least(from_path, to_path), greatest(from_path, to_path)),
edge AS (SELECT 'file-relation-' || a.id || '-' || b.id AS id, a.id AS source, b.id AS target, 'file-reference' AS reference_type, relation_count, a.label AS from_label, b.label AS to_label, first_seq
    FROM rel JOIN node a ON a.path = rel.from_path JOIN node b ON b.path = rel.to_path),
link AS (SELECT c.id, p.id AS parent FROM live c LEFT JOIN live p ON p.id = c.parent_id AND p.path = c.path),
walk AS (SELECT id, id AS root_id, 0 AS depth FROM link WHERE parent IS NULL UNION ALL SELECT l.id, w.root_id, w.depth + 1 FROM walk w JOIN link l ON l.parent = w.id),
gone_path AS (SELECT relative_path FROM cat WHERE relative_path NOT IN (SELECT relative_path FROM lst)),
pos AS (SELECT DISTINCT to_path AS path, line_number AS line FROM ref WHERE to_path IS NOT NULL AND line_number IS NOT NULL),
hold AS (SELECT p.path, p.line, l.parent, l.id, row_number() OVER (PARTITION BY p.path, p.line, l.parent ORDER BY s.start_line, s.id) AS rn
    FROM pos p JOIN live s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line JOIN link l ON l.id = s.id),
best AS (SELECT path, line, parent, id FROM hold WHERE rn = 1),
descent AS (SELECT path, line, id, 0 AS depth FROM best WHERE parent IS NULL UNION ALL SELECT b.path, b.line, b.id, d.depth + 1 FROM descent d JOIN best b ON b.path = d.path AND b.line = d.line AND b.parent = d.id),
inner_symbol AS (SELECT path, line, arg_max(id, depth) AS symbol_id FROM descent GROUP BY 1, 2)
"""


def _width(r: str) -> str:
    one = f"coalesce(nullif({r}, 0), 1)"
    i = f"least({one} / 10.0::DOUBLE, 1.0::DOUBLE)"
    return f"""least(greatest({one} * 0.8::DOUBLE, 1.0::DOUBLE), 10.0::DOUBLE) AS width,
    'rgb(' || floor(71 + {i} * 160)::BIGINT || ', ' || floor(144 - {i} * 68)::BIGINT || ', ' || floor(226 - {i} * 166)::BIGINT || ')' AS colour,
    least(0.6::DOUBLE + {one} * 0.04::DOUBLE, 1.0::DOUBLE) AS opacity, greatest(250, 450 - {one} * 15)::BIGINT AS ideal_length, (80 + {one} * 15)::BIGINT AS elasticity"""


def _box(n: str) -> str:
    one = f"coalesce(nullif({n}, 0), 1)"
    return f"greatest(140, length(label) * 9 + {one} * 3)::BIGINT AS width, greatest(70, 50 + {one} * 3)::BIGINT AS height, greatest(100, length(label) * 8)::BIGINT AS text_width, (150000 + {one} * 8000)::BIGINT AS repulsion"


def _stable(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(length({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


_DIFF = """SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN b.relative_path IS NULL THEN 'add' WHEN a.relative_path IS NULL THEN 'remove'
    WHEN date_trunc('millisecond', a.updated_at) IS NOT DISTINCT FROM date_trunc('millisecond', b.updated_at) THEN 'equal' ELSE 'update' END AS action FROM lst a FULL JOIN cat b ON a.relative_path = b.relative_path"""
_MESSAGES = {**MESSAGES, **MESSAGES_JA}
_SHARE = "round(row_number() OVER (ORDER BY relation_count DESC, first_seq, id) / (count(*) OVER ())::DOUBLE * 100, 0)::INTEGER"
SQL = {name: f"{_BASE} {body}" for name, body in {
    "pair_aggregate": "SELECT from_path, to_path, relation_count FROM rel",
    "graph_nodes": "SELECT * FROM node",
    "graph_edges": "SELECT id, source, target, reference_type, relation_count FROM edge",
    "unresolved_refs": "SELECT from_path, to_path, relation_count FROM rel WHERE from_path NOT IN (SELECT path FROM node) OR to_path NOT IN (SELECT path FROM node)",
    "edge_stats": "SELECT sum(relation_count)::BIGINT AS total, round(avg(relation_count), 2) AS average, max(relation_count) AS largest, min(relation_count) AS smallest FROM edge HAVING count(*) > 0",
    "edge_details_ranked": f"SELECT id, from_label, to_label, relation_count, row_number() OVER (ORDER BY relation_count DESC, first_seq, id) AS edge_rank, lpad({_SHARE}::VARCHAR, greatest(2, length({_SHARE}::VARCHAR))::INTEGER, '0') AS percent FROM edge",
    "edge_encoding": f"SELECT id, {_width('relation_count')} FROM edge",
    "edge_encoding_spread": f"SELECT id, {_width('(relation_count % 15)')} FROM edge",
    "node_encoding": f"SELECT id, {_box('symbol_count')} FROM node",
    "node_encoding_spread": f"SELECT id, {_box('(symbol_count % 5)')} FROM node",
    "graph_elements_union": "SELECT 'node' AS element, id, label, path, symbol_count, NULL::VARCHAR AS source, NULL::VARCHAR AS target, NULL::BIGINT AS relation_count FROM node UNION ALL SELECT 'edge', id, NULL, NULL, NULL, source, target, relation_count FROM edge",
    "total_symbols": "SELECT coalesce(sum(symbol_count), 0)::BIGINT AS total FROM node",
    "run_counters": f"""SELECT 'files' AS counter, count(*) AS n FROM cat UNION ALL SELECT 'file_symbols', count(*) FROM seen WHERE kind = 0 UNION ALL SELECT 'references', count(*) FROM ref
    UNION ALL SELECT 'upserts', count(*) FROM ({_DIFF}) WHERE action IN ('add', 'update') UNION ALL SELECT 'removes', count(*) FROM ({_DIFF}) WHERE action = 'remove'
    UNION ALL SELECT 'nodes', count(*) FROM node UNION ALL SELECT 'edges', count(*) FROM edge""",
    "symbol_roots": "SELECT l.id, s.path FROM link l JOIN live s USING (id) WHERE l.parent IS NULL",
    "symbols_per_file": """, a AS (SELECT s.path, count(*) AS n_roots FROM link l JOIN live s USING (id) WHERE l.parent IS NULL GROUP BY 1),
    b AS (SELECT from_path AS path, count(*) AS n_references FROM ref WHERE from_path IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.path, b.path) AS path, coalesce(n_roots, 0) AS n_roots, coalesce(n_references, 0) AS n_references FROM a FULL JOIN b ON a.path = b.path""",
    "symbol_flatten": """, own AS (SELECT id, path, lpad((coalesce(start_line, -1) + 1)::VARCHAR, 10, '0') || ':' || id AS k FROM live),
    chains AS (SELECT l.id, l.id AS root_id, 0 AS depth, [k] AS chain FROM link l JOIN own USING (id) WHERE l.parent IS NULL
        UNION ALL SELECT l.id, c.root_id, c.depth + 1, list_append(c.chain, k) FROM chains c JOIN link l ON l.parent = c.id JOIN own ON own.id = l.id)
    SELECT root_id, c.id, depth, row_number() OVER (ORDER BY path NULLS FIRST, chain) AS place FROM chains c JOIN own ON own.id = c.id""",
    "kept_symbols": f""", prov AS (SELECT * FROM live WHERE path IS NOT NULL AND (kind IS NULL OR kind <> 0)),
    plink AS (SELECT c.id, p.id AS parent FROM prov c LEFT JOIN prov p ON p.id = c.parent_id AND p.path = c.path),
    pwalk AS (SELECT id, id AS root_id FROM plink WHERE parent IS NULL UNION ALL SELECT l.id, w.root_id FROM pwalk w JOIN plink l ON l.parent = w.id),
    tops AS (SELECT w.id, l.parent, s.name, s.kind, s.path, s.start_line, s.end_line FROM pwalk w JOIN plink l USING (id) JOIN live s USING (id) JOIN live r ON r.id = w.root_id
        WHERE s.path IN (SELECT relative_path FROM cat) AND r.kind IN ({', '.join(map(str, TOP_KINDS))}))
    SELECT {_stable("'symbol'", 'path', 'id')} AS id, CASE WHEN parent IS NOT NULL THEN {_stable("'symbol'", 'path', 'parent')} ELSE {_stable("'file'", 'path')} END AS parent_id, name, kind, path, start_line, end_line FROM tops
    UNION ALL SELECT {_stable("'file'", 'relative_path')}, NULL, regexp_extract(relative_path, '[^/]*$'), 0, relative_path, 0, greatest(coalesce(line_count, 0) - 1, 0)::INTEGER FROM cat LEFT JOIN lines USING (relative_path)""",
    "first_symbols": f"SELECT id, path, name, coalesce({KIND_NAMES!r}[kind + 1], 'Unknown') AS kind_name FROM seen ORDER BY path NULLS FIRST, start_line NULLS FIRST, id LIMIT 3",
    "first_references": "SELECT id, from_path, to_path FROM ref ORDER BY indexed_at NULLS FIRST, id LIMIT 5",
    "first_edges": "SELECT id, from_label, to_label, relation_count FROM edge ORDER BY first_seq, id LIMIT 3",
    "files_in_locale_order": "SELECT relative_path, row_number() OVER (ORDER BY relative_path COLLATE en, relative_path) AS place FROM cat",
    "store_sequence": "SELECT step::INTEGER AS step, relative_path, updated_at FROM (VALUES (1, 'test1.txt', TIMESTAMP '2023-10-01 12:34:56.123'), (2, 'test1.txt', TIMESTAMP '2023-10-02 12:34:56.123'), (3, 'test1.txt', TIMESTAMP '2023-10-02 12:34:56.123'), (3, 'test2.txt', TIMESTAMP '2023-10-03 12:34:56.123')) t(step, relative_path, updated_at)",
    "relative_outside": "SELECT relative_path, CASE WHEN relative_path LIKE 'lattice-core/%' THEN substr(relative_path, 14) ELSE '../' || relative_path END AS seen FROM cat",
    "file_scan": "SELECT relative_path, updated_at FROM code_files",
    "file_point_lookup": f"SELECT * FROM cat WHERE relative_path = '{ONE_PATH}'",
    "reference_scan": 'SELECT id, from_symbol_id AS "fromSymbolId", to_symbol_id AS "toSymbolId", from_path AS "fromPath", to_path AS "toPath", reference_type AS "referenceType", line_number AS "lineNumber" FROM ref',
    "symbols_of_path_ordered": f"SELECT id, name, start_line, row_number() OVER (ORDER BY start_line, id) AS place FROM live WHERE path = '{ONE_PATH}'",
    "symbol_find_id": "SELECT path, name, start_line, min(id) AS symbol_id FROM live WHERE path IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL GROUP BY 1, 2, 3",
    "snapshot_diff": _DIFF,
    "snapshot_removes": "SELECT relative_path FROM gone_path",
    "catalog_upsert": "SELECT * FROM lst UNION ALL SELECT * FROM gone_path JOIN cat USING (relative_path)",
    "catalog_delete": "SELECT * FROM cat WHERE relative_path NOT IN (SELECT relative_path FROM gone_path)",
    "symbol_insert": f"""SELECT {_stable("'file'", "relative_path")} AS id, NULL::VARCHAR AS parent_id, regexp_extract(relative_path, '[^/]*$') AS name, 0 AS kind, relative_path AS path, 0 AS start_line,
    greatest(coalesce(line_count, 0) - 1, 0)::INTEGER AS end_line FROM lst LEFT JOIN lines USING (relative_path) UNION ALL SELECT id, parent_id, name, kind, path, start_line, end_line FROM live""",
    "cascade_delete_refs": f"SELECT id, from_path, to_path FROM ref WHERE coalesce(from_path NOT IN (SELECT * FROM gone_path UNION SELECT '{ONE_PATH}'), true) AND coalesce(to_path NOT IN (SELECT * FROM gone_path UNION SELECT '{ONE_PATH}'), true)",
    "cascade_delete_symbols": "SELECT id, path FROM live WHERE path IS NULL OR path NOT IN (SELECT * FROM gone_path)",
    "reference_replace": "SELECT id, line_number FROM (SELECT id, line_number, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, line_number DESC NULLS LAST) AS rn FROM symbol_references WHERE id IS NOT NULL) WHERE rn = 1",
    "fk_violations": """, e AS (SELECT id, 'from_symbol_id' AS ref_column, from_symbol_id AS symbol_id FROM ref UNION ALL SELECT id, 'to_symbol_id', to_symbol_id FROM ref)
    SELECT * FROM e WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT id FROM live)""",
    "visible_symbols": "SELECT id, path FROM seen",
    "shortest_root": "SELECT arg_min(relative_path, (length(relative_path), relative_path)) AS root FROM cat",
    "path_labels": "SELECT id, CASE WHEN kind = 0 THEN coalesce(nullif(regexp_extract(path, '[^/]*$'), ''), path) ELSE name END AS label FROM live",
    "relative_path": "SELECT relative_path, CASE WHEN replace(relative_path, chr(92), '/') LIKE 'lattice-core/%' THEN substr(replace(relative_path, chr(92), '/'), 14) ELSE replace(relative_path, chr(92), '/') END AS below_root FROM code_files",
    "line_metrics": "SELECT id, end_line - start_line + 1 AS line_count FROM live",
    "position_struct": "SELECT id, CASE WHEN pos_y IS NOT NULL THEN pos_x END AS x, CASE WHEN pos_x IS NOT NULL THEN pos_y END AS y, pos_x IS NOT NULL AND pos_y IS NOT NULL AS placed FROM live",
    "iso_timestamp": "SELECT relative_path, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM code_files",
    "kind_names": f"SELECT coalesce({KIND_NAMES!r}[kind + 1], 'Unknown') AS kind_name, count(*) AS n FROM live GROUP BY 1",
    "locale_lookup": "SELECT key, coalesce(nullif(message, ''), key) AS message FROM (VALUES ('start'), ('stop'), ('empty'), ('both'), ('other')) k(key) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _MESSAGES.items()) + ") m(k2, message) ON k2 = key",
    "association_expansion": "SELECT relative_path, 'typescript' AS language_id FROM lst WHERE relative_path LIKE '%.ts' UNION ALL SELECT relative_path, 'script' FROM lst WHERE relative_path LIKE '%.py' OR relative_path LIKE '%.go' UNION ALL SELECT relative_path, 'test' FROM lst WHERE regexp_matches(relative_path, '(^|/)tests/.*[.]ts$')",
    "file_line_counts": "SELECT relative_path, coalesce(length(file_text) - length(replace(file_text, chr(10), '')) + 1, 0)::INTEGER AS line_count FROM file_texts",
    "innermost_symbol": "SELECT path, line, symbol_id FROM inner_symbol",
    "innermost_position": """, cpos AS (SELECT DISTINCT to_path AS path, line_number AS line, length(coalesce(from_path, '')) % 23 AS char FROM ref WHERE to_path IS NOT NULL AND line_number IS NOT NULL),
    span AS (SELECT id, path, start_line, end_line, length(coalesce(name, '')) % 5 AS start_char, 10 + length(coalesce(name, '')) % 9 AS end_char FROM live),
    chold AS (SELECT p.path, p.line, p.char, l.parent, l.id, row_number() OVER (PARTITION BY p.path, p.line, p.char, l.parent ORDER BY s.start_line, s.id) AS rn FROM cpos p JOIN span s ON s.path = p.path
        AND (p.line > s.start_line OR p.line = s.start_line AND p.char >= s.start_char) AND (p.line < s.end_line OR p.line = s.end_line AND p.char <= s.end_char) JOIN link l ON l.id = s.id),
    cbest AS (SELECT path, line, char, parent, id FROM chold WHERE rn = 1),
    cdescent AS (SELECT path, line, char, id, 0 AS depth FROM cbest WHERE parent IS NULL
        UNION ALL SELECT b.path, b.line, b.char, b.id, d.depth + 1 FROM cdescent d JOIN cbest b ON b.path = d.path AND b.line = d.line AND b.char = d.char AND b.parent = d.id)
    SELECT path, line, char::INTEGER AS char, arg_max(id, depth) AS symbol_id FROM cdescent GROUP BY 1, 2, 3""",
    "unresolved_usages": """, ids AS (SELECT path, name, start_line, min(id) AS symbol_id FROM seen GROUP BY 1, 2, 3)
    SELECT r.from_path AS decl_path, r.id AS decl_key, r.to_path AS target_path, r.line_number AS line, s.name, s.start_line FROM ref r JOIN inner_symbol n ON n.path = r.to_path AND n.line = r.line_number
    JOIN live s ON s.id = n.symbol_id LEFT JOIN ids i ON i.path = s.path AND i.name = s.name AND i.start_line = s.start_line WHERE r.from_path <> r.to_path AND i.symbol_id IS NULL""",
    "extracted_references": """, ids AS (SELECT path, name, start_line, min(id) AS symbol_id FROM live WHERE path IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL GROUP BY 1, 2, 3),
    roots AS (SELECT path, min(id) AS from_symbol_id FROM live WHERE kind = 0 AND path IS NOT NULL GROUP BY 1)
    SELECT f.from_symbol_id, i.symbol_id AS to_symbol_id, r.from_path, r.to_path, 'reference' AS reference_type, r.line_number FROM ref r JOIN inner_symbol n ON n.path = r.to_path AND n.line = r.line_number
    JOIN live s ON s.id = n.symbol_id JOIN ids i ON i.path = s.path AND i.name = s.name AND i.start_line = s.start_line JOIN roots f ON f.path = r.from_path WHERE r.from_path <> r.to_path""",
}.items()}
