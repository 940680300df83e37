"""The two runs: index what changed, and build the graph."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.operators import catalog, extraction, graph
from refweave.operators.hierarchy import hierarchies
from refweave.plans.control import LIMITS, within
from refweave.session import cut
from refweave.sinks.page import page, write_page
from refweave.sources.store import Store

log = logging.getLogger("refweave")
#: Kinds of top-level symbols that are indexed if none are given.
TOP_KINDS = [1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 22]


@dataclass
class IndexRun:
    """What an indexing run did."""

    version: str
    upserts: int
    removes: int
    unresolved: DataFrame
    seconds: float


def index(store: Store, listing: DataFrame, line_counts: DataFrame, provider: DataFrame, locations: DataFrame, kinds: list[int] | None = None, strict: bool = False) -> IndexRun:
    """Bring the store up to a listing: one set-based run, published as a whole or not at all.

    listing: (relative_path, updated_at); line_counts: (relative_path, line_count); provider and locations as in
    :mod:`refweave.schema`. All symbols are saved before references are resolved. A changed file's references are
    deleted in both directions; by default those that other files have into it are resolved anew, with ``strict`` they
    are lost until the other file changes too. A path listed several times counts once.
    """
    began = time.time()
    files = catalog.one_per_path(listing, "relative_path", "updated_at")
    diff = cut(catalog.listing_diff(files, store.table("code_files")))
    changed = diff.where("action in ('add', 'update')").select("relative_path", F.col("listed_at").alias("updated_at"))
    gone = diff.where("action = 'remove'").select("relative_path")
    touched = changed.select("relative_path").union(gone)
    counts = {r[0]: r[1] for r in diff.groupBy("action").count().collect()}
    code_files = catalog.upsert(catalog.delete(store.table("code_files"), gone, "relative_path"), changed, "relative_path")
    tops = extraction.top_levels(provider)
    kept = extraction.kept_symbols(provider, TOP_KINDS if kinds is None else kinds, tops)
    fresh = extraction.symbol_rows(kept, changed.select("relative_path").join(line_counts, "relative_path", "left"))
    symbols = cut(catalog.delete_symbols(store.table("symbols"), touched).unionByName(fresh, allowMissingColumns=True))
    paths = changed.select(F.col("relative_path").alias("p"))
    outbound = locations.join(paths.select(F.col("p").alias("decl_path")), "decl_path", "left_semi")
    if not strict:
        live = code_files.select(F.col("relative_path").alias("decl_path"))
        inbound = locations.join(paths.select(F.col("p").alias("target_path")), "target_path", "left_semi").join(paths.select(F.col("p").alias("decl_path")), "decl_path", "left_anti")
        outbound = outbound.unionByName(inbound.join(live, "decl_path", "left_semi").select(outbound.columns))
    rows, lost = extraction.reference_rows(extraction.located(provider, outbound, tops), symbols)
    references = catalog.upsert(catalog.delete_references(store.table("symbol_references"), touched), rows, "id")
    lost = cut(lost)
    version = store.publish({"code_files": code_files, "symbols": symbols, "symbol_references": references})
    run = IndexRun(version, counts.get("add", 0) + counts.get("update", 0), counts.get("remove", 0), lost, time.time() - began)
    log.info("indexed in %.3f s: %d upserts, %d removes", run.seconds, run.upserts, run.removes)
    return run


def build_graph(code_files: DataFrame, symbols: DataFrame, references: DataFrame, seq: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved relations) of the catalogued files. Symbols of files not catalogued aren't seen."""
    seen = symbols.join(code_files.select(F.col("relative_path").alias("path")), "path", "left_semi")
    nodes = graph.file_nodes(seen, hierarchies(seen.select("id", "parent_id", "path", "start_line"), False))
    relations = graph.pair_relations(references, F.col(seq))
    return nodes, graph.edges(relations, nodes), graph.unresolved(relations, nodes)


@dataclass
class GraphRun:
    """What a graph run counted."""

    files: int
    symbols: int
    references: int
    nodes: int
    edges: int
    symbols_below: int
    relations: dict[str, float]
    skipped: int
    seconds: float


def show_graph(spark: SparkSession, folder: str, out: str, title: str = "Code relations", limits: dict[str, float] | None = None, progress: Callable[[int, str], None] | None = None) -> GraphRun:
    """The graph of the store in ``folder``, written as a page to ``out``.

    A store that isn't there is a FileNotFoundError, one without a symbol of a catalogued file a ValueError. Files, symbols
    and references are each read within ``limits`` seconds, else TimeoutError: symbols within their limit times the number
    of files, as all files are read at once. ``progress`` is told percent and stage, which are logged too.
    """
    began, limits = time.time(), {**LIMITS, **(limits or {})}

    def stage(percent: int, message: str) -> None:
        log.info("%.3f s, %d%%: %s", time.time() - began, percent, message)
        if progress:
            progress(percent, message)

    with Store(spark, folder, create=False) as store:
        files = store.table("code_files")
        n_files = within(spark, limits["files"], files.count)
        stage(10, f"{n_files} files")
        paths = files.select(F.col("relative_path").alias("path"))
        symbols = within(spark, limits["symbols"] * max(1, n_files), lambda: cut(store.table("symbols").join(paths, "path", "left_semi")))
        n_symbols = symbols.count()
        if not n_symbols:
            raise ValueError("no symbols of catalogued files")
        stage(20, f"{n_symbols} symbols")
        references = store.table("symbol_references")
        n_references = within(spark, limits["references"], references.count)
        stage(35, f"{n_references} references")
        nodes, edges, lost = (cut(df) for df in build_graph(files, symbols, references))
        stage(50, "nodes and edges")
        counted = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("below")).first()
        stats = [r.asDict() for r in graph.edge_stats(edges).collect()]
        n_edges, n_lost = edges.count(), lost.count()
        stage(58, f"{counted['n']} nodes, {n_edges} edges, {counted['below']} symbols; {n_lost} relations without a node")
        write_page(spark, out, page(title, graph.drawn(nodes, edges)))
        stage(100, out)
    return GraphRun(n_files, n_symbols, n_references, counted["n"], n_edges, counted["below"], stats[0] if stats else {}, n_lost, time.time() - began)
