"""The p1, p2, p4 and p5 queries over the domain tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.normalize import EDGE, norm_id, norm_path
from refweave.operators import hierarchy, orphans, skew, snapshots
from refweave.operators.liveness import symbol_states
from refweave.session import own_folder
from refweave.sources.snapshot_index import SnapshotIndex
from refweave.sources.tables import table


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_references(table(spark, sf, "symbol_references"), table(spark, sf, "symbols"), table(spark, sf, "symbol_removals"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_id", "ref_side", "ref_state")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"to_symbol_id": norm_id("to_symbol_id"), "to_path": norm_path("to_path")}
    return skew.key_profile(table(spark, sf, "symbol_references"), keys, norm_path("from_path"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.heavy_keys(_profile(spark, sf), table(spark, sf, "symbol_references").count())


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "code_file_snapshots")
    return snapshots.snapshot_changes(snapshots.latest_per_path(t), snapshots.deliveries(t)).select("snapshot_no", "relative_path", "change_kind")


def p4_last(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of the last snapshot against a kept index of the one before it."""
    t = table(spark, sf, "code_file_snapshots")
    latest, rows = snapshots.latest_per_path(t), snapshots.deliveries(t)
    two = sorted(rows, reverse=True)[:2]
    index = SnapshotIndex(spark, f"{own_folder(spark)}/index-{uuid.uuid4().hex}", max(16, -(-max(rows.values(), default=0) // snapshots.BUCKET_KEYS)))
    if len(two) == 2:
        index.swap(latest.where(F.col("snapshot_no") == two[1]).select("relative_path", "updated_ms"))
    last = latest.where(F.col("snapshot_no") == (two[0] if len(two) == 2 else -1)).select("relative_path", "updated_ms")
    return index.changes(last).select("relative_path", "change_kind")


def _tree(spark: SparkSession, sf: str, with_paths: bool) -> DataFrame:
    states = symbol_states(table(spark, sf, "symbols"), table(spark, sf, "symbol_removals"))
    return hierarchy.hierarchies(hierarchy.live_nodes(states), with_paths)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, False).select("symbol_id", "root_id", "node_depth")


def p5_chains(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, True).select("symbol_id", "root_id", "node_depth", "chain")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, sf, True))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_profile, p4_found, p4_last, p5_found, p5_chains, p5_descendants)}


def id_sql(c: str) -> str:
    edge = "".join(f"||chr({ord(x)})" for x in EDGE)
    return f"nullif(lower(trim({c}, ''{edge})), '')"


def path_sql(c: str) -> str:
    p = f"replace({c}, chr(92), '/')"
    p = f"(CASE WHEN {p} LIKE './%' THEN substr({p}, 3) ELSE {p} END)"
    return f"(CASE WHEN trim({p}) <> '' THEN {p} END)"


_STATES = f"""
sym AS (SELECT {id_sql('id')} AS id, {id_sql('parent_id')} AS parent_id, {path_sql('path')} AS path, indexed_at, start_line FROM symbols),
cur AS (SELECT * FROM (SELECT *, min(indexed_at) OVER (PARTITION BY id) AS first_at,
    row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, parent_id DESC NULLS LAST, path DESC NULLS LAST, start_line DESC NULLS LAST) AS rn FROM sym WHERE id IS NOT NULL) WHERE rn = 1),
rem AS (SELECT {id_sql('symbol_id')} AS id, max(removed_at) AS gone FROM symbol_removals WHERE {id_sql('symbol_id')} IS NOT NULL GROUP BY 1),
live AS (SELECT cur.* FROM cur LEFT JOIN rem USING (id) WHERE gone IS NULL OR gone < indexed_at)
"""
_CASES = f"""
WITH {_STATES},
ref AS (SELECT * FROM (SELECT id AS ref_id, {id_sql('from_symbol_id')} AS f, {id_sql('to_symbol_id')} AS t, indexed_at,
    row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, {id_sql('from_symbol_id')} DESC NULLS LAST, {id_sql('to_symbol_id')} DESC NULLS LAST) AS rn FROM symbol_references WHERE id IS NOT NULL) WHERE rn = 1),
ends AS (SELECT ref_id, 'from' AS ref_side, f AS k, indexed_at FROM ref WHERE f IS NOT NULL UNION ALL SELECT ref_id, 'to', t, indexed_at FROM ref WHERE t IS NOT NULL),
cases AS (SELECT ref_id, ref_side, e.indexed_at, CASE WHEN l.id IS NOT NULL THEN CASE WHEN l.first_at > e.indexed_at THEN 'late' END
    WHEN r.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state FROM ends e LEFT JOIN live l ON l.id = e.k LEFT JOIN rem r ON r.id = e.k)
"""
_TREE = f"""
WITH RECURSIVE {_STATES},
link AS (SELECT c.id, p.id AS parent FROM live c LEFT JOIN live p ON p.id = c.parent_id AND p.path = c.path),
walk AS (SELECT id, id AS root_id, 0 AS node_depth, id AS chain FROM link WHERE parent IS NULL
    UNION ALL SELECT l.id, w.root_id, w.node_depth + 1, w.chain || '/' || l.id FROM walk w JOIN link l ON l.parent = w.id)
"""
_NODES = f"{_TREE} SELECT l.id AS symbol_id, coalesce(w.root_id, '') AS root_id, coalesce(w.node_depth, -1)::INTEGER AS node_depth"
_PROFILE = f"""
WITH v AS (SELECT 'to_symbol_id' AS key_column, {id_sql('to_symbol_id')} AS key_value, {path_sql('from_path')} AS s FROM symbol_references
    UNION ALL SELECT 'to_path', {path_sql('to_path')}, {path_sql('from_path')} FROM symbol_references),
g AS (SELECT key_column, key_value, count(*) AS n_rows, count(DISTINCT s) AS n_distinct FROM v WHERE key_value IS NOT NULL GROUP BY 1, 2)
"""

SQL = {
    "p1_found": f"{_CASES} SELECT ref_id, ref_side, ref_state FROM cases WHERE ref_state IS NOT NULL",
    "p1_counts": f"{_CASES} SELECT ref_side, strftime(indexed_at, '%Y-%m') AS month, ref_state, count(*) AS n FROM cases WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3",
    "p2_found": f"{_PROFILE} SELECT key_column, key_value FROM g WHERE n_rows * 100 >= 4 * (SELECT count(*) FROM symbol_references)",
    "p2_profile": f"{_PROFILE} SELECT * FROM g",
    "p4_found": f"""
WITH l AS (SELECT snapshot_no, {path_sql('relative_path')} AS p, max(date_trunc('millisecond', updated_at)) AS u FROM code_file_snapshots
    WHERE snapshot_no IS NOT NULL AND {path_sql('relative_path')} IS NOT NULL GROUP BY 1, 2),
n AS (SELECT no, lag(no) OVER (ORDER BY no) AS prev FROM (SELECT DISTINCT snapshot_no AS no FROM l)),
b AS (SELECT n.no, l.p, l.u FROM l JOIN n ON l.snapshot_no = n.prev),
a AS (SELECT n.no, l.p, l.u FROM l JOIN n ON l.snapshot_no = n.no AND n.prev IS NOT NULL)
SELECT coalesce(a.no, b.no) AS snapshot_no, coalesce(a.p, b.p) AS relative_path,
    CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.no = b.no AND a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.u IS DISTINCT FROM b.u
""",
    "p4_last": f"""
WITH l AS (SELECT snapshot_no, {path_sql('relative_path')} AS p, max(date_trunc('millisecond', updated_at)) AS u FROM code_file_snapshots
    WHERE snapshot_no IS NOT NULL AND {path_sql('relative_path')} IS NOT NULL GROUP BY 1, 2),
a AS (SELECT p, u FROM l WHERE snapshot_no = (SELECT max(snapshot_no) FROM l)),
b AS (SELECT p, u FROM l WHERE snapshot_no = (SELECT max(snapshot_no) FROM l WHERE snapshot_no < (SELECT max(snapshot_no) FROM l)))
SELECT coalesce(a.p, b.p) AS relative_path, CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.u IS DISTINCT FROM b.u
""",
    "p5_found": f"{_NODES} FROM link l LEFT JOIN walk w ON w.id = l.id",
    "p5_chains": f"{_NODES}, coalesce(w.chain, '') AS chain FROM link l LEFT JOIN walk w ON w.id = l.id",
    "p5_descendants": f"""{_TREE}, d AS (SELECT id AS a, id AS b, 0 AS distance FROM walk UNION ALL SELECT d.a, l.id, d.distance + 1 FROM d JOIN link l ON l.parent = d.b)
SELECT a AS symbol_id, b AS descendant_id, distance::INTEGER AS distance FROM d WHERE distance > 0""",
}
