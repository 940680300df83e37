"""The weighted graph of files: nodes, undirected relations, edges, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions import encodings as enc
from refweave.functions.scalars import label
from refweave.operators.ranking import numbered
from refweave.schema import FILE


def pair_relations(refs: DataFrame, seq: Column) -> DataFrame:
    """(from_path, to_path, relation_count, first_seq): references by unordered pair of files.

    The direction that comes first by ``seq`` is kept. References with a null path are left out; a pair of one file
    counts once a row. Counts are combined map-side, so a hot pair is no burden.
    """
    f, t = F.col("from_path"), F.col("to_path")
    first = F.min(F.struct(seq.alias("seq"), f.alias("f"), t.alias("t")))
    got = refs.where(f.isNotNull() & t.isNotNull()).groupBy(F.least(f, t).alias("a"), F.greatest(f, t).alias("b")).agg(F.count(F.lit(1)).alias("relation_count"), first.alias("first"))
    return got.select(F.col("first.f").alias("from_path"), F.col("first.t").alias("to_path"), "relation_count", F.col("first.seq").alias("first_seq"))


def file_nodes(symbols: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, label, path, symbol_count, kind): one node a path, from its root symbols of kind File.

    symbol_count is the number of symbols below the root. Of several File roots of a path the last by start_line (then
    id) is taken. tree: (symbol_id, root_id, node_depth) of the same symbols.
    """
    below = tree.where("node_depth > 0").groupBy(F.col("root_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    roots = symbols.where((F.col("kind") == FILE) & F.col("path").isNotNull()).join(tree.where("node_depth = 0").select(F.col("symbol_id").alias("id")), "id", "left_semi")
    counted = roots.join(below, "id", "left")
    last = F.max(F.struct("start_line", "id", F.col("name").alias("name"), F.coalesce("n", F.lit(0)).alias("n")))
    one = counted.groupBy("path").agg(last.alias("v"))
    return one.select("v.id", label(F.lit(FILE), F.col("v.name"), F.col("path")).alias("label"), "path", F.col("v.n").cast("bigint").alias("symbol_count"), F.lit(FILE).alias("kind"))


def edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source, target, reference_type, relation_count, from_label, to_label, first_seq) where both ends have a node."""
    n = nodes.select("path", "id", "label")
    a = n.select(F.col("path").alias("from_path"), F.col("id").alias("source"), F.col("label").alias("from_label"))
    b = n.select(F.col("path").alias("to_path"), F.col("id").alias("target"), F.col("label").alias("to_label"))
    j = relations.join(a, "from_path").join(b, "to_path")
    return j.select(
        F.concat(F.lit("file-relation-"), "source", F.lit("-"), "target").alias("id"), "source", "target", F.lit("file-reference").alias("reference_type"),
        "relation_count", "from_label", "to_label", "first_seq",
    )


def unresolved(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_path, to_path, relation_count) of relations of which an end has no node."""
    a = nodes.select(F.col("path").alias("from_path"), F.lit(True).alias("has_from"))
    b = nodes.select(F.col("path").alias("to_path"), F.lit(True).alias("has_to"))
    j = relations.join(a, "from_path", "left").join(b, "to_path", "left")
    return j.where(F.col("has_from").isNull() | F.col("has_to").isNull()).select("from_path", "to_path", "relation_count")


def edge_stats(e: DataFrame) -> DataFrame:
    """(total, average, largest, smallest) of the edges' counts; no row without edges. average is rounded to 2 places."""
    c = F.col("relation_count")
    got = e.agg(F.sum(c).alias("total"), F.round(F.avg(c), 2).alias("average"), F.max(c).alias("largest"), F.min(c).alias("smallest"))
    return got.where(F.col("total").isNotNull())


def edge_ranks(e: DataFrame) -> DataFrame:
    """(id, from_label, to_label, relation_count, edge_rank, percent): by count, then first use; percent of the order, two digits at least."""
    r = numbered(e, F.col("relation_count").desc(), F.col("first_seq").asc(), F.col("id").asc())
    share = F.round(F.col("row_no") / F.col("row_count") * 100, 0).cast("int").cast("string")
    percent = F.when(F.length(share) >= 2, share).otherwise(F.lpad(share, 2, "0"))
    return r.select("id", "from_label", "to_label", "relation_count", F.col("row_no").alias("edge_rank"), percent.alias("percent"))


def encode_nodes(nodes: DataFrame, n: Column | None = None) -> DataFrame:
    """The nodes' id with width, height, text_width and repulsion, by ``n`` (the symbol count)."""
    n = F.col("symbol_count") if n is None else n
    return nodes.select("id", enc.node_width(F.col("label"), n).alias("width"), enc.node_height(n).alias("height"), enc.text_width(F.col("label")).alias("text_width"), enc.node_repulsion(n).alias("repulsion"))


def encode_edges(e: DataFrame, r: Column | None = None) -> DataFrame:
    """The edges' id with width, colour, opacity, ideal_length and elasticity, by ``r`` (the relation count)."""
    r = F.col("relation_count") if r is None else r
    return e.select("id", enc.edge_width(r).alias("width"), enc.edge_colour(r).alias("colour"), enc.edge_opacity(r).alias("opacity"), enc.edge_length(r).alias("ideal_length"), enc.edge_elasticity(r).alias("elasticity"))


def elements(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes, then edges, in one table: (element, id, label, path, symbol_count, source, target, relation_count)."""
    a = nodes.select(F.lit("node").alias("element"), "id", "label", "path", "symbol_count")
    b = e.select(F.lit("edge").alias("element"), "id", "source", "target", "relation_count")
    return a.unionByName(b, allowMissingColumns=True)


def drawn(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """:func:`elements` with what a drawing needs of the encodings: (..., width, height, colour, opacity)."""
    a = nodes.select(F.lit("node").alias("element"), "id", "label", "path", "symbol_count", enc.node_width(F.col("label"), F.col("symbol_count")).cast("double").alias("width"), enc.node_height(F.col("symbol_count")).alias("height"))
    r = F.col("relation_count")
    b = e.select(F.lit("edge").alias("element"), "id", "source", "target", r, enc.edge_width(r).alias("width"), enc.edge_colour(r).alias("colour"), enc.edge_opacity(r).alias("opacity"))
    return a.unionByName(b, allowMissingColumns=True)
