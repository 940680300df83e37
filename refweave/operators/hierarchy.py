"""Parent-child links to full hierarchies: weighted disjoint-set forests, merged over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import cut, partitions, shared_table

#: A boundary table of at most so many bytes, chains included, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 * 2**20
_ROW_BYTES = 64  # a row's numbers, and what holds its strings
SEP = "/"


class WeightedForest:
    """Nodes 0..n-1 with at most one parent each (-1: none here); every node gets its set's root and its distance.

    Links are compressed by doubling, each round halving all paths: after more rounds than the longest chain needs, a
    node that still isn't at a root is on a cycle or below one.
    """

    def __init__(self, parent: np.ndarray) -> None:
        n = len(parent)
        self.parent = parent
        self.root = np.where(parent < 0, np.arange(n), parent)
        self.offset = (parent >= 0).astype(np.int64)
        is_root = parent < 0
        for _ in range(max(1, int(n).bit_length() + 1)):
            moving = ~is_root[self.root]
            if not moving.any():
                break
            self.offset[moving] += self.offset[self.root[moving]]
            self.root[moving] = self.root[self.root[moving]]
        self.cyclic = ~is_root[self.root]

    def paths(self, names: np.ndarray) -> list[str]:
        """The chain of names from each node's root down to the node, by the index of parents; '' on cycles."""
        out: list[str] = [""] * len(names)
        order = np.argsort(np.where(self.cyclic, -1, self.offset), kind="stable")
        for i in order[int(self.cyclic.sum()):].tolist():
            p = self.parent[i]
            out[i] = names[i] if p < 0 else out[p] + SEP + names[i]
        return out


_LOCAL = "pid int, id string, path string, top string, depth long, outer string, cyclic boolean, chain string, parent string"


def _bytes(df: DataFrame) -> int:
    """The size of a table's rows, by the length of its strings."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    return df.agg(F.sum(sum(strings, F.lit(_ROW_BYTES)))).first()[0] or 0


def _local(with_paths: bool, with_parents: bool) -> object:
    """Over rows sorted by path: local tops and offsets.

    outer is the parent of the top where that parent may lie in another partition: only for the first and last path
    of the partition, as all other paths are whole here.
    """

    def solve(d: pd.DataFrame, pid: int, edge: bool) -> pd.DataFrame:
        ids = d["id"].to_numpy(dtype=object)
        at = pd.Index(ids)
        parents = d["parent_id"].to_numpy(dtype=object)
        paths = d["path"].to_numpy(dtype=object)
        pos = at.get_indexer(parents)
        has = ~pd.isna(parents)
        pos = np.where(has, pos, -1)
        found = pos >= 0
        codes = pd.factorize(paths)[0]  # null paths are -1, and are nobody's
        same = found & (codes[np.maximum(pos, 0)] == codes) & (codes >= 0)
        forest = WeightedForest(np.where(same, pos, -1))
        # a parent found here under another path, or a null path, ends the chain
        outer = np.where(has & ~found & (codes >= 0) & edge, parents, None)
        tops = forest.root
        return pd.DataFrame({
            "pid": pid, "id": ids, "path": paths, "top": np.where(forest.cyclic, None, ids[tops]), "depth": forest.offset,
            "outer": np.where(forest.cyclic, None, outer[tops]), "cyclic": forest.cyclic,
            "chain": forest.paths(ids) if with_paths else None, "parent": np.where(same, parents, None) if with_parents else None,
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        first: object = ()
        for b in batches:
            if not len(b):
                continue
            if first == ():
                first = b["path"].iloc[0]
            held.append(b)
            if sum(map(len, held)) < 50_000:
                continue
            d = pd.concat(held, ignore_index=True)
            keys = d["path"].fillna("")
            last = keys.iloc[-1]
            inner = (keys != last).to_numpy()
            begins = (keys == ("" if pd.isna(first) else first)).to_numpy()
            for part, edge in ((d[inner & begins], True), (d[inner & ~begins], False)):
                if len(part):
                    yield solve(part, pid, edge)
            held = [d[~inner]]
            if inner.any() and begins.any():
                first = None  # done
        if held:
            d = pd.concat(held, ignore_index=True)
            keys = d["path"].fillna("")
            edge = (keys == keys.iloc[-1]) | (keys == ("" if pd.isna(first) else first))
            for part, e in ((d[edge], True), (d[~edge], False)):
                if len(part):
                    yield solve(part, pid, e)

    return run


def _resolve_outer(local: DataFrame) -> DataFrame | None:
    """(path, outer, root, depth, chain, state) for every parent that a partition asks of the others; None if none.

    state: ``root`` (resolved), ``cycle``, or ``none`` (no such node: the asking top is itself a root). Links among
    these boundary nodes only are doubled, so a chain over k partitions takes log2 k rounds.
    """
    asked = cut(local.where(F.col("outer").isNotNull()).select("path", "outer").distinct())
    n = asked.count()
    if not n:
        return None
    near = F.broadcast(asked) if _bytes(asked) <= BROADCAST_BYTES else asked
    nodes = local.select("path", F.col("id").alias("outer"), F.col("top").alias("t"), F.col("depth").alias("d"), F.col("outer").alias("next"), "cyclic", "chain")
    hit = nodes.join(near, ["path", "outer"])
    state = F.when(F.col("t").isNull() & ~F.coalesce("cyclic", F.lit(False)), "none").when(F.col("cyclic"), "cycle").when(F.col("next").isNull(), "root").otherwise("open")
    b = cut(asked.join(hit, ["path", "outer"], "left").select("path", "outer", F.col("t").alias("root"), F.col("d").alias("depth"), "next", "chain", state.alias("state")))
    rounds = 0
    while b.where("state = 'open'").limit(1).count():
        to = b.select("path", F.col("outer").alias("next"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("next").alias("n2"), F.col("chain").alias("c2"), F.col("state").alias("s2"))
        stop = 2**rounds > n  # more links than nodes: it never ends
        j = b.join(to, ["path", "next"], "left")
        is_open = F.col("state") == "open"
        ends = F.col("s2") == "none"  # the node's own top is the root
        b = cut(j.select(
            "path", "outer",
            F.when(is_open & ~ends, F.col("r2")).otherwise(F.col("root")).alias("root"),
            F.when(is_open & ~ends, F.col("depth") + F.col("d2") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(is_open & (F.col("s2") == "open"), F.col("n2")).alias("next"),
            F.when(is_open & ~ends, F.concat_ws(SEP, "c2", "chain")).otherwise(F.col("chain")).alias("chain"),
            F.when(~is_open, F.col("state")).when(F.lit(stop), "cycle").when(ends, "root").otherwise(F.col("s2")).alias("state"),
        ))
        rounds += 1
    return b.drop("next")


def hierarchies(nodes: DataFrame, with_paths: bool = True, with_parents: bool = False) -> DataFrame:
    """(symbol_id, root_id, node_depth, chain): every node's root, depth and chain of ids from the root.

    nodes: (id, parent_id, path, start_line) with distinct ids. The parent is the node with that id and the same path;
    without one the node is a root of depth 0. A node on a cycle or below one has root_id '', node_depth -1 and an
    empty chain. A null path is nobody's, so its nodes are roots. An empty table gives no rows. Without ``with_paths`` the
    chains are null; ``with_parents`` adds parent_id, the parent that there is, or null.

    Nodes are range partitioned by (path, start_line, id), so most links are local and one huge path is cut over many
    partitions. Local forests leave only the parents asked for across partition bounds, which are merged by doubling.
    """
    spark = nodes.sparkSession
    ranged = nodes.select("path", "start_line", "id", "parent_id").repartitionByRange(partitions(spark), "path", "start_line", "id").sortWithinPartitions("path")
    local = shared_table(ranged.mapInPandas(_local(with_paths, with_parents), _LOCAL), "forest")
    outer = _resolve_outer(local)
    if outer is None:
        got = local.select("id", F.col("top").alias("root"), "depth", "cyclic", "chain", "parent")
    else:
        up = outer.select("path", "outer", F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), F.col("chain").alias("u_chain"), "state")
        if _bytes(up) <= BROADCAST_BYTES:
            j = local.join(F.broadcast(up), ["path", "outer"], "left")
        else:  # one row a partition and parent: a parent asked for by all partitions is as often there
            asks = local.where(F.col("outer").isNotNull()).select("pid", "path", "outer").distinct()
            j = local.join(asks.join(up, ["path", "outer"]), ["pid", "path", "outer"], "left")
        over = F.col("state") == "root"
        got = j.select(
            "id", F.when(over, F.col("u_root")).otherwise(F.col("top")).alias("root"),
            F.when(over, F.col("u_depth") + 1 + F.col("depth")).otherwise(F.col("depth")).alias("depth"),
            (F.col("cyclic") | F.coalesce(F.col("state") == "cycle", F.lit(False))).alias("cyclic"),
            F.when(over, F.concat_ws(SEP, "u_chain", "chain")).otherwise(F.col("chain")).alias("chain"),
            F.coalesce("parent", F.when((F.col("id") == F.col("top")) & F.col("state").isin("root", "cycle"), F.col("outer"))).alias("parent"),
        )
    parent = [F.col("parent").alias("parent_id")] if with_parents else []
    return got.select(
        F.col("id").alias("symbol_id"), F.when(F.col("cyclic"), "").otherwise(F.col("root")).alias("root_id"),
        F.when(F.col("cyclic"), -1).otherwise(F.col("depth")).cast("int").alias("node_depth"),
        F.when(F.col("cyclic"), "").otherwise(F.col("chain")).alias("chain"), *parent,
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(symbol_id, descendant_id, distance): every pair of a node and one below it, from the chains."""
    ids = F.split("chain", SEP)
    up = tree.where("node_depth > 0").select(F.col("symbol_id").alias("descendant_id"), "node_depth", F.posexplode(F.slice(ids, 1, F.col("node_depth"))).alias("level", "symbol_id"))
    return up.select("symbol_id", "descendant_id", (F.col("node_depth") - F.col("level")).alias("distance"))


def live_nodes(states: DataFrame) -> DataFrame:
    """(id, parent_id, path, start_line) of the live symbols, from :func:`liveness.symbol_states`."""
    return states.where("live").select("id", "parent_id", "path", "start_line")
