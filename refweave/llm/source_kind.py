"""Source files that nobody wrote by hand here: generated, minified, vendored, or data in the guise of code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.normalize import norm_path
from refweave.session import cut, shared_table

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4  # at 0.8 a pair misses all bands with a chance under 0.001
FIRST = 2  # bands whose buckets are linked first
#: A family of files is machine-made where it has at most so many distinct masked shingles a token, on average over its
#: files; a file without a family has to show less.
TEMPLATE, TEMPLATE_ALONE = 0.15, 0.06
#: A family, or a file without one, is data where so much of its code is literals.
LITERAL, LITERAL_ALONE = 0.45, 0.7
LONG_LINE, MANGLED = 300, 4.0  # what a machine-made family is called minified by, on average
#: Classes of a bucket that are compared in one task; of more, the bucket is compared in parts.
BLOCK = 4000
STRIP, COLUMNS = 256, 1024  # sets and tokens that are counted at once
PIVOTS = 64

_TOKEN = re.compile(r"[^\W\d]\w*|\n|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|0[xX][0-9a-fA-F]+|\d[\w.]*|[^\w\s]")
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)|^[ \t]*(\"\"\"|''').*?(?:\1|\Z)", re.DOTALL | re.MULTILINE)
_LINE = re.compile(r"^[ \t]*(?:#(?!include|define|if|ifdef|ifndef|endif|pragma|\[|!\[)|--|//)[^\n]*|[ \t]//[ \t][^\n]*", re.MULTILINE)
# Words of notices that other people's code carries, chosen by hand, and what each of them holds.
_NOTICE = re.compile(
    r"copyright\b.*\bauthors\b|all rights reserved|licen[cs]ed under|under the terms of|permission (?:is hereby granted|to use)|redistribution and use|external dependency|do not patch"
    r"|\bvendored\b|\bupstream\b|verbatim copy of|copied from|original project|home of the library|copyright \(c\)|spdx-license-identifier|third[- ]party (?:code|library|source)",
)
_CUES = (
    "copyright", "all rights reserved", "d under", "under the terms of", "permission", "redistribution and use", "external dependency", "do not patch", "vendored", "upstream",
    "verbatim copy of", "copied from", "original project", "home of the library", "spdx-license-identifier", "third",
)
# Folders that usually hold other people's code, chosen by hand; the next folder is the library's.
_FOLDER = r"(?:^|/)(?:vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|external(?:/src)?|extern|deps|Godeps/_workspace(?:/src)?|contrib/upstream|libs/ext)/([^/]+)/"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_ODD), k, 2**64) for k in range(1, 1025)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def mask(token: str) -> str:
    """I for an identifier, N for a number, S for a string; other tokens stay."""
    c = token[0]
    return "S" if c in "\"'`" else "N" if c.isdigit() else "I" if c == "_" or c.isalpha() else token


class Tokens:
    """Hash, masked hash, length and kind of each token met, numbered once and then only looked up."""

    LIMIT = 300_000
    IDENTIFIER, LITERAL, LINE = 1, 2, 3

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.raw, self.masked = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.size, self.kind = np.zeros(1024, np.int32), np.zeros(1024, np.int8)

    def number(self, token: str) -> int:
        k = self.known[token] = len(self.known)
        if k == len(self.raw):
            self.raw, self.masked, self.size, self.kind = (np.concatenate((x, np.zeros_like(x))) for x in (self.raw, self.masked, self.size, self.kind))
        m = mask(token)
        self.raw[k], self.masked[k] = xxhash.xxh64_intdigest(token), xxhash.xxh64_intdigest(m)
        self.size[k] = len(token)
        self.kind[k] = self.LINE if token == "\n" else self.IDENTIFIER if m == "I" else self.LITERAL if m in ("N", "S") else 0
        return k

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > self.LIMIT:
            self.clear()
        get, number = self.known.get, self.number
        return np.array([x if (x := get(t)) is not None else number(t) for t in _TOKEN.findall(text)], np.int64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of the runs of five tokens, given the tokens' hashes; of the whole where there are fewer."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int32)
    width = min(SHINGLE, n)
    runs = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        runs += hashes[k : n - width + 1 + k] * _POWERS[k]
    found = np.sort((_mix(runs) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return found[np.append(True, found[1:] != found[:-1])]


def bands(hashes: np.ndarray, view: int = 0) -> list[int]:
    """The bucket of each band of a MinHash signature, a number that no other band or view has; none for an empty set.

    One permutation: each hash falls into a slot by its mixed value, and a slot keeps its least. An empty slot takes
    over the next full one's, with the distance mixed in. The buckets of the FIRST bands are odd, those of others even.
    """
    if not len(hashes):
        return []
    slots = BANDS * ROWS
    x = _mix(hashes.view(np.uint32).astype(np.uint64) * _ODD + np.uint64(12345))
    slot = (x % np.uint64(slots)).astype(np.int64)
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, slot, x)
    full = np.zeros(slots, bool)
    full[slot] = True
    at = np.flatnonzero(full)
    next_ = at[np.searchsorted(at, np.arange(slots)) % len(at)]
    low = low[next_] + ((next_ - np.arange(slots)) % slots).astype(np.uint64) * _ODD
    band = np.arange(BANDS, dtype=np.uint64)
    rows = _mix((low.reshape(BANDS, ROWS) * _POWERS[:ROWS]).sum(axis=1, dtype=np.uint64) + band + np.uint64(BANDS * view))
    return (rows & ~np.uint64(1) | (band < FIRST).astype(np.uint64)).view(np.int64).tolist()


def measure(text: str, repository: str, tokens: Tokens) -> dict:
    """What the text alone says: its shingles, distinct masked ones a token, share of literals, lengths, notice."""
    t = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    comments: list[str] = []

    def take(m: re.Match) -> str:
        comments.append(m.group().lower())
        return " "

    body = _LINE.sub(take, _BLOCK.sub(take, t))
    notice = False
    if any(c in (said := "\n".join(comments)) for c in _CUES):
        noted = [c for c in comments if _NOTICE.search(c)]
        notice = bool(noted) and not (repository and any(repository.lower() in c for c in noted)) and bool(said)
    ids = tokens.of(body)
    kind = tokens.kind[ids]
    code = kind != Tokens.LINE
    n = int(code.sum())
    size = np.where(code, tokens.size[ids], 0)
    given = kind == Tokens.LITERAL
    # one long literal in a program makes no blob: literals must be many of the tokens too
    literal = float(size[given].sum() / size.sum()) if n and given.sum() >= 0.25 * n else 0.0
    named = size[kind == Tokens.IDENTIFIER]
    masked = shingles(tokens.masked[ids][code])
    return {
        "density": len(masked) / max(1, n - SHINGLE + 1), "literal": literal, "name_length": float(named.mean()) if len(named) else 0.0,
        "line_length": max(map(len, body.split("\n"))), "notice": notice, "masked": masked, "raw": shingles(tokens.raw[ids][code]),
    }


VIEWS = ("masked", "raw")
_MEASURES = ["density", "literal", "name_length", "line_length", "notice"]
_FIELDS = ["path", "repo", *_MEASURES, "masked_key", "masked_set", "masked_bands", "raw_key", "raw_set", "raw_bands"]
_MEASURED = "path string, repo string, density double, literal double, name_length double, line_length int, notice boolean, masked_key long, masked_set array<int>, masked_bands array<long>, raw_key long, raw_set array<int>, raw_bands array<long>"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for b in batches:
        for s in range(0, len(b), 500):
            part = b.iloc[s : s + 500]
            out = []
            for path, text in zip(part["path"], part["file_text"]):
                repo = path.split("/", 1)[0] if "/" in path else ""
                m = measure(text, repo, tokens)
                row = [path, repo, *(m[k] for k in _MEASURES)]
                for k, h in enumerate((m["masked"], m["raw"])):  # a key is of one view
                    row += [xxhash.xxh64_intdigest(h.tobytes(), k) - 2**63 if len(h) else None, h, bands(h, k)]
                out.append(row)
            yield pd.DataFrame(out, columns=_FIELDS).astype({"masked_key": "Int64", "raw_key": "Int64"})


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels, each that of its set's least member, after the sets of i and j are joined pair by pair."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each set the least number of a set that links of SIMILAR or more, each between a left and a right set, join it to.

    No link is lost: pairs are counted exactly, but for those whose sizes alone rule it out and those that links found
    before have joined already. Where left and right are the same, single sets are compared with all others first, each
    taken from outside the largest class so far; then only the sets outside of that class are compared with all. Tokens
    are counted in chunks of columns, as a product of matrices, over strips of sets sorted by size.
    """
    labels = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    if np.array_equal(left, right) and len(left) > PIVOTS:
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        outside = left
        for k in range(PIVOTS):
            pivot = outside[(k * 7919) % len(outside)]
            held = np.zeros(len(vocabulary), np.int64)
            held[column[begin[pivot] : begin[pivot] + size[pivot]]] = 1
            found = np.add.reduceat(held[column], begin)
            near = left[found[left] >= SIMILAR * (size[left] + size[pivot] - found[left]) - 1e-6]
            labels = _join(labels, np.full(len(near), pivot), near)
            names, times = np.unique(labels[left], return_counts=True)
            outside = left[labels[left] != names[times.argmax()]]
            if len(outside) <= len(left) // 50:
                break
        left = outside
    left, right = (x[np.argsort(size[x], kind="stable")] for x in (left, right))
    if not len(left):
        return labels
    # a token of one set alone is in no pair
    many = np.bincount(column) > 1
    row = np.repeat(np.arange(len(sets)), size)[many[column]]
    column = (np.cumsum(many) - 1)[column[many[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strips = []
    for s in range(0, len(left), STRIP):
        part = size[left[s : s + STRIP]]
        strips.append((slice(s, s + STRIP), slice(*np.searchsorted(size[right], (SIMILAR * part[0] - 1e-9, part[-1] / SIMILAR + 1e-9)))))
    common = [np.zeros((len(left[a]), len(right[b])), np.float32) for a, b in strips]
    for c in range(0, int(many.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (c, c + COLUMNS)))
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[at], column[at] - c] = 1
        x, y = dense[left], dense[right]
        for (a, b), found in zip(strips, common):
            found += x[a] @ y[b].T
    for (a, b), found in zip(strips, common):
        either = size[left[a], None] + size[None, right[b]] - found
        i, j = np.nonzero(found >= SIMILAR * either - 1e-6)
        labels = _join(labels, left[a][i], right[b][j])
    return labels


def _links(d: pd.DataFrame) -> pd.DataFrame:
    """Links of the buckets, or parts of buckets, that a group holds: all pairs of a rest and another member."""
    out = [pd.DataFrame({"u": [], "v": []}, dtype="int64")]
    for _, g in d.groupby(["bucket", "p", "q"], sort=False):
        g = g.groupby("set_key", sort=True).agg({"shingles": "first", "rest": "max", "other": "max"})
        keys = g.index.to_numpy()
        left, right = np.flatnonzero(g["rest"]), np.flatnonzero(g["other"])
        if len(left) and len(right):
            labels = linked(g["shingles"].to_list(), left, right)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            out.append(pd.DataFrame({"u": keys[moved], "v": keys[labels[moved]]}))
    return pd.concat(out)


def _compared(tasks: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """(u, v) of tasks: (set_key, bucket, p, q, hot, rest, other). Parts of hot buckets are groups of their own, the other
    buckets share groups."""
    task = F.when(F.col("hot"), F.xxhash64("bucket", "p", "q")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    return tasks.withColumn("task", task).drop("hot").join(sets, "set_key").groupBy("task").applyInPandas(_links, "u long, v long")


def clusters(sets: DataFrame) -> DataFrame:
    """(u, v): each set of a cluster with the least set of it, which has no row; a set without links has none either.

    sets: (set_key, shingles, bands); equal sets are one, whatever their number. Clusters are the connected components of
    the links between sets that share a bucket and are similar by the exact share of common shingles. They are found in two
    rounds. First, in the buckets of the FIRST bands, parts of at most about BLOCK sets are compared whole, each with the
    bucket's least and greatest set in it. What these links join needs no further comparison: then, in each bucket of all
    bands whose sets aren't all joined yet, the sets outside the bucket's largest joined group are compared with all that
    their sizes allow. So no link that joins two groups is lost, and a bucket of texts that are all near each other costs
    time in proportion to its sets, not to their pairs.
    """
    banded = sets.select("set_key", F.size("shingles").cast("int").alias("size"), "bands").dropDuplicates(["set_key"]).select("set_key", "size", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    members = cut(banded.join(sizes, "bucket"))
    # what stands alone in all its buckets isn't fetched
    known = cut(sets.select("set_key", "shingles").join(members.select("set_key").distinct(), "set_key", "left_semi").dropDuplicates(["set_key"]))
    groups = members.count() // BLOCK + 1
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("set_key"), parts(n)).cast("int")
    every, hot, is_first = F.lit(True), F.col("n") > BLOCK, F.col("bucket").bitwiseAND(F.lit(1)) == 1
    cols = ["set_key", "bucket", "p", F.lit(0).alias("q"), hot.alias("hot"), every.alias("rest"), every.alias("other")]
    ends = members.where(is_first & hot).groupBy("bucket", "n").agg(F.min("set_key").alias("least"), F.max("set_key").alias("greatest"))
    ends = ends.withColumn("set_key", F.explode(F.array("least", "greatest"))).withColumn("p", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    tasks = members.where(is_first).withColumn("p", part("n")).select(*cols).unionByName(ends.select(*cols))
    joined = components(_compared(tasks, known, groups))

    placed = cut(members.join(joined.withColumnRenamed("u", "set_key"), "set_key", "left").withColumn("joined", F.coalesce("v", "set_key")).drop("v"))
    held = placed.where(~is_first | hot).groupBy("bucket", "joined").agg(F.count(F.lit(1)).cast("int").alias("m"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    largest = held.groupBy("bucket").agg(F.max(F.struct("m", "joined")).alias("top"), F.sum("m").alias("all")).where("top.m < all")
    rest = held.join(largest, "bucket").where(F.col("joined") != F.col("top.joined")).groupBy("bucket").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("top.joined").alias("largest"), F.sum("m").alias("n_rest")
    )
    fits = (F.col("size") >= SIMILAR * F.col("lo") - 1e-9) & (F.col("size") <= F.col("hi") / SIMILAR + 1e-9)
    open_ = placed.where(~is_first | hot).join(rest, "bucket").where(fits).withColumn("is_rest", F.col("joined") != F.col("largest"))
    cols = ["set_key", "bucket", "p", "q", hot.alias("hot"), "rest", "other"]
    whole = open_.where(~hot).withColumns({"p": F.lit(0), "q": F.lit(0), "rest": F.col("is_rest"), "other": every})
    left = open_.where(hot & F.col("is_rest")).withColumns({"p": part("n_rest"), "q": F.explode(F.sequence(F.lit(0), parts("n") - 1)), "rest": every, "other": ~every})
    right = open_.where(hot).withColumns({"q": part("n"), "p": F.explode(F.sequence(F.lit(0), parts("n_rest") - 1)), "rest": ~every, "other": every})
    tasks = whole.select(*cols).unionByName(left.select(*cols)).unionByName(right.select(*cols))
    return components(joined.unionByName(_compared(tasks, known, groups)))


def components(pairs: DataFrame) -> DataFrame:
    """(u, v): each member of a connected component of the links (u > v) with its least member, which has no row.

    Large and small stars in turn: every node's greater neighbours, then its lesser ones, are linked to the least of
    them. Each round is a written table; it ends when all links are stars, after about the logarithm of the nodes.
    """
    edges = cut(pairs.distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return edges


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("above")))
    odd = ends.groupBy("x").agg(F.sum("above").alias("n"), F.min("above").alias("low")).where("n > 1 or n = 1 and low = 0")
    return not odd.limit(1).count()


def families(measured: DataFrame) -> DataFrame:
    """(view, set_key, n_files, n_repos, in_repo, density, literal, name_length, line_length): one row a distinct set, with
    what its cluster has in all its files: their number, that of repositories, the most of one repository, and averages.

    Files are added up by class and repository before they meet, so hot classes are small.
    """
    averages = ("density", "literal", "name_length", "line_length")
    views = [measured.where(F.col(f"{v}_key").isNotNull()).select(F.lit(k).alias("view"), "repo", *averages, *[F.col(f"{v}_{x}").alias(y) for x, y in (("key", "set_key"), ("set", "shingles"), ("bands", "bands"))]) for k, v in enumerate(VIEWS)]
    sets = views[0].unionByName(views[1])
    found = clusters(sets.select("set_key", "shingles", "bands"))
    classes = sets.groupBy("view", "set_key", "repo").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in averages])
    placed = cut(classes.join(found.select(F.col("u").alias("set_key"), F.col("v").alias("cluster")), "set_key", "left").withColumn("cluster", F.coalesce("cluster", "set_key")))
    by_repo = placed.groupBy("cluster", "repo").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in averages])
    whole = by_repo.groupBy("cluster").agg(
        F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_repos"), F.max("n").alias("in_repo"), *[(F.sum(c) / F.sum("n")).alias(c) for c in averages]
    )
    return placed.select("view", "set_key", "cluster").distinct().join(whole, "cluster").drop("cluster")


def libraries(paths: DataFrame) -> DataFrame:
    """(path): the paths below a library folder: one that follows a folder for other people's code, and that the
    collection has almost nowhere else. A project's own module of such a name holds folders that are common elsewhere."""
    after = F.regexp_extract("path", _FOLDER, 1)
    dirs = paths.select("path", after.alias("library"), F.explode(F.array_distinct(F.split("path", "/"))).alias("name"))
    use = dirs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("name") == F.col("library"), 1).otherwise(0)).alias("inside"))
    known = use.where("inside >= 0.9 * n").select(F.col("name").alias("library"))
    return paths.select("path", after.alias("library")).where("library <> ''").join(known, "library", "left_semi").select("path")


def not_hand_written(code_files: DataFrame, file_texts: DataFrame) -> DataFrame:
    """(relative_path, kind, evidence): catalogued paths whose file is generated, minified, vendored or a blob.

    Files are clustered by their masked shingles, and by their raw ones. Of a cluster of masked shingles with several files
    in one repository, the averages over all its files decide for each of them (evidence ``family``): ``blob`` where
    literals make up most of the code; otherwise it is machine-made where it has few distinct shingles for its tokens,
    ``minified`` with long lines of short names, else ``generated``. A file whose cluster has no two files in any
    repository must show more by itself (``alone``). ``vendored`` is a file that is no such data and that has a near twin
    by raw shingles in another repository (``copy``).

    Beside the clusters two kinds of evidence make a file ``vendored``: a ``notice`` in its comments that doesn't name its
    own project, and the ``folder`` of a library. A path with several texts is taken if one of them is; one without a text
    or with an empty one only by its folder. Null and blank paths are none. Extra columns don't matter.
    """
    catalogued = code_files.select(norm_path("relative_path").alias("path")).where("path is not null").distinct()
    texts = file_texts.select(norm_path("relative_path").alias("path"), "file_text").where("path is not null and trim(file_text) <> ''")
    measured = shared_table(texts.mapInPandas(_measure, _MEASURED), "measured")
    family = F.col("in_repo") >= 2
    limit = lambda a, b: F.when(family, a).otherwise(b)
    made = F.when(F.col("literal") >= limit(LITERAL, LITERAL_ALONE), "blob").when(
        F.col("density") <= limit(TEMPLATE, TEMPLATE_ALONE), F.when((F.col("line_length") >= LONG_LINE) & (F.col("name_length") < MANGLED), "minified").otherwise("generated")
    )
    of = cut(families(measured))
    machine = of.where(F.col("view") == VIEWS.index("masked")).select(F.col("set_key").alias("masked_key"), made.alias("kind"), limit(F.lit("family"), F.lit("alone")).alias("evidence")).where("kind is not null")
    copies = of.where((F.col("view") == VIEWS.index("raw")) & (F.col("n_repos") > 1)).select(F.col("set_key").alias("raw_key"), F.lit(True).alias("copied"))
    files = measured.select("path", "notice", "masked_key", "raw_key").join(machine, "masked_key", "left").join(copies, "raw_key", "left")
    vendored = F.lit("vendored")
    pick = lambda when, kind, evidence: F.when(when, F.struct(kind.alias("kind"), evidence.alias("evidence")))
    by_text = files.select("path", F.explode(F.array_compact(F.array(
        pick(F.col("kind").isNotNull(), F.col("kind"), F.col("evidence")), pick(F.col("kind").isNull() & F.col("copied"), vendored, F.lit("copy")), pick(F.col("notice"), vendored, F.lit("notice"))
    ))).alias("f")).select("path", "f.*")
    all_paths = catalogued.union(measured.select("path")).distinct()
    by_path = libraries(all_paths).select("path", vendored.alias("kind"), F.lit("folder").alias("evidence"))
    order = F.array(*map(F.lit, ("vendored", "blob", "minified", "generated")))
    sure = F.array(*map(F.lit, ("family", "copy", "alone", "notice", "folder")))
    best = F.min(F.struct(F.array_position(order, F.col("kind")).alias("k"), F.array_position(sure, F.col("evidence")).alias("s"), "kind", "evidence"))
    found = by_text.unionByName(by_path).groupBy("path").agg(best.alias("b"))
    return catalogued.join(found, "path").select(F.col("path").alias("relative_path"), "b.kind", "b.evidence")
