"""Merkle manifest of a table of documents, as a log of nodes in postorder.

Every language is a binary tree over its documents' hashes; a tree over the languages' roots joins
them. Leaves are numbered within their tree, and aligned builders of 4096 leaves each write one
segment of the log: a node stands where it is complete, behind its children. The segments' roots
are the leaves of the next group of segments, up to one segment a tree.

Where a node stands follows from its level and number alone. After t leaves a log holds
2t - bits(t) whole nodes, since a whole subtree of level l has 2^(l+1) - 1; the node that leaf t
completes at level l is l places behind that leaf. Nodes over fewer leaves than their level has room
for come last, one a level. So a proof reads its siblings by their places, without a search.

Proofs go from the top down: a segment gets the path from its root to the top, and puts its own
siblings before it. Only one row per segment is joined.

Cases: a null in a column is hashed as "-"; rows without a language are a tree of their own, the
first; rows without an id come first in their tree; rows that share language and id are ordered
by their hash, so repeated rows are interchangeable leaves; an empty table gives an empty result; other
input columns are not looked at. n_chars at its largest number is counted on in decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.session import cut, runs_in_tasks

runs_in_tasks(__name__)

#: Levels of a segment; a segment has at most 2^LEVELS leaves.
LEVELS = 12
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def trailing_zeros(m: int) -> int:
    return (m & -m).bit_length() - 1


def height_of(m: int) -> int:
    """Levels above the leaves of a tree of m leaves."""
    return (m - 1).bit_length() if m else 0


def place(level: int, number: int, m: int) -> int:
    """Where a node stands in the log of a tree of m leaves, from 0."""
    t = (number + 1) << level
    if t <= m:
        return 2 * (t - 1) - (t - 1).bit_count() + level
    return 2 * m - m.bit_count() + level - trailing_zeros(m) - 1


def written(leaves: list[str], height: int) -> list[str]:
    """The log of a tree: nodes in the order in which they are complete, the root last."""
    log, whole = [], []
    for t, node in enumerate(leaves, 1):
        log.append(node)
        for _ in range(trailing_zeros(t)):
            node = digest(whole.pop(), node)
            log.append(node)
        whole.append(node)
    m = len(leaves)
    node = whole.pop()
    for level in range(trailing_zeros(m), height):
        nodes = -(-m >> level)
        node = digest(node) if nodes % 2 else digest(whole.pop(), node)
        log.append(node)
    return log


def siblings(nodes: bytes, leaf: int, m: int, height: int) -> list[str]:
    """A leaf's path to the root of a segment: L or R and the sibling on that side, or "-" where a node stands alone."""
    path = []
    for level in range(height):
        number = leaf >> level
        other = number ^ 1
        if other < -(-m >> level):
            at = place(level, other, m) * 32
            path.append(("L" if other < number else "R") + nodes[at : at + 32].hex())
        else:
            path.append("-")
    return path


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        leaf = digest(step[1:], leaf) if step[0] == "L" else digest(leaf, step[1:])
    return leaf


def leaf_hash(doc: dict[str, Column]) -> Column:
    """sha256 over the fields: "-" for null, else UTF-8 bytes, ":", value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[field(doc[k]) for k in FIELDS]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, forged): the hash of every row, and what it becomes by tampering where that is due."""
    doc = {k: F.col(k) for k in FIELDS}
    forged = leaf_hash(doc | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1})
    due = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("bigint"), F.unhex(leaf_hash(doc)).alias("digest"), F.when(due, F.unhex(forged)).alias("forged"))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Adds ``i``, a leaf's number within its tree by ``order``, and ``n``, the tree's leaves.

    One sort by range over all trees, whose parts know their own rows; what lies before a part comes from
    sums over one row per part and tree. A salt lets equal rows fall into several parts.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_salt")]
    rows = leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_part").alias("_p"), F.col("tree").alias("_t"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    rows = rows.join(parts, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t")))
    return rows.withColumn("i", F.col("_at") + F.col("_shift")).select(*leaves.columns, "i", "n")


SEGMENT = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("n", pa.int64()), ("root", pa.binary()), ("nodes", pa.binary()), ("ids", pa.list_(pa.int64())), ("forged", pa.list_(pa.binary()))])
SEGMENT_SQL = "tree string, segment bigint, n bigint, root binary, nodes binary, ids array<bigint>, forged array<binary>"


def segments(leaves: DataFrame, levels: int) -> DataFrame:
    """One group of the log: a row per aligned run of 2^levels leaves, with its nodes in postorder and what its leaves carry."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        first, n = table["i"][0].as_py(), table["n"][0].as_py()
        # a tree of several segments goes on to the full height in each, the last one too
        height = levels if n > 1 << levels else height_of(n)
        log = written([d.hex() for d in table["digest"].to_pylist()], height)
        row = {"tree": table["tree"][0].as_py(), "segment": first >> levels, "n": n, "root": bytes.fromhex(log[-1]), "nodes": bytes.fromhex("".join(log)), "ids": table["doc_id"].to_pylist(), "forged": table["forged"].to_pylist()}
        return pa.Table.from_pylist([row], SEGMENT)

    rows = leaves.select("tree", "i", "n", "digest", "doc_id", "forged", F.shiftright("i", levels).alias("_segment"))
    return rows.groupBy("tree", "_segment").applyInArrow(build, SEGMENT_SQL)


def log_of(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log's groups, from the leaves up; each is stored before the next one is built on its roots."""
    groups = []
    while True:
        groups.append(cut(segments(leaves, levels)))
        more = groups[-1].where(F.col("n") > 1 << levels)
        if not more.limit(1).count():
            return groups
        none = [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("forged")]
        leaves = more.select("tree", F.col("segment").alias("i"), F.shiftright(F.col("n") + (1 << levels) - 1, levels).alias("n"), F.col("root").alias("digest"), *none)


def roots_of(groups: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, root): every tree's root stands in the one segment of its last group."""
    return reduce(DataFrame.union, [g.where(F.col("n") <= 1 << levels).select("tree", "root") for g in groups])


PATH = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("leaf", pa.binary()), ("path", pa.list_(pa.string())), ("top", pa.binary())])
PATH_SQL = "tree string, i bigint, leaf binary, path array<string>, top binary"

RESULT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("log_position", pa.int64())])
RESULT_SQL = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, log_position bigint"


def below(levels: int, schema: pa.Schema, result: Callable[[dict, int, str, list[str]], dict]) -> Callable:
    """Task function: ``result`` of every leaf of a segment, given its path; the segment's own siblings come first on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                m, nodes, out = len(row["ids"]), row["nodes"], []
                height = levels if row["n"] > 1 << levels else height_of(m)
                for leaf in range(m):
                    at = place(0, leaf, m) * 32
                    out.append(result(row, leaf, nodes[at : at + 32].hex(), siblings(nodes, leaf, m, height) + row["path"]))
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def path_rows(levels: int) -> Callable:
    def result(row: dict, leaf: int, own: str, path: list[str]) -> dict:
        return {"tree": row["tree"], "i": (row["segment"] << levels) + leaf, "leaf": bytes.fromhex(own), "path": path, "top": row["top"]}

    return below(levels, PATH, result)


def checked_rows(levels: int) -> Callable:
    def result(row: dict, leaf: int, own: str, path: list[str]) -> dict:
        forged, top, i = row["forged"][leaf], row["top"].hex(), (row["segment"] << levels) + leaf
        reached = folded(own if forged is None else forged.hex(), path)
        proof = digest(*[step[1:] for step in path])
        return {"doc_id": row["ids"][leaf], "leaf": own, "subroot": row["subroot"].hex(), "root": top, "proof_sha256": proof, "folded_root": reached, "verified": reached == top, "log_position": 2 * i - i.bit_count()}

    return below(levels, RESULT, result)


def segment_paths(groups: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest group's segments with the path from each one's root to the top; ``tops`` has (tree, path, top) of every tree."""
    above = None
    for group in reversed(groups):
        last = group.where(F.col("n") <= 1 << levels).select(F.col("tree").alias("_tree"))
        paths = tops.join(last, F.col("tree").eqNullSafe(F.col("_tree"))).select("_tree", F.lit(0).cast("bigint").alias("_at"), "path", "top")
        if above is not None:
            paths = paths.union(above.mapInArrow(path_rows(levels), PATH_SQL).select("tree", "i", "path", "top"))
        above = group.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("segment") == F.col("_at"))).drop("_tree", "_at")
    return above


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: its leaf, the roots, a hash of its proof, and whether the leaf, tampered with where that is due, leads to the root."""
    groups = log_of(numbered(leaves_of(docs), "doc_id", "digest"), levels)
    # the trees' roots are the leaves of one more tree, in the order of the trees' names
    none = [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("forged")]
    roots = roots_of(groups, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), *none)
    named = cut(numbered(roots, "name"))
    upper = log_of(named, levels)
    whole = roots_of(upper, levels).select("tree", F.array().cast("array<string>").alias("path"), F.col("root").alias("top"))
    paths = segment_paths(upper, whole, levels).mapInArrow(path_rows(levels), PATH_SQL)
    tops = named.join(paths.select(F.col("i").alias("_i"), "path", "top"), F.col("i") == F.col("_i"))
    tops = cut(tops.select(F.col("name").alias("tree"), "path", "top", F.col("digest").alias("subroot")))
    rows = segment_paths(groups, tops.drop("subroot"), levels)
    rows = rows.join(tops.select(F.col("tree").alias("_tree"), "subroot"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    return rows.mapInArrow(checked_rows(levels), RESULT_SQL)


def save_log(groups: list[DataFrame], path: str) -> None:
    """Store the log's segments, one folder a group."""
    for k, group in enumerate(groups):
        group.write.mode("overwrite").parquet(f"{path}/group={k}")
