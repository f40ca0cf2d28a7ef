"""Repeated lines by sharded cuckoo filters over exact reference counts.

The exact table holds one row per line key and document. Keys found in enough documents are blocked:
their lines go from every document but the largest id that holds them. Each shard of blocked keys
has a cuckoo filter, from which keys can also be taken out. Documents meet the filters first: one
without a hit is finished in place, and only the hits of the others are joined with the exact table,
so a false hit costs time and never a line. Adding documents or taking some away changes
reference counts, and with them the blocked keys and filters; nothing that was counted is lost.

Cases: a null or empty text is one empty line; a short line has no key and always stays; rows
without an id count as one document, the smallest; rows that share an id are one document for the
counts, each with its own lines; an empty table gives an empty result; other input columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.session import cut, runs_in_tasks

runs_in_tasks(__name__)

BLANKS = " \t\n\x0b\x0c\r"
SHORTEST = 40
DOCUMENTS = 5
SHARDS = 256
#: Bytes of all filters up to which they are sent to the executors; beyond it every long line goes to the exact join.
MOST_FILTER_BYTES = 64 << 20

SLOTS = 4
KICKS = 500


class Cuckoo:
    """Cuckoo filter of 16-bit marks in buckets of four, for keys of two 64-bit halves."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def for_keys(n: int) -> Cuckoo:
        return Cuckoo(1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))

    @staticmethod
    def marks(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, first bucket, what leads to the second), before they are cut to the number of buckets."""
        lo = lo.astype(np.int64).view(np.uint64)
        mark = (lo & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (lo >> np.uint64(16)).astype(np.int64), Cuckoo.turn(mark)

    @staticmethod
    def turn(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.int64) * 0x5BD1E995) >> 7

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False when a mark finds no place; the filter is then to be built anew, larger."""
        last = self.buckets - 1
        for mark, first, turn in zip(*(x.tolist() for x in self.marks(hi, lo))):
            bucket = first & last
            if self._put(bucket, mark) or self._put((bucket ^ turn) & last, mark):
                continue
            for kick in range(KICKS):
                slot = (kick * 7 + mark) % SLOTS
                mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                bucket = (bucket ^ int(self.turn(np.uint16([mark]))[0])) & last
                if self._put(bucket, mark):
                    break
            else:
                return False
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that are in the filter, one mark each."""
        last = self.buckets - 1
        for mark, first, turn in zip(*(x.tolist() for x in self.marks(hi, lo))):
            for bucket in (first & last, ((first & last) ^ turn) & last):
                there = np.flatnonzero(self.table[bucket] == mark)
                if len(there):
                    self.table[bucket, there[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, first, turn = self.marks(hi, lo)
        first = first & (self.buckets - 1)
        other = (first ^ turn) & (self.buckets - 1)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[other] == mark[:, None]).any(1)


FILTER = "shard int, buckets int, keys bigint, cells binary"


def filled(hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
    made = Cuckoo.for_keys(len(hi))
    while not made.insert(hi, lo):
        made = Cuckoo(made.buckets * 2)
    return made


def filter_row(shard: int, keys: int, made: Cuckoo) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "keys": [keys], "cells": [made.table.tobytes()]})


def build_filter(key: tuple, blocked: pd.DataFrame) -> pd.DataFrame:
    return filter_row(key[0], len(blocked), filled(blocked["hi"].to_numpy(), blocked["lo"].to_numpy()))


def change_filter(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after keys were added and taken out. One that is too small is refused, and built from the exact table."""
    made = Cuckoo(int(old["buckets"][0]), np.frombuffer(old["cells"][0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else Cuckoo.for_keys(len(changes))
    gone, new = changes[~changes["added"]], changes[changes["added"]]
    made.remove(gone["hi"].to_numpy(), gone["lo"].to_numpy())
    count = (int(old["keys"][0]) if len(old) else 0) - len(gone) + len(new)
    fits = made.insert(new["hi"].to_numpy(), new["lo"].to_numpy())
    return filter_row(key[0], count if fits else -1, made)


def keys_of(text: str | None, shortest: int) -> list[tuple[int, int]]:
    """128 bits of the key of every long line of a text, as two signed numbers.

    The key is the line without blanks at its ends, A-Z in lower case; bytes.strip() and
    bytes.lower() do exactly that.
    """
    found = []
    for line in (text or "").split("\n"):
        if len(line) >= shortest and len(line := line.strip(BLANKS)) >= shortest:
            found.append(key_hash(line))
    return found


def key_hash(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def pairs(flat: Column) -> Column:
    """Numbers that alternate between upper and lower halves, as pairs."""
    return F.transform(F.sequence(F.lit(1), (F.size(flat) / 2).cast("int")), lambda i: F.struct(F.get(flat, (2 * i - 2).cast("int")).alias("hi"), F.get(flat, (2 * i - 1).cast("int")).alias("lo")))


def long_lines(text: Column, shortest: int) -> Column:
    """The keys of a text's long lines, halves alternating."""

    @F.pandas_udf("array<bigint>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(keys_of(t, shortest), np.int64).ravel() for t in texts])

    return made(text)


@dataclass
class LineIndex:
    """Exact references (hi, lo, doc_id, lines) of line keys, with the limits they were made for."""

    refs: DataFrame
    shortest: int = SHORTEST
    documents: int = DOCUMENTS
    shards: int = SHARDS

    @classmethod
    def of(cls, docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, shards: int = SHARDS) -> LineIndex:
        return cls(cls.references(docs, shortest), shortest, documents, shards)

    @staticmethod
    def references(docs: DataFrame, shortest: int) -> DataFrame:
        keys = docs.select("doc_id", long_lines(F.col("text"), shortest).alias("_flat")).where(F.size("_flat") > 0)
        return keys.select("doc_id", F.explode(pairs(F.col("_flat"))).alias("k")).groupBy("k.hi", "k.lo", "doc_id").agg(F.count(F.lit(1)).alias("lines"))

    def insert(self, docs: DataFrame) -> LineIndex:
        both = self.refs.unionByName(self.references(docs, self.shortest)).groupBy("hi", "lo", "doc_id").agg(F.sum("lines").alias("lines"))
        return LineIndex(cut(both), self.shortest, self.documents, self.shards)

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of a table of ids."""
        gone = doc_ids.select(F.col("doc_id").alias("_gone")).distinct()
        return LineIndex(cut(self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")), self.shortest, self.documents, self.shards)

    def blocked(self) -> DataFrame:
        """(shard, hi, lo, n_docs, keeper) of keys found in enough documents."""
        counts = self.refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        return counts.where(F.col("n_docs") >= self.documents).withColumn("shard", F.pmod("hi", F.lit(self.shards)).cast("int"))

    def save(self, path: str) -> None:
        self.refs.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **limits: int) -> LineIndex:
        return cls(spark.read.parquet(path), **limits)


def filters(blocked: DataFrame) -> DataFrame:
    """A filter per shard. Keys are spread evenly, so a shard's part is 1/shards of the blocked keys."""
    return blocked.select("shard", "hi", "lo").groupBy("shard").applyInPandas(build_filter, FILTER)


def changed_filters(old: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters for the blocked keys ``after``, made from those for ``before``; shards without change keep theirs."""
    names = ["shard", "hi", "lo"]
    changes = after.select(*names).exceptAll(before.select(*names)).withColumn("added", F.lit(True))
    changes = cut(changes.union(before.select(*names).exceptAll(after.select(*names)).withColumn("added", F.lit(False))))
    touched = changes.select("shard").distinct()
    new = cut(old.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change_filter, FILTER))
    full = new.where("keys < 0").select("shard")
    return old.join(touched, "shard", "left_anti").unionByName(new.where("keys >= 0")).unionByName(filters(after.join(full, "shard", "left_semi")))


def probe(text: Column, filter_rows: list | None, shortest: int, shards: int) -> Column:
    """A text's distinct keys that the filters know, halves alternating; without filters all of them."""

    @F.pandas_udf("array<bigint>")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sent = {r["shard"]: Cuckoo(r["buckets"], np.frombuffer(r["cells"], np.uint16).reshape(-1, SLOTS)) for r in filter_rows or []}
        for texts in batches:
            each = [list(dict.fromkeys(keys_of(t, shortest))) for t in texts]
            flat = np.array([k for keys in each for k in keys], np.int64).reshape(-1, 2)
            found = np.full(len(flat), filter_rows is None)
            shard = flat[:, 0] % shards
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                if s in sent:
                    at = order[edges[s] : edges[s + 1]]
                    found[at] = sent[s].contains(flat[at, 0], flat[at, 1])
            ends = np.cumsum([len(keys) for keys in each]).astype(int)
            yield pd.Series([flat[e - len(keys) : e][found[e - len(keys) : e]].ravel() for e, keys in zip(ends, each)])

    return known(text)


def shortened(text: Column, drops: Column, shortest: int) -> Column:
    """(n, kept): a text's number of lines, and the text without the lines whose keys are given."""

    @F.pandas_udf("n bigint, dropped bigint, kept string")
    def made(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, flat in zip(texts, gone):
            held = (text or "").split("\n")
            kept = held
            if flat is not None and len(flat):
                keys = set(zip(flat[::2].tolist(), flat[1::2].tolist()))
                kept = [x for x in held if len(x) < shortest or len(k := x.strip(BLANKS)) < shortest or key_hash(k) not in keys]
            rows.append((len(held), len(held) - len(kept), "\n".join(kept)))
        return pd.DataFrame(rows, columns=["n", "dropped", "kept"])

    return made(text, drops)


def without_repeats(docs: DataFrame, index: LineIndex, most_filter_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without its blocked lines, one row per row of ``docs``."""
    blocked = cut(index.blocked())
    made = cut(filters(blocked))
    small = (made.agg(F.sum(F.length("cells"))).first()[0] or 0) <= most_filter_bytes
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    rows = rows.withColumn("_hits", probe(F.col("text"), made.collect() if small else None, index.shortest, index.shards))
    some = F.size("_hits") > 0
    nothing = F.array().cast("array<bigint>")
    clean = rows.where(~some).select("doc_id", "text", nothing.alias("_drops"))
    dirty = rows.where(some)
    asked = dirty.select("doc_id", "_row", F.explode(pairs(F.col("_hits"))).alias("k")).select("doc_id", "_row", "k.hi", "k.lo")
    asked = asked.join(blocked.select("hi", "lo", "keeper"), ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = asked.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_same")).agg(F.flatten(F.collect_set(F.array("hi", "lo"))).alias("_drops"))
    dirty = dirty.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_same")), "left").select("doc_id", "text", F.coalesce("_drops", nothing).alias("_drops"))
    done = clean.union(dirty).select("doc_id", shortened(F.col("text"), F.col("_drops"), index.shortest).alias("_x"))
    return done.select("doc_id", F.col("_x.n").alias("n_lines"), F.col("_x.dropped").alias("n_dropped"), F.col("_x.kept").alias("kept"))
