"""SimHash near-duplicates by anchor points.

Texts become 64-bit fingerprints. Two that differ in at most three bits differ in at most one bit
of one of their halves. Each half is covered by the words of a Hamming code (31 coded bits and one
free bit): every half lies within one bit of an anchor, its home. A fingerprint is sent to every
anchor within covering radius plus threshold, two bits, so it meets each near one at that one's
home. Anchors compare the fingerprints that are at home with all that were sent, and hand on a
star per group of linked ones instead of its pairs.

Cases: null and empty texts have fingerprint zero and are linked like any other; rows without an id
take part and get the smallest id of their component, null if it has none; repeated rows share a
fingerprint; an empty table gives an empty result; other input columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import let
from talkframe.llm.graph import components
from talkframe.session import cut, runs_in_tasks

runs_in_tasks(__name__)

WORDS = 3
MOST_BITS = 3
SEED = 42
#: Members an anchor may have before it is split by bytes of the other half.
HOT = 50_000
BLOCK = 2048


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of every run of three words, A-Z in lower case; of all words where there are fewer."""
    # bytes.lower() changes A-Z only, bytes.split() cuts at space and 0x09 to 0x0D
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) < WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    ends = np.cumsum([len(w) + 1 for w in found])
    line, starts, ends = b" ".join(found), [0, *ends[:-WORDS].tolist()], (ends[WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit number."""
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 8192):
        part = np.ascontiguousarray(values[i : i + 8192])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t)) for t in texts], dtype="int64")

    return made(text)


def anchors(half: Column) -> Column:
    """(anchor, home) for every anchor within two bits of a 32-bit half.

    Coded bits are numbered 1 to 31; the syndrome is the exclusive or of the numbers of set bits,
    and flipping the bit it names leads home. The others within two bits flip two coded bits whose
    numbers give the syndrome, or go home and flip the free bit, number 32.
    """
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        syndrome = syndrome + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2) * (1 << k)

    def flip(value: Column, bit: Column) -> Column:
        return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit - 1))

    def anchor(value: Column, home: bool) -> Column:
        return F.struct(value.alias("anchor"), F.lit(home).alias("home"))

    def around(s: Column) -> Column:
        home = F.when(s == 0, half).otherwise(flip(half, s))
        pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (s != 0) & (i != s) & (i < i.bitwiseXOR(s)))
        return F.concat(F.array(anchor(home, True), anchor(flip(home, F.lit(32)), False)), F.transform(pairs, lambda i: anchor(flip(flip(half, i), i.bitwiseXOR(s)), False)))

    return let(syndrome.cast("int"), around)


def sent(prints: DataFrame) -> DataFrame:
    """(side, anchor, part, fp, home): a fingerprint once for every anchor it is sent to."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    sides = F.concat(
        F.transform(anchors(low), lambda x: F.struct(F.lit(0).alias("side"), x["anchor"].alias("anchor"), F.lit(-1).alias("part"), x["home"].alias("home"))),
        F.transform(anchors(high), lambda x: F.struct(F.lit(1).alias("side"), x["anchor"].alias("anchor"), F.lit(-1).alias("part"), x["home"].alias("home"))),
    )
    return prints.select("fp", F.explode(sides).alias("x")).select("x.side", "x.anchor", "x.part", "fp", "x.home")


def split_hot(hot: DataFrame) -> DataFrame:
    """Members of hot anchors by each byte of the other half: at most three bits differ there, so one of its four bytes is equal."""
    other = F.when(F.col("side") == 0, F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))).otherwise(F.col("fp"))
    parts = F.array(*[(F.lit(k * 256) + F.call_function("shiftrightunsigned", other, F.lit(8 * k)).bitwiseAND(F.lit(255))).cast("int") for k in range(4)])
    return hot.select("side", "anchor", F.explode(parts).alias("part"), "fp", "home")


def linked(fps: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that join the members of one anchor which are within three bits of one at home."""
    root = np.arange(len(fps))
    bits = np.ascontiguousarray(fps).view(np.uint64)  # bits of a signed number are counted without its sign

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h in np.flatnonzero(home):
        for start in range(0, len(fps), 1 << 20):
            near = np.flatnonzero(np.bitwise_count(bits[start : start + (1 << 20)] ^ bits[h]) <= MOST_BITS) + start
            near = near[root[near] != root[h]]
            for n in near:
                a, b = top(n), top(h)
                if a != b:
                    root[max(a, b)] = min(a, b)
    tops = np.array([top(i) for i in range(len(fps))])
    own = tops != np.arange(len(fps))
    if own.any():
        yield fps[own], fps[tops[own]]


OUT = "kind int, side int, anchor bigint, part int, a bigint, b bigint, home boolean"


def compare(most: int):
    """Task function over rows sorted by anchor: edges (kind 0), and members of anchors beyond ``most`` (kind 1), unchanged."""

    def frame(kind, side, anchor, part, a, b, home) -> pd.DataFrame:
        n = len(a)
        full = lambda x: x if isinstance(x, np.ndarray) else np.repeat(x, n)
        return pd.DataFrame({"kind": full(np.int32(kind)), "side": full(side), "anchor": full(anchor), "part": full(part), "a": a, "b": full(b), "home": full(home)})

    def edges(keys, fps, home) -> Iterator[pd.DataFrame]:
        order = np.unique(fps, return_index=True)[1]
        for a, b in linked(fps[order], home[order]):
            yield frame(0, np.int32(0), np.int64(0), np.int32(0), a, b, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        passing = None  # the anchor whose members go through unchanged
        for batch in batches:
            if held:
                batch = pd.concat([*held, batch], ignore_index=True)
                held = []
            key = batch[["side", "anchor", "part"]].to_numpy()
            fps, home = batch["fp"].to_numpy(), batch["home"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            last = len(starts) - 1
            at_home = np.add.reduceat(home.astype(np.int64), starts) if len(key) else np.zeros(0, int)
            sizes = ends - starts
            chosen = (sizes > 1) & (at_home > 0) | (np.arange(len(starts)) == last)
            if len(key) and tuple(key[0]) == passing:
                chosen[0] = True  # the tail of an anchor that was handed back, whatever its size and homes
            for i in np.flatnonzero(chosen):
                s, e, name = starts[i], ends[i], tuple(key[starts[i]])
                if passing == name or sizes[i] > most:
                    passing = name
                    part = batch.iloc[s:e]
                    yield frame(1, part["side"].to_numpy(), part["anchor"].to_numpy(), part["part"].to_numpy(), part["fp"].to_numpy(), np.int64(0), part["home"].to_numpy())
                elif i == last:
                    held = [batch.iloc[s:e]]
                else:
                    yield from edges(name, fps[s:e], home[s:e])
        for rest in held:
            yield from edges(None, rest["fp"].to_numpy(), rest["home"].to_numpy())

    return run


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that join any two fingerprints within three bits, directly or through others.

    An anchor with more than ``hot`` members hands them back; they are dealt again by the bytes of
    their other half, and compared there whatever their number.
    """
    def compared(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.repartition("side", "anchor", "part").sortWithinPartitions("side", "anchor", "part")
        return cut(dealt.mapInPandas(compare(most), OUT))

    first = compared(sent(prints), hot)
    edges = first.where("kind = 0").select("a", "b")
    over = first.where("kind = 1")
    if over.limit(1).count():
        again = split_hot(over.select("side", "anchor", "part", F.col("a").alias("fp"), "home"))
        edges = edges.union(compared(again, 1 << 62).where("kind = 0").select("a", "b"))
    return edges.distinct()


def near_groups(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows (doc_id, key, fp), and (fp, root, first) with the first row of each component."""
    rows = cut(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), fingerprints(F.col("text")).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    nodes = cut(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(links(nodes.select("fp"), hot))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    whole = nodes.groupBy("root").agg(F.min("first").alias("first"))
    return rows, nodes.drop("first").join(whole, "root")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document its fingerprint and the smallest id reachable over links of at most three bits."""
    rows, groups = near_groups(docs, hot)
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents, one of each component: the first by id, then by a hash of the text. Repeated rows count as one."""
    _, groups = near_groups(docs, hot)
    chosen = groups.select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    kept = keyed.join(chosen, F.col("own").eqNullSafe(F.col("id")) & (F.col("same") == F.col("key")), "left_semi")
    once = F.row_number().over(Window.partitionBy("own", "same").orderBy(F.lit(0)))
    return kept.withColumn("n", once).where("n = 1").select("row.*")
