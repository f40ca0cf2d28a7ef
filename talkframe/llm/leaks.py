"""Benchmark decontamination by SimHash of item-sized windows.

A window of as many words as an item is compared with items of that length: fingerprints of the
five-word shingles first, through blocks of bits of which at least one is equal whenever two
fingerprints differ in at most RADIUS bits; then the exact similarity of the shingles, each weighed
by how often it occurs (shared weight over joint weight), which must reach 0.8.

Two bags that reach 0.8 share most shingles, so windows are laid at every start from which a text
holds so many shingles of an item that 0.8 can be reached. A fixed-size bit map of the items' shingles finds such places inside the row; what it lets
through by chance falls out in an exact join. Only stretches around such places are moved.

Words are runs of letters, marks and digits in lower case. An item of fewer than five words is one
shingle; one without words matches nothing.

Cases: null and empty texts match nothing; repeated rows are found each time; of equal pairs of
document and item the most similar window counts; rows without an id are found by their text; an
empty table on either side gives an empty result; other input columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import let, text_key
from talkframe.session import cut

GRAM = 5
SIMILARITY = 0.8
RADIUS = 20
#: Bits of the map, 128 KB. More items than it suits mean more places to look at, not fewer results.
MAP_BITS = 1 << 20


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def grams(found: Column, n: int) -> Column:
    """Hash of every run of n words."""

    def of(h: Column) -> Column:
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), of)


def shingles(found: Column) -> Column:
    """Runs of five words, or all words where there are fewer."""
    n = F.least(F.size(found), F.lit(GRAM))
    return F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.concat_ws(" ", F.slice(found, i, n)))


def simhash(parts: Column) -> Column:
    """Bits set in more than half of the shingles' hashes."""

    def bits(h: Column) -> Column:
        one = lambda b: F.when(2 * F.size(F.filter(h, lambda x: F.getbit(x, b) == 1)) > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(one(b)))

    return let(F.transform(parts, lambda s: F.xxhash64(s)), bits)


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 runs of bits: fingerprints within the radius have one of them equal."""
    out, at = [], 0
    for k in range(radius + 1):
        width = (64 - at) // (radius + 1 - k)
        out.append(F.struct(F.lit(k).alias("block"), F.call_function("shiftrightunsigned", fp, F.lit(at)).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")))
        at += width
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Shared over joint weight of two bags of shingles."""
    weight = lambda bag, s: F.size(F.filter(bag, lambda x: x == s))
    shared = F.aggregate(F.transform(F.array_distinct(a), lambda s: F.least(weight(a, s), weight(b, s))), F.lit(0), lambda t, x: t + x)
    return shared / (F.size(a) + F.size(b) - shared)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, ws, n, parts, fp) of the items that have words."""
    items = benchmark.select("item_id", terms(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumns({"n": F.size("ws"), "parts": shingles(F.col("ws"))})
    return items.withColumn("fp", simhash(F.col("parts")))


def item_grams(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, h, item_id, n): distinct shingle hashes of the items of n words."""
    out = None
    for k in sizes:
        rows = items.where(F.least("n", F.lit(GRAM)) == k).select(F.lit(k).alias("k"), "item_id", "n", F.explode(grams(F.col("ws"), k)).alias("h"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


def bit_map(hashes: DataFrame, map_bits: int) -> DataFrame:
    """One row with the map as an array of 64-bit words. Each hash sets two bits."""
    low, high = F.col("h").bitwiseAND(F.lit(map_bits - 1)), F.call_function("shiftrightunsigned", F.col("h"), F.lit(32)).bitwiseAND(F.lit(map_bits - 1))
    bits = hashes.select(F.explode(F.array(low, high)).alias("b"))
    full = bits.groupBy(F.call_function("shiftright", F.col("b"), F.lit(6)).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    every = hashes.sparkSession.range(map_bits // 64).join(F.broadcast(full), F.col("id") == F.col("w"), "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v")))).alias("all")).select(F.transform("all", lambda x: x["v"]).alias("map"))


def hit(words64: Column, h: Column, map_bits: int) -> Column:
    def bit(b: Column) -> Column:
        return F.getbit(F.get(words64, F.call_function("shiftright", b, F.lit(6)).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    return bit(h.bitwiseAND(F.lit(map_bits - 1))) & bit(F.call_function("shiftrightunsigned", h, F.lit(32)).bitwiseAND(F.lit(map_bits - 1)))


def stretches(docs: DataFrame, known: DataFrame, sizes: list[int], longest: int, map_bits: int) -> DataFrame:
    """(seg, doc_id, key, ws): words around places that may hold a shingle of an item.

    Places at most an item apart share a stretch, which goes one item beyond both ends.
    """
    bitmap = bit_map(known.select("h").distinct(), map_bits).scalar()

    def runs(w: Column, m: Column) -> Column:
        places = [let(grams(w, k), lambda g: F.filter(F.transform(g, lambda h, i: F.when(hit(m, h, map_bits), i)), lambda i: i.isNotNull())) for k in sizes]
        return let(places[0] if len(places) == 1 else F.array_sort(F.array_distinct(F.concat(*places))), lambda p: joined(w, p))

    def joined(w: Column, p: Column) -> Column:
        first = F.filter(p, lambda x, i: F.coalesce(x - F.get(p, F.greatest(i - 1, F.lit(0))) > longest, F.lit(False)) | (i == 0))
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) - x > longest, F.lit(True)))

        def piece(s: Column, e: Column) -> Column:
            start = F.greatest(s - longest, F.lit(0))
            return F.slice(w, start + 1, e - start + GRAM + longest)

        return F.transform(first, lambda s, i: piece(s, F.get(last, i)))

    rows = docs.select("doc_id", "text", bitmap.alias("map"))
    found = let(terms(F.col("text")), lambda w: let(F.col("map"), lambda m: runs(w, m)))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.explode(found).alias("ws"))
    return rows.withColumn("seg", F.monotonically_increasing_id())


def starts(p: Column, m: Column, n: Column, k: int, least: float) -> Column:
    """Every start in m words of a window of n words with enough of the sorted places p to reach ``least``.

    The windows that start behind a place and up to the next one, x, hold enough where the last of
    the places they need, counted from x, is still inside.
    """
    whole = n - k + 1
    width = F.least(whole, m - k + 1)
    need = F.greatest(F.ceil(least * (width + whole) / (1 + least) - 1e-9).cast("int"), F.lit(1))

    def up_to(x: Column, i: Column) -> Column:
        last = F.get(p, i + need - 1)
        low = F.greatest(F.coalesce(F.get(p, i - 1) + 1, F.lit(0)), last - width + 1)
        high = F.least(x, F.greatest(m - n, F.lit(0)))
        return F.when(last.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(p, up_to))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, map_bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, key, item_id, similarity, bits): each document's most similar window per item."""
    items = cut(item_table(benchmark))
    row = items.agg(F.max("n"), F.collect_set(F.least("n", F.lit(GRAM)))).first()
    sizes, longest = sorted(row[1]) or [GRAM], row[0] or 1
    known = item_grams(items, sizes)
    segs = cut(stretches(docs, known, sizes, longest, map_bits))
    windows = None
    for k in sizes:
        places = segs.select("seg", F.size("ws").alias("m"), F.posexplode(grams(F.col("ws"), k)).alias("pos", "h"))
        hits = places.join(known.where(F.col("k") == k), "h").groupBy("seg", "m", "item_id", "n").agg(F.array_sort(F.collect_set("pos")).alias("p"))
        rows = hits.select("seg", "n", F.explode(starts(F.col("p"), F.col("m"), F.col("n"), k, least)).alias("start"))
        windows = rows if windows is None else windows.union(rows)
    windows = windows.distinct().join(segs, "seg").select("doc_id", "key", "n", F.slice("ws", F.col("start") + 1, F.col("n")).alias("w"))
    windows = windows.withColumn("parts", shingles(F.col("w"))).select("doc_id", "key", "n", "parts", simhash(F.col("parts")).alias("fp"))
    theirs = items.select("item_id", "n", F.col("parts").alias("item_parts"), F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("x")).select("*", "x.*").drop("x")
    pairs = windows.withColumn("x", F.explode(blocks(F.col("fp"), radius))).select("*", "x.*").drop("x").join(theirs, ["n", "block", "bits"])
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # a pair may meet in several blocks; the first equal one stands for it
    equal = F.filter(F.zip_with(blocks(F.col("fp"), radius), blocks(F.col("item_fp"), radius), lambda a, b: F.when(a["bits"] == b["bits"], a["block"])), lambda x: x.isNotNull())
    pairs = pairs.where((differ <= radius) & (F.get(equal, F.lit(0)) == F.col("block")))
    pairs = pairs.select("doc_id", "key", "item_id", differ.alias("bits"), similarity(F.col("parts"), F.col("item_parts")).alias("similarity")).where(F.col("similarity") >= least)
    return pairs.groupBy("doc_id", "key", "item_id").agg(F.max("similarity").alias("similarity"), F.min("bits").alias("bits"))


def leaked(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of document and benchmark item, one row each."""
    found = matches(docs, benchmark, least)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min("bits").alias("bits"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without those that hold a passage of the benchmark."""
    found = matches(docs, benchmark, least).select(F.col("key").alias("leak")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("own"))
    return keyed.join(found, F.col("own") == F.col("leak"), "left_anti").select("row.*")
