"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes over training time. Its integral is the source's cumulative
demand for words; the inverse of that demand assigns each taken document its training position, and
documents are range-sorted by position.

Cases: null and empty texts have size 0 and are placed without words; a null source is a source of
its own, the last; ties in the order are broken by id and size, and rows equal in both are
interchangeable; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import words

#: Shape of a source's weight over training time in [0, 1], by its base weight: knots (time, weight).
#: Straight lines join the knots. Only the shape counts; the level is the source's target.
SCHEDULES = {
    1: [(0.0, 1.0), (1.0, 1.0)],
    2: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)],
    3: [(0.0, 0.5), (0.6, 1.0), (1.0, 2.0)],
}
MOST_REPEATS = 3
PREFIX = 3
"""Hex digits of the order key that name a block of a source, 4096 blocks."""


def shares(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources from (source, source_size): one row per source, so windows span them all.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target stops at
    ``most_repeats`` times its source; what is over goes to the others by weight. With sources
    ordered by cap per weight, the capped ones come first, and the level is that of the first
    source whose cap is not below it.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("weight", ((F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("int"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0))
    ranked = ranked.withColumn("_level", left / open_weight)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("level")))).over(every)
    return ranked.select("source", "source_size", "weight", F.least("cap", level["level"] * F.col("weight")).alias("target"))


def training_time(share: Column, weight: Column, schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """When a source's cumulative demand, as a part of the whole, reaches ``share``."""
    out = F.lit(None).cast("double")
    for base, knots in schedules.items():
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, done = math.fsum(areas), 0.0
        own = F.lit(1.0)
        pieces = []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            need = share * whole - F.lit(done)
            slope = (w1 - w0) / (t1 - t0)
            # need = w0 * x + slope * x^2 / 2, written so that a slope of nought does no harm
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
            pieces.append((done + area, F.lit(t0) + 2 * need / F.greatest(F.lit(w0) + root, F.lit(1e-12))))
            done += area
        for until, at in reversed(pieces):
            own = F.when(share * whole <= F.lit(until), F.least(at, F.lit(1.0))).otherwise(own)
        out = F.when(weight == base, own).otherwise(out)
    return out


def plan(docs: DataFrame, seed: int = 17, most_repeats: int = MOST_REPEATS, schedules: dict | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, its source's size and target, copies, words taken, positions.

    A source with a target of r times its size takes every document floor(r) times, and once
    more those that come first in a hashed order, up to the document that straddles the rest.
    Sums before a document add its block's start to a sum inside the block; blocks are ranges of
    the order, so a source of any size is spread. ``carry`` names further columns to keep.
    """
    schedules = schedules or SCHEDULES
    texts = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    rows = texts.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("_block", F.substring("_order", 1, PREFIX))
    blocks = rows.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
    targets = shares(blocks.groupBy("source").agg(F.sum("_words").alias("source_size")), most_repeats)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("_s"), F.col("_block").alias("_b"), "_start", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "_block").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumns({"_before": F.col("_start") + F.col("_inside"), "_times": times})
    rest = F.col("target") - F.col("_times") * F.col("source_size")
    rows = rows.withColumn("copies", F.col("_times") + F.when(2 * F.col("_before") + F.col("size") < 2 * rest, 1).otherwise(0))
    middle = F.col("_before") + F.col("size") / 2
    at = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")),
        lambda c: training_time(F.when(F.col("target") > 0, F.least(((c - 1) * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0)), F.col("weight"), schedules),
    )
    return rows.select(
        "doc_id", "source", "size", "source_size", F.col("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
        at.alias("positions"), *[f"_c_{c}" for c in carry],
    )


def mixture(docs: DataFrame, seed: int = 17, most_repeats: int = MOST_REPEATS, schedules: dict | None = None) -> DataFrame:
    """The training sequence: every taken copy of a document, range-sorted by its position."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source", "position"))
    taken = plan(docs, seed, most_repeats, schedules, carry).withColumn("position", F.explode("positions"))
    taken = taken.orderBy("position", "doc_id")
    return taken.select(*[F.col(c if c in ("doc_id", "source") else f"_c_{c}").alias(c) for c in docs.columns if c != "position"], "position")


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """What the mix takes of each document, range-sorted by first position; untaken ones come last."""
    planned = plan(docs, seed).withColumn("first_position", F.get("positions", F.lit(0)))
    return planned.orderBy(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")
