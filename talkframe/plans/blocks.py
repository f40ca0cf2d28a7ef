"""Ordered work on groups of any size.

A meeting, a session or a speaker may hold a large share of all rows, so no window here is
partitioned by such a key alone. Rows carry a dense position; positions are cut into blocks of
fixed length, windows run inside (key, block), and only one summary row per block takes part in
a window over the whole key. Both sides meet again on (key, block), which is how the rows are
already partitioned.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLK = "_block"
CORE = "_core"


def with_block(df: DataFrame, idx: str, size: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(BLK, F.floor(F.col(idx) / F.lit(size)))


def with_halo(df: DataFrame, idx: str, before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks whose windows may look ``before`` rows back and ``after`` rows ahead.

    Rows near a block's edge are copied into the neighbouring block; ``_core`` marks the
    original, so that copies are dropped after the window has run.
    """
    if size < max(before, after):
        raise ValueError("a block must be at least as long as its halo")
    own = F.floor(F.col(idx) / F.lit(size))
    pos = F.col(idx) - own * F.lit(size)
    places = [own]
    if before:
        places.append(F.when(pos >= size - before, own + 1))
    if after:
        places.append(F.when((pos < after) & (own > 0), own - 1))
    return (
        df.withColumn("_own", own)
        .withColumn(BLK, F.explode(F.array_compact(F.array(*places))))
        .withColumn(CORE, F.col(BLK) == F.col("_own"))
        .drop("_own")
    )


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(CORE, BLK)


def block_window(keys: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*keys, BLK).orderBy(*order)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running values over ``keys`` in ``order`` for rows that carry a block column.

    ``outputs`` maps a new column to ``(kind, expression)``:

    ``sum``/``max``   running value up to and including the row
    ``last``          latest non-null value up to and including the row
    ``before``/``after``  nearest earlier / later non-null value, the row itself left out
    ``lag``/``lead``  value of the previous / next row
    ``all_sum``/``all_max``  value over the whole key
    """
    part = [*keys, BLK]
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = inside.rowsBetween(Window.unboundedPreceding, -1)
    coming = inside.rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(*keys).orderBy(BLK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    rank = F.struct(*[F.col(c) for c in order])

    local: list[Column] = []
    totals: list[Column] = []
    carries: list[Column] = []
    merged: dict[str, Column] = {}
    for name, (kind, expr) in outputs.items():
        here, total, carry = f"_h_{name}", f"_t_{name}", f"_c_{name}"
        h, t, c = F.col(here), F.col(total), F.col(carry)
        if kind == "sum":
            local.append(F.sum(expr).over(upto).alias(here))
            totals.append(F.sum(expr).alias(total))
            carries.append(F.sum(t).over(earlier).alias(carry))
            merged[name] = F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind == "max":
            local.append(F.max(expr).over(upto).alias(here))
            totals.append(F.max(expr).alias(total))
            carries.append(F.max(t).over(earlier).alias(carry))
            merged[name] = F.greatest(h, c)
        elif kind == "last":
            local.append(F.last(expr, ignorenulls=True).over(upto).alias(here))
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), rank)).alias(total))
            carries.append(F.last(t, ignorenulls=True).over(earlier).alias(carry))
            merged[name] = F.coalesce(h, c)
        elif kind == "before":
            local.append(F.last(expr, ignorenulls=True).over(passed).alias(here))
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), rank)).alias(total))
            carries.append(F.last(t, ignorenulls=True).over(earlier).alias(carry))
            merged[name] = F.coalesce(h, c)
        elif kind == "after":
            local.append(F.first(expr, ignorenulls=True).over(coming).alias(here))
            totals.append(F.min_by(expr, F.when(expr.isNotNull(), rank)).alias(total))
            carries.append(F.first(t, ignorenulls=True).over(later).alias(carry))
            merged[name] = F.coalesce(h, c)
        elif kind in ("lag", "lead"):
            step = F.lag if kind == "lag" else F.lead
            edge_by = F.max_by if kind == "lag" else F.min_by
            # The value travels in a struct, so that a null value differs from a missing row.
            boxed = F.struct(expr.alias("v"))
            local.append(step(boxed).over(inside).alias(here))
            totals.append(edge_by(boxed, rank).alias(total))
            carries.append(step(t).over(across).alias(carry))
            merged[name] = F.coalesce(h, c)["v"]
        elif kind == "all_sum":
            totals.append(F.sum(expr).alias(total))
            carries.append(F.sum(t).over(whole).alias(carry))
            merged[name] = c
        elif kind == "all_max":
            totals.append(F.max(expr).alias(total))
            carries.append(F.max(t).over(whole).alias(carry))
            merged[name] = c
        else:
            raise ValueError(f"unknown scan kind: {kind}")

    rows = df.select("*", *local) if local else df
    summary = df.groupBy(*part).agg(*totals).select(*part, *carries)
    columns = [F.col(c) for c in df.columns if c != BLK]
    joined = rows.join(summary, part, "left")
    return joined.select(*columns, F.col(BLK), *[col.alias(name) for name, col in merged.items()])


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal ``label`` per key from 0, for rows that carry a block column."""
    return runs(df, keys, order, label, lambda before, here: before.eqNullSafe(here), name)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    same: Callable[[Column, Column], Column],
    name: str = "island",
) -> DataFrame:
    """Number runs per key from 0; a row stays in its predecessor's run where ``same`` holds."""
    part = [*keys, BLK]
    inside = Window.partitionBy(*part).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BLK)
    rank = F.struct(*[F.col(c) for c in order])
    boxed = F.struct(value.alias("v"))
    broken = lambda before, here: ~F.coalesce(same(before["v"], here["v"]), F.lit(False))

    rows = df.withColumn("_box", boxed).withColumn("_prev", F.lag("_box").over(inside))
    rows = rows.withColumn("_new", (F.col("_prev").isNotNull() & broken(F.col("_prev"), F.col("_box"))).cast("bigint"))
    edge = (F.col("_earlier").isNull() | broken(F.col("_earlier"), F.col("_first"))).cast("bigint")
    summary = (
        rows.groupBy(*part)
        .agg(F.sum("_new").alias("_inner"), F.min_by("_box", rank).alias("_first"), F.max_by("_box", rank).alias("_last"))
        .withColumn("_earlier", F.lag("_last").over(across))
        .withColumn("_edge", edge)
        .select(
            *part,
            (F.sum(F.col("_inner") + F.col("_edge")).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_inner")).alias("_base"),
        )
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_at", F.sum("_new").over(upto)).join(summary, part, "left")
    return numbered.withColumn(name, F.col("_base") + F.col("_at") - 1).drop("_box", "_prev", "_new", "_at", "_base")


def magnitude_bin(v: Column) -> Column:
    """A bin that grows with ``v`` of either sign: 4096 to a power of two, so small values are told apart like large ones.

    Infinities have the bins at either end, and what is no number one behind them, as in a sort.
    """
    size = F.least(F.abs(v), F.lit(sys.float_info.max))
    power = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    # A logarithm rounded up past its power of two only moves a value to the step below the first.
    step = (power + 1023) * 8192 + F.floor(size * F.pow(F.lit(2.0), -power) * 4096) + 1
    finite = F.when(v == 0, F.lit(0).cast("bigint")).when(v < 0, -step).otherwise(step).cast("bigint")
    end = F.lit(1 << 25).cast("bigint")
    return F.when(F.isnan(v), 2 * end).when(v == float("inf"), end).when(v == float("-inf"), -end).otherwise(finite)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    ``ranks`` maps an output column to a function from the number of values to a 0-based index.
    A coarse, order-preserving histogram (some 10^5 bins per key, combined map-side)
    finds the bin that holds each index; only the distinct values of that bin are then ordered.
    Adds ``n``, the number of values.
    """
    v = value.cast("double")
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    binned = base.withColumn("_bin", magnitude_bin(F.col("_v")))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    hist = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_n"))
        .withColumn("_cum", F.sum("_n").over(by_bin))
        .withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("bigint").alias("k")) for name, fn in ranks.items()])
    targets = (
        hist.withColumn("_w", F.explode(wanted))
        .filter((F.col("_w.k") < F.col("_cum")) & (F.col("_w.k") >= F.col("_cum") - F.col("_n")))
        .select(*keys, "_bin", "n", F.col("_w.name").alias("_name"), (F.col("_w.k") - (F.col("_cum") - F.col("_n"))).alias("_k"))
    )
    by_value = Window.partitionBy(*keys, "_name").orderBy("_v")
    picked = (
        binned.join(targets, [*keys, "_bin"])
        .groupBy(*keys, "_name", "_v", "_k", "n")
        .agg(F.count("*").alias("_n"))
        .withColumn("_cum", F.sum("_n").over(by_value))
        .filter(F.col("_cum") > F.col("_k"))
    )
    return picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks],
    )
