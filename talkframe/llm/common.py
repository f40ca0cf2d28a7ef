"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than space, tab and line breaks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """96 bits that name a text; equal texts share it. Null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.hash(whole, F.lit("b")).alias("b"))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: crc32 of the id's decimal digits, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """The other rows. A null id has no remainder and is in neither set."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, klass: str, key: str, most: int, salts: int = 64) -> DataFrame:
    """At most ``most`` rows of each class, those with the smallest hash of ``key``.

    Ranks are taken in two steps, first in one of ``salts`` parts of a class, so that no task
    sorts a whole class; the second step sees at most ``salts * most`` rows of one.
    """
    from pyspark.sql import Window

    order = [F.col("_order"), F.col(key)]
    part = rows.withColumn("_order", F.xxhash64(F.lit(29), F.col(key))).withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy(klass, "_salt").orderBy(*order))).where(F.col("_n") <= most)
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy(klass).orderBy(*order))).where(F.col("_n") <= most)
    return part.drop("_order", "_salt", "_n")
