"""Files to be scanned, in every reading their bytes allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(content: Column) -> Column:
    """Bytes as UTF-8, Latin-1 and, from four bytes on, UTF-16: an array of texts."""
    even = F.substring(content, F.lit(1), (F.floor(F.length(content) / 2) * 2).cast("int"))
    wide = F.when(F.length(content) >= 4, F.decode(even, "UTF-16LE"))
    return F.array_compact(F.array(F.decode(content, "UTF-8"), F.decode(content, "ISO-8859-1"), wide))


def utf8_only(content: Column) -> Column:
    """The one reading of bytes known to be UTF-8."""
    return F.array(F.decode(content, "UTF-8"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, length, modified)`` of every file below ``path``."""
    # Bytes outside a charset are replaced rather than refused.
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", "length", F.col("modificationTime").alias("modified"))


def text_corpus(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Texts of a table as a corpus."""
    return df.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))
