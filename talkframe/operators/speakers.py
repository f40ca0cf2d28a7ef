"""Speaker labels and the names people give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators.segments import has_speaker


def speaker_labels(segments: DataFrame) -> DataFrame:
    """Labels per meeting in order of first appearance, each with the side of its first placed segment."""
    placed = F.when(F.coalesce(F.col("source") != "", F.lit(False)), F.col("seg_idx"))
    per = segments.filter(has_speaker()).groupBy("meeting_id", "speaker").agg(F.min("seg_idx").alias("_first"), F.min_by("source", placed).alias("source"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")).cast("bigint")
    return per.select("meeting_id", rank.alias("appearance"), "speaker", "source")


def name_changes(entries: DataFrame) -> DataFrame:
    """Entries ``(meeting_id, label, name)`` that change something; a refused name is an error."""
    name = X.strip(F.col("name"))
    why = F.when(name != F.col("label"), X.name_error(F.col("name")))
    checked = F.when(why.isNull(), name).otherwise(F.raise_error(F.concat(F.lit("speaker name refused: "), why)).cast("string"))
    return entries.withColumn("name", checked).filter((F.col("name") != "") & (F.col("name") != F.col("label")))


def rename_segments(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Give mapped speakers their names; ``names`` are ``(meeting_id, label, name)``."""
    mapped = names.select("meeting_id", F.col("label").alias("speaker"), F.col("name").alias("_name"))
    return segments.join(mapped, ["meeting_id", "speaker"], "left").withColumn("speaker", F.coalesce("_name", "speaker")).select(*segments.columns)


def name_maps(names: DataFrame) -> DataFrame:
    """Names of a meeting as one map; a meeting has few labels."""
    return names.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("label", "name")))).alias("names"))


def rename_texts(texts: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Replace labels inside a text column, in one pass."""
    joined = texts.join(name_maps(names), "meeting_id", "left")
    return joined.withColumn(column, X.rename_labels(F.col(column), F.col("names"))).select(*texts.columns)


def mentions(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items that mention a speaker's label: items with ``label``.

    A meeting's labels come to an item as one list, as names do; only those that are mentioned become rows.
    """
    lists = labels.where(F.col("speaker").isNotNull()).groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("_labels"))
    said = F.filter("_labels", lambda x: F.contains("item", x) & X.mentions_label(F.col("item"), x))
    return items.join(lists, "meeting_id").withColumn("label", F.explode(said)).drop("_labels")


def spoken_lines(segments: DataFrame) -> DataFrame:
    """What each speaker said, repeats and blanks left out: ``(meeting_id, speaker, seg_idx, line)``."""
    line = X.strip(F.col("text"))
    return segments.filter(has_speaker() & ~F.col("duplicate") & (line != "")).select("meeting_id", "speaker", "seg_idx", line.alias("line"))
