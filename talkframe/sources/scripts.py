"""Scripts: plain text with one turn per line, made into timed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.plans.blocks import BLK, BLOCK_ROWS, scan, with_block

CHARS_PER_SECOND = 14
SHORTEST_CS = 80

_LOOP = r"^\[\[LOOP:(.+):([0-9]+)\]\]$"


def spoken_centiseconds(text: Column) -> Column:
    """How long a text takes to say, in hundredths of a second."""
    return F.greatest(F.floor(F.length(text) / CHARS_PER_SECOND * 100 + 0.5), F.lit(SHORTEST_CS)).cast("bigint")


def script_segments(scripts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(meeting_id, text)`` scripts as segments.

    Blank lines are dropped; ``[[LOOP:text:n]]`` stands for n turns of the same text. Turns are
    numbered and timed by line length, one turn after the other.
    """
    lines = scripts.select("meeting_id", F.posexplode(F.split(F.col("text"), r"\r?\n")).alias("_line", "_raw"))
    lines = lines.withColumn("_raw", X.strip(F.col("_raw"))).filter(F.col("_raw") != "")
    looped = F.regexp_like("_raw", F.lit(_LOOP))
    said = F.when(looped, F.regexp_extract("_raw", _LOOP, 1)).otherwise(F.col("_raw"))
    times = F.when(looped, F.regexp_extract("_raw", _LOOP, 2).cast("bigint")).otherwise(1)
    counted = lines.select("meeting_id", "_line", said.alias("text"), times.alias("_n"), spoken_centiseconds(said).alias("_cs"))
    placed = scan(
        with_block(counted.filter(F.col("_n") > 0), "_line", block_rows),
        ["meeting_id"],
        ["_line"],
        {"_rows": ("sum", F.col("_n")), "_time": ("sum", F.col("_n") * F.col("_cs"))},
    )
    repeated = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    begin = F.col("_time") - F.col("_cs") * (F.col("_n") - F.col("_k"))
    return repeated.select(
        "meeting_id",
        (F.col("_rows") - F.col("_n") + F.col("_k")).alias("seg_idx"),
        (begin / 100).alias("start"),
        ((begin + F.col("_cs")) / 100).alias("end"),
        "text",
        F.lit(None).cast("string").alias("speaker"),
        F.lit(None).cast("string").alias("source"),
        F.lit(False).alias("duplicate"),
        F.lit(False).alias("overlap"),
    ).drop(BLK)
