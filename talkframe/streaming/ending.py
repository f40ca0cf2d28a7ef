"""The end of live meetings, written by the stream that heard them.

A trigger first stores its segments. Where a meeting stops, its stored segments are finalised and its one
outcome is stored; a marker is written last. Readers look at marked triggers only, and a trigger
that Spark repeats overwrites its own folders, so each row and each outcome is there once whatever fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators import segments as S
from talkframe.plans.blocks import BLOCK_ROWS, scan, with_block
from talkframe.streaming import live
from talkframe.streaming.ordered import rocksdb

HEARD = "meeting_id string, round int, seg_in_round int, start double, end double, text string, seam double, offset double, duplicate boolean, ended boolean, batch bigint"
ENDED = "meeting_id string, status string, speakers_degraded boolean, markdown string, analysis_error string, batch bigint"
SPOKEN = "meeting_id string, seg_idx bigint, start double, end double, text string, speaker string, source string, duplicate boolean, overlap boolean, batch bigint"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def as_segments(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored rounds as the segments of whole meetings, numbered densely over the rounds."""
    counts = rows.groupBy("meeting_id", "round").agg(F.count("*").alias("_n"))
    before = scan(with_block(counts, "round", block_rows), S.MEETING, ["round"], {"_upto": ("sum", F.col("_n"))})
    placed = rows.join(before.select("meeting_id", "round", (F.col("_upto") - F.col("_n")).alias("_before")), ["meeting_id", "round"])
    none = F.lit(None).cast("string")
    return placed.select(
        "meeting_id", (F.col("_before") + F.col("seg_in_round")).alias("seg_idx"), "start", "end", "text", none.alias("speaker"), none.alias("source"), "duplicate",
        F.lit(False).alias("overlap"),
    )


def start_meetings(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    turns: DataFrame | None = None,
    frames: DataFrame | None = None,
    silent: DataFrame | None = None,
    cancelled: DataFrame | None = None,
    analyse: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = False,
):
    """Store rounds of ``live.live_rows`` below ``path`` and end each meeting that stops, once.

    ``turns`` and ``frames`` hold those of all meetings; ``silent`` and ``cancelled`` list meetings
    without stored sound and those called off. ``analyse`` gets transcript lines and returns
    ``(meeting_id, markdown, error)``. A meeting called off ends as ``cancelled`` and keeps nothing else.
    """

    def listed(meetings: DataFrame, among: DataFrame | None) -> DataFrame:
        """``meetings`` with whether ``among`` lists them."""
        if among is None:
            return meetings.withColumn("_in", F.lit(False))
        marked = among.select("meeting_id").distinct().withColumn("_yes", F.lit(True))
        return meetings.join(marked, "meeting_id", "left").withColumn("_in", F.coalesce("_yes", F.lit(False))).drop("_yes")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/segments/batch={batch_id}")
        heard = _stored(spark, f"{path}/segments", HEARD)
        over = heard.filter(F.col("ended") & (F.col("batch") == batch_id)).select("meeting_id").distinct()
        before = _stored(spark, f"{path}/outcomes", ENDED).filter(F.col("batch") != batch_id)
        over = over.join(before, "meeting_id", "left_anti")
        if over.limit(1).count():
            end(spark, heard, over, batch_id)
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    def end(spark: SparkSession, heard: DataFrame, over: DataFrame, batch_id: int) -> None:
        stopped = listed(listed(over, silent).select("meeting_id", (~F.col("_in")).alias("has_audio")), cancelled).withColumnRenamed("_in", "cancelled")
        wanted = stopped.filter(~F.col("cancelled"))
        mine = heard.filter(~F.col("ended") & (F.col("batch") <= batch_id)).join(wanted, "meeting_id", "left_semi")
        audible = wanted.filter("has_audio")
        theirs = lambda table: None if table is None else table.withColumn("meeting_id", F.col("meeting_id").cast("string")).join(audible, "meeting_id", "left_semi")
        done = live.finalize(as_segments(mine), theirs(turns), None if frames is None else frames.withColumn("meeting_id", F.col("meeting_id").cast("string")))
        folder = f"{path}/transcripts/batch={batch_id}"
        done.write.mode("overwrite").parquet(folder)
        spoken = spark.read.parquet(folder)
        results = live.outcomes(spoken, stopped, None if analyse is None else analyse(S.line_text(S.transcript_lines(spoken))))
        none = F.lit(None).cast("string")
        gone = stopped.filter("cancelled").select("meeting_id", F.lit("cancelled").alias("status"), (~F.col("has_audio")).alias("speakers_degraded"), none.alias("markdown"), none.alias("analysis_error"))
        results.unionByName(gone).write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    with rocksdb(rows.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def _marked(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    marks = _stored(spark, f"{path}/commits", "done boolean, batch bigint").select("batch").distinct()
    return _stored(spark, f"{path}/{name}", schema).join(marks, "batch", "left_semi").drop("batch")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The one terminal row of every meeting that has ended: ``result``, ``error`` or ``cancelled``."""
    return _marked(spark, path, "outcomes", ENDED)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Finalised segments of the meetings that have ended and were not called off."""
    return _marked(spark, path, "transcripts", SPOKEN)


def deltas(spark: SparkSession, path: str) -> DataFrame:
    """Segments as the rounds brought them, those of meetings called off left out."""
    gone = outcomes(spark, path).filter(F.col("status") == "cancelled")
    return _marked(spark, path, "segments", HEARD).filter(~F.col("ended")).drop("ended").join(gone, "meeting_id", "left_anti")
