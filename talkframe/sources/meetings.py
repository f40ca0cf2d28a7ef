"""The meeting archive on disk: one folder per meeting with JSON files; tables on a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators.segments import line_text, transcript_lines

SEGMENT_TYPE = "struct<start:double,end:double,text:string,speaker:string,duplicate:boolean,overlap:boolean,source:string>"
_ID_IN_PATH = r"([^/]+)/[^/]+$"


def _files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Files of one name from every meeting folder; a file that does not parse keeps only its id."""
    df = (
        spark.read.schema(schema + ", _corrupt string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(root)
    )
    return df.withColumn("meeting_id", F.regexp_extract(F.col("_metadata.file_path"), _ID_IN_PATH, 1))


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``(meeting_id, meeting_scope, text, segments)``, one row per transcript file."""
    df = _files(spark, root, "transcribe.json", f"segments array<{SEGMENT_TYPE}>, text string, meetingScope string")
    scope = F.when(F.col("meetingScope").isin("group", "two-party"), F.col("meetingScope")).otherwise("group")
    return df.select("meeting_id", scope.alias("meeting_scope"), F.coalesce("text", F.lit("")).alias("text"), "segments")


def explode_segments(transcripts: DataFrame) -> DataFrame:
    """Segment rows; array order becomes ``seg_idx``, absent flags are false, no segments give no rows."""
    each = transcripts.select("meeting_id", F.posexplode("segments").alias("seg_idx", "s"))
    flag = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(False)).alias(c)
    return each.select(
        "meeting_id", "seg_idx", "s.start", "s.end", F.coalesce("s.text", F.lit("")).alias("text"), "s.speaker", "s.source", flag("duplicate"), flag("overlap")
    )


def read_analyses(spark: SparkSession, root: str) -> DataFrame:
    """``(meeting_id, markdown, speakers_degraded)``; a corrupt or unfinished analysis has no markdown."""
    df = _files(spark, root, "analyze.json", "analysis struct<status:string,markdown:string>, speakersDegraded boolean")
    finished = F.when(F.col("analysis.status") == "success", F.col("analysis.markdown"))
    return df.select("meeting_id", finished.alias("markdown"), F.coalesce("speakersDegraded", F.lit(False)).alias("speakers_degraded"))


def read_meta(spark: SparkSession, root: str, meetings: DataFrame) -> DataFrame:
    """Meta rows for ``meetings(meeting_id)``; a meeting without a meta file has an empty one."""
    df = _files(spark, root, "meta.json", "name string, originalId string, editedId string")
    meta = df.select("meeting_id", "name", F.col("originalId").alias("original_id"), F.col("editedId").alias("edited_id"))
    return meetings.select("meeting_id").join(meta, "meeting_id", "left").withColumnRenamed("meeting_id", "id")


def write_meeting(segments: DataFrame, analyses: DataFrame | None, path: str, mode: str = "append") -> None:
    """Segments with their printed lines always, analyses where there are any.

    Tables are laid out by day of the meeting id, so a day's meetings are read without the rest.
    """
    day = F.substring("meeting_id", 1, 10)
    segments.withColumn("day", day).write.mode(mode).partitionBy("day").parquet(f"{path}/segments")
    lines = line_text(transcript_lines(segments)).withColumn("day", day)
    lines.write.mode(mode).partitionBy("day").parquet(f"{path}/lines")
    if analyses is not None:
        present = analyses.filter(F.col("markdown").isNotNull())
        present.withColumn("day", day).write.mode(mode).partitionBy("day").parquet(f"{path}/analyses")


# The words of an exported document.
ANALYSIS_HEADING, TRANSCRIPT_HEADING = "## Analiz", "## Döküm"
NO_TRANSCRIPT = "(döküm yok)"
DEGRADED_NOTE = "> Not: Konuşmacı etiketleri bu oturumda kullanılamadı."


def markdown_lines(meetings: DataFrame, lines: DataFrame) -> DataFrame:
    """Exported documents line by line: ``(meeting_id, file_name, section, line_idx, part, line)``.

    ``meetings`` are ``(meeting_id, name, markdown, text, speakers_degraded)``, ``lines`` the printed
    dialogue. The transcript is printed from segments; the stored text stands in where there are
    none. Documents stay rows of lines, so a long meeting never sits in one row; sorted by section,
    line and part they read in order.
    """
    file_name = F.concat(X.clean_file_name(F.col("name")), F.lit(".md"))
    spoken = lines.select("meeting_id").distinct().withColumn("_spoken", F.lit(True))
    head = meetings.join(spoken, "meeting_id", "left").withColumn("file_name", file_name)
    none = F.lit(None).cast("string")
    stand_in = F.when(F.coalesce("text", F.lit("")) == "", F.lit(NO_TRANSCRIPT)).otherwise(F.col("text"))
    printed = [
        F.concat(F.lit("# "), F.col("name"), F.lit("\n")),
        F.when(F.col("markdown").isNotNull(), F.concat(F.lit(ANALYSIS_HEADING + "\n\n"), F.col("markdown"), F.lit("\n"))),
        F.lit(TRANSCRIPT_HEADING + "\n"),
        F.when(F.col("_spoken"), none).otherwise(stand_in),
        F.when(F.coalesce("speakers_degraded", F.lit(False)), F.lit("\n" + DEGRADED_NOTE)),
    ]
    fixed = F.array(*[F.struct(F.lit(i).alias("section"), line.alias("line")) for i, line in enumerate(printed)])
    blocks = head.select("meeting_id", "file_name", F.explode(fixed).alias("b")).filter(F.col("b.line").isNotNull())
    zero = F.lit(0).cast("bigint")
    framed = blocks.select("meeting_id", "file_name", F.col("b.section").alias("section"), zero.alias("line_idx"), zero.alias("part"), F.col("b.line").alias("line"))
    said = head.select("meeting_id", "file_name").join(lines.select("meeting_id", "line_idx", "part", "line"), "meeting_id")
    return framed.unionByName(said.select("meeting_id", "file_name", F.lit(3).alias("section"), "line_idx", "part", "line"))


def export_markdown(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Write exported documents as text, a folder per meeting, lines in order."""
    keys = ["meeting_id", "section", "line_idx", "part"]
    ordered = documents.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    ordered.select("meeting_id", F.col("line").alias("value")).write.mode(mode).partitionBy("meeting_id").text(path)
