"""The domain tables that queries read, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators.segments import MEETING
from talkframe.plans.blocks import BLK, scan, with_block
from talkframe.session import widen
from talkframe.sources.scripts import spoken_centiseconds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "events":
        return df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that costs much per row."""
    return widen(read(spark, sf_dir, "documents").select("doc_id", "text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed segments: each turn lasts as long as its text takes to say."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").alias("seg_idx"),
        "text",
        F.col("role").alias("speaker"),
        F.when(F.col("role") == "user", "local").when(F.col("role") == "assistant", "remote").alias("source"),
        spoken_centiseconds(F.col("text")).alias("_cs"),
    )
    timed = scan(with_block(turns, "seg_idx"), MEETING, ["seg_idx"], {"_end": ("sum", F.col("_cs"))})
    return timed.select(
        "meeting_id",
        "seg_idx",
        ((F.col("_end") - F.col("_cs")) / 100).alias("start"),
        (F.col("_end") / 100).alias("end"),
        "text",
        "speaker",
        "source",
        F.lit(False).alias("duplicate"),
        F.lit(False).alias("overlap"),
    ).drop(BLK)


def echoed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a faulty decoder hands them over.

    Each turn is preceded by a row cut off after three words that overlaps it, and followed by a
    fast echo of its first seven tenths with one ``evet`` per turn number appended.
    """
    base = segments(spark, sf_dir)
    tokens = F.split(F.col("text"), r"\s+")
    head = F.array_join(F.slice(tokens, 1, 3), " ")
    kept = F.floor((F.size(tokens) * 7 + 9) / 10).cast("int")
    echo = F.concat(F.array_join(F.slice(tokens, F.lit(1), kept), " "), F.repeat(F.lit(" evet"), F.col("seg_idx").cast("int")))
    start, end = F.col("start"), F.col("end")
    rows = F.array(
        F.struct(F.lit(0).alias("k"), start.alias("s"), (start + 0.5).alias("e"), head.alias("t")),
        F.struct(F.lit(1).alias("k"), start.alias("s"), end.alias("e"), F.col("text").alias("t")),
        F.struct(F.lit(2).alias("k"), (end + 0.01).alias("s"), (end + 0.81).alias("e"), echo.alias("t")),
    )
    return base.withColumn("_r", F.explode(rows)).select(
        "meeting_id",
        (F.col("seg_idx") * 3 + F.col("_r.k")).alias("seg_idx"),
        F.col("_r.s").alias("start"),
        F.col("_r.e").alias("end"),
        F.col("_r.t").alias("text"),
        "speaker",
        "source",
        "duplicate",
        "overlap",
    )


SEGMENTS_SQL = """
seg_base AS (
  SELECT conv_id AS meeting_id, turn AS seg_idx, text, role AS speaker,
         CASE role WHEN 'user' THEN 'local' WHEN 'assistant' THEN 'remote' END AS source,
         greatest(80, CAST(floor(CAST(length(text) AS DOUBLE) / 14 * 100 + 0.5) AS BIGINT)) AS cs
  FROM conversations),
segments AS (
  SELECT meeting_id, seg_idx, text, speaker, source,
         CAST(sum(cs) OVER w - cs AS DOUBLE) / 100 AS start,
         CAST(sum(cs) OVER w AS DOUBLE) / 100 AS "end",
         CAST(sum(cs) OVER w - cs AS BIGINT) AS start_cs, CAST(sum(cs) OVER w AS BIGINT) AS end_cs
  FROM seg_base WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx))
"""

ECHO_SQL = (
    SEGMENTS_SQL
    + r""",
echo_parts AS (
  SELECT *, string_split_regex(text, '\s+') AS toks FROM segments),
echoed AS (
  SELECT meeting_id, seg_idx * 3 AS seg_idx, start, start + 0.5 AS "end",
         array_to_string(toks[1:3], ' ') AS text, speaker, source FROM echo_parts
  UNION ALL
  SELECT meeting_id, seg_idx * 3 + 1, start, "end", text, speaker, source FROM echo_parts
  UNION ALL
  SELECT meeting_id, seg_idx * 3 + 2, "end" + 0.01, "end" + 0.81,
         array_to_string(toks[1:((len(toks) * 7 + 9) // 10)], ' ') || repeat(' evet', CAST(seg_idx AS INT)), speaker, source
  FROM echo_parts)
"""
)

WORDS_SQL = r"list_filter(string_split(regexp_replace(lower(translate({0}, 'Iİ', 'ıi')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def sql_words(column: str) -> str:
    return WORDS_SQL.format(column)


SPACE_SQL = X.SPACE


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def sql_squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE_SQL}+', ' ', 'g'))"


# --- events as recordings ------------------------------------------------------------------------

RECORDING = 1024  # events per recording


def day_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a day as segments: start is the time of day, length the value in minutes."""
    return _day_spans(spark, sf_dir, ("view", "click")).select(
        "meeting_id",
        F.col("event_id").alias("seg_idx"),
        "start",
        "end",
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("speaker"),
        F.lit(None).cast("string").alias("source"),
        F.lit(False).alias("duplicate"),
        F.lit(False).alias("overlap"),
    )


def day_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sign-ups of a day as speaker turns."""
    spans = _day_spans(spark, sf_dir, ("purchase", "signup"))
    speaker = F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"))
    return spans.select("meeting_id", F.col("event_id").alias("turn_idx"), "start", "end", speaker.alias("speaker"))


def _day_spans(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*kinds))
    start = (F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))) / 1e6
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("meeting_id"),
        "event_id",
        "user_id",
        start.alias("start"),
        (start + F.floor(F.col("value") * 60)).alias("end"),
    )


DAY_SQL = """
spans AS (
  SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, event_id, user_id, event_type,
         epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS s,
         epoch_us(ts) - epoch_us(date_trunc('day', ts)) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e
  FROM events)
"""


def frames(spark: SparkSession, sf_dir: str, recording: int = RECORDING) -> DataFrame:
    """Events as energy frames, 1024 to a recording; the type of an event picks its channel."""
    rms = (F.col("value") / 100).cast("float")
    quiet = F.lit(0.001).cast("float")
    on = lambda *kinds: F.when(F.col("event_type").isin(*kinds), rms).otherwise(quiet)
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / recording).alias("meeting_id"),
        (F.col("event_id") % recording).alias("frame"),
        on("view", "click").alias("mic"),
        on("purchase", "signup").alias("system"),
    )


def side_segments(spark: SparkSession, sf_dir: str, recording: int = RECORDING) -> DataFrame:
    """Error events as the segments of those recordings; they last a quarter of their value in frames."""
    start = (F.col("event_id") % recording) * 0.016
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        F.floor(F.col("event_id") / recording).alias("meeting_id"),
        F.col("event_id").alias("seg_idx"),
        start.alias("start"),
        (start + F.col("value") * 0.004).alias("end"),
        F.lit("").alias("text"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("speaker"),
        F.lit(None).cast("string").alias("source"),
        F.lit(False).alias("duplicate"),
        F.lit(False).alias("overlap"),
    )


FRAMES_SQL = f"""
frames AS (
  SELECT event_id // {RECORDING} AS meeting_id, event_id % {RECORDING} AS frame,
    CAST(CASE WHEN event_type IN ('view', 'click') THEN value / 100 ELSE 0.001 END AS FLOAT) AS mic,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN value / 100 ELSE 0.001 END AS FLOAT) AS system FROM events),
side_segments AS (
  SELECT event_id // {RECORDING} AS meeting_id, event_id AS seg_idx, CAST(event_id % {RECORDING} AS DOUBLE) * CAST(0.016 AS DOUBLE) AS start,
    CAST(event_id % {RECORDING} AS DOUBLE) * CAST(0.016 AS DOUBLE) + value * CAST(0.004 AS DOUBLE) AS "end",
    'S' || (user_id % 5) AS speaker FROM events WHERE event_type = 'error')
"""

TAPE = 65_536  # samples per tape


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as sound samples; the second and third week of a month are a hundred times louder."""
    loud = F.dayofmonth("ts").between(8, 22)
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / TAPE).alias("meeting_id"),
        (F.col("event_id") % TAPE).alias("sample_idx"),
        F.when(loud, F.col("value") / 100).otherwise(F.col("value") / 10000).cast("float").alias("value"),
    )


SAMPLES_SQL = f"""
samples AS (
  SELECT event_id // {TAPE} AS meeting_id, event_id % {TAPE} AS sample_idx,
    CAST(CASE WHEN day(ts) BETWEEN 8 AND 22 THEN value / 100 ELSE value / 10000 END AS FLOAT) AS value FROM events)
"""


# --- embeddings as voice windows -----------------------------------------------------------------


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as overlapping voice windows of five meetings."""
    w = F.floor(F.col("vec_id") / 5)
    return read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).alias("meeting_id"),
        w.cast("int").alias("w_idx"),
        (w * 0.75).alias("mask_start"),
        (w * 0.75 + 1.5).alias("mask_end"),
        "label",
        "embedding",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of those meetings: eight windows to a region, with a short gap behind it."""
    w = windows(spark, sf_dir)
    spans = w.groupBy("meeting_id", F.floor(F.col("w_idx") / 8)).agg(F.min("mask_start").alias("start"), F.max("mask_end").alias("_end"))
    return spans.select("meeting_id", "start", (F.col("_end") - 0.9).alias("end"))


def usable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that have a voice; label 0 stands for a window without one."""
    return windows(spark, sf_dir).filter(F.col("label") != 0)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).groupBy("meeting_id").agg(F.max("mask_end").alias("duration"))


WINDOWS_SQL = """
windows AS (
  SELECT vec_id % 5 AS meeting_id, CAST(vec_id // 5 AS INT) AS w_idx, CAST(vec_id // 5 AS DOUBLE) * 0.75 AS mask_start,
    CAST(vec_id // 5 AS DOUBLE) * 0.75 + 1.5 AS mask_end, label, embedding FROM embeddings),
regions AS (SELECT meeting_id, min(mask_start) AS start, max(mask_end) - CAST(0.9 AS DOUBLE) AS "end" FROM windows GROUP BY meeting_id, w_idx // 8),
usable AS (SELECT * FROM windows WHERE label <> 0),
speech AS (
  SELECT DISTINCT meeting_id, unnest(generate_series(CAST(floor(start / CAST(0.05 AS DOUBLE)) AS BIGINT), CAST(ceil("end" / CAST(0.05 AS DOUBLE)) AS BIGINT) - 1)) AS frame
  FROM regions),
votes AS (
  SELECT meeting_id, label, unnest(generate_series(CAST(floor(mask_start / CAST(0.05 AS DOUBLE)) AS BIGINT), CAST(ceil(mask_end / CAST(0.05 AS DOUBLE)) AS BIGINT) - 1)) AS frame
  FROM usable),
counted AS (SELECT meeting_id, frame, label, count(*) AS n FROM votes GROUP BY ALL),
voted AS (SELECT meeting_id, frame, label FROM counted QUALIFY row_number() OVER (PARTITION BY meeting_id, frame ORDER BY n DESC, label) = 1),
nearest AS (
  SELECT s.meeting_id, s.frame, u.label
  FROM speech s LEFT JOIN voted v USING (meeting_id, frame) JOIN usable u ON u.meeting_id = s.meeting_id
  WHERE v.label IS NULL
  QUALIFY row_number() OVER (PARTITION BY s.meeting_id, s.frame
    ORDER BY abs((s.frame * 2 + 1) * CAST(0.025 AS DOUBLE) - (u.mask_start + u.mask_end) / 2), u.w_idx) = 1),
assigned AS (
  SELECT s.meeting_id, s.frame, coalesce(v.label, n.label) AS label
  FROM speech s LEFT JOIN voted v USING (meeting_id, frame) LEFT JOIN nearest n USING (meeting_id, frame)),
opened AS (
  SELECT *, CASE WHEN lag(frame) OVER w = frame - 1 AND lag(label) OVER w = label THEN 0 ELSE 1 END AS opens
  FROM assigned WINDOW w AS (PARTITION BY meeting_id ORDER BY frame)),
ran AS (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY frame) AS run FROM opened),
turns AS (SELECT meeting_id, min(frame) AS lo, max(frame) + 1 AS hi, min(label) AS label FROM ran GROUP BY meeting_id, run HAVING count(*) >= 5)
"""


# --- conversations as an archive -----------------------------------------------------------------

COPY = 100_000_000  # distance between a meeting's number and its copy's


def meeting_key(n):
    """Meeting number n as an id: n minutes after the start of 2026."""
    return X.timestamp_to_id(F.timestamp_seconds(F.lit(1_767_225_600) + n * 60))


def archive(spark: SparkSession, sf_dir: str):
    """One meeting per conversation.

    Every fourth has an edited copy, some copies point elsewhere, some lack a transcript; some
    analyses are missing or unfinished.
    """
    from talkframe.operators.archive import Archive

    turns = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "c")
    numbers = turns.select("c").distinct()
    none = F.lit(None).cast("string")
    fourth, twelfth, fifth = F.col("c") % 4 == 0, F.col("c") % 12 == 0, F.col("c") % 5 == 0
    first = numbers.select(
        meeting_key(F.col("c")).alias("id"),
        F.when(fifth, F.concat(F.lit("Meeting "), F.col("c").cast("string"))).alias("name"),
        none.alias("original_id"),
        F.when(fourth, meeting_key(F.col("c") + COPY)).alias("edited_id"),
    )
    copies = numbers.filter(fourth).select(
        meeting_key(F.col("c") + COPY).alias("id"),
        none.alias("name"),
        F.when(twelfth, meeting_key(F.col("c") + 1)).otherwise(meeting_key(F.col("c"))).alias("original_id"),
        none.alias("edited_id"),
    )
    rows = turns.select(
        "c",
        F.col("turn").alias("seg_idx"),
        F.col("turn").cast("double").alias("start"),
        (F.col("turn") + 1).cast("double").alias("end"),
        "text",
        F.concat(F.lit("SPEAKER_"), F.when(F.col("role") == "user", "1").otherwise("10")).alias("speaker"),
        none.alias("source"),
        F.lit(False).alias("duplicate"),
        F.lit(False).alias("overlap"),
    )
    kept = rows.filter(fourth & (F.col("c") % 16 != 0)).withColumn("c", F.col("c") + COPY)
    segs = rows.unionByName(kept).withColumn("meeting_id", meeting_key(F.col("c"))).drop("c")
    note = F.concat(F.lit("SPEAKER_1: "), F.col("c").cast("string"), F.lit(" SPEAKER_10, SPEAKER_1"))
    own = numbers.filter((F.col("c") % 3 != 0) | fourth).select(
        meeting_key(F.col("c")).alias("meeting_id"), F.when(F.col("c") % 3 != 0, note).alias("markdown"), (F.col("c") % 7 == 0).alias("speakers_degraded")
    )
    edited = numbers.filter(fourth).select(meeting_key(F.col("c") + COPY).alias("meeting_id"), note.alias("markdown"), F.lit(False).alias("speakers_degraded"))
    return Archive(first.unionByName(copies), segs, own.unionByName(edited))


def key_sql(n: str) -> str:
    return f"strftime(TIMESTAMP '2026-01-01' + to_minutes({n}), '%Y-%m-%dT%H-%M-%S-000Z')"


ARCHIVE_SQL = f"""
numbers AS (SELECT DISTINCT conv_id AS c FROM conversations),
meetings AS (
  SELECT c, {key_sql('c')} AS id, CASE WHEN c % 5 = 0 THEN 'Meeting ' || c END AS name, CAST(NULL AS VARCHAR) AS original_id,
    CASE WHEN c % 4 = 0 THEN {key_sql(f'c + {COPY}')} END AS edited_id FROM numbers
  UNION ALL
  SELECT c + {COPY}, {key_sql(f'c + {COPY}')}, NULL, CASE WHEN c % 12 = 0 THEN {key_sql('c + 1')} ELSE {key_sql('c')} END, NULL FROM numbers WHERE c % 4 = 0),
segs AS (
  SELECT {key_sql('conv_id')} AS meeting_id, turn AS seg_idx, text, CASE WHEN role = 'user' THEN 'SPEAKER_1' ELSE 'SPEAKER_10' END AS speaker FROM conversations
  UNION ALL
  SELECT {key_sql(f'conv_id + {COPY}')}, turn, text, CASE WHEN role = 'user' THEN 'SPEAKER_1' ELSE 'SPEAKER_10' END FROM conversations WHERE conv_id % 4 = 0 AND conv_id % 16 <> 0),
analyses AS (
  SELECT {key_sql('c')} AS meeting_id, CASE WHEN c % 3 <> 0 THEN 'SPEAKER_1: ' || c || ' SPEAKER_10, SPEAKER_1' END AS markdown, c % 7 = 0 AS speakers_degraded
  FROM numbers WHERE c % 3 <> 0 OR c % 4 = 0
  UNION ALL SELECT {key_sql(f'c + {COPY}')}, 'SPEAKER_1: ' || c || ' SPEAKER_10, SPEAKER_1', false FROM numbers WHERE c % 4 = 0),
has_text AS (SELECT DISTINCT meeting_id AS id FROM segs),
versions AS (
  SELECT m.id, coalesce(m.original_id, m.id) AS original, coalesce(e.id, coalesce(m.original_id, m.id)) AS active
  FROM meetings m LEFT JOIN meetings o ON o.id = coalesce(m.original_id, m.id)
  LEFT JOIN meetings e ON e.id = o.edited_id AND e.original_id = o.id AND e.id IN (SELECT id FROM has_text))
"""
