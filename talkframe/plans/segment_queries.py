"""Queries over segments: repeats, dialogue, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import segments as S
from talkframe.plans import tables as T
from talkframe.plans.blocks import BLOCK_ROWS
from talkframe.plans.registry import query
from talkframe.session import cut
from talkframe.sources.scripts import script_segments

SEG = "WITH " + T.SEGMENTS_SQL
ECHO = "WITH " + T.ECHO_SQL


@query("timed_segments", SEG + 'SELECT meeting_id, seg_idx, start, "end" AS finish, speaker FROM segments')
def timed_segments(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).select("meeting_id", "seg_idx", "start", F.col("end").alias("finish"), "speaker")


@query(
    "script_segments",
    rf"""
WITH lines AS (
  SELECT doc_id AS meeting_id, unnest(string_split_regex(text, '\r?\n')) AS raw,
         generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM documents),
said AS (SELECT meeting_id, pos, {T.sql_strip('raw')} AS text FROM lines),
kept AS (SELECT *, greatest(80, CAST(floor(CAST(length(text) AS DOUBLE) / 14 * 100 + 0.5) AS BIGINT)) AS cs FROM said WHERE text <> '')
SELECT meeting_id, row_number() OVER w - 1 AS seg_idx, text,
       CAST(sum(cs) OVER w - cs AS DOUBLE) / 100 AS start, CAST(sum(cs) OVER w AS DOUBLE) / 100 AS finish
FROM kept WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)""",
)
def scripts(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.texts(spark, sf).select(F.col("doc_id").alias("meeting_id"), "text")
    return script_segments(docs).select("meeting_id", "seg_idx", "text", "start", F.col("end").alias("finish"))


REPEATS_SQL = (
    ECHO
    + f""",
tok AS (SELECT meeting_id, seg_idx, start, "end", text, {T.sql_words('text')} AS w FROM echoed),
pos AS (SELECT meeting_id, seg_idx, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM tok),
win AS (
  SELECT c.meeting_id, c.seg_idx, q.word,
         q.p + CASE WHEN q.seg_idx = c.seg_idx - 1 THEN coalesce(len(b.w), 0) ELSE 0 END AS p
  FROM tok c JOIN pos q ON q.meeting_id = c.meeting_id AND q.seg_idx IN (c.seg_idx - 1, c.seg_idx - 2)
  LEFT JOIN tok b ON b.meeting_id = c.meeting_id AND b.seg_idx = c.seg_idx - 2),
hits AS (
  SELECT a.meeting_id, a.seg_idx, a.p, b.p - a.p AS diagonal
  FROM pos a JOIN win b ON a.meeting_id = b.meeting_id AND a.seg_idx = b.seg_idx AND a.word = b.word),
runs AS (
  SELECT meeting_id, seg_idx, diagonal, p - row_number() OVER (PARTITION BY meeting_id, seg_idx, diagonal ORDER BY p) AS island FROM hits),
best AS (
  SELECT meeting_id, seg_idx, max(n) AS run FROM
    (SELECT meeting_id, seg_idx, count(*) AS n FROM runs GROUP BY meeting_id, seg_idx, diagonal, island) GROUP BY ALL),
repeats AS (
  SELECT t.meeting_id, t.seg_idx, len(t.w) >= 4 AND
     (coalesce(run, 0) / len(t.w) >= 0.8 OR
      (coalesce(run, 0) / len(t.w) >= 0.6 AND t."end" > t.start AND length({T.sql_strip('t.text')}) / (t."end" - t.start) > 25)) AS duplicate
  FROM tok t LEFT JOIN best USING (meeting_id, seg_idx))
"""
)


@query("repeat_flags", REPEATS_SQL + "SELECT meeting_id, seg_idx, duplicate FROM repeats")
def repeat_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.flag_repeats(T.echoed_segments(spark, sf)).select("meeting_id", "seg_idx", "duplicate")


ORPHANS_SQL = (
    REPEATS_SQL
    + """,
kept AS (
  SELECT t.*, lead(t.start) OVER w AS ns, lead(t."end") OVER w AS ne, lead(t.w) OVER w AS nw
  FROM tok t JOIN repeats r USING (meeting_id, seg_idx) WHERE NOT r.duplicate
  WINDOW w AS (PARTITION BY t.meeting_id ORDER BY t.seg_idx)),
orphans AS (
  SELECT meeting_id, seg_idx FROM kept
  WHERE start < ne AND ns < "end" AND len(w) > 0 AND len(nw) > len(w) AND nw[1:len(w)] = w),
flagged AS (
  SELECT r.meeting_id, r.seg_idx, r.duplicate OR o.seg_idx IS NOT NULL AS duplicate
  FROM repeats r LEFT JOIN orphans o USING (meeting_id, seg_idx))
"""
)


@query("orphan_flags", ORPHANS_SQL + "SELECT meeting_id, seg_idx, duplicate FROM flagged")
def orphan_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.flag_orphans(S.flag_repeats(T.echoed_segments(spark, sf))).select("meeting_id", "seg_idx", "duplicate")


@query(
    "seam_flags",
    SEG + 'SELECT meeting_id, seg_idx, start + 6.5 AS start, "end" <= 20 + 0.25 AS duplicate FROM (SELECT meeting_id, seg_idx, start, "end" + 6.5 AS "end" FROM segments)',
)
def seam_flags(spark: SparkSession, sf: str) -> DataFrame:
    moved = S.shift(T.segments(spark, sf), F.lit(6.5))
    return S.flag_seam(moved, F.lit(20.0)).select("meeting_id", "seg_idx", "start", "duplicate")


@query(
    "active_segments",
    ORPHANS_SQL + f"SELECT meeting_id, count(*) AS kept FROM flagged JOIN tok USING (meeting_id, seg_idx) WHERE NOT duplicate AND {T.sql_strip('text')} <> '' GROUP BY ALL",
)
def active_segments(spark: SparkSession, sf: str) -> DataFrame:
    flagged = S.flag_orphans(S.flag_repeats(T.echoed_segments(spark, sf)))
    return S.active(flagged).groupBy("meeting_id").agg(F.count("*").alias("kept"))


def dialogue_sql(label: str, source: str = "segments") -> str:
    return f""",
labelled AS (SELECT meeting_id, seg_idx, {T.sql_strip('text')} AS text, {label} AS label FROM {source}),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS opens
  FROM labelled WHERE text <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx)),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS BIGINT) - 1 AS line_idx FROM marked)
SELECT meeting_id, line_idx, seg_idx // {BLOCK_ROWS} AS part, max(label) AS label,
       {T.sql_squeeze("string_agg(text, ' ' ORDER BY seg_idx)")} AS text
FROM numbered GROUP BY meeting_id, line_idx, seg_idx // {BLOCK_ROWS}"""


@query("speaker_dialogue", SEG + dialogue_sql("speaker"))
def speaker_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return S.dialogue(T.segments(spark, sf))


SIDE_SQL = (
    "CASE WHEN max(CASE WHEN source IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id) = 0 THEN NULL "
    "WHEN source = 'local' THEN 'Yerel Konuşmacı' WHEN source = 'remote' THEN 'Uzak Konuşmacı' ELSE 'Belirsiz' END"
)


@query("side_dialogue", SEG + dialogue_sql(SIDE_SQL))
def side_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return S.side_dialogue(T.segments(spark, sf))


FULL_LABEL_SQL = "CASE source WHEN 'local' THEN speaker || ' (Yerel)' WHEN 'remote' THEN speaker || ' (Uzak)' ELSE speaker END"


@query("transcript_dialogue", SEG + dialogue_sql(FULL_LABEL_SQL))
def transcript_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    return S.transcript_lines(T.segments(spark, sf))


@query(
    "analysis_text",
    SEG
    + ", scoped AS (SELECT *, max(CASE WHEN speaker = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id) = 0 AS two_party FROM segments)"
    + dialogue_sql(f"CASE WHEN two_party THEN {SIDE_SQL} END", "scoped"),
)
def analysis_text(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings without a system voice are declared two-party, the others are plain prose."""
    segs = T.segments(spark, sf)
    scope = segs.groupBy("meeting_id").agg((~F.bool_or(F.col("speaker") == "system")).alias("_two"))
    return S.analysis_lines(segs.join(scope, "meeting_id"), False, F.col("_two"))


@query(
    "reanalysis_input",
    SEG
    + """SELECT meeting_id, seg_idx, CASE WHEN max(CASE WHEN speaker = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id) = 0
         THEN speaker END AS speaker FROM segments""",
)
def reanalysis_input(spark: SparkSession, sf: str) -> DataFrame:
    segs = T.segments(spark, sf)
    scope = segs.groupBy("meeting_id").agg(F.when(F.bool_or(F.col("speaker") == "system"), "group").otherwise("two-party").alias("scope"))
    return S.reanalysis_segments(segs.join(scope, "meeting_id"), False, X.check_scope(F.col("scope"))).select("meeting_id", "seg_idx", "speaker")


CLOCK = "lpad(CAST(CAST(floor({0} + 0.5) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0} + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query(
    "readable_lines",
    ORPHANS_SQL
    + f"""SELECT e.meeting_id, e.seg_idx, '[' || {CLOCK.format('e.start')} || '-' || {CLOCK.format('e."end"')} || '] ' || e.speaker || ': '
      || {T.sql_strip('e.text')} || CASE WHEN f.duplicate THEN '   [DUP]' ELSE '' END AS line
    FROM echoed e JOIN flagged f USING (meeting_id, seg_idx)""",
)
def readable_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.readable_lines(S.flag_orphans(S.flag_repeats(T.echoed_segments(spark, sf))))


@query(
    "speaker_shares",
    SEG
    + """, per AS (SELECT meeting_id, speaker, count(*) AS segments, sum(end_cs - start_cs) AS cs, min(seg_idx) AS first FROM segments GROUP BY ALL)
    SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY first) AS appearance, segments,
      floor(CAST(cs AS DOUBLE) / 10 + 0.5) / 10 AS seconds,
      floor(CAST(cs AS DOUBLE) / CAST(sum(cs) OVER (PARTITION BY meeting_id) AS DOUBLE) * 1000 + 0.5) / 1000 AS share FROM per""",
)
def speaker_shares(spark: SparkSession, sf: str) -> DataFrame:
    return S.speaker_shares(T.segments(spark, sf))


REPORT_SQL = (
    ORPHANS_SQL
    + """,
named AS (SELECT e.meeting_id, e.seg_idx, CASE WHEN f.duplicate THEN NULL ELSE e.speaker END AS speaker,
    greatest(CAST(floor(e."end" * 1e6 + 0.5) AS BIGINT) - CAST(floor(e.start * 1e6 + 0.5) AS BIGINT), 0) AS us, f.duplicate AS overlap
  FROM echoed e JOIN flagged f USING (meeting_id, seg_idx)),
turned AS (SELECT meeting_id, count(*) AS turns FROM (SELECT meeting_id, speaker, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS p
    FROM named WHERE speaker IS NOT NULL) WHERE p IS NULL OR p <> speaker GROUP BY ALL)
SELECT n.meeting_id, count(DISTINCT speaker) AS speaker_count, coalesce(max(t.turns), 0) AS turns, greatest(coalesce(max(t.turns), 0) - 1, 0) AS switches,
  count(*) FILTER (WHERE speaker IS NULL) AS unlabeled,
  floor(CAST(coalesce(sum(us) FILTER (WHERE speaker IS NULL), 0) AS DOUBLE) / 1e6 * 10 + 0.5) / 10 AS unlabeled_seconds,
  count(*) FILTER (WHERE overlap) AS overlap_flags,
  floor(CAST(coalesce(sum(us) FILTER (WHERE speaker IS NOT NULL), 0) AS DOUBLE) / 1e6 * 10 + 0.5) / 10 AS labeled_seconds
FROM named n LEFT JOIN turned t USING (meeting_id) GROUP BY n.meeting_id"""
)


def flagged_echo(spark: SparkSession, sf: str) -> DataFrame:
    """Echoed segments after both repeat passes; repeats lose their speaker and count as overlap."""
    flagged = cut(S.flag_orphans(cut(S.flag_repeats(T.echoed_segments(spark, sf)))))
    return flagged.withColumn("speaker", F.when(~F.col("duplicate"), F.col("speaker"))).withColumn("overlap", F.col("duplicate"))


@query("speaker_report", REPORT_SQL)
def speaker_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.speaker_report(flagged_echo(spark, sf))


@query(
    "expected_speakers",
    SEG
    + """, found AS (SELECT meeting_id, count(DISTINCT speaker) AS speaker_count FROM segments GROUP BY ALL),
    expected AS (SELECT conv_id AS meeting_id, CASE WHEN max(turn) > 1 THEN 2 END AS n FROM conversations GROUP BY ALL)
    SELECT meeting_id, speaker_count, CASE WHEN n IS NULL THEN 'unknown' WHEN n = speaker_count THEN 'ok' ELSE 'differs' END AS verdict
    FROM found LEFT JOIN expected USING (meeting_id)""",
)
def expected_speakers(spark: SparkSession, sf: str) -> DataFrame:
    turns = T.read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("meeting_id"))
    expected = turns.agg(F.when(F.max("turn") > 1, 2).alias("n"))
    report = S.speaker_report(T.segments(spark, sf))
    return S.expected_speakers(report, expected, "meeting_id").select("meeting_id", "speaker_count", "verdict")


@query(
    "flag_counts",
    ORPHANS_SQL + "SELECT meeting_id, count(*) FILTER (WHERE duplicate) AS duplicate_flags, count(*) FILTER (WHERE duplicate) AS overlap_flags FROM flagged GROUP BY ALL",
)
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.flag_counts(flagged_echo(spark, sf))


@query(
    "timestamp_quality",
    SEG
    + """, edges AS (SELECT meeting_id, start AS b FROM segments UNION ALL SELECT meeting_id, "end" FROM segments)
    SELECT meeting_id, count(b) AS boundaries, count(*) FILTER (WHERE b <> floor(b)) AS decimal,
      count(b) - count(*) FILTER (WHERE b <> floor(b)) AS integer_stuck, count(*) FILTER (WHERE b <> floor(b)) / count(b) AS decimal_ratio
    FROM edges GROUP BY ALL""",
)
def timestamp_quality(spark: SparkSession, sf: str) -> DataFrame:
    return S.timestamp_quality(T.segments(spark, sf))


@query(
    "speech_rate",
    SEG + f'SELECT meeting_id, seg_idx, length({T.sql_strip("text")}) / ("end" - start) AS rate FROM segments',
)
def speech_rate(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).select(
        "meeting_id", "seg_idx", X.chars_per_second(F.col("text"), F.col("start"), F.col("end")).alias("rate")
    )


@query(
    "decoding_windows",
    SEG
    + """SELECT meeting_id, seg_idx, unnest(generate_series(greatest(CAST(floor((start - 30) / 20) AS BIGINT) + 1, 0), CAST(floor(start / 20) AS BIGINT))) AS "window",
       CAST(floor(start / 8) AS BIGINT) AS slice FROM segments""",
)
def decoding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.emission_slices(S.long_form_windows(T.segments(spark, sf))).select("meeting_id", "seg_idx", "window", "slice")


@query(
    "word_tokens",
    f"""SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({T.sql_words('text')}) AS word FROM documents) GROUP BY word""",
)
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.texts(spark, sf).select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    per_doc = tokens.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("docs"))
