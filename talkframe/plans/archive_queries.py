"""Queries over the archive, speaker names, runs and private data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import archive as R
from talkframe.operators import privacy, quality, runs, segments, speakers
from talkframe.plans import tables as T
from talkframe.plans.blocks import scan, with_block
from talkframe.plans.registry import query
from talkframe.plans.segment_queries import dialogue_sql
from talkframe.session import cut, run_folder, widen
from talkframe.sources import corpus
from talkframe.sources import meeting_files as meeting_store
from talkframe.sources import runs as run_files
from talkframe.sources.meetings import markdown_lines

ARC = "WITH " + T.ARCHIVE_SQL
LIST_SQL = (
    ARC
    + """, listed AS (SELECT m.id, strptime(m.id, '%Y-%m-%dT%H-%M-%S-000Z') AS created, v.active,
      coalesce(m.name, strftime(strptime(m.id, '%Y-%m-%dT%H-%M-%S-000Z'), '%d.%m.%Y %H:%M')) AS name, v.active <> m.id AS has_edited,
      CASE WHEN a.markdown IS NOT NULL THEN 'done' ELSE 'transcript-only' END AS status, a.markdown, coalesce(a.speakers_degraded, false) AS speakers_degraded
    FROM meetings m JOIN versions v USING (id) LEFT JOIN analyses a ON a.meeting_id = v.active
    WHERE m.original_id IS NULL AND m.id IN (SELECT id FROM has_text))
    """
)


@query("active_versions", ARC + "SELECT id, original, active FROM versions")
def active_versions(spark: SparkSession, sf: str) -> DataFrame:
    return R.active_versions(T.archive(spark, sf))


@query("meeting_list", LIST_SQL + "SELECT id, created, name, has_edited, status FROM listed ORDER BY created DESC, id")
def meeting_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = R.newest_first(R.meeting_list(T.archive(spark, sf)))
    return listed.withColumn("created", F.col("created").cast("timestamp_ntz"))


@query(
    "meeting_details",
    LIST_SQL
    + "SELECT id, active, name, has_edited, markdown, speakers_degraded, true AS has_original_speakers, CASE WHEN extract(minute FROM created) < 30 THEN 'two-party' ELSE 'group' END AS meeting_scope FROM listed",
)
def meeting_details(spark: SparkSession, sf: str) -> DataFrame:
    arc = T.archive(spark, sf)
    scopes = arc.meetings.filter(F.minute(X.id_to_timestamp(F.col("id"))) < 30).select(F.col("id").alias("meeting_id"), F.lit("two-party").alias("meeting_scope"))
    return R.meeting_details(arc, scopes).drop("created")


@query(
    "display_names",
    ARC
    + """SELECT m.id, coalesce(o.name, strftime(strptime(v.original, '%Y-%m-%dT%H-%M-%S-000Z'), '%d.%m.%Y %H:%M')) || CASE WHEN m.original_id IS NOT NULL THEN ' (Edited)' ELSE '' END AS name
    FROM meetings m JOIN versions v USING (id) LEFT JOIN meetings o ON o.id = v.original""",
)
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    return R.display_names(T.archive(spark, sf))


@query(
    "id_timestamps",
    ARC + "SELECT id, strptime(id, '%Y-%m-%dT%H-%M-%S-000Z') AS created FROM meetings",
)
def id_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return T.archive(spark, sf).meetings.select("id", X.id_to_timestamp(F.col("id")).cast("timestamp_ntz").alias("created"))


@query(
    "saved_order",
    ARC
    + """SELECT id, row_number() OVER (ORDER BY c IN (SELECT conv_id FROM conversations WHERE role = 'system'),
      CASE WHEN c IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN c END, c DESC) AS place FROM meetings WHERE original_id IS NULL""",
)
def saved_order(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings with a system voice have a saved place; the place of all is told by how many sort before it."""
    turns = T.read(spark, sf, "conversations")
    numbers = turns.select("conv_id").distinct()
    placed = turns.filter(F.col("role") == "system").select("conv_id").distinct()
    meetings = numbers.select(T.meeting_key(F.col("conv_id")).alias("id"), (-F.col("conv_id")).alias("pos"))
    saved = placed.select(T.meeting_key(F.col("conv_id")).alias("id"), F.col("conv_id").alias("saved_pos"))
    ordered = R.saved_order(meetings, saved)
    # Places are counted over ranks that each half of the order knows by itself.
    keyed = ordered.withColumn("_one", F.lit(1)).withColumn("_rank", F.coalesce(F.col("saved_pos") + 10**12, F.col("pos") + 10**9))
    counted = scan(with_block(keyed, "_rank"), ["_one"], ["_rank"], {"place": ("sum", F.lit(1))})
    return counted.select("id", "place")


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests for every meeting with a system voice, of which the later counts."""
    turns = T.read(spark, sf, "conversations").filter(F.col("role") == "system")
    numbers = turns.select(F.col("conv_id").alias("c")).distinct()
    each = numbers.withColumn("op_idx", F.explode(F.array(F.lit(1), F.lit(2))))
    return each.select(
        T.meeting_key(F.col("c")).alias("id"),
        T.meeting_key(F.col("c") + 2 * T.COPY).alias("new_id"),
        F.concat(F.lit("edit "), F.col("op_idx").cast("string")).alias("markdown"),
        F.concat(F.lit(" renamed "), F.col("op_idx").cast("string")).alias("name"),
        "op_idx",
    )


NEW = T.key_sql(f"c + {2 * T.COPY}")
TARGETS_SQL = (
    ARC
    + f""", asked AS (SELECT c, id FROM meetings WHERE original_id IS NULL AND c IN (SELECT conv_id FROM conversations WHERE role = 'system')),
    targets AS (SELECT a.c, a.id, coalesce(m.edited_id, {NEW.replace('c +', 'a.c +')}) AS target, m.edited_id IS NULL AS fresh FROM asked a JOIN meetings m USING (id))
    """
)


@query("edit_targets", TARGETS_SQL + "SELECT id, target, fresh FROM targets")
def edit_targets(spark: SparkSession, sf: str) -> DataFrame:
    return R.edit_targets(T.archive(spark, sf), R.latest(edits(spark, sf)).select("id", "new_id"))


def summary(arc: R.Archive) -> DataFrame:
    """An archive in one table: links, number of segments, speakers and analysis per meeting."""
    counts = arc.segments.groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias("segments"), F.min("speaker").alias("speaker"))
    notes = arc.analyses.select(F.col("meeting_id").alias("id"), "markdown")
    return arc.meetings.join(counts, "id", "left").join(notes, "id", "left")


SUMMARY_SQL = """SELECT m.id, m.name, m.original_id, m.edited_id, c.segments, c.speaker, a.markdown FROM {meetings} m
  LEFT JOIN (SELECT meeting_id, count(*) AS segments, min(speaker) AS speaker FROM {segs} GROUP BY ALL) c ON c.meeting_id = m.id
  LEFT JOIN {analyses} a ON a.meeting_id = m.id"""
COPIED_SQL = (
    TARGETS_SQL
    + """, m2 AS (SELECT m.id, m.name, m.original_id, coalesce(t.target, m.edited_id) AS edited_id FROM meetings m LEFT JOIN targets t ON t.id = m.id AND t.fresh
      UNION ALL SELECT target, NULL, id, NULL FROM targets WHERE fresh),
    s2 AS (SELECT meeting_id, seg_idx, speaker FROM segs UNION ALL SELECT t.target, seg_idx, speaker FROM segs JOIN targets t ON t.id = meeting_id AND t.fresh),
    a2 AS (SELECT meeting_id, markdown FROM analyses UNION ALL SELECT t.target, markdown FROM analyses JOIN targets t ON t.id = meeting_id AND t.fresh)
    """
)


@query(
    "saved_analyses",
    COPIED_SQL
    + """, a3 AS (SELECT coalesce(a.meeting_id, t.target) AS meeting_id, CASE WHEN t.target IS NOT NULL THEN 'edit 2' ELSE a.markdown END AS markdown
      FROM a2 a FULL JOIN targets t ON t.target = a.meeting_id) """
    + SUMMARY_SQL.format(meetings="m2", segs="s2", analyses="a3"),
)
def saved_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return summary(R.save_analyses(T.archive(spark, sf), edits(spark, sf).drop("name")))


@query(
    "named_speakers",
    COPIED_SQL
    + """, s3 AS (SELECT meeting_id, CASE WHEN t.target IS NULL THEN speaker WHEN speaker = 'SPEAKER_1' THEN 'SPEAKER_X' ELSE 'Ada' END AS speaker FROM s2 LEFT JOIN targets t ON t.target = meeting_id),
    a3 AS (SELECT meeting_id, CASE WHEN t.target IS NULL THEN markdown
        ELSE replace(replace(replace(markdown, 'SPEAKER_10', 'Ada'), 'SPEAKER_1', 'SPEAKER_X'), chr(1), '') END AS markdown FROM a2 LEFT JOIN targets t ON t.target = meeting_id) """
    + SUMMARY_SQL.format(meetings="m2", segs="s3", analyses="a3"),
)
def named_speakers(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.explode(F.create_map(F.lit("SPEAKER_1"), F.lit("SPEAKER_X"), F.lit("SPEAKER_10"), F.lit(" Ada ")))
    entries = R.latest(edits(spark, sf)).select("id", "new_id", wanted.alias("label", "name"))
    return summary(R.name_speakers(T.archive(spark, sf), entries))


@query(
    "renamed_meetings",
    ARC
    + ", m2 AS (SELECT id, CASE WHEN original_id IS NULL AND c IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 'renamed 2' ELSE name END AS name, original_id, edited_id FROM meetings) "
    + SUMMARY_SQL.format(meetings="m2", segs="segs", analyses="analyses"),
)
def renamed_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return summary(R.rename_meetings(T.archive(spark, sf), edits(spark, sf).select("id", "name", "op_idx")))


@query(
    "deleted_meetings",
    ARC
    + """, gone AS (SELECT id FROM meetings WHERE original_id IS NULL AND c IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION SELECT edited_id FROM meetings WHERE original_id IS NULL AND c IN (SELECT conv_id FROM conversations WHERE role = 'system') AND edited_id IS NOT NULL),
    m2 AS (SELECT * FROM meetings WHERE id NOT IN (SELECT id FROM gone)) """
    + SUMMARY_SQL.format(meetings="m2", segs="segs", analyses="analyses"),
)
def deleted_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return summary(R.delete_meetings(T.archive(spark, sf), edits(spark, sf)))


REVERTED_SQL = """, gone AS (SELECT DISTINCT o.edited_id AS id FROM meetings o WHERE o.original_id IS NULL AND o.c IN (SELECT conv_id FROM conversations WHERE role = 'system') AND o.edited_id IS NOT NULL),
    m2 AS (SELECT id, name, original_id, CASE WHEN edited_id IN (SELECT id FROM gone) THEN NULL ELSE edited_id END AS edited_id FROM meetings WHERE id NOT IN (SELECT id FROM gone)) """


@query("reverted_edits", ARC + REVERTED_SQL + SUMMARY_SQL.format(meetings="m2", segs="segs", analyses="analyses"))
def reverted_edits(spark: SparkSession, sf: str) -> DataFrame:
    return summary(R.revert_edits(T.archive(spark, sf), edits(spark, sf)))


@query(
    "reanalyzed_meetings",
    ARC
    + REVERTED_SQL
    + """, a3 AS (SELECT m.id AS meeting_id, CASE WHEN m.original_id IS NULL AND m.c IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 'edit 2' ELSE a.markdown END AS markdown
      FROM meetings m LEFT JOIN analyses a ON a.meeting_id = m.id) """
    + SUMMARY_SQL.format(meetings="m2", segs="segs", analyses="a3"),
)
def reanalyzed_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return summary(R.reanalyze(T.archive(spark, sf), edits(spark, sf).select("id", "markdown", "op_idx")))


@query(
    "markdown_export",
    LIST_SQL
    + ", shown AS (SELECT s.meeting_id, s.seg_idx, s.text, s.speaker FROM segs s)"
    + dialogue_sql("speaker", "shown").replace("SELECT meeting_id, line_idx, seg_idx //", ", lines AS (SELECT meeting_id, line_idx, seg_idx //", 1)
    + f""") SELECT l.id AS meeting_id, regexp_replace(l.name, '[<>:"/\\\\|?*]', ' ', 'g') || '.md' AS file_name, s.section, s.line_idx, s.part, md5(s.line) AS line
    FROM listed l JOIN (
      SELECT id, 0 AS section, 0 AS line_idx, 0 AS part, '# ' || name || chr(10) AS line FROM listed
      UNION ALL SELECT id, 1, 0, 0, '## Analiz' || chr(10) || chr(10) || markdown || chr(10) FROM listed WHERE markdown IS NOT NULL
      UNION ALL SELECT id, 2, 0, 0, '## Döküm' || chr(10) FROM listed
      UNION ALL SELECT l2.id, 3, line_idx, part, label || ': ' || text FROM lines JOIN listed l2 ON l2.active = lines.meeting_id
      UNION ALL SELECT id, 4, 0, 0, chr(10) || '> Not: Konuşmacı etiketleri bu oturumda kullanılamadı.' FROM listed WHERE speakers_degraded) s ON s.id = l.id""",
)
def markdown_export(spark: SparkSession, sf: str) -> DataFrame:
    return export_lines(spark, sf).withColumn("line", F.md5("line"))


def export_lines(spark: SparkSession, sf: str) -> DataFrame:
    arc = T.archive(spark, sf)
    scopes = arc.meetings.select(F.col("id").alias("meeting_id"), F.lit("group").alias("meeting_scope"))
    details = cut(
        R.meeting_details(arc, scopes).select(F.col("id").alias("meeting_id"), "active", "name", "markdown", F.lit("").alias("text"), "speakers_degraded")
    )
    printed = segments.line_text(segments.transcript_lines(arc.segments)).withColumnRenamed("meeting_id", "active")
    lines = cut(printed.join(details.select("active", "meeting_id"), "active"))
    return markdown_lines(details, lines)


PRINTED_SQL = (
    ", shown AS (SELECT s.meeting_id, s.seg_idx, s.text, s.speaker FROM segs s)"
    + dialogue_sql("speaker", "shown").replace("SELECT meeting_id, line_idx, seg_idx //", ", lines AS (SELECT meeting_id, line_idx, seg_idx //", 1)
    + ")"
)


@query(
    "meeting_files",
    ARC
    + PRINTED_SQL
    + """, texts AS (SELECT meeting_id, md5(string_agg(label || ': ' || text, chr(10) ORDER BY line_idx, part)) AS text_md5 FROM lines GROUP BY ALL),
    said AS (SELECT meeting_id, count(*) AS segments, sum(length(text))::BIGINT AS chars, count(DISTINCT speaker) AS speakers FROM segs GROUP BY ALL)
    SELECT m.id AS meeting_id, m.name, m.original_id, m.edited_id, segments, chars, speakers, text_md5,
      CASE WHEN segments IS NOT NULL THEN CASE WHEN extract(minute FROM strptime(m.id, '%Y-%m-%dT%H-%M-%S-000Z')) < 30 THEN 'two-party' ELSE 'group' END END AS meeting_scope,
      a.markdown, a.speakers_degraded
    FROM meetings m LEFT JOIN said ON said.meeting_id = m.id LEFT JOIN texts ON texts.meeting_id = m.id LEFT JOIN analyses a ON a.meeting_id = m.id AND a.markdown IS NOT NULL""",
)
def meeting_files(spark: SparkSession, sf: str) -> DataFrame:
    """The archive written as one JSON file per meeting and kind, and what the files say when they are read back."""
    arc, root = T.archive(spark, sf), run_folder(spark, "meetings")
    scopes = arc.meetings.filter(F.minute(X.id_to_timestamp(F.col("id"))) < 30).select(F.col("id").alias("meeting_id"), F.lit("two-party").alias("meeting_scope"))
    printed = segments.line_text(segments.transcript_lines(arc.segments))
    meeting_store.write_files(meeting_store.transcript_rows(arc.segments, printed, scopes), root, "transcripts")
    meeting_store.write_files(arc.analyses.filter(F.col("markdown").isNotNull()), root, "analyses")
    meeting_store.write_files(arc.meetings.withColumnRenamed("id", "meeting_id"), root, "meta")
    told = meeting_store.read_files(spark, root, "transcripts")
    # A meeting's segments are one row of the files, so what they hold is told within it and each file is read once.
    chars = F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + F.length(F.coalesce(s["text"], F.lit(""))))
    named = F.array_distinct(F.array_compact(F.transform("segments", lambda s: s["speaker"])))
    said = told.filter(F.size("segments") > 0).select(
        "meeting_id", F.size("segments").cast("bigint").alias("segments"), chars.alias("chars"), F.size(named).cast("bigint").alias("speakers"), "meeting_scope", F.md5("text").alias("text_md5")
    )
    return meeting_store.read_files(spark, root, "meta").join(said, "meeting_id", "left").join(meeting_store.read_files(spark, root, "analyses"), "meeting_id", "left")


@query(
    "exported_files",
    LIST_SQL
    + PRINTED_SQL
    + """, printed AS (
      SELECT id, 0 AS section, 0 AS line_idx, 0 AS part, '# ' || name || chr(10) AS line FROM listed
      UNION ALL SELECT id, 1, 0, 0, '## Analiz' || chr(10) || chr(10) || markdown || chr(10) FROM listed WHERE markdown IS NOT NULL
      UNION ALL SELECT id, 2, 0, 0, '## Döküm' || chr(10) FROM listed
      UNION ALL SELECT l2.id, 3, line_idx, part, label || ': ' || text FROM lines JOIN listed l2 ON l2.active = lines.meeting_id
      UNION ALL SELECT id, 4, 0, 0, chr(10) || '> Not: Konuşmacı etiketleri bu oturumda kullanılamadı.' FROM listed WHERE speakers_degraded)
    SELECT l.id AS meeting_id, any_value(regexp_replace(l.name, '[<>:"/\\\\|?*]', ' ', 'g')) || '.md' AS file_name, md5(string_agg(p.line || chr(10), '' ORDER BY section, line_idx, part)) AS content
    FROM listed l JOIN printed p USING (id) GROUP BY l.id""",
)
def exported_files(spark: SparkSession, sf: str) -> DataFrame:
    """Exported documents as one Markdown file per meeting under its cleaned name, read back."""
    root = run_folder(spark, "exports")
    meeting_store.write_files(meeting_store.document_rows(export_lines(spark, sf)), root, "markdown")
    return meeting_store.read_files(spark, root, "markdown").withColumn("content", F.md5("content"))


# --- speaker names -------------------------------------------------------------------------------


@query(
    "speaker_labels",
    "WITH "
    + T.SEGMENTS_SQL
    + """, per AS (SELECT meeting_id, speaker, min(seg_idx) AS first, arg_min(source, seg_idx) FILTER (WHERE source IS NOT NULL) AS source FROM segments GROUP BY ALL)
    SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY first) AS appearance, speaker, source FROM per""",
)
def speaker_labels(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.speaker_labels(T.segments(spark, sf))


@query("renamed_segments", ARC + "SELECT meeting_id, seg_idx, CASE speaker WHEN 'SPEAKER_10' THEN 'Ada' ELSE speaker END AS speaker FROM segs")
def renamed_segments(spark: SparkSession, sf: str) -> DataFrame:
    arc = T.archive(spark, sf)
    names = arc.meetings.select(F.col("id").alias("meeting_id"), F.lit("SPEAKER_10").alias("label"), F.lit("Ada").alias("name"))
    return speakers.rename_segments(arc.segments, names).select("meeting_id", "seg_idx", "speaker")


@query(
    "renamed_texts",
    ARC + "SELECT meeting_id, replace(replace(replace(markdown, 'SPEAKER_10', chr(1)), 'SPEAKER_1', 'SPEAKER_10'), chr(1), 'SPEAKER_1') AS markdown FROM analyses",
)
def renamed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels change places, which one pass over the text gets right."""
    arc = T.archive(spark, sf)
    swap = F.explode(F.create_map(F.lit("SPEAKER_1"), F.lit("SPEAKER_10"), F.lit("SPEAKER_10"), F.lit("SPEAKER_1")))
    names = arc.meetings.select(F.col("id").alias("meeting_id"), swap.alias("label", "name"))
    return speakers.rename_texts(arc.analyses, names, "markdown").select("meeting_id", "markdown")


@query(
    "label_mentions",
    ARC
    + """, items AS (SELECT meeting_id, unnest(string_split(markdown, ',')) AS item, generate_subscripts(string_split(markdown, ','), 1) AS pos FROM analyses WHERE markdown IS NOT NULL),
    labels AS (SELECT DISTINCT meeting_id, speaker AS label FROM segs)
    SELECT i.meeting_id, i.pos, l.label FROM items i JOIN labels l USING (meeting_id) WHERE regexp_matches(i.item, '(^|[^\\p{L}\\p{N}_])' || l.label || '($|[^\\p{L}\\p{N}_])')""",
)
def label_mentions(spark: SparkSession, sf: str) -> DataFrame:
    arc = T.archive(spark, sf)
    items = arc.analyses.filter(F.col("markdown").isNotNull()).select("meeting_id", F.posexplode(F.split("markdown", ",")).alias("pos", "item"))
    found = speakers.mentions(items, arc.segments.select("meeting_id", "speaker").distinct())
    return found.select("meeting_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "label")


@query(
    "spoken_lines",
    "WITH " + T.SEGMENTS_SQL + f"SELECT meeting_id, speaker, seg_idx, md5({T.sql_strip('text')}) AS line FROM segments WHERE {T.sql_strip('text')} <> ''",
)
def spoken_lines(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.spoken_lines(T.segments(spark, sf)).withColumn("line", F.md5("line"))


# --- runs ----------------------------------------------------------------------------------------


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: scenario by customer, configuration and recording type by key, measures by price."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return T.read(spark, sf, "orders").select(
        F.lit("bench").alias("kind"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_id"),
        F.format_string("S%d", F.col("o_custkey") % 14).alias("scenario"),
        F.element_at(F.array(*[F.lit(c[0]) for c in runs.CONFIGS]), (key % 4 + 1).cast("int")).alias("config_id"),
        F.when(F.floor(key / 4) % 2 == 0, "static").otherwise("live").alias("recording_type"),
        F.lit("transcribe").alias("output_type"),
        F.format_string("transcribe/%d.json", key).alias("path"),
        F.when(key % 5 != 0, F.floor(price / 1000) / 1024).alias("wer"),
        (F.floor(price) % 7).alias("found"),
        F.lit(7).cast("bigint").alias("total"),
        (F.floor(price / 100) / 4096).alias("rtf"),
        (F.floor(price) % 3).alias("duplicate_flags"),
        (F.floor(price) % 2).alias("overlap_flags"),
        F.when(key % 5 != 0, F.floor(price) % 11).alias("invented_sentences"),
        (F.floor(price) / 8).alias("peak_rss_mb"),
        F.lit(12.5).alias("disk_mb"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
        F.floor(price).alias("length"),
        key.alias("key"),
    )


RUNS_SQL = f"""WITH runs AS (SELECT 'bench' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS run_id, 'S' || (o_custkey % 14) AS scenario,
    ([{', '.join(repr(c[0]) for c in runs.CONFIGS)}])[CAST(o_orderkey % 4 + 1 AS INT)] AS config_id,
    CASE WHEN (o_orderkey // 4) % 2 = 0 THEN 'static' ELSE 'live' END AS recording_type, 'transcribe' AS output_type, 'transcribe/' || o_orderkey || '.json' AS path,
    CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 1000) / 1024 END AS wer, CAST(floor(o_totalprice) AS BIGINT) % 7 AS found, 7 AS total,
    floor(o_totalprice / 100) / 4096 AS rtf, CAST(floor(o_totalprice) AS BIGINT) % 3 AS duplicate_flags, CAST(floor(o_totalprice) AS BIGINT) % 2 AS overlap_flags,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 11 END AS invented_sentences, floor(o_totalprice) / 8 AS peak_rss_mb,
    o_orderdate AS modified, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderkey AS key FROM orders)
"""


@query(
    "benchmark_roll_up",
    RUNS_SQL
    + """SELECT config_id, recording_type, count(*) AS runs, round(avg(wer), 9) AS avg_wer, CAST(sum(found) AS BIGINT) AS found, CAST(sum(total) AS BIGINT) AS total, round(avg(rtf), 9) AS avg_rtf,
      CAST(sum(duplicate_flags) AS BIGINT) AS duplicate_flags, CAST(sum(overlap_flags) AS BIGINT) AS overlap_flags, CAST(sum(invented_sentences) AS BIGINT) AS invented_sentences, max(peak_rss_mb) AS peak_rss_mb
    FROM runs GROUP BY ALL""",
)
def benchmark_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    rolled = quality.roll_up(run_rows(spark, sf))
    return rolled.withColumn("avg_wer", F.round("avg_wer", 9)).withColumn("avg_rtf", F.round("avg_rtf", 9))


@query(
    "recall_table",
    RUNS_SQL
    + """SELECT scenario, config_id, CAST(sum(found) FILTER (WHERE recording_type = 'static') AS BIGINT) AS static,
      CAST(sum(found) FILTER (WHERE recording_type = 'live') AS BIGINT) AS live FROM runs GROUP BY ALL""",
)
def recall_table(spark: SparkSession, sf: str) -> DataFrame:
    return quality.recall_table(run_rows(spark, sf))


def device_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as timed runs of two devices; some fail, some fall back."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return T.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("scenario"),
        key.alias("run"),
        F.when(key % 2 == 0, "cpu").otherwise("cuda").alias("device"),
        (F.col("o_orderstatus") != "P").alias("ok"),
        (key % 7 == 0).alias("fell_back"),
        F.floor(price).alias("total_ms"),
        F.floor(price / 10).alias("load_ms"),
        F.floor(price / 2).alias("pipeline_ms"),
        F.lit(90.3).alias("audio_sec"),
    )


DEVICE_SQL = """WITH d AS (SELECT o_custkey AS scenario, o_orderkey AS run, CASE WHEN o_orderkey % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device, o_orderstatus <> 'P' AS ok,
   o_orderkey % 7 = 0 AS fell_back, CAST(floor(o_totalprice) AS BIGINT) AS total_ms, CAST(floor(o_totalprice / 10) AS BIGINT) AS load_ms, CAST(floor(o_totalprice / 2) AS BIGINT) AS pipeline_ms FROM orders) """


@query(
    "device_speed_up",
    DEVICE_SQL
    + """SELECT scenario, min(total_ms) FILTER (WHERE ok AND NOT fell_back AND device = 'cpu') AS cpu_ms, min(total_ms) FILTER (WHERE ok AND NOT fell_back AND device = 'cuda') AS cuda_ms,
      min(total_ms) FILTER (WHERE ok AND NOT fell_back AND device = 'cpu') / min(total_ms) FILTER (WHERE ok AND NOT fell_back AND device = 'cuda') AS speed_up FROM d GROUP BY ALL""",
)
def device_speed_up(spark: SparkSession, sf: str) -> DataFrame:
    return quality.device_speed_up(device_runs(spark, sf))


@query(
    "device_summary",
    DEVICE_SQL
    + """SELECT scenario, run, device || CASE WHEN fell_back THEN '*' ELSE '' END AS device, CASE WHEN ok THEN floor(total_ms / 1000 * 10 + 0.5) / 10 END AS total_s,
      CASE WHEN ok THEN floor(CAST(total_ms AS DOUBLE) / 1000 / CAST(90.3 AS DOUBLE) * 1000 + 0.5) / 1000 END AS rtf,
      CASE WHEN ok THEN floor(load_ms / 1000 * 10 + 0.5) / 10 END AS load_s, CASE WHEN ok THEN floor(pipeline_ms / 1000 * 10 + 0.5) / 10 END AS pipeline_s FROM d""",
)
def device_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.device_summary(device_runs(spark, sf))


@query(
    "run_summary",
    # Spark writes the one value below a thousandth with an exponent, and rounds halves up.
    RUNS_SQL
    + """SELECT config_id, recording_type, scenario, '| ' || config_id || ' | ' || recording_type || ':' || scenario || ' | '
      || coalesce(CASE WHEN wer > 0 AND wer < 0.001 THEN '9.765625E-4' ELSE CAST(wer AS VARCHAR) END, 'n/a') || ' | ' || found || '/' || total || ' | ' || duplicate_flags || ' | '
      || overlap_flags || ' | ' || coalesce(CAST(invented_sentences AS VARCHAR), 'n/a') || ' | ' || CAST(CAST(CAST(rtf AS DECIMAL(18, 12)) AS DECIMAL(18, 2)) AS VARCHAR) || ' | '
      || CAST(peak_rss_mb AS VARCHAR) || ' | 12.5 |' AS line FROM runs""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary_lines(run_rows(spark, sf))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """The most expensive order of each scenario and recording type as its reference."""
    best = run_rows(spark, sf).groupBy("scenario", F.col("output_type").alias("kind"), "recording_type")
    return best.agg(F.max_by("path", F.struct("length", "key")).alias("path"))


REGISTRY_SQL = ", registry AS (SELECT scenario, output_type AS kind, recording_type, path FROM runs QUALIFY row_number() OVER (PARTITION BY scenario, output_type, recording_type ORDER BY length DESC, key DESC) = 1) "


@query(
    "marked_references",
    RUNS_SQL + REGISTRY_SQL + "SELECT r.path, g.path IS NOT NULL AS is_reference FROM runs r LEFT JOIN registry g ON g.path = r.path",
)
def marked_references(spark: SparkSession, sf: str) -> DataFrame:
    return runs.mark_references(run_rows(spark, sf), runs.resolve_references(registry(spark, sf))).select("path", "is_reference")


@query(
    "run_references",
    RUNS_SQL + REGISTRY_SQL + "SELECT r.path, g.path AS reference_path FROM runs r LEFT JOIN registry g ON g.scenario = r.scenario AND g.kind = r.output_type AND g.recording_type = r.recording_type",
)
def run_references(spark: SparkSession, sf: str) -> DataFrame:
    return runs.reference_of(run_rows(spark, sf), registry(spark, sf)).select("path", "reference_path")


@query(
    "promotions",
    RUNS_SQL
    + REGISTRY_SQL
    + """, promoted AS (SELECT scenario || '-' || (key % 3) AS scenario, output_type AS kind, recording_type, path, key FROM runs),
    latest AS (SELECT * FROM promoted QUALIFY row_number() OVER (PARTITION BY scenario, kind, recording_type ORDER BY key DESC) = 1)
    SELECT scenario, kind, recording_type, path FROM latest UNION ALL
    SELECT r.scenario, r.kind, r.recording_type, r.path FROM registry r WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.scenario = r.scenario AND l.kind = r.kind AND l.recording_type = r.recording_type)""",
)
def promotions(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_rows(spark, sf)
    promoted = rows.select(
        F.concat("scenario", F.lit("-"), (F.col("key") % 3).cast("string")).alias("scenario"), F.col("output_type").alias("kind"), "recording_type", "path", F.col("key").alias("op_idx")
    )
    return runs.promote(registry(spark, sf), promoted)


@query(
    "pending_tasks",
    RUNS_SQL
    + f""", configs AS (SELECT unnest([{', '.join(repr(c[0]) for c in runs.CONFIGS)}]) AS config_id), files AS (SELECT DISTINCT 'S' || (o_custkey % 17) AS file FROM orders),
    tasks AS (SELECT config_id, file, recording_type FROM configs, files, (SELECT unnest(['static', 'live']) AS recording_type))
    SELECT * FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.config_id = t.config_id AND r.scenario = t.file AND r.recording_type = t.recording_type AND r.wer IS NOT NULL)""",
)
def pending_tasks(spark: SparkSession, sf: str) -> DataFrame:
    files = T.read(spark, sf, "orders").select(F.format_string("S%d", F.col("o_custkey") % 17).alias("file")).distinct()
    outputs = run_rows(spark, sf).select(
        "config_id", "scenario", "recording_type", F.lit("").alias("text"), F.array().alias("segments"), F.when(F.col("wer").isNotNull(), F.struct("wer")).alias("metrics")
    )
    return runs.pending_tasks(runs.task_matrix(files), outputs)


@query("run_sizes", RUNS_SQL + "SELECT run_id, CAST(sum(length) AS BIGINT) AS bytes, max(modified) AS newest FROM runs GROUP BY ALL")
def run_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_sizes(run_rows(spark, sf)).withColumn("newest", F.col("newest").cast("timestamp_ntz"))


PRUNE_AT = "1998-06-01 00:05:00"


@query(
    "prunable_runs",
    RUNS_SQL
    + REGISTRY_SQL
    + f""", marked AS (SELECT r.*, g.path IS NOT NULL AS ref FROM runs r LEFT JOIN registry g ON g.path = r.path),
    per AS (SELECT run_id, bool_or(ref) AS kept, CAST(sum(length) AS BIGINT) AS bytes, max(modified) AS newest FROM marked GROUP BY ALL)
    SELECT run_id, CAST(NULL AS VARCHAR) AS path, bytes FROM per WHERE NOT kept AND newest <= TIMESTAMP '{PRUNE_AT}' - INTERVAL 10 MINUTE
    UNION ALL SELECT m.run_id, m.path, m.length FROM marked m JOIN per USING (run_id) WHERE kept AND NOT ref AND modified <= TIMESTAMP '{PRUNE_AT}' - INTERVAL 10 MINUTE""",
)
def prunable_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.prunable(run_rows(spark, sf), registry(spark, sf), F.lit(PRUNE_AT).cast("timestamp"), within_kept=True)


@query(
    "run_report",
    RUNS_SQL + REGISTRY_SQL + "SELECT r.run_id, r.config_id, r.scenario, r.path FROM runs r JOIN registry g ON g.path = r.path WHERE contains(lower(r.config_id || ' ' || r.scenario), 'turbo') ORDER BY run_id DESC",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    marked = runs.mark_references(run_rows(spark, sf), registry(spark, sf))
    return runs.report_rows(marked, "TURBO", only_references=True).select("run_id", "config_id", "scenario", "path")


@query(
    "run_trees",
    RUNS_SQL
    + """, names AS (SELECT *, CASE key % 4 WHEN 0 THEN run_id || '/transcribe/' || config_id || '__' || scenario || '.json' WHEN 1 THEN run_id || '/live/analyze/' || config_id || '__' || scenario || '.json'
        WHEN 2 THEN run_id || '/' || scenario || '_live-transcribe.json' ELSE run_id || '/summary.json' END AS p FROM runs)
    SELECT 'bench' AS kind, run_id, CASE WHEN key % 4 = 2 THEN 'm_q8_chunked' ELSE config_id END AS config_id, scenario, recording_type, CASE WHEN key % 4 = 1 THEN 'analyze' ELSE 'transcribe' END AS output_type, p AS path
    FROM names WHERE key % 4 <> 3
    UNION ALL SELECT 'test_run', run_id, 'unknown', scenario, 'static', 'analyze', run_id || '/' || scenario || '_analyze.json' FROM runs WHERE key % 4 = 3""",
)
def run_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Two trees of run files, named both ways, read as one table."""
    rows = run_rows(spark, sf)
    named = F.concat(F.col("config_id"), F.lit("__"), F.col("scenario"), F.lit(".json"))
    below = (
        F.when(F.col("key") % 4 == 0, F.concat(F.lit("/transcribe/"), named))
        .when(F.col("key") % 4 == 1, F.concat(F.lit("/live/analyze/"), named))
        .when(F.col("key") % 4 == 2, F.concat(F.lit("/"), F.col("scenario"), F.lit("_live-transcribe.json")))
        .otherwise(F.lit("/summary.json"))
    )
    empty = F.lit(None).cast("string")
    model = F.when(F.col("key") % 4 == 2, F.lit("x/whisper-m-ONNX"))
    fields = [
        F.col("recording_type").alias("recordingType"),
        empty.alias("outputType"),
        F.struct(model.alias("model"), F.lit("q8").alias("dtype"), F.lit("chunked").alias("mode")).alias("config"),
        F.struct(empty.alias("model")).alias("analyzer"),
        F.lit("").alias("text"),
        F.array().alias("segments"),
        F.struct("wer").alias("metrics"),
    ]
    bench = rows.select(F.concat(F.lit("/out/bench/"), F.col("run_id"), below).alias("path"), *fields)
    manual = rows.filter(F.col("key") % 4 == 3).select(
        F.concat(F.lit("/out/test_run/"), F.col("run_id"), F.lit("/"), F.col("scenario"), F.lit("_analyze.json")).alias("path"), *fields
    ).withColumn("recordingType", empty)
    both = run_files.parse_run_files(bench, "bench", "/out/bench").unionByName(run_files.parse_run_files(manual, "test_run", "/out/test_run"))
    return both.drop("text", "segments", "metrics")


@query(
    "registry_rows",
    f"""WITH docs AS (SELECT doc_id, {T.sql_strip('source')} AS s FROM documents)
    SELECT s || doc_id AS scenario, 'transcribe' AS kind, 'static' AS recording_type, 'transcribe/' || doc_id || '.json' AS path FROM docs
    UNION ALL SELECT s || doc_id, 'analyze', 'live', lang || '/' || doc_id FROM documents JOIN docs USING (doc_id) WHERE lang <> 'en'""",
)
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A registry table written out from documents and read back; English ones lack the last cell."""
    cell = F.when(F.col("lang") != "en", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))).otherwise("-")
    key = F.concat(X.strip(F.col("source")), F.col("doc_id").cast("string"))
    row = F.concat_ws(" | ", F.concat(F.lit("| "), key), F.format_string("transcribe/%d.json", "doc_id"), F.lit("—"), F.lit(""), cell)
    prose = F.array(F.concat(row, F.lit(" |")), F.lit("|---|---|---|---|---|"), F.lit("some prose"), F.lit("| dosya | a | b | c | d |"))
    return run_files.parse_registry(T.read(spark, sf, "documents").select(F.explode(prose).alias("value")))


@query(
    "distinct_weights",
    RUNS_SQL + "SELECT config_id AS model, recording_type AS dtype, min(key) AS position FROM runs GROUP BY ALL",
)
def distinct_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_rows(spark, sf).select(F.col("config_id").alias("model"), F.col("recording_type").alias("dtype"), F.col("key").alias("position"))
    return runs.distinct_weights(rows)


# --- private data --------------------------------------------------------------------------------


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus.text_corpus(widen(T.read(spark, sf, "documents").select("doc_id", "lang", "source", "text")), path, F.col("text"))


CONTENT_SQL = rf"""WITH once AS (SELECT DISTINCT text FROM documents),
  found AS (
    SELECT text, 'private_link' AS rule FROM once WHERE contains(lower(text), 'drive.google.com') OR contains(lower(text), 'docs.google.com')
    UNION ALL SELECT text, 'session_link' FROM once WHERE contains(lower(text), 'claude.ai/code/session_')
    UNION ALL SELECT text, 'home_path' FROM once WHERE regexp_matches(text, '(?i)[A-Za-z]:\\Users\\[^\\\s]+') OR regexp_matches(text, '(?i)/home/[^/\s]+')
    UNION ALL SELECT text, 'secret' FROM once WHERE {' OR '.join(f"regexp_matches(text, '{p}')" for p in privacy.SECRETS)}
    UNION ALL SELECT text, 'phone' FROM once WHERE regexp_matches(text, '{privacy.PHONE}')
    UNION ALL SELECT text, 'email' FROM once WHERE len(list_filter(regexp_extract_all(text, '{privacy.EMAIL}'), lambda e: lower(e) <> 'info@example.com')) > 0)
"""


@query("content_findings", CONTENT_SQL + "SELECT sha256(text) AS content_hash, rule FROM found")
def content_findings(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.content_findings(scanned(spark, sf), ["info@example.com"], corpus.utf8_only)


@query(
    "finding_counts",
    CONTENT_SQL + "SELECT rule, count(DISTINCT d.doc_id) AS paths, count(DISTINCT f.text) AS contents FROM found f JOIN documents d USING (text) GROUP BY rule",
)
def finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.finding_counts(privacy.findings(scanned(spark, sf), ["info@example.com"], corpus.utf8_only))


@query("hash_paths", "SELECT sha256(text) AS content_hash, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents")
def hash_paths(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.hash_paths(scanned(spark, sf))


@query(
    "path_findings",
    """WITH p AS (SELECT CASE page_id % 6 WHEN 0 THEN 'Output/' || page_id || '.MP3' WHEN 1 THEN 'control-group/' || page_id || '.json' WHEN 2 THEN 'x/' || page_id || '/.env'
        WHEN 3 THEN 'notes\\' || page_id || '.local.md' WHEN 4 THEN url ELSE 'a/' || page_id || '/.mp3' END AS path FROM pages)
    SELECT path, 'private_root' AS rule FROM p WHERE lower(path) LIKE 'output/%' UNION ALL SELECT path, 'media' FROM p WHERE lower(path) LIKE 'output/%.mp3'
    UNION ALL SELECT path, 'reference_output' FROM p WHERE path LIKE 'control-group/%.json' UNION ALL SELECT path, 'local_file' FROM p WHERE path LIKE '%/.env' OR path LIKE '%.local.md'""",
)
def path_findings(spark: SparkSession, sf: str) -> DataFrame:
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 6
    path = (
        F.when(kind == 0, F.concat(F.lit("Output/"), n, F.lit(".MP3")))
        .when(kind == 1, F.concat(F.lit("control-group/"), n, F.lit(".json")))
        .when(kind == 2, F.concat(F.lit("x/"), n, F.lit("/.env")))
        .when(kind == 3, F.concat(F.lit("notes\\"), n, F.lit(".local.md")))
        .when(kind == 4, F.col("url"))
        .otherwise(F.concat(F.lit("a/"), n, F.lit("/.mp3")))
    )
    return privacy.path_findings(T.read(spark, sf, "pages").select(path.alias("path")))


@query("mojibake", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{privacy.MOJIBAKE}')")
def mojibake(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.mojibake(T.read(spark, sf, "documents")).select("doc_id")
