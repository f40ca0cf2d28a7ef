"""Queries over speaker turns, energy frames, samples and voice windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators import align, sides, signal, voices
from talkframe.plans import tables as T
from talkframe.plans.registry import query
from talkframe.session import cut

ALIGN_SQL = (
    "WITH "
    + T.DAY_SQL
    + """,
pairs AS (
  SELECT a.meeting_id, a.event_id AS seg_idx, 'S' || (b.user_id % 5) AS speaker, b.event_id AS turn_idx, least(a.e, b.e) - greatest(a.s, b.s) AS us
  FROM spans a JOIN spans b ON a.meeting_id = b.meeting_id AND a.s < b.e AND b.s < a.e
  WHERE a.event_type IN ('view', 'click') AND b.event_type IN ('purchase', 'signup') AND a.e > a.s AND b.e > b.s),
shared AS (SELECT meeting_id, seg_idx, speaker, sum(us) AS us, min(turn_idx) AS first FROM pairs GROUP BY ALL)
"""
)




@query("shared_time", ALIGN_SQL + "SELECT meeting_id, seg_idx, speaker, CAST(us AS BIGINT) AS shared_us, first AS first_turn FROM shared")
def shared_time(spark: SparkSession, sf: str) -> DataFrame:
    segs, turns = T.day_segments(spark, sf), T.day_turns(spark, sf)
    return align.first_turns(cut(align.shared_time(segs, turns)), segs, turns)


@query(
    "speaker_alignment",
    ALIGN_SQL
    + """,
best AS (SELECT meeting_id, seg_idx, speaker FROM shared QUALIFY row_number() OVER (PARTITION BY meeting_id, seg_idx ORDER BY us DESC, first) = 1),
present AS (SELECT h.meeting_id, h.seg_idx, count(*) AS n FROM shared h JOIN spans a ON a.event_id = h.seg_idx
  WHERE us >= 500000 AND (a.e <= a.s OR us * 10 >= (a.e - a.s) * 3) GROUP BY ALL)
SELECT a.meeting_id, a.event_id AS seg_idx, b.speaker, coalesce(p.n >= 2, false) AS overlap
FROM spans a LEFT JOIN best b ON b.seg_idx = a.event_id LEFT JOIN present p ON p.seg_idx = a.event_id
WHERE a.event_type IN ('view', 'click')""",
)
def speaker_alignment(spark: SparkSession, sf: str) -> DataFrame:
    labelled = align.assign_speakers(T.day_segments(spark, sf), T.day_turns(spark, sf))
    return labelled.select("meeting_id", "seg_idx", "speaker", "overlap")


def scale_sql(name: str, channel: str, source: str) -> str:
    return f"""
{name}_ranked AS (SELECT meeting_id, CAST({channel} AS DOUBLE) AS v, row_number() OVER (PARTITION BY meeting_id ORDER BY {channel}) - 1 AS k,
  count(*) OVER (PARTITION BY meeting_id) AS n FROM {source}),
{name}_stats AS (SELECT meeting_id, max(v) FILTER (WHERE k = floor(0.1 * (n - 1) + 0.5)) AS floor, max(v) FILTER (WHERE k = floor(0.9 * (n - 1) + 0.5)) AS loud
  FROM {name}_ranked GROUP BY meeting_id),
{name}_scale AS (SELECT meeting_id, floor, loud - floor AS span FROM {name}_stats WHERE loud >= 0.01 AND loud >= floor * 3)"""


def level_sql(rms: str, scale: str) -> str:
    return f"CASE WHEN {scale}.span IS NULL THEN 0 ELSE greatest(0, least(1, ({rms} - {scale}.floor) / {scale}.span)) END"


SIDES_SQL = (
    "WITH "
    + T.FRAMES_SQL
    + ","
    + scale_sql("system", "system", "frames")
    + f""",
ratios AS (SELECT f.meeting_id, CAST(mic AS DOUBLE) / CAST(system AS DOUBLE) AS v FROM frames f JOIN system_scale s USING (meeting_id)
  WHERE system > 0 AND {level_sql('CAST(system AS DOUBLE)', 's')} >= 0.5),
ratio_ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY meeting_id) AS n FROM ratios),
coupling AS (SELECT meeting_id, CASE WHEN max(n) >= 20 THEN least(max(v) FILTER (WHERE k = floor(0.25 * (n - 1) + 0.5)), 0.8) ELSE 0 END AS coupling
  FROM ratio_ranked GROUP BY meeting_id),
cleaned AS (SELECT f.meeting_id, frame, CAST(greatest(0, CAST(mic AS DOUBLE) - coalesce(coupling, 0) * CAST(system AS DOUBLE)) AS FLOAT) AS mic, system
  FROM frames f LEFT JOIN coupling USING (meeting_id)),"""
    + scale_sql("mic", "mic", "cleaned")
    + f""",
levels AS (SELECT c.meeting_id, frame, {level_sql('CAST(mic AS DOUBLE)', 'm')} AS mic_level, {level_sql('CAST(system AS DOUBLE)', 's')} AS system_level
  FROM cleaned c LEFT JOIN mic_scale m USING (meeting_id) LEFT JOIN system_scale s USING (meeting_id)
  WHERE m.span IS NOT NULL OR s.span IS NOT NULL),
energy AS (
  SELECT g.meeting_id, g.seg_idx, count(*) AS frames, sum(mic_level * mic_level) AS mic, sum(system_level * system_level) AS system
  FROM side_segments g JOIN levels l ON l.meeting_id = g.meeting_id
    AND l.frame >= floor(g.start / CAST(0.016 AS DOUBLE)) AND l.frame < ceil(g."end" / CAST(0.016 AS DOUBLE)) GROUP BY ALL),
own AS (
  SELECT meeting_id, seg_idx, CASE WHEN (mic + system) / frames < 0.01 THEN NULL WHEN system / (mic + system) >= 0.6 THEN 'remote'
    WHEN system / (mic + system) <= 0.4 THEN 'local' ELSE 'mixed' END AS source FROM energy),
placed AS (SELECT g.*, o.source, greatest(CAST(floor(g."end" * 1e6 + 0.5) AS BIGINT) - CAST(floor(g.start * 1e6 + 0.5) AS BIGINT), 0) AS us
  FROM side_segments g LEFT JOIN own o USING (meeting_id, seg_idx)),
tally AS (
  SELECT meeting_id, speaker, sum(CASE WHEN source = 'local' THEN w ELSE 0 END) AS local, sum(CASE WHEN source = 'remote' THEN w ELSE 0 END) AS remote
  FROM (SELECT *, CASE WHEN us > 0 THEN us ELSE 16000 END AS w FROM placed) WHERE source IN ('local', 'remote') GROUP BY ALL),
verdict AS (
  SELECT meeting_id, speaker, CASE WHEN greatest(local, remote) / (local + remote) >= 0.6 THEN CASE WHEN remote >= local THEN 'remote' ELSE 'local' END ELSE 'mixed' END AS side
  FROM tally)
"""
)


@query("channel_scale", SIDES_SQL + "SELECT meeting_id, floor, span FROM system_scale")
def channel_scale(spark: SparkSession, sf: str) -> DataFrame:
    return sides.calibrate(T.frames(spark, sf), "system")


@query("echo_coupling", SIDES_SQL + "SELECT meeting_id, coupling FROM coupling")
def echo_coupling(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    return sides.echo_coupling(f, sides.calibrate(f, "system"))


@query("echo_suppression", SIDES_SQL + "SELECT meeting_id, frame, mic, system FROM cleaned")
def echo_suppression(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    return sides.suppress_echo(f, sides.echo_coupling(f, sides.calibrate(f, "system")))


@query(
    "frame_levels",
    SIDES_SQL + "SELECT meeting_id, frame, round(mic_level * mic_level, 6) AS mic_sq, round(system_level * system_level, 6) AS system_sq FROM levels",
)
def frame_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = sides.leveled_frames(T.frames(spark, sf))
    six = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return levels.select("meeting_id", "frame", six("mic_sq"), six("system_sq"))


@query("segment_energy", SIDES_SQL + "SELECT meeting_id, seg_idx, frames, round(mic, 6) AS mic, round(system, 6) AS system FROM energy")
def segment_energy(spark: SparkSession, sf: str) -> DataFrame:
    energy = sides.segment_energy(T.side_segments(spark, sf), sides.leveled_frames(T.frames(spark, sf)))
    return energy.select("meeting_id", "seg_idx", "frames", F.round("mic", 6).alias("mic"), F.round("system", 6).alias("system"))


@query("segment_sides", SIDES_SQL + "SELECT meeting_id, seg_idx, source FROM own")
def segment_sides(spark: SparkSession, sf: str) -> DataFrame:
    read = sides.segment_sides(T.side_segments(spark, sf), T.frames(spark, sf))
    return read.select("meeting_id", "seg_idx", F.col("_side").alias("source"))


@query("speaker_sides", SIDES_SQL + "SELECT meeting_id, speaker, side FROM verdict")
def speaker_sides(spark: SparkSession, sf: str) -> DataFrame:
    segs = T.side_segments(spark, sf)
    read = segs.join(sides.segment_sides(segs, T.frames(spark, sf)), ["meeting_id", "seg_idx"], "left")
    return sides.speaker_sides(read.withColumn("source", F.col("_side")))


@query(
    "side_attribution",
    SIDES_SQL + "SELECT p.meeting_id, p.seg_idx, coalesce(v.side, p.source) AS source FROM placed p LEFT JOIN verdict v USING (meeting_id, speaker)",
)
def side_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return sides.attribute_sides(T.side_segments(spark, sf), T.frames(spark, sf)).select("meeting_id", "seg_idx", "source")


def envelope_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as chunks of frames: placed by time, so they overlap and leave gaps."""
    offset = F.floor(F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) * 2
    level = (F.col("value") / 100).cast("float")
    return T.read(spark, sf, "events").select(
        F.col("user_id").alias("meeting_id"),
        F.col("event_id").alias("seq"),
        offset.alias("offset_samples"),
        F.array_repeat(level, (F.col("event_id") % 4).cast("int")).alias("mic"),
        F.array_repeat(level, F.least(F.col("event_id") % 4, F.lit(2)).cast("int")).alias("system"),
    )


PLACEMENT_SQL = """WITH chunks AS (SELECT user_id AS meeting_id, event_id AS seq, CAST(value / 100 AS FLOAT) AS v, event_id % 4 AS n,
      CAST(floor((epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000) * 2 / 256 + 0.5) AS BIGINT) AS b FROM events),
    written AS (SELECT meeting_id, seq, v, unnest(generate_series(0, n - 1)) AS i, b FROM chunks WHERE n > 0),
    laid AS (SELECT meeting_id, b + i AS frame, v AS mic, CASE WHEN i < 2 THEN v ELSE 0 END AS system FROM written
      QUALIFY row_number() OVER (PARTITION BY meeting_id, b + i ORDER BY seq DESC) = 1),
    grid AS (SELECT meeting_id, unnest(generate_series(0, m)) AS frame FROM (SELECT meeting_id, max(frame) AS m FROM laid GROUP BY ALL))
    SELECT meeting_id, count(*) AS frames, count(*) FILTER (WHERE l.mic IS NULL OR l.mic = 0) AS gaps, round(sum(CAST(l.mic AS DOUBLE)), 4) AS mic, round(sum(CAST(l.system AS DOUBLE)), 4) AS system
    FROM grid LEFT JOIN laid l USING (meeting_id, frame) GROUP BY ALL"""


@query("envelope_placement", PLACEMENT_SQL)
def envelope_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame of every user's timeline, summed up per user."""
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 4).alias(c)
    placed = sides.place_frames(envelope_chunks(spark, sf)).withColumn("_gap", (F.col("mic") == 0) & (F.col("system") == 0))
    return placed.groupBy("meeting_id").agg(
        F.count("*").alias("frames"), F.count_if("_gap").alias("gaps"), total("mic"), total("system")
    )


SPEECH_SQL = (
    "WITH "
    + T.SAMPLES_SQL
    + """,
frames AS (SELECT meeting_id, sample_idx // 512 AS frame, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)) / 512) AS rms FROM samples GROUP BY ALL HAVING count(*) = 512),
ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY rms) - 1 AS k, count(*) OVER (PARTITION BY meeting_id) AS n FROM frames),
stats AS (SELECT meeting_id, max(rms) FILTER (WHERE k = least(n - 1, floor(0.1 * n))) AS floor, max(rms) AS peak FROM ranked GROUP BY ALL),
thresholds AS (SELECT meeting_id, greatest(0.001, CASE WHEN floor > 0.032 THEN least(floor * 3, peak * 0.3) ELSE floor * 3 END) AS threshold FROM stats),
loud AS (SELECT meeting_id, frame, frame - row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS island FROM frames JOIN thresholds USING (meeting_id) WHERE rms > threshold),
runs AS (SELECT meeting_id, min(frame) AS f, max(frame) AS l FROM loud GROUP BY meeting_id, island HAVING count(*) >= 6),
bounds AS (SELECT meeting_id, min(f) AS f, max(l) AS l FROM runs GROUP BY ALL),
lengths AS (SELECT meeting_id, count(*) AS n_samples FROM samples GROUP BY ALL),
spoken AS (SELECT n.meeting_id, CASE WHEN f IS NOT NULL THEN greatest(f * 512 - 8000, 0) END AS start_sample,
  CASE WHEN f IS NOT NULL THEN least(n_samples, (l + 1) * 512 + 8000) END AS end_sample, f IS NOT NULL AS has_speech FROM lengths n LEFT JOIN bounds USING (meeting_id))
"""
)


def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.samples(spark, sf).groupBy("meeting_id").agg(F.count("*").alias("n_samples"))


@query("frame_energy", SPEECH_SQL + "SELECT meeting_id, frame, round(rms, 9) AS rms FROM frames")
def frame_energy(spark: SparkSession, sf: str) -> DataFrame:
    energy = signal.frame_energy(T.samples(spark, sf))
    return energy.select("meeting_id", "frame", F.round("rms", 9).alias("rms"))


@query("speech_threshold", SPEECH_SQL + "SELECT meeting_id, round(threshold, 9) AS threshold FROM thresholds")
def speech_threshold(spark: SparkSession, sf: str) -> DataFrame:
    energy = signal.speech_threshold(signal.frame_energy(T.samples(spark, sf)))
    return energy.select("meeting_id", F.round("threshold", 9).alias("threshold"))


@query("speech_bounds", SPEECH_SQL + "SELECT * FROM spoken")
def speech_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return signal.speech_bounds(signal.frame_energy(T.samples(spark, sf)), sample_counts(spark, sf))


@query(
    "spoken_samples",
    SPEECH_SQL + "SELECT s.meeting_id, count(*) AS kept FROM samples s JOIN spoken b USING (meeting_id) WHERE has_speech AND sample_idx >= start_sample AND sample_idx < end_sample GROUP BY ALL",
)
def spoken_samples(spark: SparkSession, sf: str) -> DataFrame:
    bounds = speech_bounds(spark, sf)
    return signal.spoken_only(T.samples(spark, sf), bounds).groupBy("meeting_id").agg(F.count("*").alias("kept"))


@query(
    "resampled",
    "WITH "
    + T.SAMPLES_SQL
    + """, paired AS (SELECT meeting_id, sample_idx, CAST(value AS DOUBLE) AS value, CAST(coalesce(lead(value) OVER (PARTITION BY meeting_id ORDER BY sample_idx), value) AS DOUBLE) AS nv, count(*) OVER (PARTITION BY meeting_id) AS n FROM samples),
    grid AS (SELECT meeting_id, unnest(generate_series(0, CAST(floor(n / CAST(2.75625 AS DOUBLE)) AS BIGINT) - 1)) AS o FROM (SELECT DISTINCT meeting_id, n FROM paired))
    SELECT g.meeting_id, g.o AS sample_idx, round(p.value + (p.nv - p.value) * (g.o * CAST(2.75625 AS DOUBLE) - p.sample_idx), 5) AS value
    FROM grid g JOIN paired p ON p.meeting_id = g.meeting_id AND p.sample_idx = CAST(floor(g.o * CAST(2.75625 AS DOUBLE)) AS BIGINT)""",
)
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    wide = T.samples(spark, sf).withColumn("value", F.col("value").cast("double"))
    out = signal.resample(wide, sample_counts(spark, sf), 44_100, 16_000)
    return out.select("meeting_id", "sample_idx", F.round("value", 5).alias("value"))


@query(
    "mixed_down",
    "SELECT event_id // 2 AS sample_idx, user_id % 2 AS meeting_id, avg(value) AS value FROM (SELECT event_id, user_id, value FROM events) GROUP BY ALL",
)
def mixed_down(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of events as the two channels of one sample."""
    channels = T.read(spark, sf, "events").select(
        (F.col("user_id") % 2).alias("meeting_id"), (F.col("event_id") % 2).alias("channel"), F.floor(F.col("event_id") / 2).alias("sample_idx"), "value"
    )
    return signal.mix_down(channels)


# --- voices --------------------------------------------------------------------------------------

VOICES_SQL = "WITH " + T.WINDOWS_SQL


@query(
    "window_plan",
    VOICES_SQL
    + """, spans AS (SELECT meeting_id, start, "end", "end" - start AS span, CAST(floor(("end" - start - 1.5 + 1e-6) / 0.75) AS INT) AS fits FROM regions),
    fixed AS (SELECT meeting_id, start + unnest(generate_series(0, fits)) * CAST(0.75 AS DOUBLE) AS s FROM spans WHERE span >= 1.5)
    SELECT meeting_id, s AS crop_start, s AS mask_start, s + 1.5 AS mask_end FROM fixed
    UNION ALL SELECT meeting_id, "end" - 1.5, "end" - 1.5, "end" FROM spans WHERE span >= 1.5 AND "end" - (start + fits * CAST(0.75 AS DOUBLE) + 1.5) > 0.3
    UNION ALL SELECT r.meeting_id, least(greatest(start - (1.5 - span) / 2, 0), greatest(d.duration - 1.5, 0)), start, "end"
      FROM spans r JOIN (SELECT meeting_id, max(mask_end) AS duration FROM windows GROUP BY ALL) d USING (meeting_id) WHERE span < 1.5""",
)
def window_plan(spark: SparkSession, sf: str) -> DataFrame:
    return voices.plan_windows(T.regions(spark, sf), T.durations(spark, sf))


@query("frame_votes", VOICES_SQL + "SELECT meeting_id, frame, label FROM voted")
def frame_votes(spark: SparkSession, sf: str) -> DataFrame:
    return voices.frame_votes(T.usable_windows(spark, sf))


@query("nearest_windows", VOICES_SQL + "SELECT meeting_id, frame, label FROM nearest")
def nearest_windows(spark: SparkSession, sf: str) -> DataFrame:
    usable = T.usable_windows(spark, sf)
    speech = voices.speech_frames(T.regions(spark, sf), T.durations(spark, sf))
    return voices.nearest_windows(speech.join(voices.frame_votes(usable), ["meeting_id", "frame"], "left_anti"), usable)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled frames, which most queries below read more than once."""
    return cut(voices.assign_frames(T.regions(spark, sf), T.usable_windows(spark, sf), T.durations(spark, sf)))


@query("assigned_frames", VOICES_SQL + "SELECT meeting_id, frame, label FROM assigned")
def assigned_frames(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf)


@query("voice_turns", VOICES_SQL + "SELECT * FROM turns")
def voice_turns(spark: SparkSession, sf: str) -> DataFrame:
    return voices.frames_to_turns(assigned(spark, sf))


@query(
    "named_turns",
    VOICES_SQL
    + """, firsts AS (SELECT meeting_id, label, row_number() OVER (PARTITION BY meeting_id ORDER BY min(lo)) - 1 AS r FROM turns GROUP BY meeting_id, label)
    SELECT meeting_id, CAST(lo AS DOUBLE) / 20 AS start, CAST(hi AS DOUBLE) / 20 AS finish, 'SPEAKER_' || lpad(CAST(r AS VARCHAR), 2, '0') AS speaker FROM turns JOIN firsts USING (meeting_id, label)""",
)
def named_turns(spark: SparkSession, sf: str) -> DataFrame:
    return voices.name_speakers(cut(voices.frames_to_turns(assigned(spark, sf)))).withColumnRenamed("end", "finish")


@query(
    "spoken_time",
    VOICES_SQL + "SELECT meeting_id, label, CAST(sum(hi - lo) AS BIGINT) AS spoken, min(lo) AS first FROM turns GROUP BY ALL",
)
def spoken_time(spark: SparkSession, sf: str) -> DataFrame:
    return voices.spoken_frames(voices.frames_to_turns(assigned(spark, sf)))


@query("folded_speakers")
def folded_speakers(spark: SparkSession, sf: str) -> DataFrame:
    folded = voices.fold_marginal(T.regions(spark, sf), T.usable_windows(spark, sf), T.durations(spark, sf))
    return folded.groupBy("meeting_id", "label").agg(F.count("*").alias("windows"))


@query(
    "voice_centroids",
    VOICES_SQL
    + """, unit AS (SELECT meeting_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim,
       sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS n FROM usable)
    SELECT meeting_id, label, CAST(dim AS INT) AS dim, round(avg(CAST(x AS DOUBLE) / n), 9) AS x FROM unit GROUP BY meeting_id, label, dim""",
)
def voice_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return voices.centroids(T.usable_windows(spark, sf)).select("meeting_id", "label", "dim", F.round("x", 9).alias("x"))


def every_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame of every meeting; silence has label -1."""
    lasting = T.durations(spark, sf).select("meeting_id", voices.end_frame(F.col("duration")).alias("n"))
    pieces = lasting.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 1024))))
    grid = pieces.select("meeting_id", F.explode(F.sequence(F.col("p") * 1024, F.least(F.col("n"), (F.col("p") + 1) * 1024) - 1)).alias("frame"))
    return grid.join(assigned(spark, sf), ["meeting_id", "frame"], "left").select("meeting_id", "frame", F.coalesce("label", F.lit(-1)).alias("label"))


INTERIOR_SQL = (
    VOICES_SQL
    + """, grid AS (SELECT meeting_id, unnest(generate_series(0, n - 1)) AS frame, n FROM
       (SELECT meeting_id, CAST(ceil(max(mask_end) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS n FROM windows GROUP BY ALL)),
    line AS (SELECT g.meeting_id, g.frame, g.n, coalesce(a.label, -1) AS label FROM grid g LEFT JOIN assigned a USING (meeting_id, frame)),
    interior AS (SELECT a.meeting_id, a.frame, a.label FROM line a JOIN line b ON b.meeting_id = a.meeting_id
        AND (b.frame - a.frame + a.n + 6) % a.n <= 12 WHERE a.label >= 0
      GROUP BY a.meeting_id, a.frame, a.label HAVING min(b.label) = a.label AND max(b.label) = a.label)
    """
)


@query("interior_frames", INTERIOR_SQL + "SELECT * FROM interior")
def interior_frames(spark: SparkSession, sf: str) -> DataFrame:
    return voices.interior_frames(every_frame(spark, sf), reach=6)


@query(
    "reference_frames",
    INTERIOR_SQL
    + """, ranked AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY meeting_id, label) AS n FROM interior WINDOW w AS (PARTITION BY meeting_id, label ORDER BY frame)),
    picks AS (SELECT DISTINCT meeting_id, label, (unnest(generate_series(0, least(n, 24) - 1)) * (n - 1)) // greatest(least(n, 24) - 1, 1) AS r FROM ranked)
    SELECT meeting_id, label, frame FROM ranked JOIN picks USING (meeting_id, label, r)""",
)
def reference_frames(spark: SparkSession, sf: str) -> DataFrame:
    inner = voices.interior_frames(every_frame(spark, sf), reach=6)
    return voices.evenly_spaced(inner, ["meeting_id", "label"], "frame", voices.REFERENCE_MAX)


@query(
    "reference_centroids",
    INTERIOR_SQL
    + """, ranked AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY meeting_id, label) AS n FROM interior WINDOW w AS (PARTITION BY meeting_id, label ORDER BY frame)),
    picks AS (SELECT DISTINCT meeting_id, label, (unnest(generate_series(0, least(n, 24) - 1)) * (n - 1)) // greatest(least(n, 24) - 1, 1) AS r FROM ranked),
    held AS (SELECT DISTINCT meeting_id, label, frame // 15 AS w_idx FROM ranked JOIN picks USING (meeting_id, label, r)),
    unit AS (SELECT h.meeting_id, h.label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim,
       sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS n FROM held h JOIN usable u ON u.meeting_id = h.meeting_id AND u.w_idx = h.w_idx),
    mean AS (SELECT meeting_id, label, dim, avg(CAST(x AS DOUBLE) / n) AS x FROM unit GROUP BY ALL),
    long AS (SELECT meeting_id, label, sqrt(sum(x * x)) AS l FROM mean GROUP BY ALL)
    SELECT meeting_id, label, CAST(dim AS INT) AS dim, round(x / l, 6) + 0.0 AS x FROM mean JOIN long USING (meeting_id, label)""",
)
def reference_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Unit centroid per speaker over the windows that hold its reference frames, a row per dimension."""
    held = reference_frames(spark, sf).withColumn("w_idx", F.floor(F.col("frame") / 15).cast("int")).select("meeting_id", "label", "w_idx").distinct()
    embedded = held.join(T.usable_windows(spark, sf).drop("label"), ["meeting_id", "w_idx"])
    listed = voices.reference_centroids(embedded).select("meeting_id", "label", F.posexplode("centroid").alias("dim", "x"))
    return listed.withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(
    "speaker_changes",
    VOICES_SQL
    + """, stepped AS (SELECT *, lag(frame) OVER w AS pf, lag(label) OVER w AS pl FROM assigned WINDOW w AS (PARTITION BY meeting_id ORDER BY frame)),
    spans AS (SELECT meeting_id, start AS region, CAST(floor(start / CAST(0.05 AS DOUBLE)) AS BIGINT) AS lo, CAST(ceil("end" / CAST(0.05 AS DOUBLE)) AS BIGINT) AS hi FROM regions WHERE "end" - start >= 1.5)
    SELECT s.meeting_id, region, frame AS change, greatest(lo, frame - 20) AS low, least(hi, frame + 20) AS high, pl AS "left", label AS "right"
    FROM stepped s JOIN spans r ON r.meeting_id = s.meeting_id AND frame > lo AND frame < hi WHERE pf = frame - 1 AND pl <> label""",
)
def speaker_changes(spark: SparkSession, sf: str) -> DataFrame:
    return voices.speaker_changes(assigned(spark, sf), T.regions(spark, sf))


@query("refined_frames")
def refined_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames after windows near each change have voted by likeness to the two speakers' centroids."""
    frames = assigned(spark, sf)
    changes = cut(voices.speaker_changes(frames, T.regions(spark, sf)))
    middle = voices.centroids(T.usable_windows(spark, sf))
    near = changes.withColumn("w_idx", F.explode(F.sequence(F.greatest(F.floor(F.col("low") / 15) - 1, F.lit(0)), F.floor(F.col("high") / 15))))
    unit = T.usable_windows(spark, sf).select("meeting_id", "w_idx", "mask_start", F.posexplode("embedding").alias("dim", "e"))
    at = near.select("meeting_id", "change", F.col("left").alias("l"), F.col("right").alias("r"), "w_idx").join(unit, ["meeting_id", "w_idx"])
    left = middle.select("meeting_id", F.col("label").alias("l"), "dim", F.col("x").alias("xl"))
    right = middle.select("meeting_id", F.col("label").alias("r"), "dim", F.col("x").alias("xr"))
    fine = (
        at.join(left, ["meeting_id", "l", "dim"])
        .join(right, ["meeting_id", "r", "dim"])
        .groupBy("meeting_id", "change", F.col("mask_start").alias("span_start"))
        .agg(F.sum(F.col("e") * F.col("xl")).alias("like_left"), F.sum(F.col("e") * F.col("xr")).alias("like_right"))
        .withColumn("span_end", F.col("span_start") + voices.FINE_S)
    )
    return voices.refine_boundaries(frames, changes, fine)
