"""Queries over live sessions; stored rows are replayed through Structured Streaming."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.plans import tables as T
from talkframe.plans.registry import query
from talkframe.session import run_folder
from talkframe.sources.scripts import spoken_centiseconds
from talkframe.plans.sound_queries import PLACEMENT_SQL, envelope_chunks
from talkframe.streaming import ending, envelope, live


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chunk streams: a turn per chunk, with a repeat at its seam and an echo at its end.

    Pieces are laid out on the meeting's timeline and handed over from their chunk's first sample, so that
    adding the chunk's place gives the very times they were laid out with.
    """
    turns = T.segments(spark, sf).withColumnsRenamed({"meeting_id": "conv_id", "seg_idx": "turn"}).withColumn("cs", spoken_centiseconds(F.col("text")))
    begin, end = F.col("start"), F.col("end")
    tokens = F.split("text", r"\s+")
    kept = F.floor((F.size(tokens) * 7 + 9) / 10).cast("int")
    echo = F.concat(F.array_join(F.slice(tokens, F.lit(1), kept), " "), F.repeat(F.lit(" evet"), F.col("turn").cast("int")))
    piece = lambda s, e, t: F.struct((s - begin).alias("start"), (e - begin).alias("end"), t.alias("text"))
    said = F.array(
        piece(begin - 0.4, begin + 0.1, F.array_join(F.slice(tokens, 1, 3), " ")),
        piece(begin, end, F.col("text")),
        piece(end - 0.5, end + 0.3, echo),
    )
    silent = F.array().cast("array<float>")
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("turn") * 30)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("meeting_id"), F.col("turn").alias("seq"), at.alias("event_time"), (F.col("cs") * 160).alias("n_samples"),
        silent.alias("mic"), silent.alias("system"), said.alias("segments"), F.lit(False).alias("is_stop"),
    )
    last = rows.groupBy("meeting_id").agg(F.max("seq").alias("m"), F.max("event_time").alias("t"))
    stops = last.select(
        "meeting_id", (F.col("m") + 1).alias("seq"), F.col("t").alias("event_time"), F.lit(0).cast("bigint").alias("n_samples"),
        silent.alias("mic"), silent.alias("system"), F.array().cast(f"array<{live.PIECE}>").alias("segments"), F.lit(True).alias("is_stop"),
    )
    return rows.unionByName(stops)


def hand_over(df: DataFrame, step: str, folder: str) -> tuple[str, int]:
    """Store rows for a file stream, a step apart from the next: where they lie, and how many files are a trigger.

    Files come in any order. A large step has several, and a trigger takes as many as a step has on average,
    so that triggers follow the steps and not the size of the tables.
    """
    df.withColumn("step", F.col(step)).hint("rebalance", "step").write.partitionBy("step").parquet(folder)
    files = df.sparkSession.read.parquet(folder).inputFiles()
    return f"{folder}/*", -(-len(files) // len({posixpath.dirname(f) for f in files}))


@query(
    "live_rounds",
    "WITH "
    + T.SEGMENTS_SQL
    + """, chunk AS (SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, seg_idx AS seq, (end_cs - start_cs) * 160 AS n, end_cs * 160 AS cum, text FROM segments),
    opened AS (SELECT *, sum(CASE WHEN cum >= 320000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY seq) AS o FROM chunk),
    numbered AS (SELECT *, greatest(o, 1) AS round FROM opened)
    SELECT meeting_id, CAST(round AS INT) AS round, CAST(CASE WHEN round > 1 THEN cum - n ELSE 0 END AS DOUBLE) / 16000 AS seam,
      CAST(CASE WHEN round > 1 THEN cum - n - 24000 ELSE 0 END AS DOUBLE) / 16000 AS "offset", count(*) * 3 AS segments FROM numbered GROUP BY ALL""",
)
def live_rounds(spark: SparkSession, sf: str) -> DataFrame:
    replayed = live.replayed_segments(chunks(spark, sf))
    return replayed.groupBy("meeting_id", "round", "seam", "offset").agg(F.count("*").alias("segments"))


COALESCED = 5  # triggers


@query(
    "coalesced_rounds",
    "WITH "
    + T.SEGMENTS_SQL
    + f""", chunk AS (SELECT meeting_id, seg_idx AS seq, (end_cs - start_cs) * 160 AS n FROM segments
      UNION ALL SELECT meeting_id, max(seg_idx) + 1, NULL FROM segments GROUP BY ALL),
    came AS (SELECT meeting_id, least(seq // 3, {COALESCED - 1}) AS b, coalesce(sum(n), 0) AS n, count(n) AS chunks, bool_or(n IS NULL) AS stops FROM chunk GROUP BY ALL),
    held AS (SELECT *, sum(n) OVER w AS cum FROM came WINDOW w AS (PARTITION BY meeting_id ORDER BY b)),
    opened AS (SELECT *, greatest(sum(CASE WHEN n > 0 AND (cum >= 320000 OR stops) THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY b), 1) AS round FROM held),
    rounds AS (SELECT meeting_id, round, sum(n) AS n, max(cum) AS cum, sum(chunks) * 3 AS segments FROM opened GROUP BY ALL)
    SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, CAST(round AS INT) AS round, CAST(cum - n AS DOUBLE) / 16000 AS seam,
      CAST(cum - n - least(24000, cum - n) AS DOUBLE) / 16000 AS "offset", CAST(segments AS BIGINT) AS segments FROM rounds""",
)
def coalesced_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that come three turns at a trigger, one trigger after another: what waits together is one round."""
    folder = run_folder(spark, "coalesced")
    rows = chunks(spark, sf).withColumn("step", F.least(F.floor(F.col("seq") / 3), F.lit(COALESCED - 1)))
    for step in range(COALESCED):  # files are read in the order of their times
        rows.filter(F.col("step") == step).coalesce(1).write.parquet(f"{folder}/chunks/step={step}")
    live.run_to_end(live.live_segments(live.read_chunks(spark, f"{folder}/chunks/*")), f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("meeting_id", F.col("round").cast("int").alias("round"), "seam", "offset").agg(F.count("*").alias("segments"))


FLAGGED_SQL = (
    "WITH "
    + T.SEGMENTS_SQL
    + rf""", toks AS (SELECT *, string_split_regex(text, '\s+') AS t FROM segments),
    heard AS (
      SELECT meeting_id, seg_idx * 3 AS i, seg_idx, start - 0.4 AS s, start + 0.1 AS e, array_to_string(t[1:3], ' ') AS text FROM toks
      UNION ALL SELECT meeting_id, seg_idx * 3 + 1, seg_idx, start, "end", text FROM toks
      UNION ALL SELECT meeting_id, seg_idx * 3 + 2, seg_idx, "end" - 0.5, "end" + 0.3,
        array_to_string(t[1:((len(t) * 7 + 9) // 10)], ' ') || repeat(' evet', CAST(seg_idx AS INT)) FROM toks),
    opened AS (SELECT meeting_id, seg_idx, start, greatest(sum(CASE WHEN end_cs >= 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY seg_idx), 1) AS round FROM segments),
    tok AS (SELECT h.*, o.round, CASE WHEN o.round > 1 THEN o.start ELSE 0 END AS seam, {T.sql_words('h.text')} AS w FROM heard h JOIN opened o USING (meeting_id, seg_idx)),
    pos AS (SELECT meeting_id, i, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM tok),
    win AS (SELECT c.meeting_id, c.i, q.word, q.p + CASE WHEN q.i = c.i - 1 THEN coalesce(len(b.w), 0) ELSE 0 END AS p
      FROM tok c JOIN pos q ON q.meeting_id = c.meeting_id AND q.i IN (c.i - 1, c.i - 2) LEFT JOIN tok b ON b.meeting_id = c.meeting_id AND b.i = c.i - 2),
    hits AS (SELECT a.meeting_id, a.i, a.p, b.p - a.p AS d FROM pos a JOIN win b ON a.meeting_id = b.meeting_id AND a.i = b.i AND a.word = b.word),
    runs AS (SELECT meeting_id, i, d, p - row_number() OVER (PARTITION BY meeting_id, i, d ORDER BY p) AS g FROM hits),
    best AS (SELECT meeting_id, i, max(n) AS run FROM (SELECT meeting_id, i, count(*) AS n FROM runs GROUP BY meeting_id, i, d, g) GROUP BY ALL),
    flg AS (SELECT t.*, e <= seam + 0.25 OR (len(t.w) >= 4 AND (coalesce(run, 0) / len(t.w) >= 0.8
      OR (coalesce(run, 0) / len(t.w) >= 0.6 AND e > s AND length({T.sql_strip('t.text')}) / (e - s) > 25))) AS duplicate
    FROM tok t LEFT JOIN best USING (meeting_id, i))"""
)
LIVE_FLAGS_SQL = FLAGGED_SQL + " SELECT CAST(t.meeting_id AS VARCHAR) AS meeting_id, CAST(t.round AS INT) AS round, t.i AS seg_idx, duplicate FROM flg t"


@query("live_flags", LIVE_FLAGS_SQL)
def live_flags(spark: SparkSession, sf: str) -> DataFrame:
    return live.replayed_segments(chunks(spark, sf)).select("meeting_id", "round", F.col("seg_idx").cast("bigint").alias("seg_idx"), "duplicate")


@query("live_stream", LIVE_FLAGS_SQL.replace("t.i AS seg_idx", "row_number() OVER (PARTITION BY t.meeting_id, t.round ORDER BY t.i) - 1 AS seg_in_round"))
def live_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same flags from the stream itself, whose files bring the turns in any order."""
    folder = run_folder(spark, "live")
    source, files = hand_over(chunks(spark, sf), "seq", f"{folder}/chunks")
    live.run_to_end(live.live_segments(live.read_chunks(spark, source, files), coalesce=False), f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    return out.select("meeting_id", F.col("round").cast("int").alias("round"), F.col("seg_in_round").cast("bigint").alias("seg_in_round"), "duplicate")


EVENT_SQL = """CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'purchase' THEN 'stop'
  ELSE CASE WHEN value < 30 THEN 'cancel' WHEN value < 60 THEN 'finalized' WHEN value < 90 THEN 'failed' ELSE 'analyze' END END"""


def control_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each user as a session's control events, numbered from 0 as a client numbers them."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    return T.read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("meeting_id"), (F.row_number().over(at) - 1).cast("bigint").alias("seq"), "event_id", F.col("ts").alias("event_time"),
        F.expr(EVENT_SQL).alias("event"), F.floor(F.col("value") * 400).alias("n_samples"), F.trunc("ts", "week").alias("week"),
    )


@query(
    "session_states",
    f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_id AS seq, {EVENT_SQL} AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    st AS (
      SELECT DISTINCT meeting_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, '' AS event, 'idle' AS state, 'idle' AS prev, false AS cancelled, CAST(NULL AS VARCHAR) AS terminal FROM ev
      UNION ALL
      SELECT e.meeting_id, e.n, e.seq, e.event,
        CASE WHEN e.event IN ('finalized', 'failed') AND s.state IN ('finalizing', 'analyzing') THEN CASE WHEN s.cancelled THEN 'idle' WHEN e.event = 'finalized' THEN 'done' ELSE 'error' END
             WHEN s.state = 'idle' AND e.event = 'start' THEN 'recording' WHEN s.state = 'recording' AND e.event = 'pause' THEN 'paused'
             WHEN s.state = 'paused' AND e.event = 'resume' THEN 'recording' WHEN s.state IN ('recording', 'paused') AND e.event = 'stop' THEN 'finalizing'
             WHEN s.state = 'finalizing' AND e.event = 'analyze' THEN 'analyzing' ELSE s.state END,
        s.state, s.cancelled OR (e.event = 'cancel' AND s.state IN ('finalizing', 'analyzing')),
        CASE WHEN e.event IN ('finalized', 'failed') AND s.state IN ('finalizing', 'analyzing') THEN CASE WHEN s.cancelled THEN 'cancelled' WHEN e.event = 'finalized' THEN 'result' ELSE 'error' END END
      FROM st s JOIN ev e ON e.meeting_id = s.meeting_id AND e.n = s.n + 1 WHERE s.terminal IS NULL)
    SELECT meeting_id, seq, event, state, terminal FROM st WHERE n > 0 AND (state <> prev OR terminal IS NOT NULL)""",
)
def session_states(spark: SparkSession, sf: str) -> DataFrame:
    """Control events of every user, stored by weeks that arrive in any order."""
    folder, events = run_folder(spark, "sessions"), control_events(spark, sf)
    source, files = hand_over(events, "week", f"{folder}/events")
    stream = spark.readStream.schema(live.EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    live.run_to_end(live.session_states(stream), f"{folder}/out", f"{folder}/checkpoint")
    states = spark.read.parquet(f"{folder}/out").join(events.select("meeting_id", "seq", "event_id"), ["meeting_id", "seq"])
    return states.select("meeting_id", F.col("event_id").alias("seq"), "event", "state", "terminal")


@query(
    "idle_sessions",
    """WITH stepped AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2400 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM stepped)
    SELECT CAST(user_id AS VARCHAR) AS meeting_id, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM numbered GROUP BY user_id, s""",
)
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events are far apart, so the gap is forty hours here."""
    closed = live.idle_sessions(control_events(spark, sf), "2400 minutes")
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return closed.select("meeting_id", plain("first"), plain("last"), "rows")


@query(
    "emitted_slices",
    f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, {EVENT_SQL} AS event, CAST(floor(value * 400) AS BIGINT) AS n,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
    st AS (
      SELECT DISTINCT meeting_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS slice, CAST(-1 AS BIGINT) AS first_seq, CAST(0 AS BIGINT) AS held, false AS paused, false AS sent FROM ev
      UNION ALL
      SELECT meeting_id, seq, CASE WHEN was_sent THEN slice + 1 ELSE slice END, CASE WHEN before > 0 THEN first_seq WHEN held > 0 THEN seq ELSE -1 END, held, paused,
        held > 0 AND (cuts OR held >= 128000)
      FROM (SELECT e.meeting_id, e.seq, s.slice, s.sent AS was_sent, s.first_seq, e.event IN ('pause', 'stop') AS cuts, CASE WHEN s.sent THEN 0 ELSE s.held END AS before,
          CASE WHEN s.sent THEN 0 ELSE s.held END + CASE WHEN e.event NOT IN ('pause', 'stop', 'resume') AND NOT s.paused AND e.n > 0 THEN e.n ELSE 0 END AS held,
          e.event IN ('pause', 'stop') OR (s.paused AND e.event <> 'resume') AS paused
        FROM st s JOIN ev e ON e.meeting_id = s.meeting_id AND e.seq = s.seq + 1))
    SELECT meeting_id, CAST(slice AS INT) AS slice, first_seq, seq AS last_seq, held AS n_samples FROM st WHERE sent""",
)
def emitted_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Events as captured blocks of a user, gathered into slices by the stream."""
    folder = run_folder(spark, "slices")
    source, files = hand_over(control_events(spark, sf), "week", f"{folder}/blocks")
    stream = spark.readStream.schema("meeting_id string, seq bigint, event string, n_samples bigint").option("maxFilesPerTrigger", files).parquet(source)
    live.run_to_end(live.emission_slices(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").drop("batch")


MEETING_EVENTS = 1000  # events per meeting


@query(
    "finalized_meetings",
    """WITH met AS (SELECT DISTINCT event_id // 1000 AS meeting_id FROM events WHERE event_type = 'error')
    SELECT meeting_id, 'result' AS status, meeting_id % 2 <> 0 AS speakers_degraded, CASE WHEN meeting_id % 3 = 1 THEN '# ' || meeting_id END AS markdown,
      CASE WHEN meeting_id % 3 = 2 THEN 'no answer' END AS analysis_error FROM met WHERE meeting_id % 5 <> 4""",
)
def finalized_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events at the end of their meeting: speakers, fragments and sides, then one outcome each.

    A third of the meetings has no analysis and a third a failed one.
    """
    segs = T.side_segments(spark, sf, MEETING_EVENTS).withColumn("text", F.lit("x"))
    turns = segs.select("meeting_id", F.col("seg_idx").alias("turn_idx"), "start", "end", "speaker")
    numbered = segs.withColumn("seg_idx", F.col("seg_idx") % MEETING_EVENTS)
    done = live.finalize(numbered.withColumn("speaker", F.lit(None).cast("string")), turns, T.frames(spark, sf, MEETING_EVENTS))
    stopped = segs.select("meeting_id").distinct().select("meeting_id", (F.col("meeting_id") % 2 == 0).alias("has_audio"), (F.col("meeting_id") % 5 == 4).alias("cancelled"))
    third = F.col("meeting_id") % 3
    analyses = stopped.filter(third > 0).select(
        "meeting_id", F.when(third == 1, F.concat(F.lit("# "), F.col("meeting_id"))).alias("markdown"), F.when(third == 2, "no answer").alias("error")
    )
    return live.outcomes(done, stopped, analyses)


MUTE = 7  # the last of so many meetings says nothing
SPOKEN_TURNS_SQL = """
    turns AS (SELECT meeting_id, seg_idx AS turn, speaker, start_cs * 10000 - 300000 AS su, end_cs * 10000 - 300000 AS eu FROM segments
      UNION ALL SELECT meeting_id, seg_idx + 100000, 'guest', start_cs * 10000 + 200000, start_cs * 10000 + 1400000 FROM segments WHERE seg_idx % 3 = 1)"""


def ended_chunks(spark: SparkSession, sf: str) -> DataFrame:
    mute = F.col("meeting_id").cast("bigint") % MUTE == MUTE - 1
    said = F.transform("segments", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(mute, F.lit(" ")).otherwise(p["text"]).alias("text")))
    return chunks(spark, sf).withColumn("segments", said)


def spoken_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as a diarizer gives them: a little early, and with a guest who talks into every third."""
    segs = T.segments(spark, sf).select("meeting_id", "seg_idx", "speaker", "start", "end")
    at = lambda c, by: ((F.round(F.col(c) * 100) * 10_000 + by) / 1e6)
    own = segs.select("meeting_id", F.col("seg_idx").cast("bigint").alias("turn_idx"), "speaker", at("start", -300_000).alias("start"), at("end", -300_000).alias("end"))
    guest = segs.filter(F.col("seg_idx") % 3 == 1).select(
        "meeting_id", (F.col("seg_idx") + 100_000).cast("bigint").alias("turn_idx"), F.lit("guest").alias("speaker"), at("start", 200_000).alias("start"), at("start", 1_400_000).alias("end")
    )
    return own.unionByName(guest)


@query(
    "ended_meetings",
    FLAGGED_SQL
    + f""",
    {SPOKEN_TURNS_SQL.strip()},
    us AS (SELECT *, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS su, CAST(floor(e * 1e6 + 0.5) AS BIGINT) AS eu, meeting_id % {MUTE} = {MUTE - 1} AS mute FROM flg),
    shared AS (SELECT u.meeting_id, u.i, x.speaker, sum(least(u.eu, x.eu) - greatest(u.su, x.su)) AS us, min(x.turn) AS first, any_value(u.eu - u.su) AS l
      FROM us u JOIN turns x ON x.meeting_id = u.meeting_id AND least(u.eu, x.eu) > greatest(u.su, x.su) AND u.meeting_id % 2 = 0 GROUP BY ALL),
    who AS (SELECT meeting_id, i, arg_max(speaker, (us, -first)) AS speaker, count(*) FILTER (WHERE us >= 500000 AND (l <= 0 OR us * 10 >= l * 3)) >= 2 AS overlap FROM shared GROUP BY ALL),
    kept AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(w) OVER w AS nw FROM us WHERE NOT CASE WHEN mute THEN e <= seam + 0.25 ELSE duplicate END WINDOW w AS (PARTITION BY meeting_id ORDER BY i)),
    orphans AS (SELECT meeting_id, i FROM kept WHERE NOT mute AND s < ne AND ns < e AND len(w) > 0 AND len(nw) > len(w) AND nw[1:len(w)] = w),
    final AS (SELECT u.meeting_id, u.i, u.mute, speaker, coalesce(overlap, false) AS overlap,
        NOT mute AND NOT duplicate AND o.i IS NULL AND {T.sql_strip('text')} <> '' AS active
      FROM us u LEFT JOIN who USING (meeting_id, i) LEFT JOIN orphans o ON o.meeting_id = u.meeting_id AND o.i = u.i)
    SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, CASE WHEN meeting_id % 5 = 4 THEN 'cancelled' WHEN bool_or(active) THEN 'result' ELSE 'error' END AS status,
      meeting_id % 2 <> 0 AS speakers_degraded,
      CASE WHEN meeting_id % 5 <> 4 THEN count(*) FILTER (WHERE active) END AS kept, CASE WHEN meeting_id % 5 <> 4 THEN count(*) FILTER (WHERE speaker = 'user') END AS by_user,
      CASE WHEN meeting_id % 5 <> 4 THEN count(*) FILTER (WHERE speaker = 'guest') END AS by_guest, CASE WHEN meeting_id % 5 <> 4 THEN count(*) FILTER (WHERE overlap) END AS overlaps
    FROM final GROUP BY meeting_id""",
)
def ended_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations heard to their end: one terminal row each, and what their finalised transcripts hold.

    Every second meeting has no stored sound and so no speakers, every fifth is called off, every seventh says nothing.
    """
    folder = run_folder(spark, "ended")
    source, files = hand_over(ended_chunks(spark, sf).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(4))), "part", f"{folder}/chunks")
    meetings = T.segments(spark, sf).select("meeting_id").distinct()
    ids = lambda rows: rows.select(F.col("meeting_id").cast("string"))
    rows = live.live_rows(live.read_chunks(spark, source, files), coalesce=False)
    ending.start_meetings(
        rows, f"{folder}/out", f"{folder}/checkpoint", spoken_turns(spark, sf), silent=ids(meetings.filter("meeting_id % 2 <> 0")),
        cancelled=ids(meetings.filter("meeting_id % 5 = 4")), once=True,
    ).awaitTermination()
    texts = ending.transcripts(spark, f"{folder}/out")
    active = ~F.col("duplicate") & (F.trim("text") != "")
    held = texts.groupBy("meeting_id").agg(F.count_if(active).alias("kept"), F.count_if(F.col("speaker") == "user").alias("by_user"), F.count_if(F.col("speaker") == "guest").alias("by_guest"), F.count_if("overlap").alias("overlaps"))
    return ending.outcomes(spark, f"{folder}/out").select("meeting_id", "status", "speakers_degraded").join(held, "meeting_id", "left")


@query("envelope_stream", PLACEMENT_SQL)
def envelope_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The envelope of every user's events as the stream stores it, whose files bring the chunks in any order."""
    folder = run_folder(spark, "envelope")
    rows = envelope_chunks(spark, sf).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(4)))
    source, files = hand_over(rows, "part", f"{folder}/chunks")
    schema = "meeting_id string, seq bigint, offset_samples bigint, mic array<float>, system array<float>"
    stream = spark.readStream.schema(schema.replace("meeting_id string", "meeting_id bigint")).option("maxFilesPerTrigger", files).parquet(source)
    live.run_to_end(envelope.placed_blocks(stream), f"{folder}/out", f"{folder}/checkpoint", mode="update")
    frames = envelope.envelope(spark.read.parquet(f"{folder}/out"))
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 4).alias(c)
    return frames.groupBy(F.col("meeting_id").cast("bigint").alias("meeting_id")).agg(
        F.count("*").alias("frames"), F.count_if((F.col("mic") == 0) & (F.col("system") == 0)).alias("gaps"), total("mic"), total("system")
    )


CHUNK_OF_SOUND = 1000  # samples; no whole number of frames


@query(
    "measured_frames",
    f"""WITH {T.SAMPLES_SQL}
    SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, sample_idx // 256 AS frame, round(sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)) / 256), 9) AS mic,
      round(sqrt(sum(CASE WHEN sample_idx % {CHUNK_OF_SOUND} < 500 THEN CAST(value AS DOUBLE) * CAST(value AS DOUBLE) ELSE 0 END) / 256), 9) AS system
    FROM samples GROUP BY ALL HAVING count(*) = 256""",
)
def measured_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Sound in chunks of a thousand samples, of which the far side fills half: frames run over from one to the next."""
    folder = run_folder(spark, "measured")
    part = T.samples(spark, sf).groupBy("meeting_id", F.floor(F.col("sample_idx") / CHUNK_OF_SOUND).alias("seq"))
    sound = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda s: s["value"]).alias("mic"))
    rows = sound.select("meeting_id", "seq", (F.col("seq") * CHUNK_OF_SOUND).alias("offset_samples"), "mic", F.slice("mic", 1, 500).alias("system"), F.pmod(F.xxhash64("seq"), F.lit(4)).alias("part"))
    source, files = hand_over(rows, "part", f"{folder}/chunks")
    schema = "meeting_id bigint, seq bigint, offset_samples bigint, mic array<float>, system array<float>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    live.run_to_end(envelope.measured_frames(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("meeting_id", "frame", F.round("mic", 9).alias("mic"), F.round("system", 9).alias("system"))
