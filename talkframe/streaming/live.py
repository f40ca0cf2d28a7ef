"""Live meetings: chunks to rounds, control events to one terminal event, idle sessions closed.

State is kept per meeting (``ordered.py``). What a state function does in Python is bookkeeping; text and timing
rules are the column expressions of the batch operators, applied to its output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import segments as S
from talkframe.operators.sides import SAMPLE_RATE
from talkframe.plans.blocks import BLOCK_ROWS, block_window, core_rows, scan, with_block, with_halo
from talkframe.session import runs_in_tasks
from talkframe.streaming.ordered import Bookkeeper, by_key, rocksdb

runs_in_tasks(__name__)

FIRST_ROUND_SAMPLES = 20 * SAMPLE_RATE
TAIL_SAMPLES = int(1.5 * SAMPLE_RATE)
SLICE_SAMPLES = 8 * SAMPLE_RATE
IDLE = "40 minutes"

PIECE = "struct<start:double,end:double,text:string>"
CHUNK_SCHEMA = (
    f"meeting_id string, seq bigint, event_time timestamp, n_samples bigint, mic array<float>, system array<float>, segments array<{PIECE}>, is_stop boolean"
)
EVENT_SCHEMA = "meeting_id string, seq bigint, event_time timestamp, event string"


def read_chunks(spark: SparkSession, path: str, files_per_round: int = 1) -> DataFrame:
    """Chunks as they arrive in files. A chunk's segments are timed from its first new sample."""
    return spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", files_per_round).parquet(path)


# --- rounds --------------------------------------------------------------------------------------


class _Rounds(Bookkeeper):
    """Chunks of one meeting gathered into rounds; the first waits until enough has come.

    A stop comes out as a row of its own, behind the segments of the last round.
    """

    FIELDS = {"n_samples": "bigint", "segments": f"array<{PIECE}>", "is_stop": "boolean"}
    OUT = "meeting_id string, round int, seg_in_round int, start double, end double, text string, seam double, offset double, before_1 string, before_2 string, ended boolean"
    STATE = "emitted bigint, pending bigint, tail bigint, round int, context array<string>, stopped boolean"
    LISTED = "start double, end double, text string"
    COALESCE = True

    def __init__(self, key: str, saved: tuple | None, gathered=list) -> None:
        super().__init__(key, saved, gathered)
        self.emitted, self.pending, self.tail, self.number, context, self.stopped = saved or (0, 0, 0, 0, [], False)
        self.context = list(context)

    @staticmethod
    def plain(n_samples, segments, is_stop) -> tuple:
        pieces = segments if segments is not None else []
        return int(n_samples), [(p["start"], p["end"], p["text"]) for p in pieces], bool(is_stop)

    def take(self, seq: int, n_samples: int, segments: list, is_stop: bool) -> list[tuple]:
        if self.stopped:
            return []
        at = (self.emitted + self.pending) / SAMPLE_RATE
        if n_samples > 0:
            for start, end, text in segments:
                timed = start is not None and end is not None
                self.fresh.append((start + at, end + at, text) if timed else (None, None, text))
            self.pending += n_samples
        self.stopped = is_stop
        if is_stop:
            return [*self.end(), (self.key, self.number, -1, *[None] * 7, True)]
        return [] if self.COALESCE else self.end()

    def end(self) -> list[tuple]:
        """Close a round if enough is pending."""
        if not (self.pending > 0 and (self.number > 0 or self.stopped or self.pending >= FIRST_ROUND_SAMPLES)):
            return []
        self.number += 1
        held = self.gathered()
        rows, seen = [], list(self.context)
        seam, offset = self.emitted / SAMPLE_RATE, (self.emitted - self.tail) / SAMPLE_RATE
        for i, (start, end, text) in enumerate(held):
            rows.append((self.key, self.number, i, start, end, text, seam, offset, *([None, None, *seen][-2:][::-1]), False))
            seen.append(text)
        if held:
            self.context = [h[2] for h in held][-2:]
        self.tail = min(TAIL_SAMPLES, self.tail + self.pending)
        self.emitted, self.pending = self.emitted + self.pending, 0
        self.empty()
        return rows

    def saved(self) -> tuple:
        return self.emitted, self.pending, self.tail, self.number, self.context, self.stopped


class _ChunkRounds(_Rounds):
    COALESCE = False


def _flagged(rows: DataFrame, dictionary: dict[str, str] | None) -> DataFrame:
    """Correct, then flag what a round repeats: by place at its seam, by words after two earlier segments."""
    fixed = lambda c: X.correct_words(F.col(c), dictionary)
    line = lambda c: X.word_line(fixed(c))
    hay = F.concat_ws(" ", F.lit(""), line("before_2"), line("before_1"), F.lit(""))
    worded = rows.withColumn("text", fixed("text")).withColumn("_hay", hay).withColumn("_tokens", X.words(F.col("text")))
    rate = X.chars_per_second(F.col("text"), F.col("start"), F.col("end"))
    repeated = S.repeats_before(F.col("_tokens"), F.col("_hay"), rate)
    flag = S.seam_repeat(F.col("end"), F.col("seam")) | repeated
    ended = [c for c in rows.columns if c == "ended"]
    return worded.select("meeting_id", "round", "seg_in_round", "start", "end", "text", "seam", "offset", flag.alias("duplicate"), *ended)


def live_segments(chunks: DataFrame, dictionary: dict[str, str] | None = None, lateness: str | None = None, coalesce: bool = True) -> DataFrame:
    """Segments of a chunk stream, round by round, on the session's timeline and with repeats flagged.

    Chunks that wait together when a micro-batch begins become one round. Without ``coalesce`` every
    chunk is a round of its own, so rounds do not depend on how chunks arrive. Chunks after a stop are dropped.
    """
    return live_rows(chunks, dictionary, lateness, coalesce).filter(~F.col("ended")).drop("ended")


def live_rows(chunks: DataFrame, dictionary: dict[str, str] | None = None, lateness: str | None = None, coalesce: bool = True) -> DataFrame:
    """``live_segments`` with a last row for every meeting that has stopped: ``ended``, without text."""
    return _flagged(by_key(chunks, _Rounds if coalesce else _ChunkRounds, lateness), dictionary)


def replayed_segments(chunks: DataFrame, dictionary: dict[str, str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same for stored chunks, every one taken as a round of its own once the first has been held."""
    n, stop = F.col("n_samples"), F.col("is_stop")
    placed = scan(with_block(chunks, "seq", block_rows), S.MEETING, ["seq"], {"_cum": ("sum", n)}).drop("_block")
    enough = (F.col("_cum") >= FIRST_ROUND_SAMPLES) | stop
    opened = scan(
        with_block(placed, "seq", block_rows),
        S.MEETING,
        ["seq"],
        {
            "_open": ("sum", (enough & (n > 0)).cast("bigint")),
            "_ever": ("all_max", enough & (F.col("_cum") > 0)),
            "_rows": ("sum", F.when(n > 0, F.size("segments")).otherwise(0)),
        },
    ).drop("_block")
    number = F.greatest(F.col("_open"), F.lit(1))
    seam = F.when(number > 1, F.col("_cum") - n).otherwise(0)
    rounds = opened.filter(F.col("_ever") & (n > 0)).select(
        "meeting_id",
        number.cast("int").alias("round"),
        (seam / SAMPLE_RATE).alias("seam"),
        ((seam - F.when(number > 1, F.lit(TAIL_SAMPLES)).otherwise(0)) / SAMPLE_RATE).alias("offset"),
        ((F.col("_cum") - n) / SAMPLE_RATE).alias("_at"),
        (F.col("_rows") - F.size("segments")).alias("_first"),
        F.posexplode("segments").alias("_i", "_s"),
    )
    timed = F.col("_s.start").isNotNull() & F.col("_s.end").isNotNull()
    rows = rounds.select(
        "meeting_id",
        "round",
        "seam",
        "offset",
        (F.col("_first") + F.col("_i")).alias("seg_idx"),
        F.when(timed, F.col("_s.start") + F.col("_at")).alias("start"),
        F.when(timed, F.col("_s.end") + F.col("_at")).alias("end"),
        F.col("_s.text").alias("text"),
    )
    w = block_window(S.MEETING, "seg_idx")
    near = with_halo(rows, "seg_idx", before=2, size=block_rows)
    r1, r2 = F.lag("round", 1).over(w), F.lag("round", 2).over(w)
    # A round hands on two segments at most, and only its own: one before a lone one is out of sight.
    second = F.when((r1 == F.col("round")) | (r2 == r1), F.lag("text", 2).over(w))
    context = core_rows(near.withColumn("before_1", F.lag("text", 1).over(w)).withColumn("before_2", second))
    flagged = _flagged(context.withColumn("seg_in_round", F.col("seg_idx")), dictionary)
    return flagged.withColumnRenamed("seg_in_round", "seg_idx")


# --- sessions ------------------------------------------------------------------------------------

# Which event leads from which state to which.
MOVES = {
    ("idle", "start"): "recording",
    ("recording", "pause"): "paused",
    ("paused", "resume"): "recording",
    ("recording", "stop"): "finalizing",
    ("paused", "stop"): "finalizing",
    ("finalizing", "analyze"): "analyzing",
}
WORKING = ("finalizing", "analyzing")


class _Session(Bookkeeper):
    """State changes of one meeting; after its one terminal event nothing more comes out."""

    FIELDS = {"event": "string"}
    OUT = "meeting_id string, seq bigint, event string, state string, terminal string"
    STATE = "state string, cancelled boolean, over boolean"
    SMALL = True

    def __init__(self, key: str, saved: tuple | None, gathered=list) -> None:
        super().__init__(key, saved, gathered)
        self.now, self.cancelled, self.over = saved or ("idle", False, False)

    def take(self, seq: int, event: str) -> list[tuple]:
        if self.over:
            return []
        terminal, before = None, self.now
        if event == "chunk":
            # Sound that arrives while nothing records is dropped.
            return [(self.key, seq, event, self.now, None)] if self.now == "recording" else []
        if event == "cancel":
            self.cancelled = self.cancelled or self.now in WORKING
        elif event in ("finalized", "failed") and self.now in WORKING:
            # A cancel that came in time outranks whatever the work ended with.
            terminal = "cancelled" if self.cancelled else {"finalized": "result", "failed": "error"}[event]
            self.now = {"cancelled": "idle", "result": "done", "error": "error"}[terminal]
            self.over = True
        else:
            self.now = MOVES.get((self.now, event), self.now)
        return [(self.key, seq, event, self.now, terminal)] if self.now != before or terminal else []

    def saved(self) -> tuple:
        return self.now, self.cancelled, self.over


def session_states(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """State changes of a stream of control events: ``(meeting_id, seq, event, state, terminal)``.

    Chunks may stand among the events; those that arrive while the session records come out too.
    """
    return by_key(events, _Session, lateness)


class _Slices(Bookkeeper):
    """Captured blocks gathered into slices; a pause or a stop sends what there is."""

    FIELDS = {"event": "string", "n_samples": "bigint"}
    OUT = "meeting_id string, slice int, first_seq bigint, last_seq bigint, n_samples bigint"
    STATE = "slice int, first_seq bigint, pending bigint, paused boolean"
    SMALL = True

    def __init__(self, key: str, saved: tuple | None, gathered=list) -> None:
        super().__init__(key, saved, gathered)
        self.number, self.first, self.pending, self.paused = saved or (0, -1, 0, False)

    @staticmethod
    def plain(event, n_samples) -> tuple:
        return event, int(n_samples)

    def take(self, seq: int, event: str, n_samples: int) -> list[tuple]:
        pauses = event in ("pause", "stop")
        if event == "resume":
            self.paused = False
        elif not pauses and not self.paused and n_samples > 0:
            self.first = seq if self.pending == 0 else self.first
            self.pending += n_samples
        self.paused = self.paused or pauses
        if self.pending == 0 or not (pauses or self.pending >= SLICE_SAMPLES):
            return []
        done = (self.key, self.number, self.first, seq, self.pending)
        self.number, self.first, self.pending = self.number + 1, -1, 0
        return [done]

    def saved(self) -> tuple:
        return self.number, self.first, self.pending, self.paused


def emission_slices(blocks: DataFrame, lateness: str | None = None) -> DataFrame:
    """Slices sent out of captured blocks ``(meeting_id, seq, n_samples, event)``: eight seconds, or less at a pause."""
    return by_key(blocks, _Slices, lateness)


def idle_sessions(rows: DataFrame, gap: str = IDLE, lateness: str | None = None) -> DataFrame:
    """Sessions that end when nothing has come for ``gap``, with what arrived until then.

    With ``lateness`` rows may be a stream: the watermark closes sessions and lets their state go.
    """
    timely = rows.withWatermark("event_time", lateness) if lateness else rows
    return (
        timely.groupBy("meeting_id", F.session_window("event_time", gap).alias("w"))
        .agg(F.count("*").alias("rows"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
        .select("meeting_id", "first", "last", "rows")
    )


# --- the end of a meeting ------------------------------------------------------------------------


def finalize(segments: DataFrame, turns: DataFrame | None, frames: DataFrame | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Speakers, then cut-off fragments, then sides: in that order, so that no flagged repeat votes.

    Without turns the speaker step is left out, without frames the side step.
    """
    from talkframe.operators import align, sides

    labelled = segments if turns is None else align.assign_speakers(segments, turns)
    cleaned = S.flag_orphans(labelled, block_rows)
    return cleaned if frames is None else sides.attribute_sides(cleaned, frames)


def outcomes(segments: DataFrame, stopped: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """One row per stopped meeting: ``(meeting_id, status, speakers_degraded, markdown, analysis_error)``.

    ``stopped`` are ``(meeting_id, has_audio, cancelled)``. A cancelled meeting leaves nothing. A
    meeting without text is an error. A failed analysis keeps the transcript and its message.
    """
    texts = S.active(segments).groupBy("meeting_id").agg(F.count("*").alias("_kept"))
    done = stopped.filter(~F.col("cancelled")).join(texts, "meeting_id", "left")
    if analyses is None:
        none = F.lit(None).cast("string")
        done = done.withColumn("markdown", none).withColumn("analysis_error", none)
    else:
        done = done.join(analyses.select("meeting_id", "markdown", F.col("error").alias("analysis_error")), "meeting_id", "left")
    spoken = F.col("_kept").isNotNull()
    return done.select(
        "meeting_id",
        F.when(spoken, "result").otherwise("error").alias("status"),
        (~F.col("has_audio")).alias("speakers_degraded"),
        F.when(spoken, F.col("markdown")).alias("markdown"),
        F.when(spoken, F.col("analysis_error")).otherwise(F.lit("no transcript to analyse")).alias("analysis_error"),
    )


def start_live(stream: DataFrame, path: str, checkpoint: str, on_round: Callable[[DataFrame, int], None] | None = None, once: bool = False, mode: str = "append"):
    """Write each round's rows below ``path`` and hand them to ``on_round``.

    A round is its own folder and overwritten when Spark repeats it, so rows are stored once
    whatever fails.
    """

    def sink(rows: DataFrame, round_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={round_id}")
        if on_round is not None:
            on_round(rows.sparkSession.read.parquet(f"{path}/batch={round_id}"), round_id)

    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    with rocksdb(stream.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, on_round: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Work off what a stream holds now, then return."""
    started = start_live(stream, path, checkpoint, on_round, once=True, mode=mode)
    started.awaitTermination()


def one_terminal(states: DataFrame) -> DataFrame:
    """The terminal event of each meeting, at most one."""
    ended = states.filter(F.col("terminal").isNotNull())
    return ended.groupBy("meeting_id").agg(F.min_by("terminal", "seq").alias("terminal"))


