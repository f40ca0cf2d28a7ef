"""Which side of a call a voice came from, read off two channels of energy frames.

Frames are ``(meeting_id, frame, mic, system)``, one per 16 ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.operators.segments import MEETING, duration_us, has_speaker
from talkframe.plans.blocks import order_statistics
from talkframe.session import cut

FRAME_SAMPLES = 256
SAMPLE_RATE = 16_000
FRAME_SECONDS = FRAME_SAMPLES / SAMPLE_RATE
FRAME_US = 16_000

QUIETEST_SPEECH = 0.01
LEAST_RANGE = 3
REMOTE_SHARE, LOCAL_SHARE = 0.6, 0.4
LEAST_ENERGY = 0.01
CONSENSUS_SHARE = 0.6
ECHO_LEVEL, ECHO_QUANTILE, ECHO_FRAMES, ECHO_CAP = 0.5, 0.25, 20, 0.8

SPAN = 1024  # frames per pre-summed span


def nearest_rank(p: float):
    """Index of the value at fraction ``p``: the nearest position, halves upwards."""
    return lambda n: F.floor(F.lit(p) * (n - 1) + 0.5)


def calibrate(frames: DataFrame, channel: str) -> DataFrame:
    """Floor and span of a channel per meeting; meetings where it never carries speech are left out."""
    stats = order_statistics(frames, MEETING, F.col(channel), {"floor": nearest_rank(0.1), "loud": nearest_rank(0.9)})
    speaks = (F.col("loud") >= QUIETEST_SPEECH) & (F.col("loud") >= F.col("floor") * LEAST_RANGE)
    return stats.filter(speaks).select("meeting_id", "floor", (F.col("loud") - F.col("floor")).alias("span"))


def level(rms: Column, floor: Column, span: Column) -> Column:
    """How active a channel is, from 0 to 1 on its own scale; 0 for a silent channel."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rms - floor) / span))
    return F.when(span.isNotNull(), scaled).otherwise(F.lit(0.0))


def echo_coupling(frames: DataFrame, system_scale: DataFrame) -> DataFrame:
    """How much of the call comes back into the microphone, per meeting; 0 without evidence."""
    scaled = frames.join(system_scale, "meeting_id")
    loud = scaled.filter((F.col("system") > 0) & (level(F.col("system"), F.col("floor"), F.col("span")) >= ECHO_LEVEL))
    ratio = F.col("mic").cast("double") / F.col("system")
    low = order_statistics(loud, MEETING, ratio, {"ratio": nearest_rank(ECHO_QUANTILE)})
    coupling = F.when(F.col("n") >= ECHO_FRAMES, F.least("ratio", F.lit(ECHO_CAP))).otherwise(F.lit(0.0))
    return low.select("meeting_id", coupling.alias("coupling"))


def suppress_echo(frames: DataFrame, coupling: DataFrame) -> DataFrame:
    quiet = F.greatest(F.lit(0.0), F.col("mic") - F.coalesce(F.col("coupling"), F.lit(0.0)) * F.col("system"))
    cleaned = frames.join(coupling, "meeting_id", "left").withColumn("mic", quiet.cast("float"))
    return cleaned.select(*frames.columns)


def leveled_frames(frames: DataFrame) -> DataFrame:
    """Squared levels of both channels: ``(meeting_id, frame, mic_sq, system_sq)``.

    Squares are fixed-point numbers, so sums over them do not depend on their order. Meetings in
    which neither channel ever carries speech are left out.
    """
    # One row per meeting each, used more than once: kept, so that no statistic is worked out twice.
    system_scale = cut(calibrate(frames, "system"))
    cleaned = suppress_echo(frames, cut(echo_coupling(frames, system_scale)))
    mic_scale = calibrate(cleaned, "mic")
    scales = mic_scale.select("meeting_id", F.col("floor").alias("mf"), F.col("span").alias("ms")).join(
        system_scale.select("meeting_id", F.col("floor").alias("sf"), F.col("span").alias("ss")), "meeting_id", "full"
    )
    square = lambda rms, floor, span: F.pow(level(F.col(rms), F.col(floor), F.col(span)), 2).cast("decimal(20,12)")
    return cleaned.join(scales, "meeting_id").select(
        "meeting_id", "frame", square("mic", "mf", "ms").alias("mic_sq"), square("system", "sf", "ss").alias("system_sq")
    )


def segment_energy(segments: DataFrame, leveled: DataFrame, span: int = SPAN) -> DataFrame:
    """Frames and summed energy under each segment.

    A segment takes the summed spans it covers whole and single frames only at its two ends, so
    what it joins does not grow with its frames.
    """
    timed = segments.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        "meeting_id",
        "seg_idx",
        F.greatest(F.floor(F.col("start") / FRAME_SECONDS), F.lit(0)).alias("lo"),
        F.ceil(F.col("end") / FRAME_SECONDS).alias("hi"),
    )
    touched = timed.filter(F.col("hi") > F.col("lo")).withColumn(
        "piece", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor((F.col("hi") - 1) / span)))
    )
    whole = (F.col("piece") * span >= F.col("lo")) & ((F.col("piece") + 1) * span <= F.col("hi"))
    sums = [F.sum("mic_sq").alias("mic_sq"), F.sum("system_sq").alias("system_sq")]
    spans = leveled.groupBy("meeting_id", F.floor(F.col("frame") / span).alias("piece")).agg(F.count("*").alias("n"), *sums)
    inner = touched.filter(whole).join(spans, ["meeting_id", "piece"])
    first = F.greatest(F.col("lo"), F.col("piece") * span)
    final = F.least(F.col("hi"), (F.col("piece") + 1) * span) - 1
    edges = touched.filter(~whole).withColumn("frame", F.explode(F.sequence(first, final)))
    outer = edges.join(leveled, ["meeting_id", "frame"]).withColumn("n", F.lit(1).cast("bigint"))
    columns = ["meeting_id", "seg_idx", "n", "mic_sq", "system_sq"]
    return (
        inner.select(*columns)
        .unionByName(outer.select(*columns))
        .groupBy("meeting_id", "seg_idx")
        .agg(F.sum("n").alias("frames"), F.sum("mic_sq").cast("double").alias("mic"), F.sum("system_sq").cast("double").alias("system"))
    )


def segment_sides(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """The side each segment speaks for on its own evidence; null where there is too little."""
    energy = segment_energy(segments, leveled_frames(frames))
    total = F.col("mic") + F.col("system")
    share = F.col("system") / total
    side = F.when(total / F.col("frames") >= LEAST_ENERGY, side_of_share(share))
    return energy.select("meeting_id", "seg_idx", side.alias("_side"))


def side_of_share(share: Column) -> Column:
    return F.when(share >= REMOTE_SHARE, "remote").when(share <= LOCAL_SHARE, "local").otherwise("mixed")


def speaker_sides(segments: DataFrame) -> DataFrame:
    """The side of each speaker by speaking time; a close call is ``mixed``.

    Only unflagged segments that are clearly local or remote vote.
    """
    weight = F.when(duration_us() > 0, duration_us()).otherwise(F.lit(FRAME_US))
    voters = segments.filter(has_speaker() & ~F.col("duplicate") & F.col("source").isin("local", "remote"))
    votes = voters.groupBy("meeting_id", "speaker").agg(
        F.sum(F.when(F.col("source") == "local", weight).otherwise(0)).alias("local"),
        F.sum(F.when(F.col("source") == "remote", weight).otherwise(0)).alias("remote"),
    )
    winner = F.when(F.col("remote") >= F.col("local"), "remote").otherwise("local")
    share = F.greatest("local", "remote") / (F.col("local") + F.col("remote"))
    return votes.select("meeting_id", "speaker", F.when(share >= CONSENSUS_SHARE, winner).otherwise("mixed").alias("side"))


def apply_speaker_sides(segments: DataFrame, sides: DataFrame) -> DataFrame:
    """A speaker's side overrules the readings of its segments."""
    joined = segments.join(sides, ["meeting_id", "speaker"], "left")
    return joined.withColumn("source", F.coalesce("side", "source")).select(*segments.columns)


def attribute_sides(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Segments with their side: own evidence first, then the speaker's overall side."""
    read = segments.join(segment_sides(segments, frames), ["meeting_id", "seg_idx"], "left")
    placed = read.withColumn("source", F.coalesce("_side", "source")).select(*segments.columns)
    return apply_speaker_sides(placed, speaker_sides(placed))


def place_frames(chunks: DataFrame) -> DataFrame:
    """Frames of chunks at the position their audio has: ``(meeting_id, frame, mic, system)``.

    ``chunks`` are ``(meeting_id, seq, offset_samples, mic, system)``. A later chunk overwrites an
    earlier one, gaps are silent, and a chunk without frames counts for nothing.
    """
    begin = F.floor(F.col("offset_samples") / FRAME_SAMPLES + 0.5)
    written = chunks.filter(F.size("mic") > 0).select(
        "meeting_id", "seq", begin.alias("_b"), F.col("system").alias("_system"), F.posexplode("mic").alias("_i", "mic")
    )
    system = F.coalesce(F.get("_system", F.col("_i")), F.lit(0.0))
    laid = (
        written.groupBy("meeting_id", (F.col("_b") + F.col("_i")).alias("frame"))
        .agg(F.max_by(F.struct(F.col("mic"), system.cast("float").alias("system")), "seq").alias("_v"))
        .select("meeting_id", "frame", "_v.mic", "_v.system")
    )
    return laid_out(laid)


def laid_out(laid: DataFrame) -> DataFrame:
    """Every frame of a meeting from the first on, ``(meeting_id, frame, mic, system)``, from those written; the others are silent."""
    held = laid.groupBy("meeting_id", F.floor(F.col("frame") / SPAN).alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("frame", "mic", "system"))).alias("_held"))
    spans = held.groupBy("meeting_id").agg(F.max(F.get("_held", F.size("_held") - 1)["frame"]).alias("_last")).filter("_last >= 0")
    grid = spans.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / SPAN))))
    first, until = F.col("_piece") * SPAN, F.least(F.col("_last"), (F.col("_piece") + 1) * SPAN - 1) + 1
    zero = F.lit(0.0).cast("float")
    run = lambda begin, end, mic, system: F.struct(begin.alias("from"), (end - 1).alias("to"), mic.alias("mic"), system.alias("system"))
    start = lambda i: F.coalesce(F.get("_held", i)["frame"], F.col("_until"))
    sound = lambda h: run(h["frame"], h["frame"] + 1, F.coalesce(h["mic"], zero), F.coalesce(h["system"], zero))
    runs = F.transform(F.coalesce("_held", F.array().cast("array<struct<frame:bigint,mic:float,system:float>>")), lambda h, i: F.array(sound(h), run(h["frame"] + 1, start(i + 1), zero, zero)))
    # pieces meet here, not frames: silence is made where its piece lies and never shuffled
    pieces = grid.join(held, ["meeting_id", "_piece"], "left").withColumn("_first", first).withColumn("_until", until)
    cut = pieces.select("meeting_id", F.explode(F.flatten(F.concat(F.array(F.array(run(F.col("_first"), start(F.lit(0)), zero, zero))), runs))).alias("_r")).filter("_r.from <= _r.to")
    return cut.select("meeting_id", F.explode(F.sequence("_r.from", "_r.to")).alias("frame"), "_r.mic", "_r.system")
