"""From labelled voice windows to speaker turns.

Windows are ``(meeting_id, w_idx, mask_start, mask_end, label, embedding)``; time is measured in
frames of 50 ms. Speech regions are ``(meeting_id, start, end)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.operators.segments import MEETING
from talkframe.plans.blocks import BLK, BLOCK_ROWS, CORE, block_window, runs, scan, with_block, with_halo
from talkframe.session import cut

FRAMES_PER_SECOND = 20
FRAME = 0.05
WINDOW_S, HOP_S, TAIL_S = 1.5, 0.75, 0.3
SHORTEST_TURN = 5  # frames, a quarter of a second
LEAST_SPOKEN = 100  # frames, five seconds
FINE_S, RADIUS = 0.75, 20
REFERENCE_REACH, REFERENCE_MAX = 15, 24


def first_frame(c: Column) -> Column:
    """Frame that holds a time; truncation like an integer cast."""
    return F.floor(c / FRAME)


def end_frame(c: Column) -> Column:
    return F.ceil(c / FRAME)


def plan_windows(regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Overlapping analysis windows over speech: ``(meeting_id, crop_start, mask_start, mask_end)``.

    A region gets a window every hop and one flush with its end where more than 0.3 s would stay
    uncovered; a region shorter than a window gets one crop centred on it.
    """
    span = F.col("end") - F.col("start")
    fits = F.floor((span - WINDOW_S + 1e-6) / HOP_S).cast("int")
    steps = F.transform(
        F.sequence(F.lit(0), fits),
        lambda i: F.struct(
            (F.col("start") + i * HOP_S).alias("crop_start"),
            (F.col("start") + i * HOP_S).alias("mask_start"),
            (F.col("start") + i * HOP_S + WINDOW_S).alias("mask_end"),
        ),
    )
    covered = F.col("start") + fits * HOP_S + WINDOW_S
    flush = F.col("end") - WINDOW_S
    tail = F.array(F.struct(flush.alias("crop_start"), flush.alias("mask_start"), F.col("end").alias("mask_end")))
    long = F.when(F.col("end") - covered > TAIL_S, F.concat(steps, tail)).otherwise(steps)
    centred = F.greatest(F.col("start") - (WINDOW_S - span) / 2, F.lit(0.0))
    crop = F.least(centred, F.greatest(F.col("duration") - WINDOW_S, F.lit(0.0)))
    short = F.array(F.struct(crop.alias("crop_start"), F.col("start").alias("mask_start"), F.col("end").alias("mask_end")))
    planned = regions.join(durations, "meeting_id").select(
        "meeting_id", F.explode(F.when(span >= WINDOW_S, long).otherwise(short)).alias("w")
    )
    return planned.select("meeting_id", "w.*")


def speech_frames(regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Frames that lie in speech, once each."""
    inside = regions.join(durations, "meeting_id").select(
        "meeting_id", first_frame(F.col("start")).alias("lo"), F.least(end_frame(F.col("end")), end_frame(F.col("duration"))).alias("hi")
    )
    return (
        inside.filter(F.col("hi") > F.col("lo"))
        .select("meeting_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame"))
        .distinct()
    )


def frame_votes(windows: DataFrame) -> DataFrame:
    """Per frame the label most windows vote for; among equals the lowest label."""
    lo, hi = first_frame(F.col("mask_start")), end_frame(F.col("mask_end"))
    votes = windows.filter(hi > lo).select("meeting_id", "label", F.explode(F.sequence(lo, hi - 1)).alias("frame"))
    counted = votes.groupBy("meeting_id", "frame", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("meeting_id", "frame").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def nearest_windows(frames: DataFrame, windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label of the window whose centre is nearest to each frame's middle; the earlier among equals.

    Both sides meet in one time order cut into blocks of frames; the latest centre before and the
    first after a frame are carried across blocks.
    """
    at = (F.col("frame") * 2 + 1) * (FRAME / 2)
    centre = (F.col("mask_start") + F.col("mask_end")) / 2
    asked = frames.select("meeting_id", F.col("frame"), at.alias("t"), F.lit(None).cast("int").alias("w_idx"), F.lit(None).cast("int").alias("label"))
    centred = windows.groupBy("meeting_id", centre.alias("t")).agg(F.min("w_idx").cast("int").alias("w_idx"), F.min_by("label", "w_idx").cast("int").alias("label"))
    known = centred.select("meeting_id", F.lit(None).cast("bigint").alias("frame"), "t", "w_idx", "label")
    line = asked.unionByName(known).withColumn(BLK, F.floor(F.col("t") / (FRAME * block_rows)))
    line = line.withColumn("_tie", F.coalesce(F.col("w_idx"), F.lit(2**31 - 1)))
    boxed = F.when(F.col("label").isNotNull(), F.struct("t", "w_idx", "label"))
    seen = scan(line, MEETING, ["t", "_tie"], {"_before": ("last", boxed), "_after": ("after", boxed)})
    back, ahead = F.col("t") - F.col("_before.t"), F.col("_after.t") - F.col("t")
    label = F.when(ahead.isNull() | (back <= ahead), F.col("_before.label")).otherwise(F.col("_after.label"))
    return seen.filter(F.col("frame").isNotNull()).select("meeting_id", "frame", label.alias("label"))


def assign_frames(regions: DataFrame, windows: DataFrame, durations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A label for every frame of speech: the vote, or the nearest window where none votes."""
    return _label_frames(speech_frames(regions, durations), windows, block_rows)


def _label_frames(speech: DataFrame, windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    voted = speech.join(frame_votes(windows), ["meeting_id", "frame"], "left")
    orphans = voted.filter(F.col("label").isNull()).select("meeting_id", "frame")
    filled = nearest_windows(orphans, windows, block_rows)
    return voted.filter(F.col("label").isNotNull()).unionByName(filled.withColumn("label", F.col("label").cast("int")))


def frames_to_turns(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of one label over consecutive frames, at least a quarter of a second long."""
    follows = lambda a, b: (a["frame"] + 1 == b["frame"]) & (a["label"] == b["label"])
    grouped = runs(with_block(frames, "frame", block_rows), MEETING, ["frame"], F.struct("frame", "label"), follows, "_run")
    turns = grouped.groupBy("meeting_id", "_run").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"), F.min("label").alias("label"))
    return turns.filter(F.col("hi") - F.col("lo") >= SHORTEST_TURN).select("meeting_id", "lo", "hi", "label")


def spoken_frames(turns: DataFrame) -> DataFrame:
    return turns.groupBy("meeting_id", "label").agg(F.sum(F.col("hi") - F.col("lo")).alias("spoken"), F.min("lo").alias("first"))


def centroids(windows: DataFrame) -> DataFrame:
    """Mean direction per label, one row per dimension: ``(meeting_id, label, dim, x)``."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = windows.select("meeting_id", "label", norm.alias("_n"), F.posexplode("embedding").alias("dim", "_x"))
    return unit.groupBy("meeting_id", "label", "dim").agg(F.avg(F.col("_x").cast("double") / F.col("_n")).alias("x"))


def fold_marginal(regions: DataFrame, windows: DataFrame, durations: DataFrame) -> DataFrame:
    """Windows after speakers with under five seconds have joined their nearest neighbour.

    Each round every meeting gives up at most its weakest speaker, so the loop is as long as the
    largest number of speakers; what travels through the driver is whether a round changed
    anything. Rounds are cut so that the plan does not grow.
    """
    current = cut(windows)
    speech = cut(speech_frames(regions, durations))
    while True:
        merge = cut(_weakest_merge(speech, current))
        if merge.isEmpty():
            return current
        moved = current.join(merge, ["meeting_id", "label"], "left")
        current = cut(moved.withColumn("label", F.coalesce("_into", "label")).select(*windows.columns))


def _weakest_merge(speech: DataFrame, windows: DataFrame) -> DataFrame:
    """Per meeting the speaker to give up and the one to join: ``(meeting_id, label, _into)``."""
    spoken = spoken_frames(frames_to_turns(cut(_label_frames(speech, windows))))
    weakest = (
        spoken.groupBy("meeting_id")
        .agg(F.min_by(F.struct("label", "spoken"), F.struct("spoken", "first")).alias("_w"), F.count("*").alias("_speakers"))
        .filter((F.col("_speakers") > 1) & (F.col("_w.spoken") < LEAST_SPOKEN))
        .select("meeting_id", F.col("_w.label").alias("label"))
    )
    points = centroids(windows)
    weak = points.join(weakest, ["meeting_id", "label"]).select("meeting_id", F.col("label").alias("_weak"), "dim", F.col("x").alias("_wx"))
    dots = (
        points.join(weak, ["meeting_id", "dim"])
        .filter(F.col("label") != F.col("_weak"))
        .groupBy("meeting_id", "_weak", "label")
        .agg(F.sum(F.col("x") * F.col("_wx")).alias("dot"))
    )
    return dots.groupBy("meeting_id", F.col("_weak").alias("label")).agg(
        F.max_by("label", F.struct("dot", -F.col("label"))).alias("_into")
    )


def name_speakers(turns: DataFrame) -> DataFrame:
    """Turns with stable names, numbered by first appearance."""
    first = turns.groupBy("meeting_id", "label").agg(F.min("lo").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1
    named = first.select("meeting_id", "label", F.format_string("SPEAKER_%02d", rank).alias("speaker"))
    return turns.join(named, ["meeting_id", "label"]).select(
        "meeting_id", (F.col("lo") / FRAMES_PER_SECOND).alias("start"), (F.col("hi") / FRAMES_PER_SECOND).alias("end"), "speaker"
    )


def interior_frames(frames: DataFrame, reach: int = REFERENCE_REACH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frames whose neighbours within ``reach`` all belong to the same speaker.

    The frame line is closed to a ring per meeting, so the first and last frames look at each
    other, as they do for an array that is rolled. ``frames`` must cover every frame; silence has
    label -1.
    """
    last = frames.groupBy("meeting_id").agg((F.max("frame") + 1).alias("_n"))
    ring = frames.join(last, "meeting_id")
    copies = F.array_compact(
        F.array(
            F.col("frame"),
            F.when(F.col("frame") < reach, F.col("frame") + F.col("_n")),
            F.when(F.col("frame") >= F.col("_n") - reach, F.col("frame") - F.col("_n")),
        )
    )
    laid = ring.select("meeting_id", "label", "_n", F.explode(copies).alias("_at")).withColumn("_pos", F.col("_at") + reach)
    near = with_halo(laid, "_pos", before=reach, after=reach, size=block_rows)
    w = block_window(MEETING, "_pos").rowsBetween(-reach, reach)
    alike = (F.min("label").over(w) == F.col("label")) & (F.max("label").over(w) == F.col("label"))
    # Too short a ring leaves fewer neighbours than asked for; those it has decide.
    kept = near.withColumn("_alike", alike).filter(F.col(CORE) & F.col("_alike") & (F.col("label") >= 0))
    return kept.filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).select("meeting_id", F.col("_at").alias("frame"), "label")


def evenly_spaced(rows: DataFrame, keys: list[str], order: str, at_most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """At most ``at_most`` rows per key, evenly spread over its order from the first to the last."""
    ranked = scan(
        with_block(rows, order, block_rows), keys, [order], {"_rank": ("sum", F.lit(1)), "_n": ("all_sum", F.lit(1))}
    )
    rank, n = F.col("_rank") - 1, F.col("_n")
    take = F.least(n, F.lit(at_most))
    # Place i of the spread lies at floor(i * (n - 1) / (take - 1)); a row is on it if some i maps to it.
    place = F.ceil(rank * (take - 1) / (n - 1))
    hit = F.floor(place * (n - 1) / (take - 1)) == rank
    return ranked.filter((n <= at_most) | (take == 1) & (rank == 0) | (take > 1) & hit).select(*rows.columns)


def reference_centroids(embedded: DataFrame) -> DataFrame:
    """Unit mean of unit vectors per speaker: ``(meeting_id, label, centroid)``.

    ``embedded`` are ``(meeting_id, label, embedding)`` taken at the reference frames.
    """
    mean = centroids(embedded)
    norms = mean.groupBy("meeting_id", "label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    unit = mean.join(norms, ["meeting_id", "label"]).withColumn("x", F.col("x") / F.col("_norm"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return unit.groupBy("meeting_id", "label").agg(listed.alias("centroid"))


def speaker_changes(frames: DataFrame, regions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Places inside one speech region where the speaker changes: ``(meeting_id, region, change, low, high, left, right)``."""
    before = scan(with_block(frames, "frame", block_rows), MEETING, ["frame"], {"_prev": ("lag", F.struct("frame", "label"))})
    prev = F.col("_prev")
    changed = before.filter((prev["frame"] == F.col("frame") - 1) & (prev["label"] != F.col("label")) & (prev["label"] >= 0) & (F.col("label") >= 0))
    spans = regions.filter(F.col("end") - F.col("start") >= 2 * FINE_S).select(
        "meeting_id", F.col("start").alias("region"), F.greatest(first_frame(F.col("start")), F.lit(0)).alias("_lo"), end_frame(F.col("end")).alias("_hi")
    )
    # A region is met through the blocks of frames it touches.
    met = spans.withColumn(BLK, F.explode(F.sequence(F.floor(F.col("_lo") / block_rows), F.floor(F.col("_hi") / block_rows))))
    inside = changed.join(met, ["meeting_id", BLK]).filter((F.col("frame") > F.col("_lo")) & (F.col("frame") < F.col("_hi")))
    return inside.select(
        "meeting_id",
        "region",
        F.col("frame").alias("change"),
        F.greatest(F.col("_lo"), F.col("frame") - RADIUS).alias("low"),
        F.least(F.col("_hi"), F.col("frame") + RADIUS).alias("high"),
        prev["label"].alias("left"),
        F.col("label").alias("right"),
    )


def refine_boundaries(frames: DataFrame, changes: DataFrame, fine: DataFrame) -> DataFrame:
    """Frames after the fine windows around each change have voted.

    ``fine`` are ``(meeting_id, change, span_start, span_end, like_left, like_right)``: how alike a
    short window is to the two speakers of a change. A window votes for the more alike one with
    the gap times a weight that falls off from its centre, and only inside the change's zone. Where
    zones meet, the later change has the last word.
    """
    lo, hi = first_frame(F.col("span_start")), end_frame(F.col("span_end"))
    cast = fine.join(changes, ["meeting_id", "change"]).withColumn("_lo", F.greatest("low", lo)).withColumn("_hi", F.least("high", hi))
    cast = cast.filter(F.col("_hi") > F.col("_lo")).withColumn("frame", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    centre = (F.col("span_start") + F.col("span_end")) / 2
    distance = F.abs((F.col("frame") * 2 + 1) * (FRAME / 2) - centre) / FINE_S
    gap = F.col("like_left") - F.col("like_right")
    weight = F.abs(gap) * F.greatest(1 - distance, F.lit(0.0))
    sums = cast.groupBy("meeting_id", "change", "frame", "left", "right").agg(
        F.sum(F.when(gap > 0, weight).otherwise(0.0)).alias("_l"), F.sum(F.when(gap > 0, 0.0).otherwise(weight)).alias("_r")
    )
    decided = sums.filter(F.col("_l") + F.col("_r") > 0)
    label = F.when(F.col("_l") >= F.col("_r"), F.col("left")).otherwise(F.col("right"))
    final = decided.groupBy("meeting_id", "frame").agg(F.max_by(label, "change").alias("_refined"))
    return frames.join(final, ["meeting_id", "frame"], "left").select("meeting_id", "frame", F.coalesce("_refined", "label").alias("label"))
