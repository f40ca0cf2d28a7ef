"""Loudness of a running meeting: frames measured from sound as it comes, and laid where their sound lies.

A trigger touches only the state that its chunks reach: written frames are a running aggregate by frame, unfinished
sums are kept per meeting and block of frames. A chunk's place follows from its offset and not from when it comes; what
is stored is the same for shuffled, repeated, overlapping and late chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkframe.operators.sides import FRAME_SAMPLES, laid_out
from talkframe.session import runs_in_tasks
from talkframe.streaming.ordered import IDLE_MS

runs_in_tasks(__name__)

BLOCK_FRAMES = 256

MEASURED = "meeting_id string, frame bigint, mic double, system double"


class _Block(StatefulProcessor):
    """State of one block; with a watermark it goes when nothing has come for 40 minutes."""

    STATE = ""

    def __init__(self, timed: bool) -> None:
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", self.STATE)
        self.due = handle.getValueState("due", "at bigint")

    def keep(self, value: tuple, newest: int, times) -> None:
        self.state.update(value)
        if self.timed:
            before = self.due.get()[0] if self.due.exists() else -1
            then = max(newest + IDLE_MS, times.getCurrentWatermarkInMs() + 1, before)
            if then != before:
                if before >= 0:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(then)
                self.due.update((then,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Measured(_Block):
    """Sums of squares of the frames of one block that are not whole yet, and which chunks they hold."""

    STATE = "taken array<bigint>, samples array<int>, mic array<double>, system array<double>"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            taken, samples, mic, system = self.state.get()
            taken, samples, mic, system = set(taken), np.array(samples, np.int64), np.array(mic), np.array(system)
        else:
            taken, samples, mic, system = set(), np.zeros(BLOCK_FRAMES, np.int64), np.zeros(BLOCK_FRAMES), np.zeros(BLOCK_FRAMES)
        newest, done = 0, []
        for batch in rows:
            for seq, when, at, ours, theirs in batch[["seq", "at", "first", "mic", "system"]].itertuples(index=False, name=None):
                newest = max(newest, int(when))
                if seq in taken:
                    continue
                taken.add(int(seq))
                place = (int(at) + np.arange(len(ours))) // FRAME_SAMPLES
                np.add.at(samples, place, 1)
                np.add.at(mic, place, np.asarray(ours, np.float64) ** 2)
                np.add.at(system, place[: len(theirs)], np.asarray(theirs, np.float64) ** 2)
        whole = np.flatnonzero(samples >= FRAME_SAMPLES)
        done = pd.DataFrame({"meeting_id": key[0], "frame": key[1] * BLOCK_FRAMES + whole, "mic": np.sqrt(mic[whole] / FRAME_SAMPLES), "system": np.sqrt(system[whole] / FRAME_SAMPLES)})
        # a frame that is out counts for nothing any more
        samples[whole] = -(2**31)
        self.keep((sorted(taken), samples.tolist(), mic.tolist(), system.tolist()), newest, timerValues)
        if len(done):
            yield done


def _pieces(chunks: DataFrame, begin: Column, length: int, lateness: str | None) -> DataFrame:
    """What chunks write into each block of ``length`` values: ``(meeting_id, block, seq, at, first, mic, system)``."""
    timely = chunks.withWatermark("event_time", lateness) if lateness else chunks
    when = F.unix_millis("event_time") if lateness else F.lit(0).cast("bigint")
    extra = ["event_time"] if lateness else []
    system = F.coalesce("system", F.array().cast("array<float>"))
    size = F.size("mic")
    some = timely.filter(size > 0).select(F.col("meeting_id").cast("string"), "seq", when.alias("at"), begin.cast("bigint").alias("_b"), "mic", system.alias("system"), *extra)
    cut = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("_b") / length), F.floor((F.col("_b") + F.size("mic") - 1) / length))))
    first = F.greatest(F.col("_b"), F.col("block") * length)
    last = F.least(F.col("_b") + F.size("mic"), (F.col("block") + 1) * length)
    part = lambda c: F.slice(c, (first - F.col("_b") + 1).cast("int"), (last - first).cast("int"))
    return cut.select("meeting_id", "block", "seq", "at", (first - F.col("block") * length).alias("first"), part(F.col("mic")).alias("mic"), part(F.col("system")).alias("system"), *extra)


def _by_block(pieces: DataFrame, make: Callable[[bool], _Block], out: str, mode: str, timed: bool) -> DataFrame:
    return pieces.groupBy("meeting_id", "block").transformWithStateInPandas(make(timed), out, mode, "EventTime" if timed else "None")


def placed_blocks(chunks: DataFrame, lateness: str | None = None) -> DataFrame:
    """Frames that a trigger's chunks reach, as they stand then (update mode): ``(meeting_id, frame, seq, mic, system)``.

    ``chunks`` are ``(meeting_id, seq, offset_samples, mic, system)`` with a value per frame; they go
    where ``sides.place_frames`` puts them, and the latest ``seq`` counts. Chunks later than ``lateness`` are
    dropped; a frame's state then goes by the time of the chunk that wrote it.
    """
    timely = chunks.withWatermark("event_time", lateness) if lateness else chunks
    times = ["event_time"] if lateness else []
    begin = F.floor(F.col("offset_samples") / FRAME_SAMPLES + 0.5)
    written = timely.filter(F.size("mic") > 0).select(
        F.col("meeting_id").cast("string"), "seq", *times, begin.alias("_b"), F.col("system").alias("_system"), F.posexplode("mic").alias("_i", "mic")
    )
    silent = F.lit(0.0).cast("float")
    system = F.coalesce(F.get("_system", F.col("_i")), silent)
    by_frame = written.groupBy("meeting_id", (F.col("_b") + F.col("_i")).alias("frame"), *times)
    latest = by_frame.agg(F.max("seq").alias("seq"), F.max_by(F.coalesce("mic", silent), "seq").alias("mic"), F.max_by(system, "seq").alias("system"))
    return latest.drop(*times)


def envelope(frames: DataFrame) -> DataFrame:
    """``(meeting_id, frame, mic, system)`` from what ``placed_blocks`` has stored, trigger by trigger: the latest of each frame, gaps silent."""
    latest = frames.groupBy("meeting_id", "frame").agg(F.max_by("mic", "seq").alias("mic"), F.max_by("system", "seq").alias("system"))
    return laid_out(latest)


def measured_frames(chunks: DataFrame, lateness: str | None = None) -> DataFrame:
    """``(meeting_id, frame, mic, system)``: loudness of every frame once all its samples are there (append mode).

    ``chunks`` are ``(meeting_id, seq, offset_samples, mic, system)`` with a value per sample. A
    frame that ends in another chunk waits; a chunk that comes again counts once; a frame short of samples never comes out.
    """
    pieces = _pieces(chunks, F.col("offset_samples"), BLOCK_FRAMES * FRAME_SAMPLES, lateness)
    return _by_block(pieces, _Measured, MEASURED, "append", lateness is not None)
