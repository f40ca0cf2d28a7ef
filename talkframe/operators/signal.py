"""Energy of sampled sound: frames, speech bounds, mixing and resampling.

Samples are ``(meeting_id, sample_idx, value)`` with a dense index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.operators.segments import MEETING
from talkframe.plans.blocks import BLOCK_ROWS, CORE, block_window, order_statistics, with_halo

SPEECH_FRAME = 512
SPEECH_RUN = 6  # frames, about 200 ms
PAD = 8_000  # samples, half a second
FLOOR_FACTOR, FAINTEST, PEAK_PART, GAPLESS_FLOOR = 3, 1e-3, 0.3, 0.032


def frame_energy(samples: DataFrame, frame_samples: int = SPEECH_FRAME) -> DataFrame:
    """RMS per whole frame; a frame short of samples at the end is dropped."""
    frame = F.floor(F.col("sample_idx") / frame_samples)
    x = F.col("value").cast("double")
    squares = samples.groupBy("meeting_id", frame.alias("frame")).agg(F.sum(x * x).alias("_sq"), F.count("*").alias("_n"))
    whole = squares.filter(F.col("_n") == frame_samples)
    return whole.select("meeting_id", "frame", F.sqrt(F.col("_sq") / frame_samples).alias("rms"))


def speech_threshold(energy: DataFrame) -> DataFrame:
    """Level above which a frame is loud, from each meeting's own noise floor."""
    tenth = lambda n: F.least(n - 1, F.floor(F.lit(0.1) * n))
    floor = order_statistics(energy, MEETING, F.col("rms"), {"floor": tenth})
    peak = energy.groupBy("meeting_id").agg(F.max("rms").alias("peak"))
    lifted = F.col("floor") * FLOOR_FACTOR
    capped = F.when(F.col("floor") > GAPLESS_FLOOR, F.least(lifted, F.col("peak") * PEAK_PART)).otherwise(lifted)
    return floor.join(peak, "meeting_id").select("meeting_id", F.greatest(capped, F.lit(FAINTEST)).alias("threshold"))


def speech_bounds(energy: DataFrame, lengths: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First and last sample of speech per meeting of ``lengths(meeting_id, n_samples)``, padded.

    A frame opens a lasting run when it and the next five are loud, and closes one when it and
    the five before are; so a look at five neighbours is enough and no run has to be put
    together. Null bounds mean no speech.
    """
    loud = energy.join(speech_threshold(energy), "meeting_id").withColumn("_loud", (F.col("rms") > F.col("threshold")).cast("int"))
    near = with_halo(loud, "frame", before=SPEECH_RUN - 1, after=SPEECH_RUN - 1, size=block_rows)
    w = block_window(MEETING, "frame")
    onward = F.sum("_loud").over(w.rowsBetween(0, SPEECH_RUN - 1)) == SPEECH_RUN
    back = F.sum("_loud").over(w.rowsBetween(-(SPEECH_RUN - 1), 0)) == SPEECH_RUN
    marked = near.withColumn("_opens", onward).withColumn("_closes", back).filter(F.col(CORE))
    runs = marked.groupBy("meeting_id").agg(
        F.min(F.when(F.col("_opens"), F.col("frame"))).alias("_first"), F.max(F.when(F.col("_closes"), F.col("frame"))).alias("_last")
    )
    start = F.greatest(F.col("_first") * SPEECH_FRAME - PAD, F.lit(0))
    end = F.least(F.col("n_samples"), (F.col("_last") + 1) * SPEECH_FRAME + PAD)
    found = F.col("_first").isNotNull()
    return lengths.join(runs, "meeting_id", "left").select(
        "meeting_id",
        F.when(found, start).alias("start_sample"),
        F.when(found, end).alias("end_sample"),
        found.alias("has_speech"),
    )


def spoken_only(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """Samples inside the speech bounds; what costly steps should read."""
    spoken = bounds.filter(F.col("has_speech"))
    inside = (F.col("sample_idx") >= F.col("start_sample")) & (F.col("sample_idx") < F.col("end_sample"))
    return samples.join(spoken, "meeting_id").filter(inside).select(*samples.columns)


def mix_down(samples: DataFrame) -> DataFrame:
    """Mean over the channels of ``(meeting_id, channel, sample_idx, value)``."""
    return samples.groupBy("meeting_id", "sample_idx").agg(F.avg("value").alias("value"))


def resample(samples: DataFrame, lengths: DataFrame, from_rate: int, to_rate: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation to another rate.

    Each sample writes the output positions that fall between it and its successor, which is
    one row away; the last sample stands alone.
    """
    ratio = F.lit(from_rate / to_rate)
    near = with_halo(samples, "sample_idx", after=1, size=block_rows)
    w = block_window(MEETING, "sample_idx")
    paired = near.withColumn("_next", F.coalesce(F.lead("value").over(w), F.col("value"))).filter(F.col(CORE))
    idx = F.col("sample_idx")
    around = F.sequence(F.greatest(F.floor(idx / ratio) - 1, F.lit(0)), F.floor((idx + 1) / ratio) + 1)
    at = F.col("_out") * ratio
    placed = paired.withColumn("_out", F.explode(around)).filter(F.floor(at) == idx)
    bounded = placed.join(lengths, "meeting_id").filter(F.col("_out") < F.floor(F.col("n_samples") / ratio))
    value: Column = F.col("value") + (F.col("_next") - F.col("value")) * (at - idx)
    return bounded.select("meeting_id", F.col("_out").alias("sample_idx"), value.alias("value"))
