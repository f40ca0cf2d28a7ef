"""Who speaks in a segment: segments meet the running speech of every speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.operators.segments import MEETING, micros
from talkframe.plans.blocks import BLK, scan
from talkframe.session import cut

LEAST_SHARED_US = 500_000
#: Seconds from zero beyond which a time counts as this; infinite and absurd times lie here.
FAR = 4e9
#: Time that one task of the sweep sees of a speaker, about; rows decide how many there are.
SWEEP_US = 600_000_000
LOW_BITS = 26
#: Turns that a segment is compared with one by one are fewer than two to this power.
LOW_NODE = 6


def valid_turns(turns: DataFrame) -> DataFrame:
    """Turns with finite times and a speaker."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return turns.filter(finite("start") & finite("end") & F.col("speaker").isNotNull())


def _at(seconds: Column) -> Column:
    return micros(F.least(F.greatest(seconds, F.lit(-FAR)), F.lit(FAR))).cast("bigint")


def _timed(segments: DataFrame) -> DataFrame:
    """``(meeting_id, seg_idx, s, e)`` of the segments that last."""
    known = segments.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end"))
    return known.select("meeting_id", "seg_idx", _at(F.col("start")).alias("s"), _at(F.col("end")).alias("e")).filter("e > s")


def _spoken(turns: DataFrame) -> DataFrame:
    """``(meeting_id, turn_idx, who, s, e)`` of the turns that last."""
    rows = valid_turns(turns).select("meeting_id", "turn_idx", F.col("speaker").alias("who"), _at(F.col("start")).alias("s"), _at(F.col("end")).alias("e"))
    return rows.filter("e > s")


def shared_time(segments: DataFrame, turns: DataFrame, sweep_us: int = SWEEP_US) -> DataFrame:
    """Microseconds each segment shares with each speaker: ``(meeting_id, seg_idx, speaker, shared_us)``.

    What a speaker has said up to a moment is running sums over the edges of turns; a segment shares what
    was said up to its end less what was said up to its start. Both ends of a segment stand among the
    edges of every speaker of its meeting, so rows follow the number of turns and of segments times speakers and never
    how long a segment is. Equal turns count each.
    """
    spoken = _spoken(turns)
    speakers = spoken.select("meeting_id", "who").distinct()
    none = F.lit(None).cast("bigint")
    edge = lambda c, d: F.struct(F.col(c).alias("x"), F.lit(d).alias("d"))
    edges = spoken.select("meeting_id", "who", F.explode(F.array(edge("s", 1), edge("e", -1))).alias("_e")).select("meeting_id", "who", "_e.x", "_e.d", none.alias("seg_idx"), F.lit(0).alias("sign"))
    ends = _timed(segments).select("meeting_id", "seg_idx", F.explode(F.array(edge("s", -1), edge("e", 1))).alias("_e"))
    asked = ends.join(speakers, "meeting_id").select("meeting_id", "who", "_e.x", F.lit(0).alias("d"), F.col("seg_idx").cast("bigint"), F.col("_e.d").alias("sign"))
    line = edges.unionByName(asked).withColumn(BLK, F.floor(F.col("x") / sweep_us))
    # times are summed in two parts, so that no running sum leaves a long whatever the times are
    upper, lower = F.call_function("shiftright", F.col("x"), F.lit(LOW_BITS)), F.col("x").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    sums = {"_open": ("sum", F.col("d")), "_upper": ("sum", F.col("d") * upper), "_lower": ("sum", F.col("d") * lower)}
    swept = scan(line, [*MEETING, "who"], ["x"], sums).filter("sign <> 0")
    said = (F.col("_open") * upper - F.col("_upper")) * (1 << LOW_BITS) + (F.col("_open") * lower - F.col("_lower"))
    total = swept.groupBy("meeting_id", "seg_idx", F.col("who").alias("speaker")).agg(F.sum(F.col("sign") * said).alias("shared_us"))
    return total.filter(F.col("shared_us") > 0)


def first_turns(pairs: DataFrame, segments: DataFrame, turns: DataFrame, sweep_us: int = SWEEP_US, low: int = LOW_NODE) -> DataFrame:
    """``pairs(meeting_id, seg_idx, speaker, ...)`` with ``first_turn``, the speaker's turn in the segment that is listed first.

    A segment meets the turns that begin before its end and end after its start. Turns are ranked by their
    begin, so the first condition leaves the lowest ranks; these are at most one run of each power of two, and
    a rest that is compared turn by turn. Within a run, the turns that end after a start are a running
    minimum by falling end. Rows grow with segments and turns times a logarithm, however many turns lie in a segment.
    """
    keys, line = ["meeting_id", "seg_idx"], ["meeting_id", "who"]
    none, shift = F.lit(None).cast("bigint"), lambda c, k: F.call_function("shiftright", c, k)
    asked = pairs.select(*keys, F.col("speaker").alias("who")).join(_timed(segments), keys)
    # at equal times a question comes before the turns, which begin or end there and share nothing
    ends = asked.select(*keys, "who", F.col("e").alias("x"), F.lit(0).alias("d"), F.col("s").alias("y"), none.alias("turn"))
    begins = _spoken(turns).select("meeting_id", none.alias("seg_idx"), "who", F.col("s").alias("x"), F.lit(1).alias("d"), F.col("e").alias("y"), F.col("turn_idx").cast("bigint").alias("turn"))
    both = ends.unionByName(begins).withColumn(BLK, F.floor(F.col("x") / sweep_us))
    ranked = scan(both, line, ["x", "d", "y", "turn"], {"_upto": ("sum", F.col("d")), "_all": ("all_sum", F.col("d"))})
    ranked = cut(ranked.select(*line, "seg_idx", "d", "y", "turn", (F.col("_upto") - F.col("d")).alias("rank"), "_all"))

    question, rank = F.col("d") == 0, F.col("rank")
    runs = F.filter(F.sequence(F.lit(low), F.lit(62)), lambda k: (shift(F.col("_all"), k) > 0) & (shift(rank, k) % 2 == 1 - F.col("d")))
    parted = ranked.withColumn("k", F.explode(runs)).withColumn("node", shift(rank, F.col("k")) - F.lit(1) + F.col("d"))
    falling = parted.select(*line, "k", "node", "seg_idx", "d", "turn", (-F.col("y")).alias("x")).withColumn(BLK, F.floor(F.col("x") / sweep_us))
    least = scan(falling, [*line, "k", "node"], ["x", "d"], {"_least": ("max", -F.col("turn"))})
    found = least.filter(question & F.col("_least").isNotNull()).select(*keys, "who", (-F.col("_least")).alias("turn"))

    rest = ranked.withColumn("node", shift(rank, F.lit(low)))
    here = rest.filter(question).select(*keys, "who", "node", "rank", F.col("y").alias("s"))
    listed = rest.filter(~question).select(*line, "node", "turn", F.col("rank").alias("_r"), F.col("y").alias("te"))
    near = here.join(listed, [*line, "node"]).filter((F.col("_r") < rank) & (F.col("te") > F.col("s"))).select(*keys, "who", "turn")

    first = found.unionByName(near).groupBy(*keys, F.col("who").alias("speaker")).agg(F.min("turn").alias("first_turn"))
    return pairs.join(first, [*keys, "speaker"])


def assign_speakers(segments: DataFrame, turns: DataFrame, sweep_us: int = SWEEP_US) -> DataFrame:
    """Give each segment the speaker it shares most time with, and flag talk at the same time.

    Among equals the speaker whose overlapping turn is listed first wins. A segment is flagged
    when two speakers each share at least half a second and three tenths of it. Segments without
    times, without a turn, or in a meeting without turns keep what they have.
    """
    keys = ["meeting_id", "seg_idx"]
    heard = cut(shared_time(segments, turns, sweep_us).join(_timed(segments).select(*keys, (F.col("e") - F.col("s")).alias("_len")), keys))
    lasting = F.col("shared_us") * 10 >= F.col("_len") * 3
    most = heard.groupBy(*keys).agg(
        F.max("shared_us").alias("_most"), F.max_by("speaker", "shared_us").alias("_who"), F.count_if((F.col("shared_us") >= LEAST_SHARED_US) & lasting).alias("_present")
    )
    equal = heard.join(most.select(*keys, "_most"), keys).filter(F.col("shared_us") == F.col("_most")).select(*keys, "speaker")
    tied = equal.join(equal.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_semi")
    settled = first_turns(cut(tied), segments, turns, sweep_us).groupBy(*keys).agg(F.min_by("speaker", "first_turn").alias("_first"))
    verdict = most.join(settled, keys, "left").select(*keys, F.coalesce("_first", "_who").alias("_who"), "_present")
    return (
        segments.join(verdict, keys, "left")
        .withColumn("speaker", F.coalesce("_who", "speaker"))
        .withColumn("overlap", F.col("overlap") | F.coalesce(F.col("_present") >= 2, F.lit(False)))
        .select(*segments.columns)
    )
