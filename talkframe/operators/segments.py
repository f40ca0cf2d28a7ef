"""Segments: timing, repeats, dialogue lines and speaker reports.

A segment row is ``(meeting_id, seg_idx, start, end, text, speaker, source, duplicate, overlap)``;
``seg_idx`` is the dense position in the meeting. Flagged rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.plans.blocks import BLK, BLOCK_ROWS, block_window, core_rows, islands, scan, with_block, with_halo

MEETING = ["meeting_id"]


def active(segments: DataFrame) -> DataFrame:
    """Rows that carry text and are no repeat."""
    return segments.filter(~F.col("duplicate") & (X.strip(F.col("text")) != ""))


def shift(segments: DataFrame, offset: Column | str) -> DataFrame:
    """Move segments onto the session's timeline; untimed ones stay untimed."""
    by = F.col(offset) if isinstance(offset, str) else offset
    return segments.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)


SEAM_TOLERANCE = 0.25


def seam_repeat(end: Column, seam: Column) -> Column:
    return F.coalesce(end <= seam + SEAM_TOLERANCE, F.lit(False))


def flag_seam(segments: DataFrame, seam: Column | str) -> DataFrame:
    """Mark segments that end inside the part a round decoded again."""
    at = F.col(seam) if isinstance(seam, str) else seam
    return segments.withColumn("duplicate", F.col("duplicate") | seam_repeat(F.col("end"), at))


# --- repeats ------------------------------------------------------------------------------------

STRONG_FIFTHS, WEAK_FIFTHS = 4, 3  # 0.8 and 0.6 of the words
IMPLAUSIBLE_RATE = 25.0
SHORTEST_REPEAT = 4


def _run_exists(tokens: Column, hay: Column, fifths: int) -> Column:
    """Whether ceil(fifths/5 of ``tokens``) consecutive ones stand in ``hay``.

    Tried per starting word as a substring search between spaces: exact, no pairs of words are
    built, and a word repeated thousands of times costs no more than any other. All such runs
    share their middle words, so one search for those settles nearly every row.
    """
    size = F.size(tokens)
    need = ((size * fifths + 4) / 5).cast("int")
    found = lambda at, n: F.contains(hay, F.concat(F.lit(" "), F.array_join(F.slice(tokens, at, n), " "), F.lit(" ")))
    middle = found(size - need + 1, need - (size - need))
    return middle & F.exists(F.sequence(F.lit(1), size - need + 1), lambda at: found(at, need))


def repeats_before(tokens: Column, hay: Column, rate: Column) -> Column:
    """Whether a segment's words repeat the words before it, given as one line between spaces."""
    weak = F.coalesce(rate > IMPLAUSIBLE_RATE, F.lit(False))
    run = F.when(weak, _run_exists(tokens, hay, WEAK_FIFTHS)).otherwise(_run_exists(tokens, hay, STRONG_FIFTHS))
    return F.when(F.size(tokens) >= SHORTEST_REPEAT, run).otherwise(False)


def flag_repeats(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mark segments that repeat the one or two before them. One shuffle, on (meeting, block)."""
    lined = segments.withColumn("_line", X.word_line(F.col("text")))
    haloed = with_halo(lined, "seg_idx", before=2, size=block_rows)
    w = block_window(MEETING, "seg_idx")
    hay = F.concat_ws(" ", F.lit(""), F.lag("_line", 2).over(w), F.lag("_line", 1).over(w), F.lit(""))
    rows = core_rows(haloed.withColumn("_hay", hay)).withColumn("_tokens", X.split_words(F.col("_line")))
    rate = X.chars_per_second(F.col("text"), F.col("start"), F.col("end"))
    flag = repeats_before(F.col("_tokens"), F.col("_hay"), rate)
    return rows.withColumn("duplicate", F.col("duplicate") | flag).drop("_line", "_hay", "_tokens")


def flag_orphans(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mark a cut-off segment whose words open the next unflagged one it overlaps in time."""
    own = F.struct(F.col("start"), F.col("end"), X.word_line(F.col("text")).alias("line"))
    blocked = with_block(segments.withColumn("_own", own), "seg_idx", block_rows)
    # Flagged rows hold no value, so the next value after a row is its next unflagged neighbour.
    kept = F.when(~F.col("duplicate"), F.col("_own"))
    rows = scan(blocked, MEETING, ["seg_idx"], {"_next": ("after", kept)})
    line, nxt = F.col("_own.line"), F.col("_next")
    together = (F.col("start") < nxt["end"]) & (nxt["start"] < F.col("end"))
    opens = (line != "") & F.startswith(nxt["line"], F.concat(line, F.lit(" ")))
    flag = ~F.col("duplicate") & F.coalesce(together & opens, F.lit(False))
    return rows.withColumn("duplicate", F.col("duplicate") | flag).drop("_own", "_next", BLK)


# --- dialogue -----------------------------------------------------------------------------------

# How a side reads behind a speaker and on its own.
SIDE_ASIDE = {"local": "Yerel", "remote": "Uzak", "mixed": "Karışık"}
SIDE_AS_SPEAKER = {"local": "Yerel Konuşmacı", "remote": "Uzak Konuşmacı", "mixed": "Karışık"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def turn_label(with_speakers: Column, with_sources: Column) -> Column:
    speaker = F.when(with_speakers, F.coalesce(F.col("speaker"), F.lit(X.UNKNOWN_SPEAKER)))
    source = F.col("source")
    return (
        F.when(~with_sources, speaker)
        .when(speaker.isNull(), F.coalesce(_lookup(SIDE_AS_SPEAKER, source), F.lit(X.UNKNOWN_SIDE)))
        .when(source.isNotNull(), F.concat(speaker, F.lit(" ("), _lookup(SIDE_ASIDE, source), F.lit(")")))
        .otherwise(speaker)
    )


def dialogue(
    segments: DataFrame,
    with_speakers: bool | Column = True,
    with_sources: bool | Column = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lines of the attributed dialogue: ``(meeting_id, line_idx, part, label, text)``.

    Consecutive segments with one label share a line. A line that runs over several blocks of
    segments comes in several parts, so that one endless turn never has to sit in one row; parts
    of a line, joined by a space, are its text. A meeting with nothing to attribute with is one
    line without a label.
    """
    spoken = F.lit(with_speakers) if isinstance(with_speakers, bool) else with_speakers
    sided = F.lit(with_sources) if isinstance(with_sources, bool) else with_sources
    blocked = with_block(segments.withColumn("_spoken", spoken).withColumn("_sided", sided), "seg_idx", block_rows)
    known = scan(
        blocked,
        MEETING,
        ["seg_idx"],
        {
            "_has_speaker": ("all_max", F.coalesce(F.col("speaker") != "", F.lit(False))),
            "_has_source": ("all_max", F.coalesce(F.col("source") != "", F.lit(False))),
        },
    )
    label = turn_label(F.col("_spoken") & F.col("_has_speaker"), F.col("_sided") & F.col("_has_source"))
    labelled = active(known).select("meeting_id", "seg_idx", BLK, label.alias("label"), X.strip(F.col("text")).alias("text"))
    lines = islands(labelled, MEETING, ["seg_idx"], F.col("label"), "line_idx")
    said = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"])
    return (
        lines.groupBy("meeting_id", "line_idx", F.col(BLK).alias("part"))
        .agg(F.max("label").alias("label"), said.alias("_said"))
        .select("meeting_id", "line_idx", "part", "label", X.squeeze(F.array_join("_said", " ")).alias("text"))
    )


def side_dialogue(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return dialogue(segments, False, True, block_rows)


def transcript_lines(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The transcript as a person reads it: speaker and side."""
    return dialogue(segments, True, True, block_rows)


def analysis_lines(segments: DataFrame, include_speakers: bool, two_party: bool | Column = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What is analysed. A two-party meeting reads by side, whatever ``include_speakers`` says."""
    declared = F.lit(two_party) if isinstance(two_party, bool) else two_party
    return dialogue(segments, ~declared & F.lit(include_speakers), declared, block_rows)


def reanalysis_segments(segments: DataFrame, include_speakers: bool, scope: Column) -> DataFrame:
    """Segments as a repeated analysis sees them: the speaker goes unless it is asked for or sides speak."""
    keep = (scope == "two-party") | F.lit(include_speakers)
    return segments.withColumn("speaker", F.when(keep, F.col("speaker")))


def line_text(lines: DataFrame) -> DataFrame:
    """Lines as they are printed; only the first part of a line carries its label."""
    first = F.col("part") == F.min("part").over(Window.partitionBy("meeting_id", "line_idx"))
    opened = F.when(first & F.col("label").isNotNull(), F.concat(F.col("label"), F.lit(": "), F.col("text")))
    return lines.withColumn("line", F.coalesce(opened, F.col("text")))


def clock(seconds: Column) -> Column:
    total = F.greatest(F.floor(seconds + 0.5), F.lit(0))
    two = lambda c: F.when(c > 99, c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))
    return F.when(seconds.isNull(), F.lit("--:--")).otherwise(
        F.concat(two(F.floor(total / 60)), F.lit(":"), two(total % 60))
    )


def readable_lines(segments: DataFrame) -> DataFrame:
    """One printable line per segment: clock, speaker, text, flags."""
    flags = F.concat_ws(" ", F.when(F.col("duplicate"), F.lit("DUP")), F.when(F.col("overlap"), F.lit("OVERLAP")))
    suffix = F.when(flags != "", F.concat(F.lit("   ["), flags, F.lit("]"))).otherwise("")
    line = F.concat(
        F.lit("["), clock(F.col("start")), F.lit("-"), clock(F.col("end")), F.lit("] "),
        F.coalesce("speaker", F.lit(X.UNKNOWN_SPEAKER)), F.lit(": "), X.strip(F.col("text")), suffix,
    )
    return segments.select("meeting_id", "seg_idx", line.alias("line"))


# --- reports ------------------------------------------------------------------------------------


def micros(c: Column) -> Column:
    """Seconds as whole microseconds, so that sums do not depend on their order."""
    return F.floor(c * 1e6 + 0.5)


def duration_us() -> Column:
    return F.coalesce(F.greatest(micros(F.col("end")) - micros(F.col("start")), F.lit(0)), F.lit(0))


def has_speaker() -> Column:
    return F.coalesce(F.col("speaker") != "", F.lit(False))


def speaker_shares(segments: DataFrame) -> DataFrame:
    """Per speaker, in order of first appearance: segments, seconds and share of labelled time."""
    per = (
        segments.filter(has_speaker())
        .groupBy("meeting_id", "speaker")
        .agg(F.count("*").alias("segments"), F.sum(duration_us()).alias("_us"), F.min("seg_idx").alias("_first"))
    )
    of_meeting = Window.partitionBy("meeting_id")
    total = F.sum("_us").over(of_meeting)
    return per.select(
        "meeting_id",
        F.row_number().over(of_meeting.orderBy("_first")).cast("bigint").alias("appearance"),
        "speaker",
        "segments",
        X.half_up(F.col("_us") / 1e6, 1).alias("seconds"),
        F.when(total > 0, X.half_up(F.col("_us") / total, 3)).otherwise(F.lit(0.0)).alias("share"),
    )


def count_turns(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Turns per meeting over labelled rows only; an unlabelled gap does not end a turn."""
    labelled = with_block(segments.filter(has_speaker()).select("meeting_id", "seg_idx", "speaker"), "seg_idx", block_rows)
    inside = block_window(MEETING, "seg_idx")
    changed = F.lag("speaker").over(inside) != F.col("speaker")
    blocks = (
        labelled.withColumn("_changed", F.coalesce(changed, F.lit(False)).cast("bigint"))
        .groupBy("meeting_id", BLK)
        .agg(F.sum("_changed").alias("_inner"), F.min_by("speaker", "seg_idx").alias("_first"), F.max_by("speaker", "seg_idx").alias("_last"))
    )
    last_before = F.lag("_last").over(Window.partitionBy("meeting_id").orderBy(BLK))
    opening = (last_before.isNull() | (last_before != F.col("_first"))).cast("bigint")
    return blocks.withColumn("_open", opening).groupBy("meeting_id").agg(F.sum(F.col("_inner") + F.col("_open")).alias("turns"))


def speaker_report(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per meeting: speakers, turns, switches, unlabelled time, overlap flags."""
    spoken = has_speaker()
    by_speaker = segments.groupBy("meeting_id", F.when(spoken, F.col("speaker")).alias("_who")).agg(
        F.count("*").alias("_n"), F.sum(duration_us()).alias("_us"), F.count_if(F.col("overlap")).alias("_overlap")
    )
    nobody = F.col("_who").isNull()
    per_meeting = by_speaker.groupBy("meeting_id").agg(
        F.count_if(~nobody).alias("speaker_count"),
        F.coalesce(F.sum(F.when(nobody, F.col("_n"))), F.lit(0)).alias("unlabeled"),
        F.coalesce(F.sum(F.when(nobody, F.col("_us"))), F.lit(0)).alias("_unlabeled_us"),
        F.coalesce(F.sum(F.when(~nobody, F.col("_us"))), F.lit(0)).alias("_labeled_us"),
        F.sum("_overlap").alias("overlap_flags"),
    )
    turns = F.coalesce(F.col("turns"), F.lit(0))
    return per_meeting.join(count_turns(segments, block_rows), "meeting_id", "left").select(
        "meeting_id",
        "speaker_count",
        turns.alias("turns"),
        F.greatest(turns - 1, F.lit(0)).alias("switches"),
        "unlabeled",
        X.half_up(F.col("_unlabeled_us") / 1e6, 1).alias("unlabeled_seconds"),
        "overlap_flags",
        X.half_up(F.col("_labeled_us") / 1e6, 1).alias("labeled_seconds"),
    )


def expected_speakers(report: DataFrame, expected: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Found against expected speaker counts; an unknown expectation gets no verdict."""
    n = F.col("n")
    verdict = F.when(n.isNull(), F.lit("unknown")).when(n == F.col("speaker_count"), F.lit("ok")).otherwise("differs")
    return report.join(expected, scenario, "left").withColumn("verdict", verdict)


def flag_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("meeting_id").agg(
        F.count_if("duplicate").alias("duplicate_flags"), F.count_if("overlap").alias("overlap_flags")
    )


def timestamp_quality(segments: DataFrame) -> DataFrame:
    """How many boundaries exist and how many of them are not stuck to whole seconds."""
    edges = segments.select("meeting_id", F.explode(F.array("start", "end")).alias("at"))
    counted = edges.groupBy("meeting_id").agg(
        F.count("at").alias("boundaries"), F.count_if(F.col("at") != F.floor("at")).alias("decimal")
    )
    ratio = F.when(F.col("boundaries") > 0, F.col("decimal") / F.col("boundaries")).otherwise(F.lit(0.0))
    return counted.select(
        "meeting_id", "boundaries", "decimal", (F.col("boundaries") - F.col("decimal")).alias("integer_stuck"), ratio.alias("decimal_ratio")
    )


def correct(segments: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    return segments.withColumn("text", X.correct_words(F.col("text"), dictionary))


def long_form_windows(segments: DataFrame, length: float = 30.0, overlap: float = 5.0) -> DataFrame:
    """Which fixed decoding windows a segment's start lies in: length 30 s, stride 20 s, 5 s shared at each side."""
    stride = length - 2 * overlap
    at = F.col("start")
    first = F.greatest(F.floor((at - length) / stride) + 1, F.lit(0))
    return segments.filter(at.isNotNull()).withColumn("window", F.explode(F.sequence(first, F.floor(at / stride))))


def emission_slices(segments: DataFrame, length: float = 8.0) -> DataFrame:
    return segments.filter(F.col("start").isNotNull()).withColumn("slice", F.floor(F.col("start") / length))
