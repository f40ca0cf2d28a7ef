"""Comparing a run with its reference: word errors, term recall, invented sentences, metric rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.session import runs_in_tasks

runs_in_tasks(__name__)

MEGABYTE = 1024 * 1024


#: Product of two lengths up to which one cell may hold the whole table of distances.
SMALL_TABLE = 1 << 20


def _letter(index: Column) -> Column:
    """A character of its own for each index, counted past ASCII and past the surrogates."""
    code = F.when(index + 256 < 0xD800, index + 256).otherwise(index + 256 + 2048)
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def _small_distance(heard: Column, meant: Column) -> Column:
    """Each word of ``meant`` becomes one character; words that only ``heard`` has can never match, so they share one."""
    none = _letter(F.lit(0))

    def spelt(known: Column, letters: Column) -> Column:
        spell = lambda ws: F.array_join(F.transform(ws, lambda w: F.coalesce(F.get(letters, F.array_position(known, w) - 1), none)), "")
        return F.levenshtein(spell(heard), spell(meant))

    alphabet = lambda known: F.transform(known, lambda _, i: _letter(i + 1))
    return X.let(F.array_distinct(meant), lambda known: X.let(alphabet(known), lambda letters: spelt(known, letters)))


def bit_distance(heard: Sequence[str], meant: Sequence[str]) -> int:
    """Edit distance by columns of bits: one step of whole-number arithmetic per word of ``heard``.

    A column of the table of distances differs from place to place by one at most; bits say where it
    rises and where it falls, for all words of ``meant`` at once. Equal words at both ends are left out first.
    """
    begin, ends = 0, (len(heard), len(meant))
    while begin < min(ends) and heard[begin] == meant[begin]:
        begin += 1
    while min(ends) > begin and heard[ends[0] - 1] == meant[ends[1] - 1]:
        ends = (ends[0] - 1, ends[1] - 1)
    heard, meant = heard[begin : ends[0]], meant[begin : ends[1]]
    if not len(meant):
        return len(heard)
    full, top = (1 << len(meant)) - 1, 1 << (len(meant) - 1)
    places: dict[str, list[int]] = {}
    for i, word in enumerate(meant):
        places.setdefault(word, []).append(i)
    where = {}
    for word in set(heard) & places.keys():
        marks = bytearray(len(meant) // 8 + 1)
        for i in places[word]:
            marks[i >> 3] |= 1 << (i & 7)
        where[word] = int.from_bytes(marks, "little")
    rises, falls, distance = full, 0, len(meant)
    for word in heard:
        equal = where.get(word, 0)
        kept = equal | falls
        carried = (((equal & rises) + rises) ^ rises) | equal
        up, down = falls | (full & ~(carried | rises)), rises & carried
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) | 1, down << 1
        rises, falls = (down | (full & ~(kept | up))) & full, up & kept & full
    return distance


def _long_distance(heard: Column, meant: Column) -> Column:
    @F.pandas_udf("int")
    def measured(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else bit_distance(a.tolist(), b.tolist()) for a, b in zip(left, right)], dtype="Int32")

    return measured(heard, meant)


def word_distance(heard: Column, meant: Column, long_texts: bool = True) -> Column:
    """Edit distance between two arrays of words.

    Short ones are compared inside the row's expression. The table of two long ones takes too long
    in a cell, so its columns are kept as bits, all words of one text to a step. Without ``long_texts``
    every row stays in the expression, which suits references of a few hundred words.
    """
    if not long_texts:
        return _small_distance(heard, meant)
    small = F.size(heard).cast("bigint") * F.size(meant) <= SMALL_TABLE
    long = _long_distance(F.when(~small, heard), F.when(~small, meant))
    return F.when(small, _small_distance(heard, meant)).otherwise(long)


def word_errors(runs: DataFrame, text: str = "text", reference: str = "reference", long_texts: bool = True) -> DataFrame:
    """Adds ``distance``, ``ref_tokens``, ``hyp_tokens`` and ``wer``; null where there is no reference."""
    return _word_errors(runs.withColumn("_line", X.compare_line(F.col(text))), reference, long_texts).drop("_line")


def _word_errors(lined: DataFrame, reference: str, long_texts: bool) -> DataFrame:
    """The word errors of runs whose text stands in its comparison form as ``_line``, which stays."""
    heard, meant = F.col("_heard"), F.col("_meant")
    worded = lined.withColumn("_heard", X.split_words(F.col("_line"))).withColumn("_meant", X.compare_words(F.col(reference)))
    known = lambda c: F.when(F.col(reference).isNotNull(), c)
    apart = word_distance(F.coalesce(heard, F.array().cast("array<string>")), F.coalesce(meant, F.array().cast("array<string>")), long_texts)
    measured = (
        worded.withColumn("ref_tokens", known(F.size(meant)))
        .withColumn("hyp_tokens", F.size(heard))
        .withColumn("distance", known(F.when(F.size(meant) == 0, F.size(heard)).otherwise(apart)))
    )
    rate = F.when(F.col("ref_tokens") > 0, F.col("distance") / F.col("ref_tokens")).otherwise(F.when(F.col("hyp_tokens") > 0, 1.0).otherwise(0.0))
    return measured.withColumn("wer", known(rate)).drop("_heard", "_meant")


def _listed(terms: DataFrame) -> DataFrame:
    return terms.withColumn("_n", X.compare_line(F.col("term"))).groupBy("scenario").agg(F.collect_set(F.struct("term", "_n")).alias("_terms"))


def term_presence(runs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each term of a run's scenario stands in its text: ``(*keys, term, present)``.

    ``terms`` are ``(scenario, term)``. Texts are normalised once and meet the list of their
    scenario's terms as one array; the list is a checklist of a handful of terms.
    """
    listed = _listed(terms)
    hay = runs.select(*keys, "scenario", X.compare_line(F.col("text")).alias("_hay"))
    each = hay.join(listed, "scenario").select(*keys, "_hay", F.explode("_terms").alias("_t"))
    return each.select(*keys, F.col("_t.term").alias("term"), F.contains("_hay", F.col("_t._n")).alias("present"))


def term_recall(runs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Found terms per run; a run without terms has full recall."""
    counted = term_presence(runs, terms, keys).groupBy(*keys).agg(F.count_if("present").alias("found"), F.count("*").alias("total"))
    found, total = F.coalesce("found", F.lit(0)), F.coalesce("total", F.lit(0))
    recall = F.when(total > 0, found / total).otherwise(F.lit(1.0))
    return runs.select(*keys).join(counted, keys, "left").select(*keys, found.alias("found"), total.alias("total"), recall.alias("recall"))


def invented_sentences(text: Column, reference: Column) -> Column:
    """Sentences of three words or more that the reference does not hold; null without one."""
    sentences = F.transform(F.split(text, "[.!?]+"), X.compare_line)
    strange = lambda ref: F.filter(sentences, lambda s: (F.size(F.split(s, " ")) >= 3) & ~F.contains(ref, s))
    return F.when(reference.isNotNull(), F.size(X.let(X.compare_line(reference), strange)))


def metric_rows(runs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """The metric block of each run.

    ``runs`` carry ``scenario, text, reference, reference_path, duration_sec, ms, load_ms, peak_rss,
    disk_bytes, segments``. A measure without its input is null rather than zero. A text is normalised
    once and meets its scenario's terms in its own row, so runs are neither read again nor joined.
    """
    flags = lambda name: F.size(F.filter("segments", lambda s: F.coalesce(s[name], F.lit(False))))
    edges = F.filter(F.concat(F.transform("segments", lambda s: s["start"]), F.transform("segments", lambda s: s["end"])), lambda x: x.isNotNull())
    decimal = F.size(F.filter(edges, lambda x: x != F.floor(x)))
    measured = _word_errors(runs.withColumn("_line", X.compare_line(F.col("text"))), "reference", True).join(_listed(terms), "scenario", "left")
    total = F.when(F.col("_terms").isNull(), 0).otherwise(F.size("_terms")).cast("bigint")
    found = F.when(F.col("_terms").isNull(), 0).otherwise(F.size(F.filter("_terms", lambda t: F.contains(F.col("_line"), t["_n"])))).cast("bigint")
    rows = measured.select(
        *keys,
        F.when((F.col("duration_sec") > 0) & (F.col("ms") > 0), F.col("ms") / 1000 / F.col("duration_sec")).alias("rtf"),
        F.floor(F.col("ms") + 0.5).alias("transcribe_ms"),
        F.col("duration_sec").alias("audio_sec"),
        F.floor(F.col("load_ms") + 0.5).alias("load_ms"),
        X.half_up(F.col("peak_rss") / MEGABYTE, 1).alias("peak_rss_mb"),
        X.half_up(F.col("disk_bytes") / MEGABYTE, 1).alias("disk_mb"),
        X.half_up(F.col("wer"), 4).alias("wer"),
        F.col("ref_tokens").alias("wer_ref_tokens"),
        F.when(F.col("reference").isNotNull(), F.col("reference_path")).alias("reference_path"),
        flags("duplicate").alias("duplicate_flags"),
        flags("overlap").alias("overlap_flags"),
        invented_sentences(F.col("text"), F.col("reference")).alias("invented_sentences"),
        F.size(edges).alias("boundaries"),
        decimal.alias("decimal_boundaries"),
        found.alias("found"),
        total.alias("total"),
    )
    return rows.withColumn("recall", F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(F.lit(1.0)))


def roll_up(metrics: DataFrame) -> DataFrame:
    """Per configuration and recording type: mean error and speed, summed recall and flags."""
    return metrics.groupBy("config_id", "recording_type").agg(
        F.count("*").alias("runs"),
        F.avg("wer").alias("avg_wer"),
        F.sum("found").alias("found"),
        F.sum("total").alias("total"),
        F.avg("rtf").alias("avg_rtf"),
        F.sum("duplicate_flags").alias("duplicate_flags"),
        F.sum("overlap_flags").alias("overlap_flags"),
        F.sum("invented_sentences").alias("invented_sentences"),
        F.max("peak_rss_mb").alias("peak_rss_mb"),
    )


def recall_table(metrics: DataFrame) -> DataFrame:
    """Found terms per scenario and configuration, static and live side by side."""
    return metrics.groupBy("scenario", "config_id").pivot("recording_type", ["static", "live"]).agg(F.sum("found"))


def device_speed_up(bench: DataFrame) -> DataFrame:
    """Best own time per device and scenario, and their ratio; null where a side is missing.

    Runs that failed or fell back to the other device do not count.
    """
    good = F.col("ok") & ~F.coalesce("fell_back", F.lit(False))
    best = lambda device: F.min(F.when(good & (F.col("device") == device), F.col("total_ms")))
    return bench.groupBy("scenario").agg(best("cpu").alias("cpu_ms"), best("cuda").alias("cuda_ms")).withColumn(
        "speed_up", F.col("cpu_ms") / F.col("cuda_ms")
    )


def device_summary(bench: DataFrame) -> DataFrame:
    """One row per run: seconds per phase and the share of real time; failed runs have none."""
    seconds = lambda c: F.when(F.col("ok"), X.half_up(F.col(c) / 1000, 1)).alias(c.replace("_ms", "_s"))
    rtf = F.when(F.col("ok") & (F.col("audio_sec") > 0), X.half_up(F.col("total_ms") / 1000 / F.col("audio_sec"), 3))
    actual = F.when(F.coalesce("fell_back", F.lit(False)), F.concat("device", F.lit("*"))).otherwise(F.col("device"))
    return bench.select("scenario", "run", actual.alias("device"), seconds("total_ms"), rtf.alias("rtf"), seconds("load_ms"), seconds("pipeline_ms"))


def summary_lines(metrics: DataFrame) -> DataFrame:
    """Runs as rows of the printed summary table; an unknown measure reads n/a."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    rtf = F.coalesce(F.format_string("%.2f", F.col("rtf")), F.lit("n/a"))
    rtf = F.when(F.col("rtf").isNull(), F.lit("n/a")).otherwise(rtf)
    line = F.concat(
        F.lit("| "), F.col("config_id"), F.lit(" | "), F.col("recording_type"), F.lit(":"), F.col("scenario"), F.lit(" | "), shown("wer"),
        F.lit(" | "), F.col("found"), F.lit("/"), F.col("total"), F.lit(" | "), F.col("duplicate_flags"), F.lit(" | "), F.col("overlap_flags"),
        F.lit(" | "), shown("invented_sentences"), F.lit(" | "), rtf, F.lit(" | "), shown("peak_rss_mb"), F.lit(" | "), shown("disk_mb"), F.lit(" |"),
    )
    return metrics.select("config_id", "recording_type", "scenario", line.alias("line"))
