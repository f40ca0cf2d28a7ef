"""Runs, references, tasks: who is the reference, what is pending, what can go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_KEY = ["scenario", "kind", "recording_type"]

# The named configurations.
CONFIGS = [
    ("A_medium_q8_chunked", "onnx-community/whisper-medium-ONNX", "q8", "chunked"),
    ("B_turbo_q8_chunked", "onnx-community/whisper-large-v3-turbo", "q8", "chunked"),
    ("C_turbo_encq8_decfp32", "onnx-community/whisper-large-v3-turbo", "encoder=q8,decoder=fp32", "chunked"),
    ("D_turbo_fp32_chunked", "onnx-community/whisper-large-v3-turbo", "fp32", "chunked"),
]


def config_id(model: Column, dtype: Column, mode: Column) -> Column:
    """Id of a named configuration, else a slug of its parts; null when a part is missing."""
    named = F.create_map(*[x for i, m, d, o in CONFIGS for x in (F.lit(f"{m}|{d}|{o}"), F.lit(i))])[F.concat_ws("|", model, dtype, mode)]
    short = F.regexp_replace(F.regexp_replace(F.element_at(F.split(model, "/"), -1), "^whisper-", ""), "(?i)-ONNX$", "")
    slug = F.concat_ws("_", short, F.regexp_replace(dtype, "[=,]", "-"), mode)
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(given(model) & given(dtype) & given(mode), F.coalesce(named, slug))


def task_matrix(files: DataFrame, config_ids: list[str] | None = None) -> DataFrame:
    """Every file with every configuration, static and live.

    Configurations are a short list given in code, so each file row carries it and nothing is joined.
    """
    ids = [c[0] for c in CONFIGS] if config_ids is None else config_ids
    each = files.withColumn("config_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    return each.select("config_id", "file", F.explode(F.array(F.lit("static"), F.lit("live"))).alias("recording_type"))


def valid_outputs(runs: DataFrame) -> DataFrame:
    """Outputs that need not be made again: text, segments and metrics are all there."""
    return runs.filter(F.col("text").isNotNull() & F.col("segments").isNotNull() & F.col("metrics").isNotNull())


def pending_tasks(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    done = valid_outputs(runs).select("config_id", F.col("scenario").alias("file"), "recording_type")
    return tasks.join(done, ["config_id", "file", "recording_type"], "left_anti")


def distinct_weights(configs: DataFrame) -> DataFrame:
    """Model and dtype pairs, the first configuration of each."""
    return configs.groupBy("model", "dtype").agg(F.min("position").alias("position"))


def stays_below(path: Column) -> Column:
    """Whether a relative path never climbs above where it starts."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("lowest")),
        lambda acc, s: F.struct(
            (acc["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"),
            F.least(acc["lowest"], acc["at"] + F.when(s == "..", -1).otherwise(1)).alias("lowest"),
        ),
        lambda acc: acc["lowest"],
    )
    return (depth >= 0) & ~F.startswith(path, F.lit("/"))


def resolve_references(registry: DataFrame) -> DataFrame:
    """The registry with a check of its paths: one that leaves the reference root is an error."""
    checked = F.when(stays_below(F.col("path")), F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("reference path leaves its root: "), F.col("path"))).cast("string")
    )
    return registry.withColumn("path", checked)


def mark_references(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``is_reference``: the run's file is one the registry names."""
    named = registry.select(F.col("path").alias("path")).distinct().withColumn("_named", F.lit(True))
    return runs.join(named, "path", "left").withColumn("is_reference", F.coalesce("_named", F.lit(False))).drop("_named")


def reference_of(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``reference_path``: what the registry names for a run's scenario, type and recording."""
    named = registry.select("scenario", F.col("kind").alias("output_type"), "recording_type", F.col("path").alias("reference_path"))
    return runs.join(named, ["scenario", "output_type", "recording_type"], "left")


def promote(registry: DataFrame, promoted: DataFrame) -> DataFrame:
    """The registry after promotions ``(scenario, kind, recording_type, path, op_idx)``: the last one per key wins."""
    latest = promoted.groupBy(*REFERENCE_KEY).agg(F.max_by("path", "op_idx").alias("path"))
    return registry.join(latest, REFERENCE_KEY, "left_anti").select(*REFERENCE_KEY, "path").unionByName(latest)


def run_sizes(files: DataFrame) -> DataFrame:
    """Bytes and newest change per run folder."""
    return files.groupBy("run_id").agg(F.sum("length").alias("bytes"), F.max("modified").alias("newest"))


YOUNGEST_S = 600


def prunable(files: DataFrame, registry: DataFrame, now: Column, within_kept: bool = False) -> DataFrame:
    """What no reference needs: ``(run_id, path, bytes)``, a null path for whole runs.

    Runs changed in the last ten minutes may still be written and are left alone. With
    ``within_kept`` also single files of runs that hold a reference.
    """
    marked = mark_references(files, registry)
    runs = marked.groupBy("run_id").agg(
        F.bool_or("is_reference").alias("_kept"), F.sum("length").alias("bytes"), F.max("modified").alias("_newest")
    )
    old = lambda c: F.unix_micros(now) - F.unix_micros(c) >= YOUNGEST_S * 1_000_000
    whole = runs.filter(~F.col("_kept") & old(F.col("_newest"))).select("run_id", F.lit(None).cast("string").alias("path"), "bytes")
    if not within_kept:
        return whole
    single = (
        marked.filter(~F.col("is_reference") & old(F.col("modified")))
        .join(runs.filter("_kept").select("run_id"), "run_id", "left_semi")
        .select("run_id", "path", F.col("length").alias("bytes"))
    )
    return whole.unionByName(single)


def report_rows(runs: DataFrame, needle: str = "", only_references: bool = False, sort_by: str = "run_id", descending: bool = True) -> DataFrame:
    """Runs whose six naming columns contain ``needle``, sorted by any column."""
    named = F.lower(F.concat_ws(" ", "kind", "recording_type", "run_id", "config_id", "scenario", "output_type"))
    kept = runs.filter(F.contains(named, F.lit(needle.strip().lower()))) if needle.strip() else runs
    if only_references:
        kept = kept.filter("is_reference")
    key = F.col(sort_by)
    return kept.orderBy(key.desc() if descending else key.asc())
