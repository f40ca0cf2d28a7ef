"""Plans of registered queries: no nested loops, no Python where the JVM does the work, pruned scans."""

import subprocess
import sys
from pathlib import Path

import pytest

from talkframe.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
JOINS = ["speaker_alignment", "segment_energy", "side_attribution", "term_presence", "label_mentions", "pending_tasks", "nearest_windows", "speaker_changes", "active_versions", "prunable_runs", "live_flags"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["repeat_flags", "value_anchors", "text_chunks", "word_errors", "draft_items", "speech_bounds"])
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text


def test_repeats_shuffle_once(spark):
    from pyspark.sql import functions as F

    from talkframe.operators.segments import flag_repeats

    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = turns.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "text", F.lit(False).alias("duplicate")
    )
    text = flag_repeats(rows)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_scans_are_pruned(spark):
    text = plan(spark, "segment_energy")
    assert "props" not in text
    assert "purchase,signup])" in plan(spark, "shared_time").split("PushedFilters")[-1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_queries_are_imported_without_a_session():
    """The caller may list the queries before it opens a session."""
    subprocess.run([sys.executable, "-c", "import talkframe.plans.catalog"], check=True, cwd=Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("name", ["order_claims", "detected_values"])
def test_values_are_worked_out_once(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in text and "Filter ((size(" not in text
