"""Metric blocks: one for each run, worked out in the run's own row."""

from pyspark.sql import functions as F

from talkframe.operators import quality as Q


def test_runs_that_share_their_keys_have_a_block_each(spark):
    segments = "array<struct<start:double,end:double,duplicate:boolean,overlap:boolean>>"
    rows = spark.createDataFrame([("r", "S", "beş kilo elma"), ("r", "S", "armut"), ("q", "none", None)], "id string, scenario string, text string")
    for name, kind in {"reference": "string", "reference_path": "string", "duration_sec": "double", "ms": "double", "load_ms": "double", "peak_rss": "double", "disk_bytes": "double", "segments": segments}.items():
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    terms = spark.createDataFrame([("S", "5 kilo"), ("S", "Elma"), ("S", "armut")], "scenario string, term string")
    got = [(r.id, r.found, r.total, r.recall) for r in Q.metric_rows(rows, terms, ["id"]).collect()]
    assert sorted(got) == [("q", 0, 0, 1.0), ("r", 1, 3, 1 / 3), ("r", 2, 3, 2 / 3)]
