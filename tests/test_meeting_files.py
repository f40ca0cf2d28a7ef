"""One file per meeting: round trips, odd files, packing, and writers that fail."""

import json

import pytest
from pyspark.sql import functions as F

from talkframe.sources import meeting_files as M

SEG = {"start": 0.5, "end": 2.0, "text": "bütçe \"onaylandı\"\n", "speaker": "S1", "duplicate": False, "overlap": True, "source": None}


def rows(spark, n=5):
    return spark.createDataFrame([(f"m{k}", "two-party" if k % 2 else None, f"text {k}", [SEG] * k) for k in range(n)], M.SCHEMAS["transcripts"])


def test_round_trip(spark, tmp_path):
    root = str(tmp_path / "archive")
    M.write_files(rows(spark).repartition(3), root, "transcripts")
    got = {r.meeting_id: r for r in M.read_files(spark, root, "transcripts").collect()}
    assert sorted(got) == [f"m{k}" for k in range(5)]
    assert got["m3"].meeting_scope == "two-party" and got["m2"].meeting_scope == "group" and got["m3"].text == "text 3"
    assert len(got["m4"].segments) == 4 and got["m4"].segments[0].asDict() == SEG and got["m0"].segments == []
    assert sorted(p.relative_to(root).as_posix() for p in (tmp_path / "archive").rglob("*") if p.is_file()) == [f"m{k}/transcribe.json" for k in range(5)]


def test_odd_files(spark, tmp_path):
    texts = {"a": "{", "b": "[]", "c": '{"segments": 5, "meetingScope": "three"}', "d": '{"segments": [1, {"start": "x", "end": true, "text": 4, "extra": 1}], "text": null}', "e": ""}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "transcribe.json").write_text(text)
        (tmp_path / name / "analyze.json").write_text(text)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "analyze.json").write_text(json.dumps({"analysis": {"status": "running", "markdown": "# half"}, "speakersDegraded": True}))
    got = {r.meeting_id: r for r in M.read_files(spark, str(tmp_path), "transcripts").collect()}
    assert set(got) == set("abcde") and all(r.meeting_scope == "group" and r.text == "" for r in got.values())
    assert got["a"].segments is None and [s.text for s in got["d"].segments] == [None, None] and got["d"].segments[1].end is None
    analyses = {r.meeting_id: (r.markdown, r.speakers_degraded) for r in M.read_files(spark, str(tmp_path), "analyses").collect()}
    assert analyses["f"] == (None, True) and analyses["a"] == (None, False) and len(analyses) == 6


def test_files_are_packed_by_size_and_only_those_asked_for_are_opened(spark, tmp_path):
    root = str(tmp_path)
    M.write_files(rows(spark, 40), root, "transcripts")
    M.register(spark)
    packed = spark.read.format(M.FORMAT).option("packBytes", 10 * M.OPEN_BYTES).load(root)
    assert packed.rdd.getNumPartitions() == 5 and packed.count() == 40
    (tmp_path / "m3" / "transcribe.json").unlink()
    (tmp_path / "m3" / "transcribe.json").symlink_to(tmp_path / "nowhere")
    assert [r.text for r in M.read_files(spark, root, "transcripts", ["m7", "none"]).collect()] == ["text 7"]
    assert sorted(r.meeting_id for r in M.read_files(spark, root, "transcripts", ["m1", "m2"]).collect()) == ["m1", "m2"]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = tmp_path / "out"
    bad = rows(spark, 6).repartition(3).withColumn("text", F.when(F.col("meeting_id") == "m4", F.raise_error(F.lit("stop here"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop here|Writing|write"):
        M.write_files(bad, str(root), "transcripts")
    assert [p for p in root.rglob("*") if p.is_file()] == []


def test_overwriting_one_kind_keeps_the_others(spark, tmp_path):
    root = str(tmp_path)
    M.write_files(rows(spark), root, "transcripts")
    names = spark.createDataFrame([("m0", "Weekly", None, "m0x"), ("m1", None, "m0", None)], M.SCHEMAS["meta"])
    M.write_files(names, root, "meta")
    M.write_files(rows(spark, 2), root, "transcripts", "overwrite")
    assert M.read_files(spark, root, "transcripts").count() == 2
    assert {(r.meeting_id, r.name, r.original_id, r.edited_id) for r in M.read_files(spark, root, "meta").collect()} == {("m0", "Weekly", None, "m0x"), ("m1", None, "m0", None)}
    assert M.read_files(spark, str(tmp_path / "nothing"), "transcripts").collect() == []


def test_documents(spark, tmp_path):
    lines = [("m", "a b.md", 0, 0, 0, "# a b\n"), ("m", "a b.md", 3, 10, 0, "S: last"), ("m", "a b.md", 3, 2, 0, "S: first"), ("m", "a b.md", 2, 0, 0, "## T\n")]
    df = spark.createDataFrame(lines, "meeting_id string, file_name string, section int, line_idx bigint, part bigint, line string")
    M.write_files(M.document_rows(df), str(tmp_path), "markdown")
    assert (tmp_path / "m" / "a b.md").read_text() == "# a b\n\n## T\n\nS: first\nS: last\n"
    assert [tuple(r) for r in M.read_files(spark, str(tmp_path), "markdown").collect()] == [("m", "a b.md", "# a b\n\n## T\n\nS: first\nS: last\n")]


def test_each_kind_is_read_once(spark):
    """What a meeting's segments hold is told within its row, so no kind of file is read twice."""
    from talkframe.plans import archive_queries

    told = archive_queries.meeting_files(spark, "/root/testdata/sf0.001")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 3
