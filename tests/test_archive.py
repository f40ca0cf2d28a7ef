import json

import pytest
from pyspark.sql import functions as F

from talkframe.operators import archive as R
from talkframe.operators import privacy, quality, runs, speakers
from talkframe.operators import segments as S
from talkframe.sources import corpus, meetings
from talkframe.sources import runs as run_files

A, B, C, N = (f"2026-01-0{i}T10-00-00-000Z" for i in (1, 2, 3, 4))


@pytest.fixture()
def root(tmp_path):
    def put(mid, name, data):
        (tmp_path / mid).mkdir(exist_ok=True)
        (tmp_path / mid / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf8")

    put(A, "transcribe.json", {"segments": [{"start": 0, "end": 1.5, "text": " x", "speaker": "SPEAKER_1", "duplicate": True}, {"start": None, "end": None, "text": "y"}], "text": "t", "meetingScope": "two-party"})
    put(A, "analyze.json", {"analysis": {"status": "success", "markdown": "SPEAKER_1: a"}, "speakersDegraded": True})
    put(A, "meta.json", {"name": "Ad", "editedId": B})
    put(B, "transcribe.json", {"text": "z", "meetingScope": "??"})
    put(B, "analyze.json", "{broken")
    put(B, "meta.json", {"originalId": A})
    put(C, "transcribe.json", {"segments": []})
    put(C, "analyze.json", {"analysis": {"status": "failed", "markdown": "m"}})
    return str(tmp_path)


def test_read_archive(spark, root):
    t = {r.meeting_id: r for r in meetings.read_transcripts(spark, root).collect()}
    assert (t[A].meeting_scope, t[B].meeting_scope, t[C].text) == ("two-party", "group", "")
    rows = meetings.explode_segments(meetings.read_transcripts(spark, root)).collect()
    assert [(r.meeting_id, r.seg_idx, r.start, r.duplicate, r.overlap, r.speaker) for r in rows] == [(A, 0, 0.0, True, False, "SPEAKER_1"), (A, 1, None, False, False, None)]
    n = {r.meeting_id: r for r in meetings.read_analyses(spark, root).collect()}
    assert (n[A].markdown, n[A].speakers_degraded, n[B].markdown, n[C].markdown) == ("SPEAKER_1: a", True, None, None)
    m = {r.id: r for r in meetings.read_meta(spark, root, meetings.read_transcripts(spark, root)).collect()}
    assert (m[A].edited_id, m[B].original_id, m[C].name) == (B, A, None)


def make(spark, links, texts, notes):
    m = spark.createDataFrame(links, "id string, name string, original_id string, edited_id string")
    s = spark.createDataFrame([(i, n, None, None, "x", who, None, False, False) for i, n, who in texts], "meeting_id string, seg_idx int, start double, end double, text string, speaker string, source string, duplicate boolean, overlap boolean")
    a = spark.createDataFrame(notes, "meeting_id string, markdown string, speakers_degraded boolean")
    return R.Archive(m, s, a)


@pytest.fixture()
def pair(spark):
    return make(spark, [(A, "Ad", None, B), (B, None, A, None), (C, None, None, None)], [(A, 0, "SPEAKER_1"), (B, 0, "Ada"), (C, 0, "SPEAKER_1"), (C, 1, "SPEAKER_2")], [(A, "old SPEAKER_1", False), (B, "edited", True), (C, "SPEAKER_1 SPEAKER_10", False)])


def links(arc):
    return {r.id: (r.name, r.original_id, r.edited_id) for r in arc.meetings.collect()}


def notes(arc):
    return {r.meeting_id: r.markdown for r in arc.analyses.collect()}


def test_versions(spark, pair):
    active = {r.id: r.active for r in R.active_versions(pair).collect()}
    assert active == {A: B, B: B, C: C}
    stale = make(spark, [(A, None, None, B), (B, None, C, None), (C, None, None, None)], [(A, 0, "x"), (B, 0, "x"), (C, 0, "x")], [])
    assert {r.id: r.active for r in R.active_versions(stale).collect()}[A] == A
    untold = make(spark, [(A, None, None, B), (B, None, A, None)], [(A, 0, "x")], [])
    assert {r.id: r.active for r in R.active_versions(untold).collect()}[A] == A
    listed = R.newest_first(R.meeting_list(pair)).collect()
    assert [(r.id, r.name, r.has_edited, r.status) for r in listed] == [(C, "03.01.2026 10:00", False, "done"), (A, "Ad", True, "done")]
    assert {r.id: r.name for r in R.display_names(pair).collect()}[B] == "Ad (Edited)"


def test_edits_make_one_copy_and_reuse_it(spark, pair):
    edits = spark.createDataFrame([(C, N, "first", 1), (C, N, "second", 2), (A, "unused", "on copy", 1)], "id string, new_id string, markdown string, op_idx int")
    after = R.save_analyses(pair, edits)
    assert links(after)[C] == (None, None, N) and links(after)[N] == (None, C, None) and "unused" not in links(after)
    assert notes(after) == {A: "old SPEAKER_1", B: "on copy", C: "SPEAKER_1 SPEAKER_10", N: "second"}
    again = R.name_speakers(after, spark.createDataFrame([(C, "other", "SPEAKER_1", " Ayşe "), (C, "other", "SPEAKER_2", "SPEAKER_2")], "id string, new_id string, label string, name string"))
    assert "other" not in links(again)
    assert sorted(r.speaker for r in again.segments.filter(F.col("meeting_id") == N).collect()) == ["Ayşe", "SPEAKER_2"]
    with pytest.raises(Exception, match="cannot be copied"):
        R.create_copies(pair, spark.createDataFrame([(B, N)], "id string, new_id string")).meetings.collect()


def test_naming_renames_the_analysis_too(spark, pair):
    after = R.name_speakers(pair, spark.createDataFrame([(C, N, "SPEAKER_1", "Ayşe")], "id string, new_id string, label string, name string"))
    assert notes(after)[N] == "Ayşe SPEAKER_10" and notes(after)[C] == "SPEAKER_1 SPEAKER_10"
    nothing = R.name_speakers(pair, spark.createDataFrame([(C, N, "SPEAKER_1", "  ")], "id string, new_id string, label string, name string"))
    assert links(nothing) == links(pair)
    with pytest.raises(Exception, match="speaker name refused"):
        R.name_speakers(pair, spark.createDataFrame([(C, N, "SPEAKER_1", "speaker 4")], "id string, new_id string, label string, name string")).segments.collect()


def test_rename_delete_revert_reanalyze(spark, pair):
    renamed = R.rename_meetings(pair, spark.createDataFrame([(B, " Yeni ", 1)], "id string, name string, op_idx int"))
    assert links(renamed)[A][0] == "Yeni" and links(renamed)[B][0] is None
    with pytest.raises(Exception, match="must not be blank"):
        R.rename_meetings(pair, spark.createDataFrame([(B, " ", 1)], "id string, name string, op_idx int")).meetings.collect()
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert set(links(R.delete_meetings(pair, one(A)))) == {C}
    assert links(R.delete_meetings(pair, one(B))) == {A: ("Ad", None, None), C: (None, None, None)}
    assert links(R.revert_edits(pair, one(B))) == links(R.revert_edits(pair, one(A))) == {A: ("Ad", None, None), C: (None, None, None)}
    after = R.reanalyze(pair, spark.createDataFrame([(B, "new", 1)], "id string, markdown string, op_idx int"))
    assert notes(after) == {A: "new", C: "SPEAKER_1 SPEAKER_10"} and set(links(after)) == {A, C}


def test_saved_order(spark):
    def order(ids, saved):
        m = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos int")
        s = spark.createDataFrame([(x, i) for i, x in enumerate(saved)], "id string, saved_pos int")
        return [r.id for r in R.saved_order(m, s).collect()]

    assert order("abc", "cab") == ["c", "a", "b"]
    assert order("xab", "ba") == ["x", "b", "a"]
    assert order("ab", "bza") == ["b", "a"]
    assert order("ab", "") == ["a", "b"]


def test_write_and_export(spark, segs, tmp_path):
    rows = segs({"text": "Merhaba", "speaker": "A"}, {"text": "Selam", "speaker": "B"}, meeting=A)
    noted = spark.createDataFrame([(A, "md", False), (B, None, False)], "meeting_id string, markdown string, speakers_degraded boolean")
    meetings.write_meeting(rows, noted, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/segments")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/analyses")).count() == 1
    heads = spark.createDataFrame([(A, "Ad: x.", "### m", "", True), (B, "b", None, "stored", False), (C, "c", None, None, False)], "meeting_id string, name string, markdown string, text string, speakers_degraded boolean")
    docs = meetings.markdown_lines(heads, S.line_text(S.transcript_lines(rows)))
    got = {}
    for r in docs.orderBy("section", "line_idx", "part").collect():
        got.setdefault((r.meeting_id, r.file_name), []).append(r.line)
    assert "\n".join(got[(A, "Ad  x.md")]) == "# Ad: x.\n\n## Analiz\n\n### m\n\n## Döküm\n\nA: Merhaba\nB: Selam\n\n> Not: Konuşmacı etiketleri bu oturumda kullanılamadı."
    assert got[(B, "b.md")][-1] == "stored" and got[(C, "c.md")][-1] == "(döküm yok)"
    meetings.export_markdown(docs, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).filter("value = 'B: Selam'").count() == 1


def test_speaker_labels_and_mentions(spark, segs):
    rows = segs({"speaker": "B", "text": " b "}, {"speaker": "A", "source": "remote", "text": "a"}, {"speaker": "B", "source": "local", "text": "c", "duplicate": True}, {})
    assert [(r.speaker, r.source) for r in speakers.speaker_labels(rows).orderBy("appearance").collect()] == [("B", "local"), ("A", "remote")]
    assert sorted((r.speaker, r.line) for r in speakers.spoken_lines(rows).collect()) == [("A", "a"), ("B", "b")]
    items = spark.createDataFrame([("m", "SPEAKER_1 gelir"), ("m", "SPEAKER_10 gider"), ("m", "(SPEAKER_1)")], "meeting_id string, item string")
    labels = spark.createDataFrame([("m", "SPEAKER_1")], "meeting_id string, speaker string")
    assert {r.item for r in speakers.mentions(items, labels).collect()} == {"SPEAKER_1 gelir", "(SPEAKER_1)"}


# --- runs ----------------------------------------------------------------------------------------


def test_scan_runs(spark, tmp_path):
    def put(path, data):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(data), encoding="utf8")

    turbo = {"model": "onnx-community/whisper-large-v3-turbo", "dtype": "q8", "mode": "chunked"}
    put("bench/r1/transcribe/cfg__S1-C.json", {"text": "t", "segments": [], "metrics": {"wer": 0.5}})
    put("bench/r1/live/analyze/cfg__S1-C.json", {"recordingType": "live"})
    put("bench/r1/S2_live-transcribe.json", {"config": turbo, "recordingType": "live"})
    put("bench/r1/S3_analyze.json", {"analyzer": {"model": "gemma"}})
    put("bench/r1/S4_transcribe.json", {"config": {"model": "x/whisper-z-ONNX", "dtype": "encoder=q8,decoder=fp32", "mode": "m"}})
    put("bench/r1/summary.json", {})
    put("bench/r1/notes.json", {})
    put("ref/live/transcribe/S1-C_live-transcribe.json", {"recordingType": "live", "config": turbo})
    put("ref/transcribe/A__S9.json", {})
    got = {(r.config_id, r.scenario, r.recording_type, r.output_type) for r in run_files.scan_runs(spark, str(tmp_path / "bench"), "bench").collect()}
    assert got == {
        ("cfg", "S1-C", "static", "transcribe"),
        ("cfg", "S1-C", "live", "analyze"),
        ("B_turbo_q8_chunked", "S2", "live", "transcribe"),
        ("gemma", "S3", "static", "analyze"),
        ("z_encoder-q8-decoder-fp32_m", "S4", "static", "transcribe"),
    }
    refs = {(r.run_id, r.scenario, r.recording_type, r.path) for r in run_files.scan_references(spark, str(tmp_path / "ref")).collect()}
    assert refs == {("control-group", "S1-C", "live", "live/transcribe/S1-C_live-transcribe.json"), ("control-group", "S9", "static", "transcribe/A__S9.json")}


def test_registry(spark, tmp_path):
    table = "# x\n\n| dosya | transcribe | analyze | live transcribe | live analyze |\n|---|---|---|---|---|\n| S1 | a.json | - | l.json |  |\n| S2 | — | b.json |\nprose\n"
    (tmp_path / "r.md").write_text(table, encoding="utf8")
    got = {tuple(r) for r in run_files.read_registry(spark, str(tmp_path / "r.md")).collect()}
    assert got == {("S1", "transcribe", "static", "a.json"), ("S1", "transcribe", "live", "l.json"), ("S2", "analyze", "static", "b.json")}
    assert run_files.read_registry(spark, str(tmp_path / "none.md")).count() == 0
    reg = spark.createDataFrame([("S1", "transcribe", "static", "x/../../y.json")], "scenario string, kind string, recording_type string, path string")
    with pytest.raises(Exception, match="leaves its root"):
        runs.resolve_references(reg).collect()
    fine = runs.resolve_references(reg.withColumn("path", F.lit("x/../y.json")))
    assert fine.count() == 1
    more = spark.createDataFrame([("S1", "transcribe", "static", "n1", 1), ("S1", "transcribe", "static", "n2", 2), ("S9", "analyze", "live", "q", 1)], "scenario string, kind string, recording_type string, path string, op_idx int")
    assert {(r.scenario, r.path) for r in runs.promote(fine, more).collect()} == {("S1", "n2"), ("S9", "q")}


def test_metric_rows(spark, segs):
    seg = "array<struct<start:double,end:double,text:string,duplicate:boolean,overlap:boolean>>"
    rows = spark.createDataFrame(
        [("r", "S", "bir iki üç beş", "1 iki 3 dört", "ref.json", 10.0, 2500.0, 99.6, 1048576.0 * 3, 1048576.0, [(0.0, 1.5, "a", True, None), (2.0, None, "b", False, True)])],
        f"id string, scenario string, text string, reference string, reference_path string, duration_sec double, ms double, load_ms double, peak_rss double, disk_bytes double, segments {seg}",
    )
    terms = spark.createDataFrame([("S", "zzz")], "scenario string, term string")
    m = quality.metric_rows(rows, terms, ["id"]).collect()[0]
    assert (m.rtf, m.load_ms, m.peak_rss_mb, m.disk_mb, m.duplicate_flags, m.overlap_flags, m.boundaries, m.decimal_boundaries) == (0.25, 100, 3.0, 1.0, 1, 1, 3, 1)
    blank = quality.metric_rows(rows.withColumn("reference", F.lit(None).cast("string")).withColumn("duration_sec", F.lit(None).cast("double")), terms, ["id"]).collect()[0]
    assert (blank.wer, blank.rtf, blank.reference_path, blank.invented_sentences, blank.recall) == (None, None, None, None, 0.0)


def test_write_summary(spark, tmp_path):
    columns = "config_id string, recording_type string, scenario string, wer double, found bigint, total bigint, duplicate_flags bigint, overlap_flags bigint, invented_sentences bigint, rtf double, peak_rss_mb double, disk_mb double"
    rows = spark.createDataFrame([("B", "live", "S1", None, 1, 2, 0, 0, None, None, 10.5, 1.0), ("A", "static", "S1", 0.25, 2, 2, 1, 0, 3, 0.456, 10.5, 1.0)], columns)
    run_files.write_summary(rows, str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s/summary")).orderBy("value").collect()] == [
        "| A | static:S1 | 0.25 | 2/2 | 1 | 0 | 3 | 0.46 | 10.5 | 1.0 |",
        "| B | live:S1 | n/a | 1/2 | 0 | 0 | n/a | n/a | 10.5 | 1.0 |",
    ]


# --- private data --------------------------------------------------------------------------------


def test_private_data(spark, tmp_path):
    secret = "ghp_" + "A" * 24
    text = "\n".join(["someone@example.org", r"C:\Users\someone\project", "https://drive.google.com/private", secret, "+90 555 111 22 33"])
    (tmp_path / "a.md").write_text(text, encoding="utf8")
    (tmp_path / "copy.md").write_text(text, encoding="utf8")
    (tmp_path / "wide.txt").write_bytes(("x " + secret).encode("utf-16-le"))
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe\xfa" + secret.encode())
    (tmp_path / "clean.txt").write_text("owner@example.org", encoding="utf8")
    files = corpus.read_corpus(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {}
    for r in privacy.findings(files, ["owner@example.org"]).collect():
        got.setdefault(r.path, set()).add(r.rule)
    five = {"email", "home_path", "private_link", "secret", "phone"}
    assert got == {"a.md": five, "copy.md": five, "wide.txt": {"secret"}, "bin.dat": {"secret"}}
    assert privacy.content_findings(files, ["owner@example.org"]).filter("rule = 'phone'").count() == 1
    locked = files.filter("path = 'clean.txt'").withColumn("path", F.lit("package-lock.json"))
    assert privacy.content_findings(locked).count() == 0
    paths = {"output/a.mp3": 2, ".env": 1, "x/.env.example": 0, "control-group/synthetic/S9.txt": 0, "control-group/a.json": 1, r"notes\b.local.md": 1, "a/.mp3": 0}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.n for r in df.select("path", F.size(privacy.path_problems(F.col("path"))).alias("n")).collect()} == paths


def test_dictionary_as_a_table(spark):
    """Many entries, several words to a key, capitals, word edges, and texts that share an id."""
    from talkframe.operators import dictionary

    entries = [("kedi", "cat"), ("kara kedi", "panther"), ("KEDİ MAMASI", "kibble"), ("a.b", "dot"), ("ısı", "heat"), ("--", "none"), ("null", None), ("ad", "z"), ("ad", "b")]
    entries += [(f"k{i}x", f"v{i}") for i in range(5000)]
    rows = [(1, "Kedi kara kedi Kara Kedi kedicik ükedi, kedi mamasi"), (1, "k17x K4999X k5000x"), (2, None), (None, "a.b axb Isı ad null"), (3, "")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "id bigint, text string, key string")
    got = sorted([tuple(r) for r in dictionary.correct_texts(df, spark.createDataFrame(entries, "key string, word string"), ["id"]).collect()], key=str)
    want = [(1, "Cat panther Panther kedicik ükedi, kibble", "kept"), (1, "v17 V4999 k5000x", "kept"), (2, None, "kept"), (None, "dot axb Heat b null", "kept"), (3, "", "kept")]
    assert got == sorted(want, key=str)
