import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkframe.plans import live_queries
from talkframe.streaming import live, ordered

CHUNKS = f"meeting_id string, seq bigint, n_samples bigint, segments array<{live.PIECE}>, is_stop boolean"


def chunk_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for m in "abc":
        for seq in range(9):
            n = rng.choice([0, 16_000, 96_000, 160_000])
            pieces = [(rng.choice([-1.0, 0.0, 2.0]), rng.choice([0.1, 3.0, 5.0]), " ".join(rng.choice("pqr") for _ in range(rng.randint(1, 7)))) for _ in range(rng.randint(0, 3))]
            if pieces and rng.random() < 0.3:
                pieces[0] = (None, None, pieces[0][2])
            rows.append((m, seq, n, pieces if n else [], False))
        rows.append((m, 9, 0, [], m != "c"))
    return rows


def replay(spark, rows, schema, order, operator, folder):
    df = spark.createDataFrame(rows, schema)
    for step in sorted({r[1] for r in rows}):
        df.filter(F.col(order) == step).coalesce(1).write.parquet(f"{folder}/in/{step:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    seen = []
    live.run_to_end(operator(stream), f"{folder}/out", f"{folder}/check", lambda df, i: seen.append(i))
    assert seen
    return spark.read.parquet(f"{folder}/out").drop("batch")


def plain_rounds(rows):
    """Which round each segment belongs to, by walking through the chunks."""
    out = {}
    for m in sorted({r[0] for r in rows}):
        pending, emitted, started, number, held = 0, 0, False, 0, []
        for _, _, n, pieces, stop in [r for r in rows if r[0] == m]:
            if n:
                held += [(s + (emitted + pending) / 16000 if s is not None else None) for s, _, _ in pieces]
                pending += n
            if pending and (started or stop or pending >= 320_000):
                number, started = number + 1, True
                out.update({(m, number, i): (h, emitted / 16000) for i, h in enumerate(held)})
                emitted, pending, held = emitted + pending, 0, []
    return out


def test_stream_equals_replay(spark, tmp_path):
    rows = chunk_rows()
    streamed = replay(spark, rows, CHUNKS, "seq", live.live_segments, str(tmp_path)).collect()
    want = plain_rounds(rows)
    assert {(r.meeting_id, r.round, r.seg_in_round): (r.start, r.seam) for r in streamed} == {k: pytest.approx(v) if v[0] is not None else v for k, v in want.items()}
    for block in (2, 4096):
        batch = live.replayed_segments(spark.createDataFrame(rows, CHUNKS), block_rows=block).collect()
        key = lambda r: (r.meeting_id, r.round, r.text, r.start or -1, r.end or -1, r.seam, r.duplicate)
        assert sorted(map(key, batch)) == sorted(map(key, streamed))
    assert any(r.duplicate for r in streamed) and not all(r.duplicate for r in streamed)


def shuffled(spark, rows, schema, operator, folder, files):
    """The same rows in files that hold any of them, some rows twice."""
    mixed = random.Random(files).sample(rows + rows[::5], len(rows + rows[::5]))
    for i in range(files):
        spark.createDataFrame(mixed[i::files], schema).coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    live.run_to_end(operator(stream), f"{folder}/out", f"{folder}/check")
    return sorted(map(str, spark.read.parquet(f"{folder}/out").drop("batch").collect()))


@pytest.mark.parametrize("files", [1, 8])
def test_any_order_gives_the_same_rounds(spark, tmp_path, files):
    rows = [r for r in chunk_rows() if r[0] != "b"]
    by_chunk = lambda chunks: live.live_segments(chunks, coalesce=False)
    got = shuffled(spark, rows, CHUNKS, by_chunk, str(tmp_path), files)
    ordered = replay(spark, rows, CHUNKS, "seq", live.live_segments, str(tmp_path / "ordered"))
    assert got == sorted(map(str, ordered.collect()))


@pytest.mark.parametrize("files", [1, 8])
def test_any_order_gives_the_same_sessions(spark, tmp_path, files):
    rows = [(m, i, e) for m, (events, _) in SESSIONS.items() for i, e in enumerate(events)]
    got = shuffled(spark, rows, EVENTS, live.session_states, str(tmp_path), files)
    ordered = replay(spark, rows, EVENTS, "seq", live.session_states, str(tmp_path / "ordered"))
    assert got == sorted(map(str, ordered.collect()))


class _Map:
    """A map state that counts the calls on it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.map = _Map()

    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, *schemas):
        return self.map


def test_early_rows_are_read_and_written_by_blocks():
    """Rows that come the wrong way round wait in few entries of the state, and a repeated one leaves nothing behind."""
    events = [("start", "pause", "resume", "chunk")[k % 4] if k else "start" for k in range(1000)]
    rows = pd.DataFrame({"seq": range(1000), "at": 0, "event": events})
    handle, step = _Handle(), ordered.InTurn(live._Session, False)
    step.init(handle)
    got = []
    for lo in (800, 400, 600, 200, 200, 0):
        for out in step.handleInputRows(("m",), iter([rows[lo : lo + 200], rows[lo + 150 : lo + 200]]), None):
            got += list(out.itertuples(index=False, name=None))
    work = live._Session("m", None)
    assert got == [row for k in range(1000) for row in work.take(k, events[k])]
    assert handle.map.calls < 60 and not handle.map.held


class _Part(_Handle):
    """A part's state: one value and one map, and the calls on them."""

    def __init__(self):
        super().__init__()
        self.value = _Value()
        self.map.keys = lambda: iter(list(self.map.held))
        self.value.clear = lambda: self.value.update(None)

    def getValueState(self, name, schema):
        return self.value


@pytest.mark.parametrize("held", [40, 65_536])
def test_small_keys_share_calls_and_entries(monkeypatch, held):
    """Rows of many sessions in any order, some twice: each in its turn, with a few calls to the state a trigger."""
    monkeypatch.setattr(ordered, "HELD_TOGETHER", held)
    said = {f"m{k}": [("start", "pause", "resume", "chunk", "stop")[(k + i) % 5] if i else "start" for i in range(20 + k)] for k in range(50)}
    rows = [(m, i, 0, e) for m, events in said.items() for i, e in enumerate(events)]
    rows += [(m, i, 0, e) for m, i, e in (("m0", 300, "chunk"), ("m1", 301, "chunk"))]
    mixed = random.Random(3).sample(rows + rows[::7], len(rows + rows[::7]))
    handle, step = _Part(), ordered.InTurnTogether(live._Session, False, "meeting_id")
    step.init(handle)
    got = []
    for k in range(6):
        table = pd.DataFrame(mixed[k::6], columns=["meeting_id", "seq", "at", "event"])
        for out in step.handleInputRows((0,), iter([table[:100], table[100:]]), None):
            got += list(out.itertuples(index=False, name=None))
    want = []
    for m, events in said.items():
        work = live._Session(m, None)
        want += [row for i, e in enumerate(events) for row in work.take(i, e)]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert list(handle.map.held) == [(1,)] and sum(map(len, step.block(1).values())) == 2
    assert held == 40 or handle.map.calls < 40


def test_state_entries_do_not_follow_the_number_of_sessions(spark, tmp_path):
    n = ordered.PARTS * 3
    for step, (lo, event) in enumerate([(1, "pause"), (2, "resume")]):  # row 0 never comes
        spark.range(n).select(F.col("id").cast("string").alias("meeting_id"), F.lit(lo).cast("bigint").alias("seq"), F.lit(event).alias("event")).coalesce(1).write.parquet(f"{tmp_path}/in/{step}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    started = live.start_live(live.session_states(stream), f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    started.awaitTermination()
    assert started.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * ordered.PARTS


def test_a_step_in_several_files_is_one_trigger(spark, tmp_path):
    """Triggers follow the steps, however many files a step has."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select((F.col("id") % 3).alias("week"), "id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
        source, files = live_queries.hand_over(df, "week", f"{tmp_path}/in")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) > 6
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", files).parquet(source)
    live.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.countDistinct("batch"), F.count("*")).first() == (3, 200_000)


def test_watermark_gives_up_a_gap(spark, tmp_path):
    """Row 1 of ``a`` never comes; once the watermark has passed row 2 the session goes on without it."""
    at = lambda minute: datetime(2026, 1, 1, 10) + timedelta(minutes=minute)
    rows = [("a", 0, "start", at(0)), ("a", 2, "stop", at(2)), ("b", 0, "start", at(200)), ("c", 0, "start", at(400))]
    schema = EVENTS + ", event_time timestamp"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/in/{i:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    live.run_to_end(live.session_states(stream, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {(r.meeting_id, r.seq, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0, "recording"), ("a", 2, "finalizing"), ("b", 0, "recording"), ("c", 0, "recording")}


EVENTS = "meeting_id string, seq bigint, event string"
SESSIONS = {
    "plain": (["chunk", "start", "chunk", "pause", "chunk", "resume", "chunk", "stop", "chunk", "analyze", "finalized"], "result"),
    "cancelled": (["start", "stop", "cancel", "finalized", "finalized"], "cancelled"),
    "cancelled late": (["start", "stop", "analyze", "cancel", "failed"], "cancelled"),
    "too early": (["start", "cancel", "stop", "finalized"], "result"),
    "failed": (["start", "pause", "stop", "failed", "start"], "error"),
    "open": (["start", "finalized", "pause"], None),
}


def test_sessions_end_once(spark, tmp_path):
    rows = [(m, i, e) for m, (events, _) in SESSIONS.items() for i, e in enumerate(events)]
    got = replay(spark, rows, EVENTS, "seq", live.session_states, str(tmp_path))
    ended = {r.meeting_id: r.terminal for r in got.filter("terminal is not null").collect()}
    assert ended == {m: t for m, (_, t) in SESSIONS.items() if t}
    assert got.filter("terminal is not null").count() == len(ended)
    assert {r.meeting_id: r.terminal for r in live.one_terminal(got).collect()} == ended
    plain = [r.state for r in got.filter("meeting_id = 'plain' and event <> 'chunk'").orderBy("seq").collect()]
    assert sorted(r.seq for r in got.filter("event = 'chunk'").collect()) == [2, 6]
    assert plain == ["recording", "paused", "recording", "finalizing", "analyzing", "done"]


def test_slices(spark, tmp_path):
    rows = [("m", i, 4096, "block") for i in range(40)] + [("m", 40, 0, "pause"), ("m", 41, 4096, "block"), ("m", 42, 0, "resume"), ("m", 43, 4096, "block"), ("m", 44, 0, "stop")]
    got = replay(spark, rows, "meeting_id string, seq bigint, n_samples bigint, event string", "seq", live.emission_slices, str(tmp_path))
    assert [(r.slice, r.first_seq, r.last_seq, r.n_samples) for r in got.orderBy("slice").collect()] == [(0, 0, 31, 131072), (1, 32, 40, 32768), (2, 43, 44, 4096)]


def test_idle_sessions(spark):
    rows = [("m", "2026-01-01 10:00:00"), ("m", "2026-01-01 10:39:00"), ("m", "2026-01-01 11:30:00")]
    df = spark.createDataFrame(rows, "meeting_id string, t string").withColumn("event_time", F.col("t").cast("timestamp"))
    assert sorted(r.rows for r in live.idle_sessions(df).collect()) == [1, 2]


def test_end_of_meeting(spark, segs):
    rows = segs({"start": 0.0, "end": 2.0, "text": "Bütçeyi", "meeting": "a"}, {"start": 0.1, "end": 4.0, "text": "Bütçeyi konuşalım", "meeting": "a"}, {"text": "  ", "meeting": "b"}, {"text": "x", "meeting": "c"})
    done = live.finalize(rows, None, None)
    assert [r.duplicate for r in done.orderBy("seg_idx").collect()] == [True, False, False, False]
    stopped = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", True, True)], "meeting_id string, has_audio boolean, cancelled boolean")
    notes = spark.createDataFrame([("a", None, "provider down")], "meeting_id string, markdown string, error string")
    got = {r.meeting_id: r for r in live.outcomes(done, stopped, notes).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].status, got["a"].speakers_degraded, got["a"].analysis_error) == ("result", True, "provider down")
    assert got["b"].status == "error"
