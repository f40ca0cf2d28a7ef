"""Envelopes and endings written by streams: the same however chunks come, once whatever is repeated."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.operators import sides
from talkframe.streaming import ending, envelope, live

FRAMES = "meeting_id string, seq bigint, offset_samples bigint, mic array<float>, system array<float>"


def files(spark, rows, schema, folder, parts, first=0):
    for i in range(parts):
        if rows[i::parts]:
            spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.parquet(f"{folder}/in/{first + i:04d}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def frame_chunks(seed=2):
    rng = random.Random(seed)
    rows = []
    for m in "ab":
        for seq in range(40):
            n = rng.choice([0, 1, 5, 300])
            level = [float(np.float32(rng.random())) for _ in range(n)]
            rows.append((m, seq, rng.choice([0, 130, 128, 65_000, 400_000, 256 * seq * 9]), level, level[: n // 2]))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_envelope_equals_batch(spark, tmp_path, parts):
    rows = frame_chunks()
    mixed = random.Random(parts).sample(rows + rows[::3], len(rows + rows[::3]))
    files(spark, mixed, FRAMES, tmp_path, parts)
    live.run_to_end(envelope.placed_blocks(stream(spark, FRAMES, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/check", mode="update")
    got = envelope.envelope(spark.read.parquet(f"{tmp_path}/out")).collect()
    want = sides.place_frames(spark.createDataFrame(rows, FRAMES)).collect()
    key = lambda r: (r.meeting_id, r.frame, r.mic, r.system)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 2000


def test_scattered_chunks_are_no_calls_of_python(spark, tmp_path):
    """Chunks far apart, each in a block of its own: the state is an aggregate by frame."""
    rows = [("m", k, k * 256 * 1000, [1.0, 2.0], [0.5]) for k in range(300)] + [("m", 300, 256, [], [])]
    files(spark, rows, FRAMES, tmp_path, 2)
    placed = envelope.placed_blocks(stream(spark, FRAMES, tmp_path))
    assert "TransformWithState" not in placed._jdf.queryExecution().logical().toString()
    live.run_to_end(placed, f"{tmp_path}/out", f"{tmp_path}/check", mode="update")
    frames = envelope.envelope(spark.read.parquet(f"{tmp_path}/out"))
    got = frames.agg(F.count("*").alias("n"), F.sum("mic").alias("mic"), F.sum("system").alias("system")).collect()[0]
    assert tuple(got) == (299_002, 900.0, 150.0)


def test_late_chunks_after_a_restart_and_a_bounded_state(spark, tmp_path):
    timed = FRAMES + ", event_time timestamp"
    at = lambda minute: datetime(2026, 1, 1, 10) + timedelta(minutes=minute)
    rows = [("a", 0, 0, [0.5], [0.5], at(0)), ("a", 2, 512, [0.25], [], at(2)), ("a", 1, 256, [0.125], [], at(1)), ("z", 0, 0, [1.0], [], at(500)), ("a", 3, 0, [0.75], [], at(3)), ("z", 1, 256, [1.0], [], at(501))]
    for k, row in enumerate(rows):
        files(spark, [row], timed, tmp_path, 1, k)
        made = envelope.placed_blocks(stream(spark, timed, tmp_path), "10 minutes")
        live.run_to_end(made, f"{tmp_path}/out", f"{tmp_path}/check", mode="update")
    got = {(r.meeting_id, r.frame): r.mic for r in envelope.envelope(spark.read.parquet(f"{tmp_path}/out")).collect()}
    # the last chunk of a is later than the watermark allows
    assert got == {("a", 0): 0.5, ("a", 1): 0.125, ("a", 2): 0.25, ("z", 0): 1.0, ("z", 1): 1.0}


@pytest.mark.parametrize("size", [100, 256, 1000, 70_000])
def test_frames_run_over_chunks(spark, tmp_path, size):
    sound = (np.arange(150_000) % 97 / 64).astype(np.float32)
    rows = [("m", k, k * size, sound[k * size : (k + 1) * size].tolist(), sound[k * size : (k + 1) * size][: size // 3].tolist()) for k in range(-(-len(sound) // size)) if k < 200]
    rows = [r for r in rows if r[3]]
    mixed = random.Random(1).sample(rows + rows[::4], len(rows + rows[::4]))
    files(spark, mixed, FRAMES, tmp_path, 3)
    live.run_to_end(envelope.measured_frames(stream(spark, FRAMES, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/check")
    heard = np.concatenate([np.array(r[3]) for r in rows])
    far = np.concatenate([np.r_[r[4], np.zeros(len(r[3]) - len(r[4]))] for r in rows])
    whole = len(heard) // 256
    rms = lambda x: np.sqrt((x[: whole * 256].reshape(-1, 256) ** 2).mean(axis=1))
    got = sorted((r.frame, r.mic, r.system) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [g[0] for g in got] == list(range(whole))
    assert np.allclose([g[1] for g in got], rms(heard)) and np.allclose([g[2] for g in got], rms(far))


CHUNKS = f"meeting_id string, seq bigint, n_samples bigint, segments array<{live.PIECE}>, is_stop boolean"
SAY = 16_000 * 5


def meeting(name, texts, stop=True):
    rows = [(name, k, SAY, [(0.0, 4.0, t)], False) for k, t in enumerate(texts)]
    return rows + ([(name, len(texts), 0, [], True)] if stop else [])


def hear(spark, folder, check="check", **tables):
    rows = live.live_rows(stream(spark, CHUNKS, folder), coalesce=False)
    ending.start_meetings(rows, f"{folder}/out", f"{folder}/{check}", once=True, **tables).awaitTermination()
    return {r.meeting_id: r for r in ending.outcomes(spark, f"{folder}/out").collect()}


def test_every_meeting_ends_once(spark, tmp_path):
    rows = [*meeting("plain", ["good morning all of you", "budget first then the plan", "see you next week then"]), *meeting("mute", [" ", ""]), *meeting("off", ["nobody wants this one"]), *meeting("open", ["still going on here"] * 5, False), *meeting("late", ["a word", "another word here"])]
    late = [r for r in rows if r[0] == "late"]
    files(spark, random.Random(4).sample([r for r in rows if r not in late[:1]], len(rows) - 1), CHUNKS, tmp_path, 3)
    turns = spark.createDataFrame([("plain", 0, 0.0, 7.0, "A"), ("plain", 1, 7.0, 15.0, "B"), ("off", 0, 0.0, 9.0, "A"), ("late", 0, 0.0, 9.0, "A")], "meeting_id string, turn_idx bigint, start double, end double, speaker string")
    one = lambda name: spark.createDataFrame([(name,)], "meeting_id string")
    notes = lambda lines: lines.groupBy("meeting_id").agg(F.concat(F.lit("# "), F.count("*").cast("string")).alias("markdown")).withColumn("error", F.when(F.col("meeting_id") == "late", "no answer"))
    tables = {"turns": turns, "silent": one("late"), "cancelled": one("off"), "analyse": notes}
    got = hear(spark, tmp_path, **tables)
    assert {m: r.status for m, r in got.items()} == {"plain": "result", "mute": "error", "off": "cancelled"}
    # the row that was missing comes after a restart
    files(spark, late[:1], CHUNKS, tmp_path, 1, 10)
    got = hear(spark, tmp_path, **tables)
    assert {m: (r.status, r.speakers_degraded, r.analysis_error) for m, r in got.items() if m != "mute"} == {"plain": ("result", False, None), "off": ("cancelled", False, None), "late": ("result", True, "no answer")}
    texts = ending.transcripts(spark, f"{tmp_path}/out").orderBy("meeting_id", "seg_idx").collect()
    assert [(r.meeting_id, r.seg_idx, r.speaker) for r in texts if r.meeting_id != "mute"] == [("late", 0, None), ("late", 1, None), ("plain", 0, "A"), ("plain", 1, "A"), ("plain", 2, "B")]
    assert {r.meeting_id for r in ending.deltas(spark, f"{tmp_path}/out").collect()} == {"plain", "mute", "open", "late"}
    # everything once more, as if the checkpoint had been lost: other triggers, the same outcomes
    again = hear(spark, tmp_path, "other", **tables)
    assert {m: r.status for m, r in again.items()} == {m: r.status for m, r in got.items()}
    assert ending.outcomes(spark, f"{tmp_path}/out").count() == 4


def test_a_trigger_without_its_mark_is_not_read(spark, tmp_path):
    files(spark, meeting("m", ["one two three"]), CHUNKS, tmp_path, 1)
    assert hear(spark, tmp_path)["m"].status == "result"
    row = ending.outcomes(spark, f"{tmp_path}/out").withColumn("status", F.lit("error"))
    row.write.parquet(f"{tmp_path}/out/outcomes/batch=77")
    assert [r.status for r in ending.outcomes(spark, f"{tmp_path}/out").collect()] == ["result"]
