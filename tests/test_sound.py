import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.operators import align, sides, signal, voices

TURNS = "meeting_id string, turn_idx bigint, start double, end double, speaker string"


def test_alignment(spark, segs):
    turns = spark.createDataFrame([("m", 0, 0.0, 5.0, "A"), ("m", 1, 5.0, 10.0, "B"), ("m", 2, math.nan, 9.0, "C"), ("m", 3, 1.0, math.inf, "D")], TURNS)
    rows = segs(
        {"start": 0.5, "end": 4.5}, {"start": 4.0, "end": 7.0}, {}, {"start": 20.0, "end": 25.0}, {"start": 3.0, "end": 7.0},
        {"start": 1.0, "end": 5.6}, {"start": 4.0, "end": 6.0}, {"start": 0.0, "end": 10.0},
    )
    for sweep in (700_000, 600_000_000):
        out = align.assign_speakers(rows, turns, sweep).orderBy("seg_idx").collect()
        assert [r.speaker for r in out] == ["A", "B", None, None, "A", "A", "A", "A"]
        assert [r.overlap for r in out] == [False, True, False, False, True, False, True, True]
    kept = align.assign_speakers(rows.withColumn("speaker", F.lit("old")), turns.limit(0)).collect()
    assert {r.speaker for r in kept} == {"old"}


def test_alignment_matches_brute_force(spark, segs):
    rng = random.Random(11)
    turns = [("m", i, s := rng.randint(0, 60) / 4, s + rng.randint(0, 40) / 4, rng.choice("ABC")) for i in range(40)]
    rows = [{"start": (s := rng.randint(0, 60) / 4), "end": s + rng.randint(0, 30) / 4} for _ in range(40)]
    out = align.assign_speakers(segs(*rows), spark.createDataFrame(turns, TURNS), 1_500_000).orderBy("seg_idx").collect()
    for got, r in zip(out, rows):
        per = {}
        for _, _, s, e, who in turns:
            shared = min(e, r["end"]) - max(s, r["start"])
            if shared > 0:
                per[who] = per.get(who, 0) + shared
        best = max(per, key=per.get) if per else None
        length = r["end"] - r["start"]
        assert got.speaker == best
        assert got.overlap == (sum(v >= 0.5 and (length <= 0 or v >= 0.3 * length - 1e-9) for v in per.values()) >= 2)


def test_absurd_times_do_no_harm(spark, segs):
    """A segment without an end in sight costs as many rows as any other."""
    turns = spark.createDataFrame([("m", k, k * 2.0, k * 2.0 + 1.5, "AB"[k % 2]) for k in range(200)] + [("m", 500, -1e300, 1e300, "C"), ("m", 501, 3.0, 3.0, "D")], TURNS)
    rows = segs({"start": 0.0, "end": 1e9}, {"start": -math.inf, "end": math.inf}, {"start": 1e300, "end": math.inf}, {"start": math.nan, "end": 5.0}, {"start": 1.0, "end": 1.25}, {"start": 9.0, "end": 2.0})
    shared = align.shared_time(rows, turns.filter("speaker <> 'C'"))
    assert {(r.seg_idx, r.speaker, r.shared_us) for r in shared.collect()} == {(k, who, 150_000_000) for k in (0, 1) for who in "AB"} | {(4, "A", 250_000)}
    out = align.assign_speakers(rows, turns).orderBy("seg_idx").collect()
    assert [r.speaker for r in out] == ["C", "C", None, None, "A", None]
    ties = align.first_turns(shared, rows, turns).collect()
    assert {(r.seg_idx, r.speaker): r.first_turn for r in ties} == {(0, "A"): 0, (0, "B"): 1, (1, "A"): 0, (1, "B"): 1, (4, "A"): 0}


@pytest.mark.parametrize("low", [0, 2])
def test_first_turns_of_many_at_once(spark, segs, low):
    """Turns that all overlap: a segment meets runs of turns, not every turn; begins, ends and starts coincide."""
    rng = random.Random(low)
    turns = [("m", i, float(s := rng.randint(0, 30)), float(s + rng.randint(0, 12)), rng.choice("AB")) for i in rng.sample(range(1000), 150)]
    rows = [{"start": float(s := rng.randint(0, 40)), "end": float(s + rng.randint(0, 6))} for _ in range(120)]
    df, listed = segs(*rows), spark.createDataFrame(turns, TURNS)
    pairs = spark.createDataFrame([("m", i, who) for i in range(120) for who in "AB"], "meeting_id string, seg_idx bigint, speaker string")
    first = align.first_turns(pairs, df, listed, 5_000_000, low)
    got = {(r.seg_idx, r.speaker): r.first_turn for r in first.collect()}
    want = {}
    for i, r in enumerate(rows):
        for _, k, s, e, who in turns:
            if min(r["end"], e) > max(r["start"], s):
                want[i, who] = min(want.get((i, who), k), k)
    assert got == want and len(want) > 100


def test_first_turns_match_brute_force(spark, segs):
    rng = random.Random(3)
    turns = [("m", i, s := rng.randint(-20, 60) / 7, s + rng.randint(0, 40) / 7, rng.choice("AB")) for i in range(60)]
    rng.shuffle(turns)
    rows = [{"start": (s := rng.randint(-20, 60) / 7), "end": s + rng.randint(0, 30) / 7} for _ in range(60)]
    df, listed = segs(*rows), spark.createDataFrame(turns, TURNS)
    got = {(r.seg_idx, r.speaker): (r.shared_us, r.first_turn) for r in align.first_turns(align.shared_time(df, listed, 3_000_000), df, listed).collect()}
    us = lambda x: math.floor(x * 1e6 + 0.5)
    want = {}
    for i, r in enumerate(rows):
        for _, k, s, e, who in turns:
            both = min(us(e), us(r["end"])) - max(us(s), us(r["start"]))
            if both > 0:
                total, first = want.get((i, who), (0, k))
                want[i, who] = total + both, min(first, k)
    assert got == want and len(want) > 60


SPEECH, NOISE = 0.2, 0.001


def envelope(spark, seconds, *spans):
    n = round(seconds / sides.FRAME_SECONDS)
    mic, system = [NOISE] * n, [NOISE] * n
    for a, b, m, s in spans:
        for i in range(round(a / sides.FRAME_SECONDS), min(n, round(b / sides.FRAME_SECONDS))):
            mic[i], system[i] = m, s
    return spark.createDataFrame([("m", i, float(mic[i]), float(system[i])) for i in range(n)], "meeting_id string, frame bigint, mic float, system float")


# a room that speaks, then a far side, with stillness around both
CALL = (12, (1, 4, SPEECH, NOISE), (7, 10, NOISE, SPEECH))
ROOM, FAR_SIDE, STILL = ({"start": s, "end": e} for s, e in ((1.4, 3.5), (7.3, 9.6), (4.4, 6.5)))
SIDE_CASES = [
    (CALL, ROOM, "local"),
    (CALL, FAR_SIDE, "remote"),
    (CALL, STILL, None),
    (CALL, {}, None),
    ((5, (0, 4, SPEECH * 0.1, SPEECH)), {"start": 0.5, "end": 3.4}, "remote"),
    ((9, (0, 9, NOISE * 3, 0.03), (3, 6, SPEECH, 0.03)), {"start": 3.4, "end": 5.5}, "local"),
    ((12, (1, 4, SPEECH, NOISE), (4, 7, SPEECH, SPEECH), (7, 10, NOISE, SPEECH)), {"start": 4.5, "end": 6.4}, "mixed"),
    ((5, (0, 5, NOISE, 0.0), (0, 4, SPEECH, 0.0)), {"start": 0.5, "end": 3.4}, "local"),
    ((5, (0, 4, NOISE, SPEECH)), {"start": 0.5, "end": 3.4}, "remote"),
]


@pytest.mark.parametrize("shape,segment,want", SIDE_CASES)
def test_sides(spark, segs, shape, segment, want):
    out = sides.attribute_sides(segs(segment), envelope(spark, *shape))
    assert out.collect()[0].source == want


def test_segment_energy_by_spans(spark, segs):
    rng = random.Random(2)
    data = [("m", i, rng.random(), rng.random()) for i in range(200)]
    leveled = spark.createDataFrame(data, "meeting_id string, frame bigint, mic_sq double, system_sq double")
    rows = [{"start": 0.016 * a, "end": 0.016 * b} for a, b in [(0, 200), (3, 4), (7, 63), (16, 48), (150, 260)]]
    got = sides.segment_energy(segs(*rows), leveled, span=16).orderBy("seg_idx").collect()
    for r, row in zip(got, rows):
        lo, hi = math.floor(row["start"] / 0.016), min(200, math.ceil(row["end"] / 0.016))
        assert r.frames == hi - lo
        assert r.mic == pytest.approx(sum(d[2] for d in data[lo:hi]))


def test_speaker_sides(segs):
    rows = segs(
        {"start": 0.0, "end": 8.0, "speaker": "A", "source": "remote"},
        {"start": 8.0, "end": 9.0, "speaker": "A", "source": "local"},
        {"start": 9.0, "end": 12.0, "speaker": "B", "source": "local"},
        {"start": 0.0, "end": 2.0, "speaker": "C", "source": "remote"},
        {"start": 2.0, "end": 4.0, "speaker": "C", "source": "local"},
        {"start": 6.0, "end": 60.0, "speaker": "B", "source": "remote", "duplicate": True},
        {"start": 5.0, "end": 6.0, "speaker": "D", "source": "mixed"},
    )
    got = {r.speaker: r.side for r in sides.speaker_sides(rows).collect()}
    assert got == {"A": "remote", "B": "local", "C": "mixed"}


def test_envelope_placement(spark):
    schema = "meeting_id string, seq bigint, offset_samples bigint, mic array<float>, system array<float>"
    chunks = [("a", 0, 0, [1.0, 2.0], [0.0, 0.0]), ("a", 1, 512, [3.0, 4.0], []), ("b", 0, 0, [1.0], [0.0]), ("b", 1, 1024, [5.0], [0.5]), ("c", 0, 768, [], [])]
    got = {}
    for r in sides.place_frames(spark.createDataFrame(chunks, schema)).orderBy("frame").collect():
        got.setdefault(r.meeting_id, []).append((r.mic, r.system))
    assert [m for m, _ in got["a"]] == [1, 2, 3, 4]
    assert got["b"] == [(1, 0), (0, 0), (0, 0), (0, 0), (5, 0.5)]
    assert "c" not in got


def test_silence_is_not_shuffled(spark):
    """Frames far apart: pieces without sound, the edges of pieces, and a place before the start."""
    schema = "meeting_id string, seq bigint, offset_samples bigint, mic array<float>, system array<float>"
    starts = [-3, 0, 1022, 1023, 2048, 5000]
    rows = [("a", i, b * 256, [1.0 + i, 2.0 + i, 3.0 + i], [0.5]) for i, b in enumerate(starts)] + [("b", 0, -2560, [1.0], [1.0])]
    want = {}
    for i, b in enumerate(starts):
        want.update({b + k: (1.0 + i + k, 0.5 if k == 0 else 0.0) for k in range(3)})
    placed = sides.place_frames(spark.createDataFrame(rows, schema))
    got = {r.frame: (r.mic, r.system) for r in placed.filter("meeting_id = 'a'").collect()}
    assert got == {f: want.get(f, (0.0, 0.0)) for f in range(5003)}
    assert placed.filter("meeting_id = 'b'").count() == 0
    joined = placed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(joined) if "Join" in line)
    assert any("Generate explode(sequence" in line for line in joined[:at])


RATE = 16_000


def hiss(seconds, amplitude, seed=8):
    return np.random.default_rng(seed).uniform(-amplitude, amplitude, round(seconds * RATE))


def with_voice(audio, a, b, amplitude, steady=False):
    """A hum of 170 Hz that swells five times a second, unless it is steady."""
    i = np.arange(round(a * RATE), round(b * RATE))
    loud = np.ones(len(i)) if steady else 0.65 - 0.35 * np.cos(2 * np.pi * 5 * i / RATE)
    audio[i] += amplitude * loud * np.sin(2 * np.pi * 170 * i / RATE)
    return audio


def test_speech_bounds(spark):
    cases = {
        "silence": np.zeros(6 * RATE),
        "room": hiss(9, 0.003),
        "loud room": hiss(9, 0.052),
        "bump": with_voice(hiss(9, 0.036), 2, 2.06, 0.3, steady=True),
        "late": with_voice(hiss(15, 0.003), 10, 13, 0.25),
        "gapless": with_voice(hiss(7, 0.003), 0, 7, 0.25),
        "click": with_voice(hiss(9, 0.003), 6, 6.04, 0.6, steady=True),
        "faint": with_voice(hiss(9, 0.002), 3, 6, 0.02),
        "short": np.zeros(77),
    }
    import pandas as pd

    frames = [pd.DataFrame({"meeting_id": k, "sample_idx": range(len(v)), "value": v.astype("float32")}) for k, v in cases.items()]
    samples = spark.createDataFrame(pd.concat(frames))
    lengths = spark.createDataFrame([(k, len(v)) for k, v in cases.items()], "meeting_id string, n_samples bigint")
    energy = signal.frame_energy(samples).persist()
    for block in (6, 4096):
        got = {r.meeting_id: r for r in signal.speech_bounds(energy, lengths, block).collect()}
        assert {k for k, r in got.items() if r.has_speech} == {"late", "gapless", "faint"}
        assert 8.5 < got["late"].start_sample / RATE < 10 and got["late"].end_sample / RATE > 13
        assert (got["gapless"].start_sample, got["gapless"].end_sample) == (0, 7 * RATE)
        assert got["faint"].start_sample / RATE < 3 and got["faint"].end_sample / RATE > 6
        assert got["short"].start_sample is None


def test_resample_and_mix(spark):
    rng = random.Random(1)
    xs = [rng.random() for _ in range(50)]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(xs)], "meeting_id string, sample_idx bigint, value double")
    lengths = spark.createDataFrame([("m", 50)], "meeting_id string, n_samples bigint")
    for frm, to in ((48_000, 16_000), (44_100, 16_000), (8_000, 16_000)):
        got = [r.value for r in signal.resample(df, lengths, frm, to, block_rows=7).orderBy("sample_idx").collect()]
        ratio = frm / to
        want = []
        for i in range(math.floor(50 / ratio)):
            idx = math.floor(i * ratio)
            nxt = xs[idx + 1] if idx + 1 < 50 else xs[idx]
            want.append(xs[idx] + (nxt - xs[idx]) * (i * ratio - idx))
        assert got == pytest.approx(want)


# --- voices --------------------------------------------------------------------------------------


def test_window_plan(spark):
    regions = spark.createDataFrame([("m", 0.0, 4.0), ("m", 5.0, 5.4), ("m", 6.0, 7.5)], "meeting_id string, start double, end double")
    durations = spark.createDataFrame([("m", 8.0)], "meeting_id string, duration double")
    got = sorted((r.crop_start, r.mask_start, r.mask_end) for r in voices.plan_windows(regions, durations).collect())
    want = [(0.0, 0.0, 1.5), (0.75, 0.75, 2.25), (1.5, 1.5, 3.0), (2.25, 2.25, 3.75), (4.45, 5.0, 5.4), (6.0, 6.0, 7.5)]
    assert len(got) == len(want) and all(g == pytest.approx(w) for g, w in zip(got, want))


def test_frames_to_named_turns(spark):
    labels = [2] * 6 + [0] * 3 + [2] * 7 + [1] * 5 + [-9] * 4 + [1] * 8
    rows = [("m", i, v) for i, v in enumerate(labels) if v >= 0]
    frames = spark.createDataFrame(rows, "meeting_id string, frame bigint, label int")
    for block in (2, 4096):
        turns = voices.frames_to_turns(frames, block)
        assert sorted((r.lo, r.hi, r.label) for r in turns.collect()) == [(0, 6, 2), (9, 16, 2), (16, 21, 1), (25, 33, 1)]
        named = sorted((r.start, r.speaker) for r in voices.name_speakers(turns).collect())
        assert named == [(0.0, "SPEAKER_00"), (0.45, "SPEAKER_00"), (0.8, "SPEAKER_01"), (1.25, "SPEAKER_01")]


def test_nearest_windows(spark):
    windows = spark.createDataFrame([("m", 0, 0.0, 1.0, 4), ("m", 1, 3.0, 4.0, 7), ("m", 2, 3.0, 4.0, 8)], "meeting_id string, w_idx int, mask_start double, mask_end double, label int")
    frames = spark.createDataFrame([("m", f) for f in (0, 20, 39, 41, 90)], "meeting_id string, frame bigint")
    for block in (8, 4096):
        got = {r.frame: r.label for r in voices.nearest_windows(frames, windows, block).collect()}
        assert got == {0: 4, 20: 4, 39: 4, 41: 7, 90: 7}


def test_fold_marginal(spark):
    rows, w = [], 0
    for label, count, vector in [(0, 10, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (2, 10, [0.0, 1.0])]:
        for _ in range(count):
            rows.append(("m", w, w * 0.75, w * 0.75 + 1.5, label, vector))
            w += 1
    windows = spark.createDataFrame(rows, "meeting_id string, w_idx int, mask_start double, mask_end double, label int, embedding array<double>")
    regions = spark.createDataFrame([("m", 0.0, 17.25)], "meeting_id string, start double, end double")
    durations = spark.createDataFrame([("m", 17.25)], "meeting_id string, duration double")
    folded = voices.fold_marginal(regions, windows, durations)
    assert {(r.label, r["count"]) for r in folded.groupBy("label").count().collect()} == {(0, 12), (2, 10)}


def test_interior_and_even_spread(spark):
    labels = [0] * 12 + [1] * 3 + [0] * 10 + [-1] * 5
    frames = spark.createDataFrame([("m", i, v) for i, v in enumerate(labels)], "meeting_id string, frame bigint, label int")
    got = sorted(r.frame for r in voices.interior_frames(frames, reach=2, block_rows=4).collect())
    held = np.array(labels)
    want = []
    for s in (0, 1):
        inside = held == s
        keep = inside.copy()
        for shift in (1, 2):
            keep &= np.roll(inside, shift) & np.roll(inside, -shift)
        want += list(np.flatnonzero(keep))
    assert got == sorted(want)
    for n, k in ((10, 4), (3, 5), (47, 24), (100, 24), (1, 1)):
        rows = spark.createDataFrame([("m", i) for i in range(n)], "meeting_id string, i bigint")
        picked = sorted(r.i for r in voices.evenly_spaced(rows, ["meeting_id"], "i", k, block_rows=3).collect())
        assert picked == list(np.linspace(0, n - 1, min(n, k)).astype(int))


def test_refine_boundaries(spark):
    frames = spark.createDataFrame([("m", i, 0 if i < 20 else 1) for i in range(40)], "meeting_id string, frame bigint, label int")
    changes = spark.createDataFrame([("m", 0.0, 20, 10, 30, 0, 1)], "meeting_id string, region double, change bigint, low bigint, high bigint, left int, right int")
    fine = spark.createDataFrame([("m", 20, 0.9, 1.3, 0.9, 0.2), ("m", 20, 1.2, 1.5, 0.2, 0.9)], "meeting_id string, change bigint, span_start double, span_end double, like_left double, like_right double")
    got = [r.label for r in voices.refine_boundaries(frames, changes, fine).orderBy("frame").collect()]
    assert got[:18] == [0] * 18 and got[20:24] == [0] * 4 and got[27:] == [1] * 13
