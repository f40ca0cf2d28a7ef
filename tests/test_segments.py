import random

import pytest
from pyspark.sql import functions as F

from talkframe.operators import segments as S
from talkframe.plans.blocks import islands, order_statistics, scan, with_block
from talkframe.sources.scripts import script_segments


def flags(df, column="duplicate"):
    return [r[column] for r in df.orderBy("seg_idx").collect()]


def test_repeat_flags(segs):
    pair = segs(
        {"start": 100.0, "end": 104.0, "text": "Kitapları rafa dizelim önce. Sonra kapıyı kilitleyip çıkarız birlikte."},
        {"start": 104.0, "end": 104.9, "text": "Olur mu? Kitapları rafa dizelim önce sonra kapıyı kilitleyip çıkarız"},
        {"start": 105.2, "end": 108.0, "text": "Olur mu olmaz mı yarın konuşuruz"},
    )
    assert flags(S.flag_repeats(pair)) == [False, True, False]
    without_times = segs({"text": "dal yaprak kök gövde çiçek"}, {"text": "dal yaprak kök gövde çiçek"})
    assert flags(S.flag_repeats(without_times)) == [False, True]
    three_words = segs({"start": 7.0, "end": 8.0, "text": "Öyle değil mi"}, {"start": 8.0, "end": 9.0, "text": "Öyle değil mi"})
    assert flags(S.flag_repeats(three_words)) == [False, False]


def longest_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_repeats_match_brute_force_across_blocks(segs):
    rng = random.Random(7)
    rows = []
    for _ in range(120):
        n = rng.randint(1, 9)
        rows.append({"start": 0.0, "end": rng.choice([0.5, 5.0]), "text": " ".join(rng.choice("ab") * 3 for _ in range(n))})
    want = []
    for i, r in enumerate(rows):
        cur = r["text"].split()
        prev = [w for p in rows[max(0, i - 2) : i] for w in p["text"].split()]
        ratio = longest_run(cur, prev) / len(cur)
        fast = len(r["text"]) / r["end"] > 25
        want.append(i > 0 and len(cur) >= 4 and (ratio >= 0.8 or (ratio >= 0.6 and fast)))
    df = segs(*rows)
    assert flags(S.flag_repeats(df, block_rows=3)) == want
    assert flags(S.flag_repeats(df)) == want
    assert True in want and False in want


def said(start, end, text, **more):
    return {"start": start, "end": end, "text": text, **more}


TRAIN = said(12.1, 15.0, "Treni sabah altıda kaçırdık.")
ORPHAN = [
    ([said(12.0, 13.4, "Treni sabah"), TRAIN], [True, False]),
    ([said(51.2, 51.9, "Hadi."), said(50.0, 54.0, "Hadi. Yola koyulalım artık.")], [True, False]),
    ([said(8.0, 9.0, "Biz yarın geliriz."), said(8.0, 9.8, "Biz yarın gelmeyiz.")], [False, False]),
    ([said(2.0, 3.0, "Bahçe kapısı"), said(70.0, 73.0, "Bahçe kapısı açık kalmış yine.")], [False, False]),
    ([said(15.0, 16.0, "iki eş cümle"), said(15.5, 16.5, "iki eş cümle")], [False, False]),
    ([said(12.0, 13.4, "Treni sabah"), said(12.2, 12.9, "sabah", duplicate=True), TRAIN], [True, True, False]),
    ([said(None, None, "Treni sabah"), said(None, None, "Treni sabah altıda kaçırdık.")], [False, False]),
]


@pytest.mark.parametrize("rows,want", ORPHAN)
@pytest.mark.parametrize("block", [1, 2, 4096])
def test_orphans(segs, rows, want, block):
    assert flags(S.flag_orphans(segs(*rows), block_rows=block)) == want


def test_seam(segs):
    rows = segs({"start": 8.0, "end": 9.1}, {"start": 8.9, "end": 10.4}, {"start": 9.5, "end": 12.0}, {}, {"start": 8.5, "end": 9.25})
    assert flags(S.flag_seam(rows, F.lit(9.0))) == [True, False, False, False, True]
    moved = S.shift(segs({"start": 1.0, "end": 2.0}, {}), F.lit(10.0)).orderBy("seg_idx").collect()
    assert (moved[0].start, moved[0].end, moved[1].start) == (11.0, 12.0, None)


def text_of(lines):
    rows = S.line_text(lines).orderBy("meeting_id", "line_idx", "part").collect()
    out = {}
    for r in rows:
        out.setdefault(r.line_idx, []).append(r.line)
    return "\n".join(" ".join(parts) for _, parts in sorted(out.items()))


def test_dialogue_forms(segs):
    both = segs(
        {"text": "Günaydın", "speaker": "SPEAKER_01", "source": "remote"},
        {"text": "hazır mıyız", "speaker": "SPEAKER_01", "source": "remote"},
        {"text": "Hazırız", "speaker": "SPEAKER_02", "source": "local"},
        {"text": "Hazırız", "speaker": "SPEAKER_02", "source": "local", "duplicate": True},
    )
    for block in (1, 2, 4096):
        assert text_of(S.transcript_lines(both, block)) == "SPEAKER_01 (Uzak): Günaydın hazır mıyız\nSPEAKER_02 (Yerel): Hazırız"
    assert text_of(S.dialogue(both)) == "SPEAKER_01: Günaydın hazır mıyız\nSPEAKER_02: Hazırız"
    assert text_of(S.side_dialogue(both)) == "Uzak Konuşmacı: Günaydın hazır mıyız\nYerel Konuşmacı: Hazırız"
    assert text_of(S.analysis_lines(both, False)) == "Günaydın hazır mıyız Hazırız"
    assert text_of(S.analysis_lines(both, False, True)) == text_of(S.side_dialogue(both))
    faint = segs({"text": "Günaydın", "speaker": "SPEAKER_01", "source": "local"}, {"text": "uğultu", "speaker": "SPEAKER_02"}, {"text": "x"})
    assert text_of(S.transcript_lines(faint)) == "SPEAKER_01 (Yerel): Günaydın\nSPEAKER_02: uğultu\nSPEAKER_??: x"
    sides = segs({"text": "Öteden", "source": "remote"}, {"text": "uğultu"}, {"text": "a", "source": "mixed"})
    assert text_of(S.transcript_lines(sides)) == "Uzak Konuşmacı: Öteden\nBelirsiz: uğultu\nKarışık: a"
    plain = segs({"text": " Günaydın\n"}, {"text": " "}, {"text": "yoklamaya  geçelim"})
    assert text_of(S.transcript_lines(plain)) == "Günaydın yoklamaya geçelim"


def test_report_does_not_depend_on_blocks(segs):
    rows = segs(
        {"start": 0.0, "end": 2.0, "speaker": "A"},
        {"start": 2.0, "end": 3.5},
        {"start": 3.5, "end": 4.0, "speaker": "A", "overlap": True},
        {"start": 4.0, "end": 9.0, "speaker": "B"},
        {"start": 9.0, "end": 8.0, "speaker": "A"},
        {"speaker": "B"},
    )
    for block in (1, 2, 4096):
        r = S.speaker_report(rows, block).collect()[0]
        assert (r.speaker_count, r.turns, r.switches, r.unlabeled, r.unlabeled_seconds, r.overlap_flags, r.labeled_seconds) == (2, 4, 3, 1, 1.5, 1, 7.5)
    shares = S.speaker_shares(rows).orderBy("appearance").collect()
    assert [(s.speaker, s.segments, s.seconds, s.share) for s in shares] == [("A", 3, 2.5, 0.333), ("B", 2, 5.0, 0.667)]


def test_readable_lines(segs):
    rows = segs({"start": 61.6, "end": 125.0, "text": " x ", "speaker": "S", "duplicate": True, "overlap": True}, {"text": "y"})
    got = [r.line for r in S.readable_lines(rows).orderBy("seg_idx").collect()]
    assert got == ["[01:02-02:05] S: x   [DUP OVERLAP]", "[--:-----:--] SPEAKER_??: y"]


def test_timestamp_quality_and_counts(segs):
    rows = segs({"start": 0.0, "end": 1.5, "duplicate": True}, {"start": 2.0, "end": 3.25, "overlap": True}, {"start": 4.5, "end": 6.0})
    q = S.timestamp_quality(rows).collect()[0]
    assert (q.boundaries, q.decimal, q.integer_stuck, q.decimal_ratio) == (6, 3, 3, 0.5)
    c = S.flag_counts(rows).collect()[0]
    assert (c.duplicate_flags, c.overlap_flags) == (1, 1)


def test_script_loops(spark):
    scripts = spark.createDataFrame([("s", "Günaydın çocuklar, ders başladı bile.\n\n[[LOOP:tamam:3]]\nbitti")], "meeting_id string, text string")
    for block in (1, 4096):
        rows = script_segments(scripts, block).orderBy("seg_idx").collect()
        assert [(r.seg_idx, r.start, r.end, r.text) for r in rows] == [
            (0, 0.0, 2.64, "Günaydın çocuklar, ders başladı bile."),
            (1, 2.64, 3.44, "tamam"),
            (2, 3.44, 4.24, "tamam"),
            (3, 4.24, 5.04, "tamam"),
            (4, 5.04, 5.84, "bitti"),
        ]


def test_scans_match_plain_loops(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for k in "xy" for i in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint, l string")
    kinds = {n: (n, F.col("v")) for n in ("sum", "max", "last", "before", "after", "lag", "lead", "all_sum", "all_max")}
    got = scan(with_block(df, "i", 4), ["k"], ["i"], kinds)
    numbered = islands(with_block(df, "i", 4), ["k"], ["i"], F.col("l"))
    found = {(r.k, r.i): r for r in got.collect()}
    runs = {(r.k, r.i): r.island for r in numbered.collect()}
    for k in "xy":
        rows = [d for d in data if d[0] == k]
        vs, run = [d[2] for d in rows], -1
        for n, d in enumerate(rows):
            r, known = found[(k, d[1])], [v for v in vs[: n + 1] if v is not None]
            later, past = [v for v in vs[n + 1 :] if v is not None], [v for v in vs[:n] if v is not None]
            assert r["sum"] == sum(known)
            assert r["max"] == (max(known) if known else None)
            assert r["last"] == (known[-1] if known else None)
            assert r["before"] == (past[-1] if past else None)
            assert r["after"] == (later[0] if later else None)
            assert r["lag"] == (vs[n - 1] if n else None)
            assert r["lead"] == (vs[n + 1] if n + 1 < len(vs) else None)
            assert r["all_sum"] == sum(v for v in vs if v is not None)
            run += n == 0 or rows[n - 1][3] != d[3]
            assert runs[(k, d[1])] == run


@pytest.mark.parametrize("scale", [9.0, 2e-4, -3.0, 1e-310])
def test_order_statistics_are_exact(spark, scale):
    rng = random.Random(5)
    data = [(k, rng.choice([0.0, 0.25 * scale, 2.0 ** -rng.randint(0, 9) * scale, (rng.random() - 0.3) * scale])) for k in "ab" for _ in range(301)]
    df = spark.createDataFrame(data, "k string, v double")
    got = order_statistics(df, ["k"], F.col("v"), {"low": lambda n: F.floor(n * 0.1), "high": lambda n: n - 1}).collect()
    for r in got:
        vs = sorted(v for k, v in data if k == r.k)
        assert (r.n, r.low, r.high) == (301, vs[30], vs[300])


def test_order_statistics_of_infinite_values(spark):
    inf, nan = float("inf"), float("nan")
    data = [("a", v) for v in (inf, -inf, 1.0, -inf, 1.7e308, -1.7e308, None, 0.0)] + [("b", v) for v in (nan, 2.0, inf)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in order_statistics(df, ["k"], F.col("v"), {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "high": lambda n: n - 1}).collect()}
    assert (got["a"].n, got["a"].low, got["a"].mid, got["a"].high) == (7, -inf, 0.0, inf)
    assert (got["b"].n, got["b"].low, got["b"].mid) == (3, 2.0, inf) and got["b"].high != got["b"].high
