"""Hard negatives beside brute force in whole numbers."""

import numpy as np
import pytest

from talkframe.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, d string, tile string, norm string"


def brute(rows):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)
        if sum(x * x for x in q) < 2**56:
            kept[vec_id, label, q] = None
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        score = {x: sum(p * q for p, q in zip(a[2], x[2])) for x in kept if len(x[2]) == len(a[2])}
        order = sorted(score, key=lambda x: (-score[x], x[0]))
        for p in [x for x in order if x[1] == a[1] and x[0] != a[0]][:5]:
            found = [x for x in order if x[1] != a[1] and 80 * score[p] <= 100 * score[x] <= 100 * score[p]][:5]
            out += [(a[0], p[0], k, x[0], score[p], score[x]) for k, x in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(4)


def vectors(seed, n, d, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    label = rng.integers(0, 10, n)
    x = centres[label % clusters] + rng.normal(size=(n, d)) * 0.4
    return [(i * 5, x[i].astype(np.float32).tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize(("seed", "d", "clusters"), [(1, 8, 3), (2, 3, 10), (3, 64, 1)])
def test_as_by_brute_force(spark, seed, d, clusters):
    rows = vectors(seed, 500, d, clusters)
    rows += [(10_000 + k, rows[40][1], k % 3) for k in range(60)]  # equal vectors, ties by id
    got = negatives.hard_negatives(table(spark, rows), 64, 16).collect()
    assert sorted(map(tuple, got)) == brute(rows) and got


def test_small_tiles_find_what_large_ones_find(spark):
    rows = vectors(5, 300, 6, 2)
    small, large = (sorted(map(tuple, negatives.hard_negatives(table(spark, rows), *sizes).collect())) for sizes in ((7, 2), (8192, 1024)))
    assert small == large == brute(rows)


def test_rows_without_parts_and_odd_vectors(spark):
    rows = vectors(7, 80, 4, 2)
    odd = [(None, [1.0] * 4, 1), (100, None, 1), (200, [1.0, None, 1.0, 1.0], 1), (300, [float("nan")] * 4, 1), (400, [float("inf"), 0.0, 0.0, 0.0], 1), (500, [1.0] * 4, None)]
    odd += [(600, [], 1), (601, [], 1), (602, [], 2), (700, [0.0] * 4, 3), (701, [2.0**21, 0.0, 0.0, 0.0], 3), (800, [1.0, 2.0], 4), (801, [1.0, 2.0], 4), (802, [1.0, 2.0], 5)]
    odd += [(900, [2.0**19, 2.0**19, 0.0, 0.0], 1), (901, [2.0**19, 2.0**19, 0.0, 3.0], 1), (902, [2.0**19, 2.0**19, 1.0, 0.0], 2), (2**60 + 4, [0.5] * 4, 1)]
    rows += odd + rows[:3] + rows[20:21] * 4
    got = sorted(map(tuple, negatives.hard_negatives(table(spark, rows)).collect()))
    assert got == brute(rows)
    assert (600, 601, 1, 602, 0, 0) in got and any(r[0] == 900 and r[3] == 902 for r in got)


def test_no_rows_and_no_anchors(spark):
    rows = vectors(9, 10, 4, 2)
    assert negatives.hard_negatives(table(spark, [])).collect() == []
    assert negatives.hard_negatives(table(spark, [(i + 1, v, y) for i, v, y in rows])).collect() == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    q = np.floor(rng.normal(size=(200, 5)) * 300)
    q[0] = 0
    made = negatives.Tile.__new__(negatives.Tile)
    made.q, made.norms, made.ids, made.angles = q, np.linalg.norm(q, axis=1), np.arange(200), negatives.angles(q, q[1 : 1 + negatives.REFERENCES])
    low, high = negatives.bounds(made, made, slice(0, 200))
    assert ((low <= q @ q.T) & (q @ q.T <= high)).all() and (high - low < 2 * made.norms[:, None] * made.norms[None]).mean() > 0.9
