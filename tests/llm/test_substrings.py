"""Repeated windows beside brute force, over random texts with copies, runs and periods."""

import collections
import random

import numpy as np
import pytest

from talkframe.llm import substrings
from talkframe.llm.queries import op12_substring_dedup


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        starts = [p for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1]
        gone = {k for p in starts for k in range(p, p + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def texts(seed, n=50):
    rnd = random.Random(seed)
    alphabet = [2, 3, 30, 1000][seed % 4]
    passages = [" ".join(str(rnd.randrange(alphabet)) for _ in range(rnd.randrange(30, 90))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(4)):
            kind = rnd.randrange(4)
            parts.append([lambda: rnd.choice(passages), lambda: " ".join(["a"] * rnd.randrange(1, 100)), lambda: " ".join("abc"[: rnd.randrange(1, 4)] * rnd.randrange(1, 40)), lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(rnd.randrange(1, 120)))][kind]())
        rows.append((i, "\n  ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("heights", [((4, 8),), ((2, 4), (5, 12))])
def test_repeats_as_by_brute_force(spark, seed, heights):
    rows = [*texts(seed), (None, None), (900, ""), (901, " \t"), (7, texts(seed)[7][1]), (7, texts(seed)[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted([tuple(r) for r in substrings.without_repeats(df, heights=heights, block_bytes=3000).collect()], key=str)
    assert got == brute(rows, substrings.WINDOW)


def test_clashing_columns_large_ids_and_no_rows(spark):
    schema = "block string, part int, text string, replies string, ids string, doc_id bigint, a binary"
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [("x", 1, long, "r", "i", 2**60 + 1, b"a"), ("x", 1, "lead " + long + " tail", "r", "i", -(2**60) - 1, None), (None, None, "", None, None, None, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2**60 + 1: (40_000, 40_000, ""), -(2**60) - 1: (40_002, 40_000, "lead tail"), None: (0, 0, "")}
    assert substrings.without_repeats(spark.createDataFrame([], schema)).collect() == []


def test_symbols_whose_making_lies_inside_are_equal_wherever_the_passage_stands():
    rng = np.random.default_rng(3)
    inside = rng.integers(0, 5, 60).astype(np.uint64) * np.uint64(11)
    found = []
    for k in range(6):
        before, behind = rng.integers(0, 5, 20 + k).astype(np.uint64) * np.uint64(11), rng.integers(0, 5, 30).astype(np.uint64) * np.uint64(11)
        names = np.r_[before, inside, behind]
        made = substrings.Symbols(names, np.zeros(len(names), np.int64)).climb(0, 4, 8)
        own = (made.from_ >= len(before)) & (made.to < len(before) + 60)
        found.append({(n, lo - len(before), hi - len(before)) for n, lo, hi in zip(made.names[own].tolist(), made.lo[own].tolist(), made.hi[own].tolist())})
    assert all(f == found[0] for f in found) and found[0]


def test_query_has_one_row_per_document(spark):
    rows = op12_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r["n_removed"] <= r["n_words"] for r in rows)
