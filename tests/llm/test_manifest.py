"""The manifest beside a plain tree of lists, and the log's closed-form places beside its order of writing."""

import hashlib
import zlib

import pytest

from talkframe.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, i string, n string, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[name] = levels([leaf(r) for r in trees[name]])
    whole = levels([made[n][-1][0] for n in names])
    out = []
    for t, name in enumerate(names):
        for k, row in enumerate(trees[name]):
            forged = row
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                forged = (*row[:3], row[3] + 1, row[4])
            node, proof = leaf(forged), ""
            for tree, at in ((made[name], k), (whole, t)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(x for x in run if x != level[at]) if len(set(run)) == len(run) else run[1 - at % 2]
                    run[at % 2] = node
                    node, at = sha(*run), at // 2
            out.append((row[0], leaf(row), made[name][-1][0], whole[-1][0], sha(proof), node, node == whole[-1][0], 2 * k - k.bit_count()))
    return sorted(out, key=str)


@pytest.mark.parametrize("m", [*range(1, 35), 63, 64, 65])
@pytest.mark.parametrize("more", [0, 3])
def test_nodes_stand_at_their_closed_form_places(m, more):
    nodes = [sha(str(k)) for k in range(m)]
    height = merkle.height_of(m) + more
    log = merkle.written(nodes, height)
    tree = levels(nodes)
    while len(tree) <= height:
        tree.append([sha(tree[-1][0])])
    assert len(log) == sum(map(len, tree))
    assert all(log[merkle.place(level, k, m)] == node for level, row in enumerate(tree) for k, node in enumerate(row))
    data = bytes.fromhex("".join(log))
    assert all(merkle.folded(nodes[k], merkle.siblings(data, k, m, height)) == log[-1] for k in range(m))


@pytest.mark.parametrize("segment", [1, 2, 12])
def test_manifest_is_that_of_a_plain_tree(spark, segment):
    rows = [(k * 3 - 40, "ab"[k % 2], ["en", "de", "é", "z", ""][k * k % 5], k if k % 6 else None, f"text {k} é" if k % 5 else None) for k in range(90)]
    rows += [(None, None, None, None, None), (None, None, "en", 5, ""), (7, "a", None, 2**63 - 1, ""), (14, "a", "fr", 2**63 - 1, "one leaf"), *[rows[8]] * 5, (rows[8][0], "other", *rows[8][2:])]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    got = sorted([tuple(r) for r in merkle.manifest(df, segment).collect()], key=str)
    assert got == plain(rows)
    assert any(not r[6] for r in got)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc", "x", "x", "x", "x")], SCHEMA)
    (row,) = merkle.manifest(df).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert merkle.manifest(df.limit(0)).collect() == []


def test_log_is_stored(spark, tmp_path):
    rows = [(k, "s", "en", k, "t", "x", "x", "x", "x") for k in range(20)]
    groups = merkle.log_of(merkle.numbered(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA)), "doc_id", "digest"), 2)
    merkle.save_log(groups, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    assert sorted(r["count"] for r in stored.groupBy("group").count().collect()) == [1, 2, 5]
