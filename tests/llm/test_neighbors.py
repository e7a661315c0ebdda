"""Nearest neighbours: recall against brute force, ties, copies, unusable vectors."""

import numpy as np

from docmill.llm import neighbors
from docmill.llm.neighbors import nearest, neighbor_pairs, unit

SCHEMA = "id long, embedding array<float>, leaf int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, "x") for i, v in rows], SCHEMA)


def brute(x, ids, k, least):
    s = unit(x.astype(float)).astype(float) @ unit(x.astype(float)).astype(float).T
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-round(s[r, j], 7), ids[j]))[:k]
        out |= {(ids[r], ids[j]) for j in order if s[r, j] >= least}
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // 8, dim))
    return c[rng.integers(0, len(c), n)] + rng.normal(size=(n, dim)) * 0.25


def test_recall(spark):
    x = clustered(900, 64, 1)
    want = brute(x, list(range(900)), 5, 0.85)
    near = nearest(frame(spark, list(enumerate(x))), least=0.85)
    got = {(r["id"], r["neighbor"]) for r in near.collect()}
    assert len(got & want) / len(want) > 0.95
    pairs = {tuple(r) for r in neighbor_pairs(near).collect()}
    assert all(a < b for a, b in pairs)


def test_large_leaves_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", 16)
    monkeypatch.setattr(neighbors, "GROUP", 16)
    x = clustered(600, 16, 2)
    want = brute(x, list(range(600)), 5, 0.85)
    rows = frame(spark, list(enumerate(x)))
    # one tree of one leaf: everything meets everything, part by part
    got = {(r["id"], r["neighbor"]) for r in nearest(rows, least=0.85, dim=16, leaf=1000, trees=1, probes=1).collect()}
    assert got == want
    got = {(r["id"], r["neighbor"]) for r in nearest(rows, least=0.85, dim=16, leaf=64, sample=100).collect()}
    assert len(got & want) / len(want) > 0.97


def test_effort_grows_with_the_vectors():
    assert neighbors.effort(1) == neighbors.effort(200_000) == (2, 16)
    assert neighbors.effort(2_000_000) == (3, 35) and neighbors.effort(200_000_000) == (5, 160)


def test_every_branch_waits_in_the_queue():
    # a deep, lopsided tree: with as many probes as leaves every leaf comes up
    rng = np.random.default_rng(3)
    x = unit(np.cumsum(rng.exponential(size=(400, 4)), axis=0))
    forest = neighbors.Forest(x, 2, 4)
    leaves, _ = forest.search(x[:50], forest.leaves)
    assert all(set(r) == set(range(forest.leaves)) for r in leaves)


def test_unusable_vectors_and_scales(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    data = [(1, v), (2, [2 * e for e in v]), (3, None), (4, [0, 0, 0, 0]), (5, [1, 2]), (6, [float("nan"), 1, 1, 1]), (7, [None, 1, 1, 1]), (8, [1e30, 2e30, 3e30, 4e30]), (9, [-1, -2, -3, -4])]
    got = {(r["id"], r["neighbor"]) for r in nearest(frame(spark, data), least=0.85, dim=4).collect()}
    assert got == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}


def test_many_copies_give_the_smallest_ids(spark):
    v = [1.0, 0.5, 0.25, 0.125]
    data = [(i, v) for i in range(40)] + [(100, [1.0, 0.5, 0.25, 0.12]), (101, [-1, 0, 0, 0])]
    got = {}
    for r in nearest(frame(spark, data), k=5, least=0.85, dim=4).collect():
        got.setdefault(r["id"], set()).add(r["neighbor"])
    assert got[0] == {1, 2, 3, 4, 5} and got[3] == {0, 1, 2, 4, 5} and got[39] == {0, 1, 2, 3, 4} and got[100] == {0, 1, 2, 3, 4} and 101 not in got


def test_empty_and_repeated_rows(spark):
    assert nearest(frame(spark, []), dim=4).count() == 0
    assert nearest(frame(spark, [(1, [1, 0, 0, 0]), (1, [1, 0, 0, 0])]), dim=4).count() == 0


def test_repeated_rows_without_copies_count_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(12, 64)) + 3)]
    df = spark.createDataFrame([r for r in rows for _ in range(6)], "id long, embedding array<float>")
    got = nearest(df).groupBy("id").count().collect()
    assert {(r["id"], r["count"]) for r in got} == {(i, 5) for i in range(12)}
