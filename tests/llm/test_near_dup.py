"""Near-duplicates against brute force, and the defined results of odd inputs."""

import random
import re

import pytest

from docmill.llm import near_dup
from docmill.llm.near_dup import near_duplicate_groups, near_duplicates, pairs_written_out

SCHEMA = "id long, text string, bucket int, grams string"  # with clashing names


def brute(texts, k, t):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if w:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.randrange(5)):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            if rng.random() < 0.3:
                cut = rng.randrange(len(words) + 1)
                words = words[cut:] + words[:cut]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        out.append((i, " ".join(words)))
    return out


def found(spark, texts, k, t):
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in texts], SCHEMA)
    return {tuple(r) for r in pairs_written_out(*near_duplicates(df, k=k, threshold=t)).collect()}


@pytest.mark.parametrize("k, t", [(3, 0.6), (5, 0.8)])
def test_equals_brute_force(spark, k, t):
    texts = corpus(250, k)
    assert found(spark, texts, k, t) == brute(texts, k, t)


def test_hot_lists_are_cut_into_cells_without_loss(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 8)
    base = " ".join(f"w{i}" for i in range(30))
    texts = [(i, f"{base} x{i}") for i in range(40)] + corpus(30, 9)[:0]
    assert found(spark, texts, 3, 0.6) == brute(texts, 3, 0.6)


def test_copies_nulls_and_short_texts(spark):
    texts = [(1, "one two three four"), (2, "One, two; THREE four!"), (3, None), (4, ""), (5, "..."), (6, "hi"), (7, "Hi."), (8, "hi there"), (9, "one two three four")]
    assert found(spark, texts, 3, 0.6) == {(1, 2), (1, 9), (2, 9), (6, 7)}


def together(pairs):
    """The groups that pairs connect."""
    name = {}
    for a, b in pairs:
        x, y = name.setdefault(a, {a}), name.setdefault(b, {b})
        if x is not y:
            x |= y
            for i in y:
                name[i] = x
    return {frozenset(x) for x in name.values()}


def test_many_copies_are_paired_in_cells_that_hang_together(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "COPIES", 4)
    base = " ".join(f"w{i}" for i in range(20))
    texts = [(i, base) for i in range(60)] + [(100 + i, base + " more") for i in range(9)] + [(200, base + " less")]
    got, want = found(spark, texts, 3, 0.6), brute(texts, 3, 0.6)
    assert got <= want and together(got) == together(want)
    assert len(got) < 70 * 12  # grows as the records do
    for i in range(60):  # every record meets some of either other text
        assert any((i, j) in got for j in range(100, 109)) and (i, 200) in got


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, base), (2, base + " x"), (3, base + " x y"), (4, "other words stand here alone now"), (4, "other words stand here alone now"), (5, None)], "id long, text string")
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_duplicate_groups(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_empty(spark):
    assert found(spark, [], 3, 0.6) == set()
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    assert found(spark, [(1, long), (2, long + " end"), (3, "w1 w2")], 3, 0.6) == {(1, 2)}


@pytest.mark.parametrize("cell", [256, 2])
def test_different_texts_of_a_class_are_written_out(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dup, "CELL", cell)
    words = [f"w{i}" for i in range(20)]
    variants = [" ".join(w.upper() if n >> i & 1 else w for i, w in enumerate(words)) for n in range(70)]
    texts = list(enumerate(variants)) + [(100 + i, x + " more") for i, x in enumerate(variants[:9])]
    copies = [(200 + i, variants[5]) for i in range(5)]
    assert found(spark, texts + copies, 3, 0.6) == brute(texts + copies, 3, 0.6)
