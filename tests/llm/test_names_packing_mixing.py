"""Names, containers and mixtures."""

import random
from pathlib import Path

import pytest

from docmill.llm import names, packing
from docmill.llm.mixing import mix_sources, mixture_shares
from docmill.llm.names import link_names, name_pairs, names_of
from docmill.llm.tokens import VOCABULARY

needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")

SAME = [
    ["Müller, Susan K.", "Muller, Susan K.", "MUELLER, Susan K.", "Susan K. Müller", "Müller, Susan", "Sue Müller", "Müller, S.", "S. Müller", "Müller S", "Müler, Susan", "Dr. Susan Müller", "müller, susan", "Müller,Susan"],
    ["Müller, Oskar", "Oskar Müller"],
    ["Archive Studies Laboratory Northby", "Arch. Stud. Lab. Northby", "ARCHIVE STUDIES LABORATORY NORTHBY", "Archive Studies Labratory Northby"],
    ["Archive Security Laboratory Southby"],
    ["International Centre for Risk Research of Westby", "ICRR (Westby)", "Int Ctr Risk Res Westby", "Westby, International Centre for Risk Research of"],
]


def test_variants_are_linked(spark):
    df = spark.createDataFrame([("creators", n) for group in SAME for n in group] + [("creators", None), ("creators", " "), ("creators", "!?")], "field_name string, name string")
    got = {tuple(r) for r in name_pairs(link_names(df)).select("name_a", "name_b").collect()}
    want = {tuple(sorted((a, b))) for group in SAME for i, a in enumerate(group) for b in group[i + 1 :]}
    assert got == want


def test_initials_that_fit_two_persons_stay_apart(spark):
    df = spark.createDataFrame([("creators", n) for n in ("Berg, Susan", "Berg, Sigrid", "Berg, S.", "S. Berg")], "field_name string, name string")
    assert {tuple(r) for r in name_pairs(link_names(df)).select("name_a", "name_b").collect()} == {("Berg, S.", "S. Berg")}


def test_publications(spark):
    z = spark.createDataFrame([(["A, B"], "Annals of Risk & Text Systems in Northby"), ([], "Annals of Risk and Text Systems in Northby"), (None, "Ann. Risk Text Syst. Northby"), ([None], None), ([], "Annals of Risk and Text Studies in Northby")], "creators array<string>, publication string")
    got = {tuple(r) for r in name_pairs(link_names(names_of(z))).collect()}
    assert {g[0] for g in got} == {"publication"} and len(got) == 3
    assert link_names(names_of(z.limit(0))).count() == 0


def test_abbreviations_are_linked_among_many_names(spark, monkeypatch):
    monkeypatch.setattr(names, "CELL", 16)
    rng = random.Random(8)
    made = ["".join(rng.choice("bcdfghklmnprst") for _ in range(9)) for _ in range(140)]
    crowd = [f"International Centre for Evidence Assessment of {w}" for w in made[:70]] + [f"{w} Institute Northby" for w in made[70:]]
    one = ["International Centre for Evidence Assessment of Northby", "Int. Ctr. Evidence Assess., Northby", "Int. Ctr. Evid. Assess., Morthby"]
    got = {(r["name_a"], r["name_b"]) for r in name_pairs(link_names(spark.createDataFrame([("publication", n) for n in crowd + one], "field_name string, name string"))).collect()}
    assert got == {tuple(sorted((a, b))) for i, a in enumerate(one) for b in one[i + 1 :]}


def test_related_names_share_a_key():
    rng, related = random.Random(5), 0
    pool = ["evidence", "evid", "vidence", "centre", "ctr", "cnetre", "ecntre", "risk", "rsk", "research", "res", "eresearch", "northby", "morthby", "onrthby"]
    for _ in range(20_000):
        x, y = ((names.Reading((), tuple(rng.choice(pool) for _ in range(rng.choice((1, 2)))), rng.choice(("", "", "c", "er"))),) for _ in range(2))
        if names.relate(x, y)[0]:
            related += x[0].words != y[0].words
            assert names.keys_of(x) & names.keys_of(y)
    parts = ["Anna", "Anna", "Annna", "Maria", "Mara", "Nnaa", "A.", "M.", "Susan", "Sue"]
    last = ["Müller", "Mueller", "Muller", "Müler", "von Berg", "Alt-Berg", "Berg"]
    for _ in range(20_000):
        x, y = (f"{rng.choice(last)}, {' '.join(rng.choice(parts) for _ in range(rng.choice((1, 2, 3))))}" for _ in range(2))
        x, y = names.parse_name(x, True), names.parse_name(y, True)
        if names.relate(x, y)[0]:
            related += 1
            assert names.keys_of(x) & names.keys_of(y)
    assert related > 500


def kind(a, b):
    return names.relate(names.parse_name(a, True), names.parse_name(b, True))[0]


@pytest.mark.parametrize(
    "a, b, want",
    [("Anna Maria Berg", "Maria Anna Berg", names.LINK), ("Berg, A. M.", "Berg, M. A.", names.NONE), ("E. B. Holm", "Holm, E. B.", names.LINK), ("A. Holm", "Holm, Anna", names.LESS), ("Y. Holm", "Holm Y", names.LINK),
     ("Alt-Berg, Susan", "Berg, Susan Alt", names.LINK), ("C. vos Berg", "von Berg, Carl", names.LESS), ("Nueimberg, Sara", "Nseimberg, Sara", names.LINK), ("Nueimberg, Sara", "Nümberg, Tara", names.NONE),
     ("Risk Anal., Northby Univ. Dept.", "Northby University Department of Risk Analysis", names.LINK), ("Berg, Anna B. C. D. E.", "Anna B. C. D. E. Berg", names.LINK), ("Ana María López García", "Lopez Garcia, Ana Maria", names.LINK),
     ("Berg, Anna Karen", "Berg, Anna Maria", names.NONE)],
)
def test_relations(a, b, want):
    assert kind(a, b) == kind(b, a) == want


def test_names_of_any_number_of_tokens():
    words = "archive bridge council document evidence forecast glacier harbour incident journal kingdom library".split()
    other = tuple(w[:4] for w in reversed(words))
    assert names.assign(tuple(words), other) == pytest.approx(0.12)


def test_cheapest_assignment_equals_brute_force():
    from itertools import permutations

    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 5)
        m = n + rng.randrange(0, 2)
        costs = [[rng.choice((None, None, 0.0, 0.01, 1.0)) for _ in range(m)] for _ in range(n)]
        every = [sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n) if all(costs[i][j] is not None for i, j in enumerate(p))]
        got = names.cheapest(costs)
        assert (got is None) == (not every) and (got is None or abs(got - min(every)) < 1e-6)


def test_assignment_and_edits():
    assert names.assign(("risk", "systems"), ("syst", "risk")) == pytest.approx(0.01)
    assert names.assign(("a", "b"), ("a",)) is None and names.assign(("risk",), ("text",)) is None
    assert names.within_one("fiona", "finoa") and names.within_one("susan", "suan") and not names.within_one("oskar", "susan") and not names.within_one("bob", "bab")
    assert names.abbreviates("wksp", "workshop") and names.abbreviates("j", "journal") and not names.abbreviates("lab", "library")


def test_deletion_neighbourhoods_meet_within_one_edit():
    rng = random.Random(3)
    for _ in range(500):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :]])
        if len(b) >= 4:
            assert names.within_one(a, b) and names.deletes(a) & names.deletes(b)


def test_bins_hold_all_items():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.randrange(10, 600)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        bins = packing.complete_bins(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins) and len(bins) <= len(packing.best_fit(sizes, capacity))


def test_completion_beats_best_fit():
    sizes = [6, 6, 5, 5, 4, 4] * 4 + [7, 3] * 3
    assert len(packing.complete_bins(sizes, 10)) == -(-sum(sizes) // 10)


def fewest(sizes, capacity):
    """Containers that are needed, over all subsets."""
    best = [(1, 0)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for m in range(1, 1 << len(sizes)):
        for i, s in enumerate(sizes):
            if m >> i & 1:
                k, used = best[m ^ (1 << i)]
                best[m] = min(best[m], (k, used + s) if used + s <= capacity else (k + 1, s))
    return best[-1][0] if sizes else 0


def test_search_is_exact_when_given_time():
    rng, better = random.Random(3), 0
    for _ in range(150):
        capacity = rng.randrange(10, 80)
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(max(1, capacity // 6), max(2, capacity // 2)) for _ in range(rng.randrange(0, 11))]
        want, got = fewest(sizes, capacity), len(packing.complete_bins(sizes, capacity, None))
        assert got == want >= packing.lower_bound(sizes, capacity)
        better += got < len(packing.best_fit(sizes, capacity))
    assert better


def test_search_goes_back():
    # the fullest filling of the first container leads nowhere; the second one does
    sizes, capacity = [55, 45, 40, 35, 25, 30, 30, 20, 20], 100
    assert len(packing.complete_bins(sizes, capacity, None)) == fewest(sizes, capacity) == 3
    assert len(packing.complete_bins(sizes, capacity, 0)) == len(packing.best_fit(sizes, capacity))


@needs_vocabulary
def test_packing_tables(spark):
    rows = [(i, "some words here " * (i % 40 + 1)) for i in range(200)] + [(500, "long " * 400), (501, None), (502, ""), (None, "x"), (0, "some words here ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as group")
    boxes = spark.createDataFrame([("a", 64), ("b", 256), (None, 9), ("c", 0)], "container_kind string, capacity_tokens int")
    p = packing.pack_documents(df, boxes)
    got = p.toPandas()
    assert set(got.container_kind) == {"a", "b"} and {501, 502}.isdisjoint(got.doc_id)
    for kind, capacity in (("a", 64), ("b", 256)):
        x = got[got.container_kind == kind]
        assert x.groupby("container_id").tokens.sum().max() <= capacity and not x.duplicated(["doc_id", "piece_no"]).any()
        whole = x.groupby("doc_id").tokens.sum()
        assert (x.groupby("doc_id").piece_no.max()[whole <= capacity] == 0).all()
        assert (x.groupby("container_id").tokens.sum() == x.groupby("container_id").fill.first()).all()
    r = {x["container_kind"]: x for x in packing.packing_report(p, boxes).collect()}
    assert r["a"]["fill_share"] > 0.97 and r["a"]["containers"] >= r["a"]["least"]
    assert packing.pack_documents(df.limit(0), boxes).count() == 0 and packing.pack_documents(df, boxes.limit(0)).count() == 0


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, s, "word " * rng.randrange(5, 60)) for i, s in enumerate(["big"] * 300 + ["small"] * 20 + ["mid"] * 100 + ["none"] * 10)]
    rows += [(1000, None, "x y"), (1001, "big", None), (1002, "big", ""), (None, "big", "x"), (0, "big", rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as position", "2 as tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.2, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    m, plan = mix_sources(df, targets)
    got = m.toPandas()
    assert set(got.source) == {"big", "small", "mid"} and got.position.between(0, 1).all()
    shares = {r["source"]: r for r in mixture_shares(m, plan).collect()}
    for s, want in (("big", 0.5 / 0.9), ("small", 0.2 / 0.9), ("mid", 0.2 / 0.9)):
        assert shares[s]["reached_share"] == pytest.approx(want, abs=0.01) and shares[s]["most_repeats"] <= shares[s]["max_repeats"]
    assert shares["absent"]["mixed_tokens"] == 0 and not got.duplicated(["doc_id", "copy_no"]).any()
    # large sources come early, small ones late, and the order is that of the partitions
    assert got[got.source == "big"].position.mean() < 0.5 < got[got.source == "small"].position.mean()
    assert got.position.is_monotonic_increasing
    assert mix_sources(df.limit(0), targets)[0].count() == 0


def test_segments_invert(spark):
    from pyspark.sql import functions as F

    from docmill.llm.mixing import _SEGMENTS, _inverse, segments

    plans = [[(0.0, 1.5), (1.0, 0.5)], [(0.2, 0.0), (0.5, 3.0), (0.9, 0.0)], [(0.0, 1.0)], [], [(0.3, 0.0)], [(0.0, 0.0), (1.0, 2.0)], [(0.5, 1.0), (0.5, 0.0)]]
    rows = [(n, y / 40, segments(p)) for n, p in enumerate(plans) for y in range(41)]
    got = spark.createDataFrame(rows, f"n int, y double, lines {_SEGMENTS}").select("n", "y", _inverse(F.col("y"), F.col("lines")).alias("u"), "lines").collect()
    for r in got:
        whole = sum((min(s["end"], max(s["begin"], r["u"])) - s["begin"]) * (s["low"] + s["low"] + (s["high"] - s["low"]) * (min(s["end"], max(s["begin"], r["u"])) - s["begin"]) / (s["end"] - s["begin"])) / 2 for s in r["lines"])
        assert abs(whole - r["y"]) < 1e-9 and 0 <= r["u"] <= 1


@needs_vocabulary
def test_given_schedules_and_balance(spark, monkeypatch):
    from docmill.llm import mixing

    monkeypatch.setattr(mixing, "PART_ROWS", 16)
    rng = random.Random(4)
    sources = ["one"] * 400 + [f"s{i % 60}" for i in range(1200)]
    df = spark.createDataFrame([(i, s, "word " * rng.randrange(5, 60)) for i, s in enumerate(sources)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("one", 0.1, 1)] + [(f"s{i}", 0.015, 1) for i in range(60)], "source string, target_share double, max_repeats int")
    m, plan = mix_sources(df, targets)
    slopes = {r["source"]: (r["slope"], r["mix_share"]) for r in plan.collect()}
    # far larger than the others: the slope stays in bounds and all of them in balance
    assert min(s for s, _ in slopes.values()) == pytest.approx(-0.9) and abs(sum(s * w for s, w in slopes.values())) < 1e-9
    late = spark.createDataFrame([("one", 0.8, 0.0), ("one", 0.9, 1.0), (None, 0.1, 1.0), ("s1", None, 1.0)], "source string, at double, weight double")
    got = mix_sources(df, targets, schedules=late)[0].toPandas()
    assert got[got.source == "one"].position.min() > 0.8 and got[got.source == "s1"].position.min() < 0.2
    assert set(zip(got.doc_id, got.copy_no)) == set(map(tuple, m.toPandas()[["doc_id", "copy_no"]].itertuples(index=False)))
