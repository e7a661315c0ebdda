"""Most similar vectors: a forest of random-projection trees searched through one priority queue.

* The trees are fitted on a bounded sample (``SAMPLE`` vectors); every vector is indexed.
* A vector is indexed in its own leaf of each tree. As a query it takes leaves of all trees from one
  priority queue ordered by the largest margin on the way, until ``probes`` leaves are taken.
* Leaves that stand beside one another in a tree form a group, to which a vector is sent once for all its leaves
  there. Within a leaf the cosine similarities are exact; a query keeps its best k of a group, and the best
  k over all its groups are the result.
* A leaf of which the sample says that it holds more than ``CELL`` vectors is dealt into parts; its queries meet
  every part, so no task holds it whole.

Vectors with equal elements are copies: the k + 1 smallest ids stand for the class, which is exact,
since with ties broken by id nobody takes another of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.session import materialize

SAMPLE = 131_072
#: Vectors of a leaf (points of the sample, if it is the smaller), of a part of a leaf and of a group of leaves.
LEAF, CELL, GROUP = 1024, 16_384, 49_152
#: Parts into which the members of one class of copies are dealt where they meet what the class found.
SALT = 64


class Forest:
    """Random-projection trees over unit vectors, kept as arrays of nodes."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []  # children; a negative one is -1 - leaf
        self.leaves = 0
        self.depth = 1
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng, 0) for _ in range(trees)]
        dim = sample.shape[1] if sample.ndim == 2 else 1
        self.normal_a = np.array(self.normal, np.float32).reshape(-1, dim)
        self.offset_a = np.array(self.offset, np.float32)
        self.child_a = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng, depth: int) -> int:
        self.depth = max(self.depth, depth)
        if len(at) <= leaf or depth > 40:
            self.leaves += 1
            return -self.leaves
        # the plane between two centres of a few rounds of two-means on a few points, cut at the median
        few = x[at[rng.integers(0, len(at), min(len(at), 64))]]
        a, b = few[0], few[-1]
        for _ in range(4):
            side = few @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = few[side].mean(0), few[~side].mean(0)
        normal = a - b
        size = float(np.linalg.norm(normal))
        if size < 1e-6:
            normal = rng.normal(size=x.shape[1]).astype(np.float32)
            size = float(np.linalg.norm(normal))
        normal = normal / size
        p = x[at] @ normal
        # a cut in the middle of a gap near the median parts no tight group
        order = np.sort(p)
        lo, hi = int(len(order) * 0.3), max(int(len(order) * 0.7), int(len(order) * 0.3) + 2)
        gaps = np.diff(order[lo:hi])
        cut = float(order[lo:hi][int(np.argmax(gaps))] + gaps.max() / 2) if len(gaps) and gaps.max() > 0 else float(np.median(p))
        left = p > cut
        if left.all() or not left.any():
            self.leaves += 1
            return -self.leaves
        me = len(self.normal)
        self.normal.append(normal)
        self.offset.append(cut)
        self.child.append([0, 0])
        self.child[me] = [self._grow(x, at[left], leaf, rng, depth + 1), self._grow(x, at[~left], leaf, rng, depth + 1)]
        return me

    def search(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, int]:
        """(n, probes) leaves in order of the shared queue; -1 where there are no more. The first
        column of each tree comes first, so columns [0, trees) are the leaves x itself belongs to."""
        n, trees = len(x), len(self.roots)
        out = np.full((n, probes), -1, np.int64)
        # a way down passes as many branches as its tree is deep at most
        width = trees + probes * self.depth
        prio = np.full((n, width), np.inf, np.float32)
        node = np.zeros((n, width), np.int64)
        used = np.full(n, trees, np.int64)
        for t, root in enumerate(self.roots):
            prio[:, t] = -np.inf
            node[:, t] = root
        rows = np.arange(n)
        for step in range(probes):
            best = np.full(n, step) if step < trees else np.argmin(prio, axis=1)
            p, cur = prio[rows, best], node[rows, best]
            prio[rows, best] = np.inf
            live = rows[p < np.inf]
            cur = cur[live]
            floor = np.maximum(p[live], 0)
            while True:
                inner = cur >= 0
                if not inner.any():
                    break
                r, c = live[inner], cur[inner]
                margin = np.einsum("ij,ij->i", x[r], self.normal_a[c]) - self.offset_a[c]
                go = np.where(margin > 0, 0, 1)
                slot = used[r]
                prio[r, slot] = np.maximum(floor[inner], np.abs(margin))
                node[r, slot] = self.child_a[c, 1 - go]
                used[r] += 1
                cur[inner] = self.child_a[c, go]
            out[live, step] = -1 - cur
        return out, trees


class Layout:
    """How the leaves of a forest are dealt into parts and groups, by what the sample says of their sizes."""

    def __init__(self, forest: Forest, sample: np.ndarray, rows: int) -> None:
        own, trees = forest.search(sample, len(forest.roots))
        size = np.bincount(own[:, :trees].ravel(), minlength=forest.leaves) * (rows / max(1, len(sample)))
        self.parts = np.maximum(1, np.ceil(size / CELL)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts)[:-1]])
        # neighbouring parts share a group up to its size
        each = np.repeat(size / self.parts, self.parts)
        self.group = (np.cumsum(each) // GROUP).astype(np.int64)

    def cells(self, leaves: np.ndarray, trees: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether the row is indexed there) of rows and their leaves, as Forest.search gives them."""
        n, probes = leaves.shape
        who, leaf, own = np.repeat(np.arange(n), probes), leaves.ravel(), np.tile(np.arange(probes) < trees, n)
        who, leaf, own = who[leaf >= 0], leaf[leaf >= 0], own[leaf >= 0]
        times = self.parts[leaf]
        part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        who, leaf, own = np.repeat(who, times), np.repeat(leaf, times), np.repeat(own, times)
        with np.errstate(over="ignore"):
            mine = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)[who] % self.parts[leaf]
        return who, self.first[leaf] + part, own & (mine == part)


def _route(forest_b, dim: int, probes: int):
    """Of each batch and group: the vectors that have a leaf there, and which cells of it they ask or belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, layout = forest_b.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            x = unit(np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(n, dim))
            who, cell, own = layout.cells(*forest.search(x, max(probes, len(forest.roots))), ids)
            group = layout.group[cell]
            by = np.lexsort((cell, who, group))
            who, cell, own, group = who[by], cell[by], own[by], group[by]
            new = np.concatenate([[True], (np.diff(who) != 0) | (np.diff(group) != 0)])  # of a vector in a group
            row = np.cumsum(new) - 1
            sent = who[new]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
            ends = np.concatenate([starts[1:], [len(group)]])
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                a, b = row[s], row[e - 1] + 1
                # of each vector how many cells follow; a cell that it belongs to is written as -1 - cell
                times = np.bincount(row[s:e] - a, minlength=b - a).astype(np.uint16)
                rows.append((int(group[s]), ids[sent[a:b]].tobytes(), x[sent[a:b]].tobytes(), times.tobytes(), np.where(own[s:e], -1 - cell[s:e], cell[s:e]).astype(np.int32).tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["group", "ids", "vectors", "times", "cells"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, as float32. Scaled by the largest element first, so that no square over- or underflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exact cosine in blocks; of each query its best k and what may tie with them."""
    out = []
    keep = min(len(x), k + 4)
    for s in range(0, len(q), 512):
        block, bid = q[s : s + 512], qid[s : s + 512]
        sims, cols = [], []
        for u in range(0, len(x), 8192):
            sim = block @ x[u : u + 8192].T
            sim[bid[:, None] == xid[None, u : u + 8192]] = -2
            m = min(keep, sim.shape[1])
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            sims.append(np.take_along_axis(sim, top, 1))
            cols.append(top + u)
        sim, col = np.concatenate(sims, 1), np.concatenate(cols, 1)
        r, c = np.nonzero(sim >= least - 1e-4)
        j = col[r, c]
        exact = np.einsum("ij,ij->i", block[r].astype(np.float64), x[j].astype(np.float64))
        ok = exact >= least
        r, j, exact = r[ok], j[ok], exact[ok]
        order = np.lexsort((xid[j], -np.round(exact, 7), r))
        r, j, exact = r[order], j[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        first = rank < k
        out.append((bid[r[first]], xid[j[first]], exact[first]))
    return out


def _search(dim: int, k: int, least: float):
    """Of one group: the best k of each vector that asks there."""

    def run(tab: pa.Table) -> pa.Table:
        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(v, kind) for v in tab.column(name).to_pylist()]

        ids, x = np.concatenate(column("ids", np.int64)), np.concatenate(column("vectors", np.float32)).reshape(-1, dim)
        row, cell = np.repeat(np.arange(len(ids)), np.concatenate(column("times", np.uint16))), np.concatenate(column("cells", np.int32))
        own = cell < 0
        cell = np.where(own, -1 - cell, cell)
        by = np.argsort(cell, kind="stable")
        row, cell, own = row[by], cell[by], own[by]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        found = []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mine = row[s:e][own[s:e]]
            if len(mine):
                found += _best(x[row[s:e]], ids[row[s:e]], x[mine], ids[mine], k, least)
        if not any(len(f[0]) for f in found):
            return _NEAR.empty_table()
        a, b, sim = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.lexsort((b, -np.round(sim, 7), a))
        a, b, sim = a[by], b[by], sim[by]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])  # met in two trees
        a, b, sim = a[new], b[new], sim[new]
        first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
        return pa.table([pa.array(a[first]), pa.array(b[first]), pa.array(sim[first])], schema=_NEAR)

    return run


_NEAR = pa.schema([("id", pa.int64()), ("neighbor", pa.int64()), ("similarity", pa.float64())])


def effort(rows: int) -> tuple[int, int]:
    """(trees, probes) for so many vectors: 2 and 16 up to 200,000, then a tree more for every tenfold and probes by the
    cube root, as the same search finds less the more leaves there are."""
    more = max(1.0, rows / 200_000)
    return 2 + round(math.log10(more)), math.ceil(16 * more ** (1 / 3))


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id``, ``v``: rows whose vector has dim elements, none null, NaN or infinite, and not only zeros."""
    v = F.col(vector_col).cast("array<float>")
    good = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def nearest(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = 5, least: float = -1.0, dim: int = 64, trees: int | None = None, probes: int | None = None, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``id``, ``neighbor``, ``similarity``: of each row its k most similar other rows by cosine.

    Rows without a usable vector take none and are taken by none. Only similarities of at least
    ``least`` count, so a row can have fewer than k. Ties go to the smaller id. A repeated id counts
    once. The recall of the forest is measured against brute force in the tests and the README. Other
    columns of df are not read. An empty df gives an empty result.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, dim)
    keyed = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    w = Window.partitionBy("h1", "h2").orderBy("id")
    heads = materialize(keyed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1), "nearest-heads")
    firsts = heads.where("rank = 1").select("id")
    multi = heads.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("heads")).where("n > 1")
    multi = materialize(multi, "nearest-copies")
    copies = multi.limit(1).count() > 0
    firsts_n = heads.where("rank = 1").count()
    if firsts_n == 0:
        return spark.createDataFrame([], "id long, neighbor long, similarity double")
    once = rows.dropDuplicates(["id"])
    one = once.join(firsts, "id", "left_semi") if copies else once
    usual = effort(firsts_n)
    trees, probes = trees or usual[0], probes or usual[1]
    share = min(1.0, sample / firsts_n)
    some = one.where((F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))) < share).select("v").limit(sample + sample // 8)
    got = unit(np.array([r[0] for r in some.toLocalIterator()], np.float64).reshape(-1, dim))
    forest = Forest(got, trees, max(8, int(leaf * share)))
    plan = spark.sparkContext.broadcast((forest, Layout(forest, got, firsts_n)))  # grows with the sample only
    near = (
        one.mapInArrow(_route(plan, dim, probes), "group int, ids binary, vectors binary, times binary, cells binary")
        .groupBy("group")
        .applyInArrow(_search(dim, k, least), "id long, neighbor long, similarity double")
        .distinct()
    )
    if copies:
        near = _with_copies(near, keyed, multi, k, least)
    best = Window.partitionBy("id").orderBy(F.round("similarity", 7).desc(), "neighbor")
    return near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("id", "neighbor", "similarity")


def _with_copies(near: DataFrame, keyed: DataFrame, multi: DataFrame, k: int, least: float) -> DataFrame:
    """Give every class found the ids that stand for it, and every copy what its class found.

    A class can hold any part of the rows: its members are dealt by SALT before they meet its ids and finds."""
    salt = F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")
    dealt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    of = multi.select(F.col("heads")[0].alias("neighbor"), F.slice("heads", 2, k + 1).alias("more"))
    near = near.join(of, "neighbor", "left")
    near = near.select("id", F.explode(F.concat(F.array("neighbor"), F.coalesce("more", F.array().cast("array<long>")))).alias("neighbor"), "similarity")
    member = keyed.withColumn("salt", dealt).join(multi.select("h1", "h2", "heads", salt), ["h1", "h2", "salt"]).select("id", "heads", "salt")
    others = member.where(F.col("id") != F.col("heads")[0]).select(F.col("heads")[0].alias("rep"), F.col("id").alias("copy"), "salt")
    reps = near.join(multi.select(F.col("heads")[0].alias("id")), "id", "left_semi")
    inherited = reps.select(F.col("id").alias("rep"), "neighbor", "similarity", salt).join(others, ["rep", "salt"]).select(F.col("copy").alias("id"), "neighbor", "similarity")
    equal = member.select("id", F.explode("heads").alias("neighbor"), F.lit(1.0).alias("similarity")).where("id <> neighbor").where(F.lit(least <= 1.0))
    return near.unionByName(inherited).unionByName(equal).where("id <> neighbor")


def neighbor_pairs(near: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: pairs of which at least one takes the other, id_a < id_b."""
    return near.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
