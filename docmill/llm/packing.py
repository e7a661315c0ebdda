"""Packing texts into containers of a fixed capacity by bin completion.

A text over the capacity is cut: its full pieces fill containers of their own, the rest is an item. Items
are packed in groups of bounded size, each by branch and bound over its containers. The container of the
largest item left is completed next. Its undominated fillings are enumerated by rising waste: a filling is
dominated if one of its items, or two of them, can give way to a single item left that is as large or
larger. A branch is cut when its waste exceeds what a solution with fewer containers than the best one
could have, and the search goes back to the next filling of the last container that has one. Best-fit
decreasing gives the first incumbent; a group whose best solution meets the lower bound is done. Given
time the search is exact; it ends after ``STEPS`` steps a group with the best solution found so far.

The containers that stay under-full are opened again and their items packed together in another round, for
as long as a round gets on, so that a group's remainder wastes nothing.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.tokens import VOCABULARY, token_sizes
from docmill.session import materialize

#: Items of a group, and search steps spent on one: bounds on the work of a task, not on the data.
GROUP, STEPS = 1024, 50_000
#: Containers filled less than this are opened again; a round that leaves more than the second share of the
#: items that it had in under-full containers is the last.
FULL, STILL_OPEN = 0.99, 0.9


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; sizes as positions of `sizes`, which must not exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []  # (room left, container)
    out: list[list[int]] = []
    for i in order:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            out[b].append(i)
        else:
            left, b = capacity, len(out)
            out.append([i])
        bisect.insort(room, (left - sizes[i], b))
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer containers: over all thresholds t, items above capacity - t stand alone, those
    above half the capacity stand apart, and what is left of the rest over t fills whole containers."""
    x = np.sort(np.asarray(sizes, np.int64))
    if not len(x):
        return 0
    before = np.concatenate([[0], np.cumsum(x)])
    at = lambda v: np.searchsorted(x, v, side="right")
    half = at(capacity // 2)
    t = np.unique(np.concatenate([[0], x[:half]]))
    low, alone = np.searchsorted(x, t, side="left"), at(capacity - t)
    big = alone - half
    rest = before[half] - before[np.minimum(low, half)] - (big * capacity - (before[alone] - before[half]))
    return int((len(x) - alone + big + np.maximum(0, -(-rest // capacity))).max())


class Budget:
    """Steps that a search may still take; None is no end."""

    def __init__(self, steps: int | None) -> None:
        self.left = math.inf if steps is None else steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def dominated(chosen: tuple[int, ...], waste: int, count: dict[int, int], distinct: list[int]) -> bool:
    """Whether one or two items of a filling can give way to one item left that fits in their place and the
    waste. count holds the items left without those chosen."""

    def other(low: int, high: int) -> bool:
        k = bisect.bisect_left(distinct, low)
        while k < len(distinct) and distinct[k] <= high:
            if count[distinct[k]] > 0:
                return True
            k += 1
        return False

    if other(1, waste):
        return True
    sizes = sorted(set(chosen))
    if any(other(s + 1, s + waste) for s in sizes):
        return True
    twice = [s for s in sizes if chosen.count(s) > 1]
    return any(other(a + b, a + b + waste) for i, a in enumerate(sizes) for b in sizes[i + 1 :]) or any(other(2 * s, 2 * s + waste) for s in twice)


def fillings(count: dict[int, int], distinct: list[int], room: int, allowed: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of a room that waste at most `allowed`, by rising waste, as sizes in falling order.

    distinct: all sizes, rising; count: how many of each are left. Both must be as they were whenever the next
    filling is asked for. The iteration also ends with the budget.
    """
    sums = [0]
    for s in distinct:
        sums.append(sums[-1] + s * count[s])
    if sums[-1] <= room:  # all that is left fits: no other filling can do better
        if room - sums[-1] <= allowed or sums[-1] == 0:
            yield tuple(s for s in reversed(distinct) for _ in range(count[s]))
        return
    taken: dict[int, int] = {}

    def exact(target: int, limit: int) -> Iterator[tuple[int, ...]]:
        """Choices of sizes at distinct[: limit] that sum to the target."""
        if not target:
            yield ()
            return
        k = bisect.bisect_right(distinct, target, 0, limit) - 1
        while k >= 0 and sums[k + 1] >= target:  # what is left up to here must reach the target
            s = distinct[k]
            if count[s] > taken.get(s, 0):
                if not budget.spend():
                    return
                taken[s] = taken.get(s, 0) + 1
                for more in exact(target - s, k + 1):
                    yield (s, *more)
                taken[s] -= 1
            k -= 1

    for waste in range(min(allowed, room) + 1):
        for chosen in exact(room - waste, len(distinct)):
            if chosen:
                budget.left -= len(set(chosen)) ** 2 // 16  # what the comparisons below cost
            for s in chosen:
                count[s] -= 1
            bad = dominated(chosen, waste, count, distinct)
            for s in chosen:
                count[s] += 1
            if not bad:
                yield chosen
            if budget.left < 0:
                return
        if budget.left < 0:
            return


def complete_bins(sizes: list[int], capacity: int, steps: int | None = STEPS) -> list[list[int]]:
    """Containers as lists of positions of `sizes`, each of at most `capacity`; a size must not exceed it.

    steps: those of the search; None lets it end by itself, with a proof that no fewer containers do.
    """
    incumbent = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(incumbent) <= bound:
        return incumbent
    where: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        where.setdefault(s, []).append(i)
    distinct, count = sorted(where), {s: len(v) for s, v in where.items()}
    total, budget = sum(sizes), Budget(steps)
    best, found = len(incumbent), None
    slack = (best - 1) * capacity - total  # the waste that a better solution can have
    done: list[tuple[int, ...]] = []
    waste, left = 0, len(sizes)
    levels: list[tuple[int, Iterator[tuple[int, ...]]]] = []

    def open_level() -> None:
        big = next(s for s in reversed(distinct) if count[s])
        count[big] -= 1
        levels.append((big, fillings(count, distinct, capacity - big, slack - waste, budget)))

    open_level()
    while levels:
        big, options = levels[-1]
        if len(done) == len(levels):  # back from below: take this container's filling out again
            gone = done.pop()
            waste -= capacity - sum(gone)
            left += len(gone)
            for s in gone[1:]:
                count[s] += 1
        pick = next(options, None) if waste <= slack else None
        if pick is None:
            levels.pop()
            count[big] += 1
            if budget.left < 0:
                break
            continue
        box = (big, *pick)
        if waste + capacity - sum(box) > slack:
            done.append(box)  # taken out again above
            waste += capacity - sum(box)
            left -= len(box)
            for s in pick:
                count[s] -= 1
            continue
        for s in pick:
            count[s] -= 1
        done.append(box)
        waste += capacity - sum(box)
        left -= len(box)
        if left:
            open_level()
            continue
        best, found = len(done), list(done)
        if best <= bound:
            break
        slack = (best - 1) * capacity - total
    if found is None:
        return incumbent
    pool = {s: list(v) for s, v in where.items()}
    return [[pool[s].pop() for s in box] for box in found]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
    sizes = pdf["tokens"].astype(int).tolist()
    box, fill = [0] * len(sizes), [0] * len(sizes)
    for b, items in enumerate(complete_bins(sizes, capacity)):
        used = sum(sizes[i] for i in items)
        for i in items:
            box[i], fill[i] = b, used
    return pdf.assign(box=box, fill=fill)


_ITEM = "container_kind string, capacity int, group long, doc_id long, piece_no int, start_token int, tokens int"


def pack_documents(df: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text of df in a container of every kind of ``containers`` (container_kind, capacity_tokens).

    The result has ``container_kind``, ``container_id``, ``doc_id``, ``piece_no`` (from 0), ``start_token``,
    ``tokens`` and ``fill`` (tokens in the container). Only a text over the capacity is cut, into pieces
    of the capacity and a rest.

    Null ids and null or empty texts have no piece. Repeated rows with one id and size count once, as do
    repeated kinds (the smallest capacity holds); kinds that are null or under one token are left out.
    Empty tables give an empty result. Other columns are not read. containers is a small fixed table. Jobs run while
    the result is built: they write tables to the shared folder.
    """
    kinds = containers.where("container_kind is not null and capacity_tokens >= 1").groupBy("container_kind").agg(F.min("capacity_tokens").cast("int").alias("capacity")).collect()
    if not kinds:
        kinds = [(None, 1)]
    per_kind = F.explode(F.array(*(F.struct(F.lit(k).cast("string").alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds))).alias("k")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    sized = materialize(token_sizes(rows, vocabulary).where("tokens > 0").distinct(), "pack-sizes")
    n = sized.count()
    pieces = sized.select("doc_id", "tokens", per_kind).select("doc_id", "tokens", "k.*").where("container_kind is not null").select(
        "container_kind", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece_no")
    )
    pieces = pieces.withColumn("start_token", F.col("piece_no") * F.col("capacity")).withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("start_token")))
    alone = pieces.where("tokens = capacity").select(
        "container_kind", F.concat_ws("-", "container_kind", "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", "start_token", "tokens", F.col("tokens").alias("fill")
    )
    items = pieces.where("tokens < capacity")
    done = alone
    groups, before = max(1, -(-n // GROUP)), None
    for turn in itertools.count():
        keyed = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(groups))).select(*[c.split()[0] for c in _ITEM.split(", ")])
        packed = materialize(keyed.groupBy("container_kind", "group").applyInPandas(_pack, _ITEM + ", box int, fill int"), "packed")
        most = packed.where(F.col("fill") < FULL * F.col("capacity")).groupBy("container_kind").count().agg(F.max("count")).first()[0] or 0
        last = groups == 1 or most == 0 or (before is not None and most > STILL_OPEN * before)
        full = packed if last else packed.where(F.col("fill") >= FULL * F.col("capacity"))
        done = done.unionByName(
            full.select("container_kind", F.concat_ws("-", "container_kind", F.lit(f"r{turn}"), "group", "box").alias("container_id"), "doc_id", "piece_no", "start_token", "tokens", "fill")
        )
        if last:
            break
        items = packed.where(F.col("fill") < FULL * F.col("capacity")).drop("box", "fill", "group")
        groups, before = max(1, -(-most // GROUP)), most
    return done


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Of each kind: ``containers``, ``tokens``, ``least`` (no packing needs fewer) and ``fill_share``."""
    cap = containers.groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity"))
    got = packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return got.join(F.broadcast(cap), "container_kind").select(
        "container_kind", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill_share")
    )

