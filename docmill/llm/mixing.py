"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the training run. Its integral is the source's cumulative demand
of tokens; a document that stands after c tokens of its source is due where that demand reaches c, so the
inverse of the integral gives its position. Documents are then sorted by position, by ranges.

A schedule is a table of (source, at, weight): straight lines between its points, level before the first and
after the last, scaled so that the source gets its share in the whole. A source without one runs straight
from 1 - a at the start to 1 + a at the end. By default a balances: large sources taper off, small ones grow,
and the tokens due at any time are constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.tokens import VOCABULARY, token_sizes
from docmill.session import materialize

#: Rows of a source that one part holds, of whose sums running sums are built so that no task holds a source,
#: and the most parts of a source; their sums are broadcast.
PART_ROWS, PARTS = 16_384, 65_536
#: The steepest default schedules: down to 1 - 0.9 at the end, up to 1 + 0.5.
FALL, RISE = 0.9, 0.5


def source_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: its supply, share, demand and slope of the schedule.

    total_tokens: size of the mixture; None takes the largest in which every source that has documents
    reaches its share without exceeding its repeats. Shares of sources without documents are spread over
    the others in proportion. targets is a small fixed table; its sources count once (largest share).
    """
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct(F.col("target_share").cast("double").alias("share"), F.greatest(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats"))).alias("s")).select("source", "s.*")
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("documents"))
    p = t.join(supply, "source", "left").fillna(0, ["supply", "documents"])
    every = Window.partitionBy(F.lit(1))
    p = p.withColumn("mix_share", F.when(F.col("supply") > 0, F.col("share")).otherwise(0.0) / F.sum(F.when(F.col("supply") > 0, F.col("share"))).over(every))
    size = F.lit(float(total_tokens)) if total_tokens else F.min(F.when(F.col("supply") > 0, F.col("supply") * F.col("repeats") / F.col("mix_share"))).over(every)
    p = p.withColumn("demand", F.least(F.col("mix_share") * size, F.col("supply") * F.col("repeats")))
    # slopes that are in balance however they are scaled; scaled so that the steepest stays in bounds
    lean = 1 - F.col("mix_share") / F.sum(F.col("mix_share") ** 2).over(every)
    p = p.withColumn("lean", F.coalesce(lean, F.lit(0.0)))
    steepest = F.min(F.when(F.col("mix_share") > 0, F.col("lean"))).over(every)
    scale = F.when(steepest < 0, F.least(F.lit(RISE), -FALL / steepest)).otherwise(RISE)
    return p.withColumn("slope", F.col("lean") * scale).drop("lean")


def segments(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(begin, end, weight at both, share of the whole before and after) of the straight lines between the points
    of a schedule; negative weights count as none, and a schedule without any weight is level."""
    p = sorted((min(1.0, max(0.0, t)), max(0.0, w)) for t, w in points)
    p = [(0.0, p[0][1]), *p, (1.0, p[-1][1])] if p else [(0.0, 1.0), (1.0, 1.0)]
    lines = [(t, u, v, w) for (t, v), (u, w) in zip(p, p[1:]) if u > t]
    whole = sum((u - t) * (v + w) / 2 for t, u, v, w in lines)
    if whole <= 0:
        return [(0.0, 1.0, 1.0, 1.0, 0.0, 1.0)]
    out, done = [], 0.0
    for t, u, v, w in lines:
        area = (u - t) * (v + w) / 2 / whole
        out.append((t, u, v / whole, w / whole, done, done + area))
        done += area
    return [x for x in out if x[5] > x[4]]


_SEGMENTS = "array<struct<begin:double,end:double,low:double,high:double,before:double,after:double>>"


def _inverse(y: Column, lines: Column) -> Column:
    """Where the integral of a schedule reaches y of the whole."""
    one = F.coalesce(F.get(F.filter(lines, lambda s: y <= s["after"]), F.lit(0)), F.element_at(lines, -1))
    rise = (one["high"] - one["low"]) / (one["end"] - one["begin"])
    area = F.greatest(F.lit(0.0), y - one["before"])
    root = F.sqrt(F.greatest(F.lit(0.0), one["low"] * one["low"] + 2 * rise * area))
    # the form of the root that does not cancel
    return F.least(one["end"], one["begin"] + F.when(area <= 0, 0.0).otherwise(2 * area / (one["low"] + root)))


def mix_sources(df: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", vocabulary: str = VOCABULARY, schedules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan).

    mixture: ``doc_id``, ``source``, ``copy_no`` (from 0), ``tokens``, ``position`` in [0, 1], sorted by
    position over range partitions; ties by id and copy. plan: see source_plan. schedules: ``source``, ``at`` in
    [0, 1], ``weight``; a small fixed table, of which rows with nulls are left out.

    A document is used at most max_repeats times. Which documents of a source come first is decided by a
    hash of the id and the seed. Null ids, null or empty texts, null sources and sources without a target
    are left out; repeated rows of one id and source count once. Empty tables give an empty mixture.
    Other columns are not read. A source may hold any part of the rows: its running sums are built in
    parts. Jobs run while the result is built: they write tables to the shared folder.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    known = targets.where("source is not null").select("source").distinct()
    sized = token_sizes(rows.join(F.broadcast(known), "source", "left_semi"), vocabulary).where("tokens > 0")
    sized = sized.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))
    order = F.xxhash64("doc_id", F.lit(seed))
    sized = materialize(sized.withColumn("order", order), "mix-sizes")
    plan = materialize(source_plan(sized, targets, total_tokens), "mix-plan")
    rows = plan.collect()  # one per target source
    parts = max(1, min(PARTS, -(-max((r["documents"] for r in rows), default=0) // PART_ROWS)))
    sized = sized.withColumn("part", F.pmod(F.shiftrightunsigned("order", 40), F.lit(parts)))
    own: dict[str, list[tuple[float, float]]] = {}
    for r in schedules.where("source is not null and at is not null and weight is not null").select("source", F.col("at").cast("double"), F.col("weight").cast("double")).collect() if schedules is not None else ():
        own.setdefault(r[0], []).append((r[1], r[2]))
    drawn = [(r["source"], segments(own.get(r["source"]) or [(0.0, 1 - r["slope"]), (1.0, 1 + r["slope"])])) for r in rows]
    drawn = df.sparkSession.createDataFrame(drawn, f"source string, lines {_SEGMENTS}")
    sums = sized.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("part")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id")
    placed = (
        sized.withColumn("run", F.sum("tokens").over(inside) - F.col("tokens"))
        .join(F.broadcast(before), ["source", "part"])  # at most PARTS rows per target source
        .join(F.broadcast(plan.where("demand > 0").join(drawn, "source").select("source", "supply", "repeats", "demand", "lines")), "source")
        .select("doc_id", "source", "tokens", "supply", "demand", "lines", (F.col("before") + F.col("run")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy_no"))
    )
    middle = F.col("copy_no") * F.col("supply") + F.col("at") + F.col("tokens") / 2
    due = placed.withColumn("middle", middle).where(F.col("middle") <= F.col("demand"))
    mixture = due.select("doc_id", "source", "copy_no", "tokens", _inverse(F.col("middle") / F.col("demand"), F.col("lines")).alias("position"))
    return mixture.repartitionByRange("position", "doc_id", "copy_no").sortWithinPartitions("position", "doc_id", "copy_no"), plan


def mixture_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each target source: documents used, tokens, the share reached and the target share."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("uses"), F.max(F.col("copy_no") + 1).alias("most_repeats"))
    every = Window.partitionBy(F.lit(1))
    p = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "uses", "most_repeats"])
    return p.select(
        "source", F.col("share").alias("target_share"), "mix_share", F.col("repeats").alias("max_repeats"), "most_repeats", F.col("supply").alias("supply_tokens"), "mixed_tokens", "uses",
        (F.col("mixed_tokens") / F.sum("mixed_tokens").over(every)).alias("reached_share"),
    )
