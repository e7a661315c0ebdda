"""Near-duplicate records: a byte-position inverted index with count filtering.

Each run of ``k`` consecutive words sets one byte of a sparse byte string: a 64-bit hash of the run
gives the position (upper 56 bits) and the byte (lowest 8). Two records share a positional byte where
both have the same byte at the same position.

* A record of n positional bytes that has a Jaccard similarity of at least t with another shares at
  least ceil(t n) of them. So of any common order of all positional bytes its first
  n - ceil(t n) + m entries, with m <= ceil(t n), share at least m entries with the other record's.
  This m is the guaranteed minimum of matches; only those first entries are indexed. Against a record
  that is no shorter it shares at least ceil(2t/(1+t) n), so as the shorter one it needs to show only its
  first n - ceil(2t/(1+t) n) + m entries.
* The order puts rare bytes first. Rarity is read from a table of 2**24 counters that covers all
  records; its size is fixed, so it can be broadcast at any scale. The order only decides how many
  candidates arise, never whether a pair is found.
* The index is partitioned by positional byte. Within each list, pairs are tallied; pairs that reach
  the guaranteed minimum are verified on the whole texts.

Records with equal sets of word runs form a class that enters the index once. An index list that is
expected to exceed ``HOT`` entries is laid out as a triangle of cells, so that no task holds it whole.

Pairs are written in one form: all pairs of different texts, and of identical texts those within cells of
about ``COPIES`` records, the cells hanging together by links to the record with the smallest id. What a
record belongs to stands in the membership table, one row per record.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import few_tasks, materialize, shuffle_partitions

WORD = re.compile(r"[^\W_]+")
#: Counters of the rarity table; fixed, so its broadcast does not grow with the data.
CELLS = 1 << 24
SLICE = 1 << 18
SHIFT = np.uint64(64 - 24)
#: Matches that are guaranteed and asked for, where a record has as many positional bytes.
MATCHES = 4
#: Entries of one index list that one cell takes.
HOT = 4096
#: Records with identical text that are paired with one another; more of them are dealt into so large cells.
COPIES = 64
#: Texts of one class that are paired at once with those of another, or with its own.
CELL = 256


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 1_000_000:
            self.clear()
        return h


_MULT = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingle_sets(texts: list, k: int, cache: dict) -> list[np.ndarray]:
    """The sorted distinct positional bytes (uint64) of each text.

    Null texts and texts without letters or digits have none. A text of fewer than k words has one,
    of all its words.
    """
    get = cache.__getitem__
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = WORD.findall(text.lower())
            counts[i] = len(words)
            hashes += map(get, words)
    flat = np.array(hashes, dtype=np.uint64) if hashes else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    runs = np.zeros(len(flat), np.uint64)
    if len(flat) >= k:
        m = len(flat) - k + 1
        with np.errstate(over="ignore"):
            acc = np.zeros(m, np.uint64)
            for j in range(k):
                acc = (acc ^ flat[j : j + m]) * np.uint64(_MULT[j % len(_MULT)])
                acc ^= acc >> np.uint64(31)
            runs[:m] = _mix(acc)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(runs[end - n : end - k + 1]))
        elif n:
            h = xxhash.xxh3_64_intdigest(b" ".join(str(x).encode() for x in hashes[end - n : end]), seed=n)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _classes(k: int):
    """Of each record its class key and text key; at the end of a task, its table of counters in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        cells = np.zeros(CELLS, np.uint32)
        names = ["id", "class_key", "text_key", "part", "counts"]
        seen = False
        for batch in batches:
            seen = True
            texts = batch.column("text").to_pylist()
            sets = shingle_sets(texts, k, cache)
            keep = [(i, s, x) for i, s, x in zip(batch.column("id").to_pylist(), sets, texts) if i is not None and len(s)]
            if keep:
                np.add.at(cells, (np.concatenate([s for _, s, _ in keep]) >> SHIFT).astype(np.int64), np.uint32(1))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for _, s, _ in keep]
            same = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for _, _, x in keep], np.uint64).view(np.int64)
            none = pa.nulls(len(keep))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in keep], pa.int64()), pa.array(keys, pa.binary()), pa.array(same), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if seen:
            parts = _slices(cells)
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _slices(cells: np.ndarray) -> list[bytes]:
    return [zlib.compress(cells[i : i + SLICE].tobytes(), 1) for i in range(0, CELLS, SLICE)]


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact to 127, then sixteenths of powers of two, rounded up."""
    c = counts.astype(np.float64)
    return np.where(c < 128, c, np.minimum(255, 128 + np.ceil(4 * np.log2(np.maximum(c, 1) / 128)))).astype(np.uint8)


def _count(level: np.ndarray) -> np.ndarray:
    x = level.astype(np.float64)
    return np.where(x < 128, x, 128 * 2 ** ((x - 128) / 4)).astype(np.int64)


def _count_cells(column: str):
    """Per task: a table of counters, by the top bits of the 64-bit values packed in the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        seen = False
        for batch in batches:
            seen = True
            flat = np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint64)
            np.add.at(cells, (flat >> SHIFT).astype(np.int64), np.uint32(1))
        if seen:
            parts = _slices(cells)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    return run


def _add_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.uint64)
    for x in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "counts": [_level(total).tobytes()]})


def _table(parts: DataFrame) -> bytes:
    """The counters of all tasks as levels: a table of fixed size (16 MB), summed by slice on the executors."""
    levels = bytearray(CELLS)
    for row in parts.groupBy("part").applyInPandas(_add_cells, "part int, counts binary").toLocalIterator():
        levels[SLICE * row["part"] : SLICE * (row["part"] + 1)] = row["counts"]
    return bytes(levels)


def _needed(n: int, t: float) -> int:
    return math.ceil(t * n - 1e-9)


def _index_entries(levels_b, k: int, t: float, buckets: int):
    """Of each class, its first positional bytes, packed by bucket of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_b.value, np.uint8)
        cache = _WordHash()
        for batch in batches:
            # copies enter once a batch here, and once in the index, which names a class by 8 bytes of its key;
            # classes that share a name share their candidates, and each candidate is verified
            once = {xxhash.xxh3_128_digest(x.tobytes()): x for x in shingle_sets(batch.column("text").to_pylist(), k, cache) if len(x)}
            if not once:
                continue
            ids = np.frombuffer(b"".join(x[:8] for x in once), np.int64)
            grams = list(once.values())
            n = np.array([len(g) for g in grams], np.int64)
            flat = np.concatenate(grams)
            owner = np.repeat(np.arange(len(ids)), n)
            rarity = levels[(flat >> SHIFT).astype(np.int64)]
            order = np.lexsort((flat, rarity, owner))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            need = np.array([_needed(int(x), t) for x in n], np.int64)
            match = np.minimum(need, MATCHES)
            first = rank < (n - need + match)[owner]
            shown = rank < (n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + match)[owner]
            key, who, often, shown = flat[order][first], owner[first], rarity[order][first], shown[first]
            spread = np.maximum(1, -(-_count(often) // HOT))
            key, who, flags = _triangle(key, who, shown, spread, ids)
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rec = np.empty(len(by), _ENTRY)
            rec["low"], rec["high"], rec["id"], rec["n"], rec["flags"] = key[by] & np.uint64(0xFFFFFFFF), (key[by] >> np.uint64(32)) & np.uint64(0xFFFF), ids[who[by]], n[who[by]], flags[by]
            b = bucket[by]
            cut = np.flatnonzero(np.diff(b)) + 1
            starts = np.concatenate([[0], cut]) if len(b) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b[s]) for s in starts], pa.int32()), pa.array([x.tobytes() for x in np.split(rec, cut)] if len(b) else [], pa.binary())],
                names=["bucket", "entries"],
            )

    return run


#: An index entry: the lower 48 bits of the key, class, size; flags: 1 and 2 the side in a cell, 4 shown as the shorter.
_ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("id", "<i8"), ("n", "<i4"), ("flags", "u1")])


def _triangle(key, who, shown, spread, ids):
    """Lists expected to be long become cells (i, j) of a triangle; each entry goes to the cells of its group."""
    hot = spread > 1
    flags = np.where(shown, 4, 0).astype(np.uint8)
    if not hot.any():
        return key, who, flags
    keys, owners, sides = [key[~hot]], [who[~hot]], [flags[~hot]]
    with np.errstate(over="ignore"):
        for g in np.unique(spread[hot]).tolist():
            at = spread == g
            k, w, f = key[at], who[at], flags[at]
            mine = (_mix(ids[w].astype(np.uint64) * np.uint64(_MULT[0])) % np.uint64(g)).astype(np.int64)
            for other in range(g):
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                keys.append(_mix(k + (lo * g + hi + 1).astype(np.uint64) * np.uint64(_MULT[2])))
                owners.append(w)
                sides.append(f | np.where(lo == hi, 0, np.where(mine == lo, 1, 2)).astype(np.uint8))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(sides)


def _tally(t: float):
    """Per bucket: pairs that share positional bytes, and how many of them."""

    def run(tab: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x, _ENTRY) for x in tab.column("entries").to_pylist()])
        key = rec["low"].astype(np.uint64) | rec["high"].astype(np.uint64) << np.uint64(32)
        order = np.lexsort((rec["id"], key))
        rec, key = rec[order], key[order]
        new = np.ones(len(rec), bool)
        new[1:] = (key[1:] != key[:-1]) | (rec["id"][1:] != rec["id"][:-1])
        rec, key = rec[new], key[new]
        side, shown = rec["flags"] & 3, rec["flags"] > 3
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([starts, [len(rec)]]))
        left, right = [], []
        for m in np.unique(size[size > 1]).tolist():
            at = starts[size == m]
            i, j = np.triu_indices(m, 1)
            for s in range(0, len(at), max(1, 2_000_000 // len(i))):
                block = at[s : s + max(1, 2_000_000 // len(i)), None]
                left.append((block + i).ravel())
                right.append((block + j).ravel())
                la, lb = left[-1], right[-1]
                na, nb = rec["n"][la], rec["n"][lb]
                # lengths alone rule a pair out; in a cell across two groups, pairs of one group belong to another cell
                ok = (np.minimum(na, nb) >= np.ceil(t * np.maximum(na, nb) - 1e-9)) & ((side[la] == 0) | (side[la] != side[lb]))
                # entries are sorted by class within a list: of two equally long ones, the first counts as the shorter
                ok &= np.where(na <= nb, shown[la], shown[lb])
                left[-1], right[-1] = left[-1][ok], right[-1][ok]
        if not left:
            return _PAIRS.empty_table()
        a, b = rec[np.concatenate(left)], rec[np.concatenate(right)]
        match = np.minimum(MATCHES, np.ceil(t * np.minimum(a["n"], b["n"]) - 1e-9).astype(np.int64))
        pair = np.stack([np.minimum(a["id"], b["id"]), np.maximum(a["id"], b["id"]), match], axis=1)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[order]
        new = np.concatenate([[True], (np.diff(pair[:, 0]) != 0) | (np.diff(pair[:, 1]) != 0)]) if len(pair) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.diff(np.concatenate([at, [len(pair)]]))
        pair = pair[at]
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2].astype(np.int32)), pa.array(count.astype(np.int32))], schema=_PAIRS)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("least", pa.int32()), ("shared", pa.int32())])


def _mixed(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _mix(np.array(batch.column(column).to_pylist(), np.int64).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in h], pa.binary())], names=[column])

    return run


def _among(wanted_b, k: int):
    """The positional bytes of records whose id may be in some pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(wanted_b.value, np.uint8)
        cache = _WordHash()
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            cell = (_mix(ids.astype(np.uint64)) >> SHIFT).astype(np.int64)
            some = batch.filter(pa.array(wanted[cell] > 0))
            sets = shingle_sets(some.column("text").to_pylist(), k, cache)
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([_pack(x) for x in sets], pa.binary())], names=["id", "grams"])

    return run


def _pack(grams: np.ndarray) -> bytes:
    """The lower 48 bits of each, for comparing two sets."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        j = []
        for x, y in batch.column("grams").to_pylist():
            x, y = _unpack(x), _unpack(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            j.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], names=["a", "b", "similarity"])


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the near-duplicates in df.

    members: ``id``, ``class_id``, ``text_key``; one row per record with at least one word. Records with
    equal sets of word runs share a class, named by its smallest id; those of them with identical text share
    a text_key.
    links: ``a``, ``b``, ``similarity``; one row per pair of classes whose Jaccard similarity reaches
    the threshold, a < b.

    Null ids, null texts and texts without a word are in neither table. Repeated rows with one id count
    once. Other columns of df are not read. An empty df gives empty tables. Jobs run while the result is built: they
    write tables to the shared folder. Classes whose keys begin with the same 8 bytes are told apart when they are
    verified; only a pair of such classes that are near to each other would be missed.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    first = materialize(few_tasks(src).mapInArrow(_classes(k), "id long, class_key binary, text_key long, part int, counts binary"), "near-dup-classes")
    keys = first.where("part is null").select("id", "class_key", "text_key")
    n = keys.count()
    reps = keys.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    reps = materialize(reps, "near-dup-reps")
    members = keys.join(reps, "class_key").select("id", "class_id", "text_key").distinct()
    rarity = spark.sparkContext.broadcast(_table(first.where("part is not null").select("part", "counts")))
    buckets = max(shuffle_partitions(spark), -(-n // 4000))
    entries = src.select("text").mapInArrow(_index_entries(rarity, k, threshold, buckets), "bucket int, entries binary")
    pairs = (
        entries.groupBy("bucket")
        .applyInArrow(_tally(threshold), "a long, b long, least int, shared int")
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
        .where("shared >= least")
        .select("a", "b")
    )
    # the index names a class by the first 8 bytes of its key
    named = reps.select("class_id", "class_key").mapInArrow(_short_keys, "class_id long, class long")
    pairs = (
        materialize(pairs, "near-dup-pairs")
        .join(named.select(F.col("class").alias("a"), F.col("class_id").alias("ia")), "a")
        .join(named.select(F.col("class").alias("b"), F.col("class_id").alias("ib")), "b")
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
        .where("a <> b")
        .distinct()
    )
    pairs = materialize(pairs, "near-dup-candidates")
    # only texts of records in some pair are read into sets and moved; a table of counters over them tells which
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"))
    wanted = spark.sparkContext.broadcast(_table(few_tasks(ends).mapInArrow(_mixed("c"), "c binary").mapInArrow(_count_cells("c"), "part int, counts binary")))
    some = src.mapInArrow(_among(wanted, k), "id long, grams binary").repartition("id").dropDuplicates(["id"])
    sides = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b").join(some, "id")
    both = sides.groupBy("a", "b").agg(F.collect_list("grams").alias("grams"))
    links = both.mapInArrow(_overlap, "a long, b long, similarity double")
    return members, materialize(links.where(F.col("similarity") >= threshold - 1e-12), "near-dup-links")


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = np.frombuffer(b"".join(x[:8] for x in batch.column("class_key").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(short)], names=["class_id", "class"])


def pairs_written_out(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: the pairs of records behind near_duplicates, in the one form told above.

    Texts are paired first, each named by its smallest id: those of one class, and those of linked classes,
    cut into cells of about CELL texts so that no task pairs a whole class. The records with either text are
    then paired cell by cell: of texts with m and n cells, max(m, n) pairs of cells meet, so each record with
    the one text is paired with some with the other, and what is written grows as the records do.
    """
    texts = members.groupBy("class_id", "text_key").agg(F.min("id").alias("head"), F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), F.count("*").alias("n"))
    texts = materialize(texts, "near-dup-texts")
    copied = texts.where("n > 1").select("class_id", "text_key", "head", "parts")
    copies = members.join(copied, ["class_id", "text_key"]).select("head", "parts", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("cell"))
    copies = materialize(copies, "near-dup-copies")
    # identical texts
    mate = copies.select("head", "cell", F.col("id").alias("y"))
    same = copies.select("head", "cell", F.col("id").alias("x")).join(mate, ["head", "cell"]).where("x < y").select("x", "y")
    heads = copies.where("parts > 1").groupBy("head", "cell").agg(F.min("id").alias("y")).select(F.col("head").alias("x"), "y")
    # different texts
    crowd = materialize(texts.groupBy("class_id").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"), F.count("*").alias("n")), "near-dup-crowds")
    few = texts.join(crowd.where("n > 1").select("class_id", "cells"), "class_id").select(F.col("class_id").alias("c"), F.col("head").alias("m"), F.pmod(F.xxhash64("head"), "cells").cast("int").alias("cell"))
    few = materialize(few, "near-dup-carriers")
    cells = crowd.where("n > 1").select(F.col("class_id").alias("c"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    inside = cells.select(F.col("c").alias("a"), F.col("cell").alias("ca")).join(cells.select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("cell").alias("cb")), "a").where("ca <= cb").select("a", "b", "ca", "cb")
    between = (
        links.select("a", "b").join(cells.withColumnsRenamed({"c": "a", "cell": "ca"}), "a", "left").join(cells.withColumnsRenamed({"c": "b", "cell": "cb"}), "b", "left")
        .select("a", "b", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("cb", F.lit(0)).alias("cb"))
    )
    pairs = (
        inside.unionByName(between)
        .join(few.withColumnsRenamed({"c": "a", "m": "ma", "cell": "ca"}), ["a", "ca"], "left")
        .join(few.withColumnsRenamed({"c": "b", "m": "mb", "cell": "cb"}), ["b", "cb"], "left")
        .select("a", "b", "ca", "cb", F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        # within one cell each pair is met from both sides
        .where("a <> b or ca <> cb or x < y")
        .select("x", "y")
    )
    # records with the texts; a text of one record needs no look-up
    parts = copied.select("head", "parts")
    met = pairs.join(parts.withColumnsRenamed({"head": "x", "parts": "px"}), "x", "left").join(parts.withColumnsRenamed({"head": "y", "parts": "py"}), "y", "left").fillna(1, ["px", "py"])
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest("px", "py") - 1)))
    met = met.select("x", "y", (F.col("k") % F.col("px")).alias("cx"), (F.col("k") % F.col("py")).alias("cy"))
    cross = (
        met.join(copies.select(F.col("head").alias("x"), F.col("cell").alias("cx"), F.col("id").alias("ix")), ["x", "cx"], "left")
        .join(copies.select(F.col("head").alias("y"), F.col("cell").alias("cy"), F.col("id").alias("iy")), ["y", "cy"], "left")
        .select(F.coalesce("ix", "x").alias("x"), F.coalesce("iy", "y").alias("y"))
    )
    every = same.unionByName(heads).unionByName(cross)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``id``, ``class_id``, ``group_id``, ``links``: one row per record.

    group_id is the smallest id that is reached over links; links the number of other classes linked
    to the record's class. Records without a word are absent.
    """
    from docmill.llm.graph import components

    members, links = near_duplicates(df, id_col, text_col, k, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    comp = components(links.select("a", "b")).withColumnsRenamed({"node": "class_id", "component": "group_id"})
    return (
        members.join(degree, "class_id", "left").join(comp, "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
