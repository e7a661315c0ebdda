"""Splitting oversized texts at natural boundaries.

A text over its limit is cut by a hierarchy of separators: section heading, paragraph, line, sentence,
word, character. Each level only cuts what is still too large for the limit; the resulting atoms are
packed greedily up to the limit, each piece after the first beginning with trailing atoms of the one
before it, up to the given overlap.

A token is a maximal run of characters other than space, tab, carriage return and line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^ \t\r\n]+")
#: Each level cuts before the position that its pattern's end gives.
LEVELS = (
    ("section", re.compile(r"\n(?=#{1,6} |={2,6} [^=\n]+ ={2,6}[ \t]*(?:\n|$)|\\(?:sub)*section\{|\d+(?:\.\d+)*\.? +[^\W\d_]+[^\n]{0,80}\n\s*\n)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"[.!?;:][\"'»”)\]]*[ \t\r\n]+")),
    ("word", re.compile(r"[ \t\r\n]+")),
)


def token_count(text: Column) -> Column:
    """Tokens of a text column; null for null."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))


def _cuts(text: str, start: int, end: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    at, out = start, []
    for m in pattern.finditer(text, start, end):
        if at < m.end() < end:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, end))
    return out


def _atoms(text: str, start: int, end: int, limit: int, level: int, out: list[tuple[int, int, int, int]]) -> None:
    """(start, end, tokens, level) of the parts that a recursive cut leaves."""
    n = len(TOKEN.findall(text, start, end))
    if n <= limit or level >= len(LEVELS):
        out.append((start, end, n, level))
        return
    parts = _cuts(text, start, end, LEVELS[level][1])
    if len(parts) == 1:
        _atoms(text, start, end, limit, level + 1, out)
        return
    for s, e in parts:
        _atoms(text, s, e, limit, level + 1, out)


def _chars(text: str, max_chars: int | None, atoms: list) -> list:
    """Cut atoms of too many characters, the last level of the hierarchy."""
    if not max_chars:
        return atoms
    out = []
    for s, e, n, level in atoms:
        if e - s <= max_chars:
            out.append((s, e, n, level))
            continue
        for u in range(s, e, max_chars):
            v = min(u + max_chars, e)
            out.append((u, v, len(TOKEN.findall(text, u, v)), len(LEVELS)))
    return out


def _tail(text: str, start: int, end: int, tokens: int) -> int:
    """Where the last `tokens` tokens of text[start:end] begin."""
    if tokens <= 0:
        return end
    begins = [m.start() for m in TOKEN.finditer(text, start, end)]
    if not begins:
        return end
    return begins[-min(tokens, len(begins))]


def split_text(text: str, limit: int, overlap: int = 0, max_chars: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of text.

    Every piece has at most `limit` tokens (and `max_chars` characters, if given); the pieces without
    their overlaps join to the text exactly. The overlap is less than the limit, whatever is asked.
    """
    limit = max(1, int(limit))
    overlap = max(0, min(int(overlap or 0), limit - 1))
    atoms: list[tuple[int, int, int, int]] = []
    _atoms(text, 0, len(text), limit - overlap, 0, atoms)
    atoms = _chars(text, max_chars, atoms)
    out: list[tuple[int, int, int]] = []
    i, fresh = 0, 0  # fresh: where text begins that no piece has yet
    while i < len(atoms):
        begin = _tail(text, out[-1][0], fresh, overlap) if out and overlap else fresh
        if max_chars and out:
            begin = max(begin, atoms[i][1] - max_chars)
        n = len(TOKEN.findall(text, begin, fresh))
        j, end = i, fresh
        while j < len(atoms) and (j == i or (n + atoms[j][2] <= limit and (not max_chars or atoms[j][1] - begin <= max_chars))):
            n += atoms[j][2]
            end = atoms[j][1]
            j += 1
        # a word cut between characters counts in both pieces
        out.append((begin, end, n))
        i, fresh = j, end
    return out


def _pieces(extra: list[str], max_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            cols: dict[str, list] = {c: [] for c in (*extra, "piece_no", "pieces", "start", "end", "piece_tokens", "overlap_chars", "piece")}
            for r in range(batch.num_rows):
                text, limit = rows["__text"][r], rows["__limit"][r]
                cut = split_text(text, limit, rows["__overlap"][r] or 0, max_chars)
                fresh = 0
                for no, (s, e, _) in enumerate(cut):
                    piece = text[s:e]
                    for c in extra:
                        cols[c].append(rows[c][r])
                    for c, v in (("piece_no", no), ("pieces", len(cut)), ("start", s), ("end", e), ("piece_tokens", len(TOKEN.findall(piece))), ("overlap_chars", max(0, fresh - s)), ("piece", piece)):
                        cols[c].append(v)
                    fresh = e
            kinds = {"piece_no": pa.int32(), "pieces": pa.int32(), "start": pa.int32(), "end": pa.int32(), "piece_tokens": pa.int32(), "overlap_chars": pa.int32(), "piece": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c) or batch.schema.field(c).type) for c, v in cols.items()], names=list(cols))

    return run


def split_oversized(df: DataFrame, limits: DataFrame, id_col: str = "id", text_col: str = "text", kind_col: str = "content_type", section_col: str = "section_path", max_chars: int | None = None) -> DataFrame:
    """The pieces of all rows of df whose text has more tokens than their kind allows.

    limits has ``content_type``, ``max_tokens``, ``overlap_tokens``, one row per kind: a small fixed
    table. The result has ``id``, ``section_path``, ``piece_no`` (from 0), ``pieces``, ``start`` and
    ``end`` (code points), ``piece_tokens``, ``overlap_chars`` and ``piece``.

    Rows with a null text, a kind that is null or has no limit, or a null limit give no piece. Limits
    under 1 count as 1; null overlaps as 0; an overlap not under the limit is cut to limit - 1. A kind
    that stands several times in limits counts with its smallest limit. Repeated rows are split each.
    Empty tables give an empty result; other columns are not read.
    """
    small = (
        limits.select(F.col("content_type").cast("string").alias("__kind"), F.greatest(F.col("max_tokens").cast("int"), F.lit(1)).alias("__limit"), F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)).alias("__overlap"))
        .where("__kind is not null and __limit is not null")
        .groupBy("__kind").agg(F.min(F.struct("__limit", "__overlap")).alias("s")).select("__kind", "s.*")
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(section_col).alias("section_path"), F.col(text_col).cast("string").alias("__text"), F.col(kind_col).cast("string").alias("__kind"))
    # a text of n characters has at most (n + 1) / 2 tokens, so most rows need no count
    over = (
        rows.where("__text is not null")
        .join(small, "__kind")
        .where((F.length("__text") >= 2 * F.col("__limit")) & (token_count(F.col("__text")) > F.col("__limit")))
        .drop("__kind")
    )
    kinds = {f.name: f.dataType.simpleString() for f in over.schema.fields}
    out = f"id {kinds['id']}, section_path {kinds['section_path']}, piece_no int, pieces int, start int, end int, piece_tokens int, overlap_chars int, piece string"
    return over.mapInArrow(_pieces(["id", "section_path"], max_chars), out)
