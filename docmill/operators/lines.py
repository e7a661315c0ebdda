"""Documents as ordered lines and pages: explode, implode, offsets, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import is_page_marker, page_marker


def explode_lines(df: DataFrame, doc: str = "doc", text: str = "markdown") -> DataFrame:
    """``doc``, ``line_no`` (from 0), ``line``."""
    return df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def implode_lines(lines: DataFrame, name: str = "markdown", sep: str = "\n", order: str = "line_no", value: str = "line") -> DataFrame:
    """One text per doc from ordered lines; one shuffle by doc."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return lines.groupBy("doc").agg(parts.alias("__p")).select("doc", F.array_join(F.transform("__p", lambda s: s["v"]), sep).alias(name))


def pages(df: DataFrame, doc: str, pages_col: str) -> DataFrame:
    """``doc``, ``page_no`` (from 1), ``markdown`` of an array column of pages."""
    p = df.select(F.col(doc).alias("doc"), F.posexplode(pages_col).alias("i", "markdown"))
    return p.select("doc", (F.col("i") + 1).alias("page_no"), F.coalesce("markdown", F.lit("")).alias("markdown"))


def join_pages(pages_df: DataFrame, markers: bool = False) -> DataFrame:
    """Pages of a document joined by a blank line, in order; with markers each page stands under its marker."""
    body = F.concat(page_marker(F.col("page_no")), F.lit("\n\n"), F.col("markdown")) if markers else F.col("markdown")
    return implode_lines(pages_df.withColumn("__body", body), "markdown", "\n\n", "page_no", "__body")


def line_offsets(lines: DataFrame) -> DataFrame:
    """Lines with ``offset``, the code points before each in its document."""
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def page_index(lines: DataFrame) -> DataFrame:
    """``doc``, ``page_no``, ``offset`` of every page marker line."""
    return line_offsets(lines).where(is_page_marker(F.col("line"))).select("doc", F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("page_no"), "offset")


def page_ranges(spans: DataFrame, index: DataFrame) -> DataFrame:
    """spans (doc, span_no, start, end) with ``page_start`` and ``page_end``.

    The start is as of the last marker at or before it, else the first marker; the end as of the last
    marker strictly before it, but never before the start. Documents without markers have nulls. Both
    sides are united and sorted by offset within a document: one shuffle by doc, no join of ranges.
    """
    def as_of(at: Column, strict: bool, name: str) -> DataFrame:
        marks = index.select("doc", F.col("offset").alias("at"), F.lit(1 if strict else 0).alias("kind"), "page_no", F.lit(None).cast("int").alias("span_no"))
        asks = spans.select("doc", at.alias("at"), F.lit(0 if strict else 1).alias("kind"), F.lit(None).cast("int").alias("page_no"), "span_no")
        w = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("doc")
        found = marks.unionByName(asks).withColumn(name, F.coalesce(F.last("page_no", True).over(w), F.min_by("page_no", F.when(F.col("page_no").isNotNull(), F.col("at"))).over(every)))
        return found.where("span_no is not null").select("doc", "span_no", name)

    a = as_of(F.col("start"), False, "page_start")
    b = as_of(F.greatest("start", "end"), True, "page_end")
    return spans.join(a, ["doc", "span_no"]).join(b, ["doc", "span_no"]).withColumn("page_end", F.greatest("page_start", "page_end"))


def split_pages(lines: DataFrame) -> DataFrame:
    """``doc``, ``part_no``, ``page_no``, ``text``: the document cut at its markers; what stands before the
    first has a null page."""
    w = Window.partitionBy("doc").orderBy("line_no")
    mark = is_page_marker(F.col("line"))
    x = lines.withColumn("part_no", F.sum(mark.cast("int")).over(w)).withColumn("page", F.when(mark, F.regexp_extract("line", r"(\d+)", 1).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return x.groupBy("doc", "part_no").agg(F.max("page").alias("page_no"), parts.alias("p")).select("doc", "part_no", "page_no", F.array_join(F.transform("p", lambda s: s["line"]), "\n").alias("text"))


def islands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """``start``, ``length`` of every maximal run of true flags (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumn("__rank", F.row_number().over(w))
    x = x.where(F.col(flag)).withColumn("__gap", F.col("__rank") - F.row_number().over(w))
    return x.groupBy(*by, "__gap").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("__gap")
