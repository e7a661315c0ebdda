"""Documents with every feature the cleanup handles, derived from the OCR results by one expression that
both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import table

_NL = "chr(10)"
_BODY = [
    "CASE WHEN ocr_id % 4 = 0 THEN 'SECRET//NOFORN' || chr(10) || chr(10) WHEN ocr_id % 4 = 1 THEN 'UNCLASSIFIED' || chr(10) || chr(10) ELSE '' END",
    "'# Report ' || pdf",
    "chr(10) || chr(10)",
    "markdown",
    "chr(10) || chr(10) || '## 1. Scope' || chr(10) || chr(10) || 'The text is cut at this line and' || chr(10) || chr(10) || 'goes on below. See ![x](figure) here.'",
    "chr(10) || chr(10) || '![figure](figure)' || chr(10) || chr(10) || '### 1.1 Parts *and* pieces' || chr(10) || chr(10) || 'Running head' || chr(10) || '12' || chr(10) || 'Running head' || chr(10) || chr(10) || '13' || chr(10) || chr(10)",
    "'| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || '![plot](img-1.png)' || chr(10) || '> **Figure description:** a plot' || chr(10) || 'of two lines' || chr(10) || chr(10)",
    "'## II. Results' || chr(10) || chr(10) || 'Values of $x_1$ and $y$ are given in [1](http://a.example/x).' || chr(10) || chr(10) || 'Downloaded by Library ' || cast(ocr_id % 7 as varchar(9)) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'Page 2 of 3' || chr(10)",
    "CASE WHEN ocr_id % 3 = 0 THEN chr(10) || 'CUI' || chr(10) ELSE '' END",
]
TEXT = " || ".join(f"({b})" for b in _BODY)
DOCS_SQL = f"docs AS (SELECT ocr_id AS doc, {TEXT} AS markdown FROM ocr_results WHERE markdown IS NOT NULL)"
PAGES_SQL = "pages AS (SELECT ocr_id AS doc, generate_subscripts(page_markdowns, 1) AS page_no, coalesce(unnest(page_markdowns), '') AS markdown FROM ocr_results)"
LINES_SQL = "lines AS (SELECT doc, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no, unnest(string_split(markdown, chr(10))) AS line FROM docs)"
#: White space as both engines see it, at both ends.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_results").where("markdown is not null").select(F.col("ocr_id").alias("doc"), F.expr(TEXT).alias("markdown"))
