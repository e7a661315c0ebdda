"""Queries over descriptions, front matter, fonts and per-page scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import describe, geometry, lines
from docmill.plans.fixtures import DOCS_SQL, LINES_SQL, docs
from docmill.plans.registry import query
from docmill.session import table
from docmill.sources import zotero


@query("SELECT zotero_key, regexp_extract(coalesce(pub_date, ''), '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1) AS year, coalesce(split_part(creators[1], ',', 1), '') AS author FROM zotero_items")
def t17_year_author(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "zotero_items").select("zotero_key", zotero.year(F.coalesce("pub_date", F.lit(""))).alias("year"), zotero.first_author(F.col("creators")).alias("author"))


@query(
    """SELECT zotero_key, concat_ws(chr(10), '---', CASE WHEN title <> '' THEN 'title: "' || replace(title, '"', '''') || '"' END, CASE WHEN len(creators) > 0 THEN 'authors: [' || array_to_string(creators, '; ') || ']' END,
CASE WHEN regexp_extract(pub_date, '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1) <> '' THEN 'year: "' || regexp_extract(pub_date, '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1) || '"' END, CASE WHEN doi <> '' THEN 'doi: "' || replace(doi, '"', '''') || '"' END,
CASE WHEN publication <> '' THEN 'publication: "' || replace(publication, '"', '''') || '"' END, CASE WHEN len(tags) > 0 THEN 'tags: [' || array_to_string(tags, ', ') || ']' END, '---') AS front FROM zotero_items"""
)
def t17_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    return zotero.front_matter(table(spark, sf, "zotero_items"))


@query("SELECT stem, CASE WHEN starts_with(stem, '---' || chr(10)) THEN stem ELSE '---' || chr(10) || '---' || chr(10) || chr(10) || stem END AS doc, NOT regexp_matches(substring(pdf_hash, 1, 3), '[A-Za-z]') AS rename FROM manifest")
def t18_inject(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest").select("stem", zotero.inject(F.col("stem"), F.lit("---\n---")).alias("doc"), zotero.needs_new_name(F.col("pdf_hash")).alias("rename"))


# What stands before the first line that begins with DATA: (its marks aside), and what follows the words.
_DATA = r"'(?mi)^\s*\**DATA:\**\s*'"


@query(
    rf"""WITH t AS (SELECT id, coalesce(section, '') || chr(10) || CASE WHEN id % 2 = 0 THEN '**DATA:** ' ELSE '' END || text AS d FROM chunks), m AS (SELECT id, d, regexp_extract(d, {_DATA}) AS mark FROM t)
SELECT id, regexp_replace(CASE WHEN mark = '' THEN d ELSE substring(d, 1, strpos(d, mark) - 1) END, '^\s+|\s+$', '', 'g') AS prose, CASE WHEN mark = '' THEN '' ELSE regexp_replace(substring(d, strpos(d, mark) + length(mark)), '^\s+|\s+$', '', 'g') END AS data FROM m"""
)
def t16_split_data(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    prose, data = describe.split_data(F.concat(F.coalesce("section", F.lit("")), F.lit("\n"), F.when(F.col("id") % 2 == 0, "**DATA:** ").otherwise(""), "text"))
    return c.select("id", prose.alias("prose"), data.alias("data"))


@query(f"WITH {DOCS_SQL}, x AS (SELECT doc, markdown, strpos(markdown, '![plot](img-1.png)') AS ps FROM docs) SELECT doc, regexp_replace(substring(markdown, greatest(ps - 500, 1), least(ps - 1, 500) + 18 + 500), '!\\[[^\\]]*\\]\\([^)]*\\)', '[IMAGE]', 'g') AS around FROM x")
def t24_context(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", describe.context_window(F.col("markdown"), F.lit("![plot](img-1.png)")).alias("around"))


@query(f"WITH {DOCS_SQL} SELECT doc, 'other.png' AS image_id FROM docs")
def p08_undescribed(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return describe.undescribed(d.select("doc", F.explode(F.array(F.lit("img-1.png"), F.lit("other.png"))).alias("image_id")), d)


@query(f"WITH {DOCS_SQL}, {LINES_SQL}, x AS (SELECT doc, line_no, regexp_replace(regexp_replace(line, '<!--.*?-->', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g') AS line FROM lines) SELECT doc, CAST(line_no AS INT) AS line_no, line FROM x WHERE NOT starts_with(line, '>')")
def t20_strip_generated(spark: SparkSession, sf: str) -> DataFrame:
    return describe.strip_generated(lines.explode_lines(docs(spark, sf)))


@query("SELECT id, text AS reply FROM chunks")
def t23_reply_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content")).alias("message"))).alias("choices")))
    return c.select("id", describe.reply_text(F.when(F.col("id") % 2 == 0, whole).otherwise(parts)).alias("reply"))


@query(
    r"""SELECT id, len(list_filter(regexp_split_to_array(section, '\s+'), lambda t: t <> '')) BETWEEN 1 AND 15 AND length(section) <= 120 AND NOT regexp_matches(section, '[.,;]\s*$') AND regexp_matches(section, '^[A-Z0-9ÄÖÜÀÉ]') AS ok FROM chunks WHERE section IS NOT NULL"""
)
def p10_title_ok(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("section is not null").select("id", T.title_ok(F.col("section")).alias("ok"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Font spans made of parts: a line of a brand's document in a size and weight."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_brand").alias("doc"), F.lit(1).alias("page_no"), (F.col("p_partkey") / 2).cast("int").alias("line_no"), (F.col("p_partkey") % 2).alias("span_no"), F.col("p_name").alias("text"),
        (F.lit(8) + F.col("p_size") % 4 * 0.3).alias("size"), F.when(F.col("p_partkey") % 3 == 0, "Sans-Bold").otherwise("Sans").alias("font"), (F.col("p_partkey") % 32).cast("int").alias("flags"),
    )


_SL = "sl AS (SELECT p_brand AS doc, p_partkey // 2 AS line_no, regexp_replace(lower(string_agg(p_name, '' ORDER BY p_partkey % 2, p_name)), '[^a-z0-9]+', '', 'g') AS key, max(round_even((8 + p_size % 4 * 0.3) * 2, 0) / 2) AS size, bool_or((p_partkey % 32) & 16 > 0 OR p_partkey % 3 = 0) AS bold FROM part GROUP BY 1, 2)"


@query(f"WITH {_SL} SELECT doc, line_no::INT AS line_no, key, round(CAST(size AS DOUBLE), 4) AS size, bold FROM sl")
def h07_span_lines(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.span_lines(_spans(spark, sf)).select("doc", "line_no", "key", F.round("size", 4).alias("size"), "bold")


@query(
    f"""WITH {_SL}, ld AS (SELECT *, lead(key, 1) OVER w AS k1, lead(key, 2) OVER w AS k2, lead(key, 3) OVER w AS k3 FROM sl WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
ex AS (SELECT doc, size, bold, unnest([key, key || k1, key || k1 || k2, key || k1 || k2 || k3]) AS k FROM ld), h AS (SELECT DISTINCT doc, key FROM sl WHERE key <> ''),
met AS (SELECT h.doc, h.key, size, bold FROM h JOIN ex ON ex.doc = h.doc AND ex.k = h.key UNION ALL SELECT h.doc, h.key, size, bold FROM h JOIN sl ON sl.doc = h.doc AND length(h.key) >= 8 AND length(sl.key) > length(h.key) AND starts_with(sl.key, h.key))
SELECT doc, key, max(CAST(size AS DOUBLE)) AS size FROM met WHERE size > 8 OR (bold AND size >= 8) GROUP BY doc, key"""
)
def j15_heading_style(spark: SparkSession, sf: str) -> DataFrame:
    s = geometry.span_lines(_spans(spark, sf))
    return geometry.heading_style(s.where("key <> ''").select("doc", "key"), s, s.select("doc").distinct().withColumn("size", F.lit(8.0))).select("doc", "key", "size")


@query("WITH p AS (SELECT ocr_id AS doc, generate_subscripts(page_markdowns, 1) AS page_no, unnest(page_markdowns) AS t FROM ocr_results) SELECT doc, count(*) AS pages, count(*) FILTER (WHERE coalesce(regexp_replace(t, '\\s', '', 'g'), '') = '') AS empty_pages FROM p GROUP BY doc")
def e10_page_split(spark: SparkSession, sf: str) -> DataFrame:
    p = lines.pages(table(spark, sf, "ocr_results"), "ocr_id", "page_markdowns")
    return p.groupBy("doc").agg(F.count("*").alias("pages"), F.count(F.when(F.regexp_replace("markdown", r"\s", "") == "", 1)).alias("empty_pages"))


@query("SELECT l_orderkey AS page, l_suppkey % 3 AS block, l_linenumber % 2 AS line, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_quantity, l_linenumber, l_returnflag || l_partkey) AS text FROM lineitem GROUP BY 1, 2, 3")
def f12_printed_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    w = li.select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("block"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").alias("word_no"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return geometry.printed_lines(w)


@query("SELECT p_partkey AS id, p_size >= 0.25 * 100 AND length(p_name) * 4 >= 25 * (p_size % 4 + 1) AS prose FROM part")
def f07_prose_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), geometry.prose_block(F.col("p_size"), F.lit(100), F.length("p_name") * 4, F.col("p_size") % 4 + 1).alias("prose"))


@query("WITH l AS (SELECT l_orderkey AS page, l_suppkey % 2 AS box, l_linenumber AS id, CAST(l_partkey % 9 AS DOUBLE) AS x0, l_quantity AS y0, l_quantity + 8 AS y1 FROM lineitem) SELECT a.page, a.box, bool_or(a.id <> b.id AND abs(a.x0 - b.x0) <= 2.5 AND b.y0 - a.y1 BETWEEN 0 AND 12) AS is_listing FROM l a JOIN l b ON a.page = b.page AND a.box = b.box GROUP BY 1, 2")
def f06_listing(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return geometry.listing(li.select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 2).alias("box"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 9).cast("double").alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 8).alias("y1")))
