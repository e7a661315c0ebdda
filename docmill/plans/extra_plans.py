"""Queries over lookups, maps, runs, roll-ups and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import describe, evaluate, headings, ingest, lines, repair
from docmill.plans.document_plans import LOOPS
from docmill.plans.fixtures import DOCS_SQL, LINES_SQL, PAGES_SQL, docs
from docmill.plans.registry import query
from docmill.session import table


@query("SELECT event_id, (coalesce(s IN (429, 500, 502, 503, 504) OR s >= 500, false) OR coalesce(regexp_matches(name, 'Timeout|Connect'), false)) AS again FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 395 + event_id % 211 END AS s, CASE event_id % 5 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ConnectError' WHEN 2 THEN NULL ELSE 'ValueError' END AS name FROM events)")
def p03_retryable(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 7 != 0, 395 + i % 211)
    name = F.when(i % 5 == 0, "ReadTimeout").when(i % 5 == 1, "ConnectError").when(i % 5 > 2, "ValueError")
    return table(spark, sf, "events").select("event_id", ingest.retryable(status, name).alias("again"))


@query("WITH m AS (SELECT source, max(pdf_hash) AS h FROM manifest WHERE source IS NOT NULL GROUP BY source) SELECT id, coalesce(h, 'new') AS known FROM chunks c LEFT JOIN m ON c.source = m.source")
def j02_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest").where("source is not null").groupBy("source").agg(F.max("pdf_hash").alias("h"))
    return ingest.lookup(table(spark, sf, "chunks").select("id", "source"), m, ["source"], "h", "new").select("id", F.col("h").alias("known"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, map_extract(map_concat(MAP {'a': l_partkey, 'b': l_suppkey}, MAP {'b': -l_partkey, 'c': l_suppkey}), 'b')[1] AS b, cardinality(map_concat(MAP {'a': l_partkey, 'b': l_suppkey}, MAP {'b': -l_partkey, 'c': l_suppkey})) AS size FROM lineitem")
def u05_map_merge(spark: SparkSession, sf: str) -> DataFrame:
    left = F.create_map(F.lit("a"), F.col("l_partkey"), F.lit("b"), F.col("l_suppkey"))
    right = F.create_map(F.lit("b"), -F.col("l_partkey"), F.lit("c"), F.col("l_suppkey"))
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ingest.merge_maps(left, right).alias("m"))
    return x.select("k", "n", F.element_at("m", F.lit("b")).alias("b"), F.size("m").cast("long").alias("size"))


@query(f"WITH {DOCS_SQL}, {LINES_SQL}, x AS (SELECT doc, line_no, line <> '' AS filled FROM lines), r AS (SELECT doc, line_no, filled, line_no - row_number() OVER (PARTITION BY doc, filled ORDER BY line_no) AS g FROM x) SELECT doc, CAST(min(line_no) AS INT) AS first_line, count(*) AS run FROM r WHERE filled GROUP BY doc, g HAVING count(*) >= 3")
def w10_runs(spark: SparkSession, sf: str) -> DataFrame:
    x = lines.explode_lines(docs(spark, sf)).withColumn("full", F.col("line") != "")
    return lines.islands(x, ["doc"], "line_no", "full").where("length >= 3").select("doc", F.col("start").alias("first_line"), F.col("length").alias("run"))


@query(f"WITH {PAGES_SQL}, h AS (SELECT doc, page_no, sha256(markdown) AS h FROM pages WHERE regexp_matches(markdown, '\\S')) SELECT doc, count(*) AS repeated FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc) > 1) GROUP BY doc")
def e10_repeated_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = lines.pages(table(spark, sf, "ocr_results"), "ocr_id", "page_markdowns")
    return evaluate.repeated_pages(p).groupBy("doc").agg(F.count("*").alias("repeated"))


@query(f"WITH {PAGES_SQL}, b AS (SELECT doc * 1000 + page_no AS k, markdown AS text FROM pages), {LOOPS} SELECT k // 1000 AS doc, k % 1000 AS page_no, k IN (SELECT k FROM loops) AS has_loop FROM b")
def e10_loop_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = lines.pages(table(spark, sf, "ocr_results"), "ocr_id", "page_markdowns").select(F.struct("doc", "page_no").alias("page"), "markdown")
    return repair.find_loops(p, "page", "markdown").select("doc.*", "has_loop")


_METRICS = "m AS (SELECT lang, page_count AS pages, CAST(length(markdown) AS DOUBLE) AS chars, length(markdown) % 9 AS n, (length(markdown) % 5) / 4.0 AS hr, (length(markdown) % 3) / 2.0 AS hh FROM ocr_results WHERE markdown IS NOT NULL AND lang IS NOT NULL)"


@query(f"WITH {_METRICS} SELECT lang, sum(pages) AS pages, round(sum(chars * pages) / sum(CASE WHEN pages IS NOT NULL THEN pages END), 6) AS chars, sum(n) AS n_headings, round(sum(round(hr * n)) / sum(n), 6) AS h_recall, round(sum(hh * greatest(0, round(hr * n) - 1)) / nullif(sum(greatest(0, round(hr * n) - 1)), 0), 6) AS h_hierarchy FROM m GROUP BY lang")
def a10_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("markdown")
    m = table(spark, sf, "ocr_results").where("markdown is not null and lang is not null").select("lang", F.col("page_count").alias("pages"), n.cast("double").alias("chars"), (n % 9).alias("n_headings"), ((n % 5) / 4).alias("h_recall"), ((n % 3) / 2).alias("h_hierarchy"))
    x = evaluate.roll_up(m.withColumn("headings", F.col("n_headings")), ["lang"], ["chars"], totals=["headings"])
    return x.select("lang", "pages", "chars", F.col("headings").alias("n_headings"), F.round("h_recall", 6).alias("h_recall"), F.round("h_hierarchy", 6).alias("h_hierarchy"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'total', count(*) FROM events")
def a17_totals(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return evaluate.with_total(x, "kind", ["n"])


@query("WITH d AS (SELECT source AS doc, substring(sha256(text), 1, 16) AS k, CASE WHEN id % 3 = 0 THEN '[Image description unavailable]' ELSE 'text ' || length(text) END AS description FROM chunks) SELECT doc, count(DISTINCT k) AS n, count(DISTINCT k || description) AS entries FROM d WHERE description NOT LIKE '[Image%' GROUP BY doc")
def g12_description_cache(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select(F.col("source").alias("doc"), F.col("text").cast("binary").alias("content"), F.when(F.col("id") % 3 == 0, "[Image description unavailable]").otherwise(F.concat(F.lit("text "), F.length("text").cast("string"))).alias("description"))
    x = ingest.description_cache(c)
    return x.select("doc", F.size("image_descriptions").cast("long").alias("n"), F.size(F.map_values("image_descriptions")).cast("long").alias("entries"))


@query()
def p11_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return headings.is_numbered(lines.explode_lines(docs(spark, sf)))


@query("SELECT DISTINCT substring(sha256(text), 1, 16) AS content_hash FROM chunks WHERE id % 2 = 0 AND substring(sha256(text), 1, 16) NOT IN (SELECT substring(sha256(text), 1, 16) FROM chunks WHERE id % 2 = 1 AND id % 5 <> 0)")
def g14_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures to be asked: once by content, and those that the cache holds (failures aside) not at all."""
    c = table(spark, sf, "chunks")
    images = c.where("id % 2 = 0").select(F.col("text").cast("binary").alias("content"), F.lit("").alias("context"))
    told = F.when(F.col("id") % 5 == 0, "[Image description unavailable: late]").otherwise("known")
    cache = c.where("id % 2 = 1").select(F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), told.alias("description"))
    return describe.requests(images, cache).select("content_hash")
