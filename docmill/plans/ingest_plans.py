"""Queries over manifests, run states, uploads and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import evaluate, ingest
from docmill.plans.registry import query
from docmill.session import table
from docmill.sources import files


@query("SELECT source FROM sources WHERE NOT contains(lower(source), 'data') AND NOT contains(lower(source), 'query') AND lower(source) LIKE '%.pdf'")
def s01_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.exclude_names(table(spark, sf, "sources"), ["Data", "query"], "source").select("source")


@query("SELECT id, sha256(text) AS hash FROM chunks")
def s02_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("SELECT m.stem, m.pdf_hash, m.source FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest d WHERE d.output_path IS NOT NULL AND d.stem = m.stem AND d.pdf_hash = m.pdf_hash)")
def p01_todo(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest")
    return ingest.todo(m.select("stem", "pdf_hash", "source"), m)


@query("SELECT source FROM sources WHERE regexp_replace(source, '\\.pdf$', '') NOT IN (SELECT stem FROM manifest WHERE stem IS NOT NULL)")
def p02_backlog(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").withColumn("stem", F.regexp_replace("source", r"\.pdf$", ""))
    return ingest.backlog(s, table(spark, sf, "manifest").where("stem is not null")).select("source")


@query("SELECT ocr_id, CASE WHEN n = 0 THEN 'no pages' WHEN length(regexp_replace(coalesce(markdown, ''), '^\\s+|\\s+$', '', 'g')) < 20 * coalesce(CASE WHEN n > 0 THEN n END, CASE WHEN page_count > 0 THEN page_count END, 1) THEN 'too little text' END AS error, CASE WHEN NOT (coalesce(n = 0, false) OR length(regexp_replace(coalesce(markdown, ''), '^\\s+|\\s+$', '', 'g')) < 20 * coalesce(CASE WHEN n > 0 THEN n END, CASE WHEN page_count > 0 THEN page_count END, 1)) AND n <> page_count THEN 'page count differs' END AS warning FROM (SELECT *, len(page_markdowns) AS n FROM ocr_results)")
def p07_validate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("page_markdowns").isNotNull(), F.size("page_markdowns"))
    e, w = ingest.validate(n, F.col("page_count"), F.col("markdown"))
    return table(spark, sf, "ocr_results").select("ocr_id", e.alias("error"), w.alias("warning"))


@query("WITH f AS (SELECT DISTINCT unnest(pdf_paths) AS path FROM zotero_items), x AS (SELECT path, substring(sha256(path), 1, 12) || CAST(length(path) % 3 AS VARCHAR) AS hash, 'r' || CAST(length(path) % 11 AS VARCHAR) AS stem, split_part(path, '/', 2) AS folder FROM f), a AS (SELECT *, first_value(hash) OVER (PARTITION BY stem ORDER BY path) AS kept, stem || ' (' || folder || ')' AS second FROM x), b AS (SELECT *, first_value(hash) OVER (PARTITION BY second, hash = kept ORDER BY path) AS kept2 FROM a) SELECT 'lib/' || folder || '/' || stem || '.pdf' || path AS path, CASE WHEN hash = kept THEN stem WHEN hash = kept2 THEN second ELSE stem || ' (' || substring(hash, 1, 8) || ')' END AS out_stem FROM b")
def t14_output_stems(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "zotero_items").select(F.explode("pdf_paths").alias("old")).distinct()
    p = p.withColumn("stem", F.concat(F.lit("r"), (F.length("old") % 11).cast("string"))).withColumn("folder", F.split_part("old", F.lit("/"), F.lit(2)))
    p = p.withColumn("hash", F.concat(F.substring(F.sha2("old", 256), 1, 12), (F.length("old") % 3).cast("string")))
    # the old path keeps equal new ones in order
    p = p.withColumn("path", F.concat(F.lit("lib/"), F.translate("old", "/.", "__"), F.lit("/"), "folder", F.lit("/"), "stem", F.lit(".pdf")))
    out = ingest.output_stems(p, "path", "hash").join(p.select("path", "old", "folder", "stem"), "path")
    return out.select(F.concat(F.lit("lib/"), "folder", F.lit("/"), "stem", F.lit(".pdf"), "old").alias("path"), "out_stem")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY converted_at DESC NULLS LAST) AS n FROM manifest) SELECT stem, max(converted_at)::VARCHAR AS converted_at FROM r WHERE n = 1 GROUP BY stem")
def u04_latest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    x = ingest.latest(table(spark, sf, "manifest"), ["stem"], "converted_at")
    return x.select("stem", F.col("converted_at").cast("string").alias("converted_at"))


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, -1.0 FROM lineitem WHERE l_returnflag = 'R'")
def u03_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("v", F.lit(-1.0))
    return ingest.upsert(old, new, ["k"])


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'pending') AS remaining FROM (SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'failed' ELSE 'pending' END AS s FROM events) WHERE event_type = 'view' OR true GROUP BY event_type")
def a07_status_by_type(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 5
    s = F.when(r == 0, "done").when(r == 1, "skipped").when(r == 2, "incomplete").when(r == 3, "failed").otherwise("pending")
    x = table(spark, sf, "events").select("event_type", s.alias("s"))
    return x.groupBy("event_type").agg(F.count("*").alias("total"), *[F.count(F.when(F.col("s") == v, 1)).alias(n) for v, n in (("done", "done"), ("failed", "failed"), ("pending", "remaining"))])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 5 = 0) AS done, count(*) FILTER (WHERE event_id % 5 = 1) AS skipped, count(*) FILTER (WHERE event_id % 5 = 2) AS incomplete, count(*) FILTER (WHERE event_id % 5 = 3) AS failed, count(*) FILTER (WHERE event_id % 5 = 4) AS remaining FROM events")
def a07_run_state(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("event_id") % 5
    s = F.when(r == 0, "done").when(r == 1, "skipped").when(r == 2, "incomplete").when(r == 3, "failed").otherwise("pending")
    return ingest.run_state(table(spark, sf, "events").select(F.col("event_type").alias("name"), s.alias("status"))).drop("failures")


@query("WITH o AS (SELECT pdf || '#' || ocr_id AS custom_id, page_markdowns AS pages, CASE WHEN ocr_id % 5 = 0 THEN 500 ELSE 200 END AS status_code FROM ocr_results), p AS (SELECT custom_id, generate_subscripts(pages, 1) AS i, unnest(pages) AS page FROM o WHERE status_code = 200) SELECT custom_id, string_agg(page, chr(10) || chr(10) ORDER BY i) AS markdown, count(*) AS page_count FROM p GROUP BY custom_id")
def s11_batch_results(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "ocr_results")
    key = F.concat("pdf", F.lit("#"), F.col("ocr_id").cast("string")).alias("custom_id")
    out = o.select(key, F.col("page_markdowns").alias("pages"), F.when(F.col("ocr_id") % 5 == 0, 500).otherwise(200).alias("status_code"))
    return ingest.batch_results(out, o.select(key)).select("custom_id", "markdown", "page_count")


@query("SELECT id, split_part(source || '::' || 'img-' || CAST(chunk_index AS VARCHAR) || '.png', '::', 1) AS stem, 'img-' || CAST(chunk_index AS VARCHAR) || '.png' AS image_id FROM chunks")
def j14_custom_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", F.concat("source", F.lit("::img-"), F.col("chunk_index").cast("string"), F.lit(".png")).alias("custom_id"), F.col("id").cast("string").alias("description"))
    return ingest.vision_results(c).select(F.col("description").cast("long").alias("id"), "stem", "image_id")


@query("SELECT id, text AS back FROM chunks")
def s14_base64(spark: SparkSession, sf: str) -> DataFrame:
    sent = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))
    return table(spark, sf, "chunks").select("id", ingest.base64_bytes(sent).cast("string").alias("back"))


@query("SELECT stem, pdf_hash FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.pdf = m.source AND o.markdown IS NOT NULL)")
def s25_cache_todo(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest").select("stem", "pdf_hash", F.col("source").alias("pdf"), F.lit(0).alias("page_index"))
    o = table(spark, sf, "ocr_results").select("pdf", F.lit(0).alias("page_index"), "markdown")
    return ingest.cache_todo(m, o, ["pdf"]).select("stem", "pdf_hash")


@query("WITH e AS (SELECT pdf AS doc, max(page_count) AS page_count FROM ocr_results WHERE page_count IS NOT NULL GROUP BY pdf), g AS (SELECT pdf AS doc, count(DISTINCT i) AS n FROM (SELECT pdf, generate_subscripts(page_markdowns, 1) AS i, unnest(page_markdowns) AS m FROM ocr_results) WHERE m IS NOT NULL GROUP BY pdf) SELECT e.doc, coalesce(n, 0) = page_count AS complete FROM e LEFT JOIN g ON e.doc = g.doc")
def s08_complete(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "ocr_results")
    p = o.select(F.col("pdf").alias("doc"), F.posexplode("page_markdowns").alias("page_no", "markdown"))
    return ingest.complete(p, o.where("page_count is not null").groupBy(F.col("pdf").alias("doc")).agg(F.max("page_count").alias("page_count")))


@query("WITH s AS (SELECT DISTINCT 'host/' || source AS id FROM sources), a AS (SELECT DISTINCT 'alias of ' || source AS alias, 'host/' || source AS id FROM sources), n AS (SELECT DISTINCT coalesce(source, '') AS name FROM manifest UNION SELECT 'alias of ' || source FROM manifest WHERE source IS NOT NULL UNION SELECT 'host/' || source FROM manifest WHERE source IS NOT NULL UNION SELECT 'nobody'), t AS (SELECT regexp_replace(id, '^.*/', '') AS tail, min(id) AS one FROM s GROUP BY 1 HAVING count(*) = 1) SELECT n.name, coalesce(s.id, a.id, t.one) AS resolved FROM n LEFT JOIN s ON s.id = n.name LEFT JOIN a ON a.alias = n.name LEFT JOIN t ON t.tail = n.name")
def s29_resolve(spark: SparkSession, sf: str) -> DataFrame:
    served = table(spark, sf, "sources").select(F.concat(F.lit("host/"), "source").alias("id")).distinct()
    aliases = table(spark, sf, "sources").select(F.concat(F.lit("alias of "), "source").alias("alias"), F.concat(F.lit("host/"), "source").alias("id")).distinct()
    m = table(spark, sf, "manifest").select("source")
    forms = F.array(F.coalesce("source", F.lit("")), F.concat(F.lit("alias of "), "source"), F.concat(F.lit("host/"), "source"), F.lit("nobody"))
    names = m.select(F.explode(forms).alias("name")).where("name is not null").distinct()
    return ingest.resolve_names(names, served, aliases)


@query("SELECT name, CASE WHEN regexp_full_match(trim(name), '[+-]?[0-9]+') THEN CAST(trim(name) AS INT) ELSE 8 END AS n, CASE WHEN name IS NULL OR trim(name) = '' THEN true ELSE lower(trim(name)) NOT IN ('0', 'false', 'no', 'off') END AS flag FROM (SELECT r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT unnest(['OFF', ' off ', '', ' ', NULL, '0', 'No', '-3', '1.5']))")
def p12_env(spark: SparkSession, sf: str) -> DataFrame:
    more = spark.createDataFrame([(x,) for x in ("OFF", " off ", "", " ", None, "0", "No", "-3", "1.5")], "name string")
    r = table(spark, sf, "region").select(F.col("r_name").alias("name")).unionAll(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string"))).unionAll(more)
    return r.select("name", ingest.env_int(F.col("name"), 8).alias("n"), ingest.env_flag(F.col("name"), True).alias("flag"))


@query("SELECT zotero_key, CASE WHEN length(zotero_key) % 2 = 0 THEN 1 ELSE 0 END AS kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || url || '/v1/', '^\\s+|\\s+$', '', 'g'), '/+$', ''), '/v1$', ''), '/+$', '') AS base, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '/+$', ''), '/v1$', ''), '/+$', '') AS plain FROM zotero_items WHERE url IS NOT NULL")
def p13_base_url(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "zotero_items").where("url is not null")
    return z.select("zotero_key", F.when(F.length("zotero_key") % 2 == 0, 1).otherwise(0).alias("kind"), T.base_url(F.concat(F.lit(" "), "url", F.lit("/v1/"))).alias("base"), T.base_url(F.col("url")).alias("plain"))


@query("SELECT id, text IS NULL OR text = '' OR starts_with(text, '[Image description unavailable') AS gone FROM chunks")
def p04_unavailable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", ingest.unavailable(F.col("text")).alias("gone"))


@query("SELECT creator, count(*) AS items FROM (SELECT unnest(creators) AS creator FROM zotero_items) GROUP BY creator")
def s15_creators(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "zotero_items").select(F.explode("creators").alias("n"))
    c = F.struct(F.split_part("n", F.lit(", "), F.lit(1)).alias("lastName"), F.when(F.contains("n", F.lit(", ")), F.substring("n", F.locate(", ", F.col("n")) + 2, F.length("n"))).otherwise(F.lit("")).alias("firstName"), F.col("n").alias("name"))
    return z.select(files.creator_name(c).alias("creator")).groupBy("creator").agg(F.count("*").alias("items"))


@query("SELECT sum(least(a.n, b.n)) AS shared FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) b ON a.k = b.k")
def u01_multiset(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey").intersectAll(li.where("l_returnflag <> 'A'").select("l_partkey")).agg(F.count("*").alias("shared"))


@query("SELECT stem, source, 'skipped' AS status FROM manifest WHERE output_path IS NOT NULL UNION ALL SELECT stem, source, 'processed' FROM manifest WHERE output_path IS NULL")
def u02_union(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest").select("stem", "source", "output_path")
    return m.where("output_path is not null").select("stem", "source", F.lit("skipped").alias("status")).unionByName(m.where("output_path is null").select("stem", F.lit("processed").alias("status"), "source"))


@query("SELECT p.pdf, count(*) AS marked FROM (SELECT DISTINCT pdf, unnest(range(1, len(page_markdowns) + 1)) AS n FROM ocr_results) p JOIN (SELECT pdf, max(page_count) AS m FROM ocr_results GROUP BY pdf) q ON p.pdf = q.pdf AND p.n <= q.m GROUP BY p.pdf")
def u07_marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "ocr_results")
    p = o.where(F.size("page_markdowns") > 0).select("pdf", F.explode(F.sequence(F.lit(1), F.size("page_markdowns"))).alias("n")).distinct()
    return p.join(o.groupBy("pdf").agg(F.max("page_count").alias("m")), "pdf").where("n <= m").groupBy("pdf").agg(F.count("*").alias("marked"))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a09_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value is not null").groupBy("event_type").agg(F.round(evaluate.weighted_mean(F.col("value"), F.col("user_id")), 6).alias("mean"))


@query("SELECT id, '![x](' || replace(replace(replace(replace(replace(url_encode(source || '_images/a b' || id || '.png'), '+', '%20'), '%2F', '/'), '%7E', '~'), '*', '%2A'), '%21', '%21') || ')' AS markdown FROM chunks")
def s20_link_images(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", F.concat(F.lit("![x](a b"), F.col("id").cast("string"), F.lit(".png)")).alias("m"), F.concat(F.lit("a b"), F.col("id").cast("string"), F.lit(".png")).alias("i"), "source")
    return c.select("id", files.link_images(F.col("m"), F.col("i"), F.col("source")).alias("markdown"))


@query("SELECT id, '![x](data:image/png;base64,' || base64(encode(text)) || ')' AS markdown FROM chunks")
def s21_embed_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", files.embed_image(F.lit("![x](i.png)"), F.lit("i.png"), F.col("text").cast("binary")).alias("markdown"))
