"""Queries over the chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import search
from docmill.plans.registry import query
from docmill.session import scratch, table

_TOK = "list_filter(regexp_split_to_array(translate(lower(coalesce({0}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(phrases: list[list[str]]) -> str:
    """BM25 over text, source and section, as plain SQL: term positions by list functions."""
    cols = ("text", "source", "section")
    toks = ", ".join(f"{_TOK.format(c)} AS t{i}" for i, c in enumerate(cols))
    counts, idf, where = [], [], []
    for j, p in enumerate(phrases):
        parts = []
        for i in range(3):
            tests = " AND ".join(f"t{i}[k + {d}] = '{w}'" for d, w in enumerate(p))
            parts.append(f"len(list_filter(range(1, len(t{i}) + 1), lambda k: coalesce({tests}, false)))")
        counts.append(" + ".join(parts) + f" AS f{j}")
        where.append(f"f{j} > 0")
        idf.append(f"(CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{j} + 0.5) / (n{j} + 0.5)) END) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
    stats = ", ".join(f"count(*) FILTER (WHERE f{j} > 0) AS n{j}" for j in range(len(phrases)))
    return f"tk AS (SELECT id, {toks} FROM chunks), fr AS (SELECT id, len(t0) + len(t1) + len(t2) AS dl, {', '.join(counts)} FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM fr), bm AS (SELECT id, {' + '.join(idf)} AS score FROM fr, st WHERE {' AND '.join(where)})"


QUERY = "statistical payload"
PHRASE = "page-level"
P1, P2 = search.phrases_of(QUERY), search.phrases_of(PHRASE)


@query(f"WITH {_bm25_sql(P1)} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def r02_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(search.bm25(table(spark, sf, "chunks"), P1), 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(P2)} SELECT id, round(score, 6) AS score FROM bm")
def r02_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "chunks"), P2).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(P1 + P2)} SELECT id, round(score, 6) AS score FROM bm")
def r02_postings(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "postings")
    search.build_postings(table(spark, sf, "chunks"), path, buckets=16)
    return search.bm25_postings(spark, path, P1 + P2).select("id", F.round("score", 6).alias("score"))


#: A fixed query vector of the width of the index.
VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_V = "[" + ", ".join(map(str, VECTOR)) + "]"
_COS = f"sc AS (SELECT id, list_sum(list_transform(list_zip(embedding, {_V}), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e))) * sqrt(list_sum(list_transform({_V}, lambda e: CAST(e AS DOUBLE) * e))) + 1e-8) AS score FROM chunks WHERE len(embedding) = 64), sm AS (SELECT id, score FROM sc WHERE score IS NOT NULL AND NOT isnan(score))"


@query(f"WITH {_COS} SELECT id, round(score, 6) AS score FROM sm")
def r03_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return search.semantic(table(spark, sf, "chunks"), VECTOR).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT id, round(score, 6) AS score FROM sm ORDER BY sm.score DESC, id LIMIT 20")
def r03_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(search.semantic(table(spark, sf, "chunks"), VECTOR), 20).select("id", F.round("score", 6).alias("score"))


_LISTS = f"{_bm25_sql(P1)}, {_COS}, tx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk, 'text' AS method, 0 AS ln FROM bm QUALIFY rk <= 20), se AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk, 'semantic' AS method, 1 AS ln FROM sm QUALIFY rk <= 20), li AS (SELECT * FROM tx UNION ALL SELECT * FROM se), fu AS (SELECT id, sum(1.0::DOUBLE / (60 + rk)) AS rrf, string_agg(method, '+' ORDER BY ln) AS method, min((ln, rk)) AS fst FROM li GROUP BY id)"


@query(f"WITH {_LISTS} SELECT id, method, round(rrf, 6) AS rrf_score FROM fu")
def r05_rrf_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    both = search.ranked(search.bm25(c, P1), 20, "text", 0).unionByName(search.ranked(search.semantic(c, VECTOR), 20, "semantic", 1))
    return search.fuse(both).select("id", "method", F.round("rrf_score", 6).alias("rrf_score"))


_W = "CASE content_type WHEN 'abstract' THEN 1.5 WHEN 'figure' THEN 1.3 WHEN 'frontmatter' THEN 0.7 WHEN 'references' THEN 0.5 ELSE 1.0 END"


@query(f"WITH {_LISTS} SELECT fu.id, method, round(rrf, 6) AS rrf_score, round(rrf * {_W}, 6) AS weighted_score FROM fu JOIN chunks ON fu.id = chunks.id ORDER BY rrf * {_W} DESC, rrf DESC, fst, fu.id LIMIT 10")
def r04_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    x = search.hybrid(table(spark, sf, "chunks"), P1, VECTOR, 10)
    return x.select("id", "method", F.round("rrf_score", 6).alias("rrf_score"), F.round("weighted_score", 6).alias("weighted_score"))


@query(f"SELECT id, CAST({_W} AS DOUBLE) AS weight FROM chunks")
def r06_weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", search.weight(F.col("content_type")).alias("weight"))


@query("WITH l AS (SELECT source, chunk_index, arg_max(text, id) AS text FROM chunks GROUP BY ALL) SELECT c.id, coalesce(b.text, '') AS context_before, coalesce(a.text, '') AS context_after FROM chunks c LEFT JOIN l b ON b.source = c.source AND b.chunk_index = c.chunk_index - 1 LEFT JOIN l a ON a.source = c.source AND a.chunk_index = c.chunk_index + 1")
def j07_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.neighbours(c.select("id", "source", "chunk_index"), c).select("id", "context_before", "context_after")


_HITS = f"WITH {_bm25_sql(P2)}, hits AS (SELECT c.id, source, parent_id, chunk_index FROM bm JOIN chunks c ON bm.id = c.id)"


@query(_HITS + ", x AS (SELECT h.id, c.text, row_number() OVER (PARTITION BY h.id ORDER BY abs(c.chunk_index - h.chunk_index), c.chunk_index, c.id) AS n FROM hits h JOIN chunks c ON c.source = h.source AND c.parent_id = h.parent_id AND c.id <> h.id WHERE coalesce(h.parent_id, '') <> '') SELECT hits.id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n), '') AS section_context FROM hits LEFT JOIN x ON x.id = hits.id AND n <= 4 GROUP BY hits.id")
def j08_section_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.section_context(search.bm25(c, P2).join(c, "id").select("id", "source", "parent_id", "chunk_index"), c)


@query(_HITS + ", x AS (SELECT h.id, c.text, row_number() OVER (PARTITION BY h.id ORDER BY c.chunk_index, c.id) AS n FROM hits h JOIN chunks c ON c.source = h.source AND c.parent_id = h.parent_id AND c.content_type = 'figure' WHERE coalesce(h.parent_id, '') <> '') SELECT hits.id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n), '') AS figure_context FROM hits LEFT JOIN x ON x.id = hits.id AND n <= 3 GROUP BY hits.id")
def j09_figure_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.figure_context(search.bm25(c, P2).join(c, "id").select("id", "source", "parent_id", "chunk_index"), c)


@query("SELECT source, grouping(source) = 1 AS is_total, count(*) AS chunk_count FROM chunks GROUP BY ROLLUP (source)")
def r08_list_indexes(spark: SparkSession, sf: str) -> DataFrame:
    return search.list_indexes(table(spark, sf, "chunks"))


@query("WITH n AS (SELECT id + 1000000 AS id, source, text FROM chunks WHERE source LIKE '%a%'), o AS (SELECT id, source, text FROM chunks) SELECT id, source, text FROM o WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT id, source, text FROM n")
def r01_replace_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "source", "text")
    return search.replace_by_source(c, c.where("source like '%a%'").withColumn("id", F.col("id") + 1000000))


@query("WITH m AS (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS j FROM chunks) SELECT id, coalesce(nullif(chunk_id, ''), json_extract_string(j, '$.chunk_id'), '') AS chunk_id, coalesce(nullif(parent_id, ''), json_extract_string(j, '$.parent_id'), '') AS parent_id, coalesce(nullif(section_path, ''), json_extract_string(j, '$.section_path'), '') AS section_path, coalesce(nullif(content_type, ''), json_extract_string(j, '$.content_type'), '') AS content_type FROM m")
def r10_result_columns(spark: SparkSession, sf: str) -> DataFrame:
    return search.result_columns(table(spark, sf, "chunks")).drop("doc_year")


@query(f"WITH tk AS (SELECT id, {_TOK.format('text')} AS t FROM chunks), x AS (SELECT unnest(t) AS term, id FROM tk) SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM x GROUP BY term")
def a15_corpus_terms(spark: SparkSession, sf: str) -> DataFrame:
    p = search.postings(table(spark, sf, "chunks"), ("text",))
    return p.groupBy("id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e)), 4) AS sq FROM embeddings")
def r03_norms(spark: SparkSession, sf: str) -> DataFrame:
    sq = F.aggregate(F.transform("embedding", lambda e: e.cast("double") * e), F.lit(0.0), lambda s, e: s + e)
    return table(spark, sf, "embeddings").select("vec_id", "label", F.round(sq, 4).alias("sq"))


def _toy_embedder(texts: list[str]) -> list[list[float]]:
    """Lengths and letters as a vector, for use without a model."""
    return [[float(len(t)), float(t.count("e")), float(t.count("a")), float(t.count(" "))] for t in texts]


_EMBEDDED = "[length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, ' ', ''))]"


@query(f"SELECT id, source, CAST(list_sum({_EMBEDDED}) AS BIGINT) AS total FROM chunks WHERE source NOT LIKE '%a%' UNION ALL SELECT id + 1000000, source, CAST(list_sum({_EMBEDDED}) AS BIGINT) FROM chunks WHERE source LIKE '%a%'")
def r01_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Sources are ingested, some of them again; every row is embedded on the way in."""
    c = table(spark, sf, "chunks").drop("embedding", "metadata")
    ix = search.Index(spark, scratch(spark, "index"), "lib")
    ix.ingest(c, _toy_embedder)
    ix.ingest(c.where("source like '%a%'").withColumn("id", F.col("id") + 1000000), _toy_embedder)
    return ix.chunks().select("id", "source", F.aggregate(F.transform("embedding", lambda e: e.cast("long")), F.lit(0).cast("long"), lambda s, e: s + e).alias("total"))


@query(f"WITH {_bm25_sql(P1)} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def r02_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Text search of an index that was written in two goes, over its postings."""
    c = table(spark, sf, "chunks").select("id", "source", "section", "text")
    ix = search.Index(spark, scratch(spark, "index"), "lib")
    ix.ingest(c.where("source like '%a%'"))
    ix.ingest(c.where("source not like '%a%'"))
    return search.top(ix.text_search(P1), 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT n AS index_name, source, grouping(source) = 1 AS is_total, count(*) AS chunk_count FROM (SELECT 'even' AS n, source FROM chunks WHERE id % 2 = 0 UNION ALL SELECT 'odd', source FROM chunks WHERE id % 2 = 1) GROUP BY GROUPING SETS ((n, source), (n))")
def r08_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Two indexes in one folder that hold all chunks between them."""
    c = table(spark, sf, "chunks").select("id", "source", "section", "text")
    path = scratch(spark, "indexes")
    for n, name in enumerate(("even", "odd")):
        search.Index(spark, path, name).ingest(c.where(F.col("id") % 2 == n))
    return search.indexes(spark, path)
