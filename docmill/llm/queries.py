"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.markup import residue

    parts = [
        residue(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("record_table"), F.col("id").cast("long").alias("record_id"))
        for name, key, text in (("chunks", "id", "text"), ("ocr_results", "ocr_id", "markdown"))
    ]
    return parts[0].unionByName(parts[1]).where("record_id is not null").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.markup import clean_documents

    parts = [
        clean_documents(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("record_table"), F.col("id").cast("long").alias("record_id"), "clean_text", "residue_blocks")
        for name, key, text in (("chunks", "id", "text"), ("ocr_results", "ocr_id", "markdown"))
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.names import link_names, name_pairs, names_of

    return name_pairs(link_names(names_of(table(spark, sf_dir, "zotero_items"))))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.names import link_names, names_of

    return link_names(names_of(table(spark, sf_dir, "zotero_items")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.neighbors import nearest, neighbor_pairs

    return neighbor_pairs(nearest(table(spark, sf_dir, "chunks"), least=0.85))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.splitting import split_oversized

    pieces = split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))
    return pieces.where("piece_no = 0").select("id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.splitting import split_oversized

    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.ocr_noise import repair_pages

    found = repair_pages(table(spark, sf_dir, "ocr_results"), kinds_only=True)
    return found.where("id is not null").select(F.col("id").cast("long").alias("ocr_id"), "page_no", F.explode("noise").alias("noise")).distinct()


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.ocr_noise import repair_pages

    return repair_pages(table(spark, sf_dir, "ocr_results"), text_col="markdown").select(F.col("id").alias("ocr_id"), "page_no", "noise", "paragraphs")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.near_dup import near_duplicates, pairs_written_out

    return pairs_written_out(*near_duplicates(table(spark, sf_dir, "chunks"), k=3, threshold=0.6))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.near_dup import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "chunks"), k=3, threshold=0.6)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.packing import packing_report

    return packing_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_containers"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.mixing import mix_sources, mixture_shares

    return mixture_shares(*mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.spam import spam_pages

    return spam_pages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


#: Brute force over whole tables. p3_found is exact where its probes cover all leaves, as they do on small tables.
_SQL = {
    "p3_found": """WITH u AS (SELECT id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM chunks
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.id <> b.id),
t AS (SELECT a, b FROM s WHERE sim >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 7) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t""",
    "p4_found": "SELECT DISTINCT c.id FROM chunks c JOIN chunk_limits l ON c.content_type = l.content_type WHERE len(regexp_extract_all(c.text, '[^ \\t\\r\\n]+')) > l.max_tokens",
    "p6_found": """WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM chunks),
g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b FROM s JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k >= 0.6 * (p.n + q.n - k) - 1e-9""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
