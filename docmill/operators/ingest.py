"""Relational steps of ingestion: skips, stems, upserts, validation, run state, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import strip

#: Characters a page has on average at least, in output that passes validation.
LEAST_CHARS = 20
#: Statuses of a reply that are worth another try; fixed values.
RETRY_STATUS = (429, 500, 502, 503, 504)
UNAVAILABLE = "[Image description unavailable"


def exclude_names(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """PDF files without those whose name holds a pattern, in any case."""
    name = F.lower(F.regexp_replace(path, "^.*/", ""))
    keep = name.endswith(".pdf")
    for p in patterns:
        keep = keep & ~F.contains(name, F.lit(p.lower()))
    return files.where(keep)


def todo(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (stem, pdf_hash) that the manifest does not hold with the same hash and an output."""
    done = manifest.where("output_path is not null").select("stem", "pdf_hash")
    return files.join(done, ["stem", "pdf_hash"], "left_anti")


def backlog(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files whose stem has no output, whatever its hash."""
    return files.join(outputs.select("stem").distinct(), "stem", "left_anti")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; equal stamps are told apart by the whole row."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose keys new does not hold."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def output_stems(files: DataFrame, path: str = "path", content_hash: str = "pdf_hash") -> DataFrame:
    """``path``, ``out_stem``: file name stems made unique.

    Files of one name and content share a stem. Of different contents the first (by path) keeps the name,
    the next takes its folder's name in brackets, and where that is taken too, the start of its hash.
    """
    x = files.select(F.col(path).alias("path"), F.col(content_hash).alias("hash"))
    x = x.withColumn("stem", F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")).withColumn("folder", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    first = Window.partitionBy("stem").orderBy("path")
    x = x.withColumn("kept", F.first("hash").over(first))
    x = x.withColumn("second", F.concat("stem", F.lit(" ("), "folder", F.lit(")")))
    by_folder = Window.partitionBy("second", F.col("hash") == F.col("kept")).orderBy("path")
    x = x.withColumn("kept2", F.first("hash").over(by_folder))
    third = F.concat("stem", F.lit(" ("), F.substring("hash", 1, 8), F.lit(")"))
    return x.select("path", F.when(F.col("hash") == F.col("kept"), F.col("stem")).when(F.col("hash") == F.col("kept2"), F.col("second")).otherwise(third).alias("out_stem"))


def validate(ocr_pages: Column, expected: Column, text: Column) -> tuple[Column, Column]:
    """(error, warning) of a transcription; null where there is none."""
    n = F.length(strip(F.coalesce(text, F.lit(""))))
    pages = F.coalesce(F.when(ocr_pages > 0, ocr_pages), F.when(expected > 0, expected), F.lit(1))
    error = F.when(ocr_pages == 0, "no pages").when(n < LEAST_CHARS * pages, "too little text")
    warning = F.when(error.isNull() & ocr_pages.isNotNull() & expected.isNotNull() & (ocr_pages != expected), "page count differs")
    return error, warning


def complete(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """``doc``, ``complete``: whether every page of a document has a text."""
    got = pages.where("markdown is not null").groupBy("doc").agg(F.count_distinct("page_no").alias("n"))
    return expected.join(got, "doc", "left").select("doc", (F.coalesce("n", F.lit(0)) == F.col("page_count")).alias("complete"))


def run_state(rows: DataFrame) -> DataFrame:
    """One row: total, counts by status, remaining and the names that failed."""
    def n(s: str) -> Column:
        return F.count(F.when(F.col("status") == s, 1))

    x = rows.agg(F.count("*").alias("total"), *[n(s).alias(s) for s in ("done", "skipped", "incomplete", "failed")], F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.col("name")))).alias("failures"))
    return x.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("skipped") - F.col("incomplete") - F.col("failed")))


def batch_results(outputs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Outputs of a remote batch joined to what was uploaded: status 200 only, pages joined in order."""
    ok = outputs.where("status_code = 200").select("custom_id", F.posexplode("pages").alias("i", "page"))
    parts = F.array_sort(F.collect_list(F.struct("i", "page")))
    text = ok.groupBy("custom_id").agg(F.array_join(F.transform(parts, lambda s: s["page"]), "\n\n").alias("markdown"), F.count("*").alias("page_count"))
    return uploads.join(text, "custom_id")


def vision_results(results: DataFrame, sep: str = "::") -> DataFrame:
    """Results keyed by 'stem::image' as stem, image_id, description."""
    p = F.split("custom_id", sep, 2)
    return results.select(p[0].alias("stem"), p[1].alias("image_id"), "description")


def cache_todo(pages: DataFrame, cache: DataFrame, meta: list[str]) -> DataFrame:
    """Pages that a cache of the same settings does not hold."""
    return pages.join(cache.where("markdown is not null"), [*meta, "page_index"], "left_anti")


def base64_bytes(text: Column) -> Column:
    """Decoded bytes of a base64 text, a data address' head and foreign characters set aside; null if that fails."""
    body = F.regexp_replace(F.when(F.contains(text, F.lit(",")), F.substring_index(text, ",", -1)).otherwise(text), "[^A-Za-z0-9+/=]", "")
    return F.when(F.length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64")))


def resolve_names(names: DataFrame, served: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name``, ``resolved``: the served id itself, else by alias, else the one id that ends in the name."""
    tail = served.withColumn("tail", F.regexp_replace("id", "^.*/", "")).groupBy("tail").agg(F.count("*").alias("n"), F.min("id").alias("one")).where("n = 1")
    x = names.join(served.select(F.col("id").alias("name"), F.col("id").alias("exact")), "name", "left")
    x = x.join(aliases.select(F.col("alias").alias("name"), F.col("id").alias("by_alias")), "name", "left")
    x = x.join(tail.select(F.col("tail").alias("name"), "one"), "name", "left")
    return x.select("name", F.coalesce("exact", "by_alias", "one").alias("resolved"))


def only_served(served: DataFrame, configured: str | None = None) -> DataFrame:
    """``model``: the configured one, else the one that is served alone, else null."""
    return served.agg(F.count("*").alias("n"), F.min("id").alias("id")).select(F.coalesce(F.lit(configured), F.when(F.col("n") == 1, F.col("id"))).alias("model"))


def env_int(text: Column, default: int) -> Column:
    return F.coalesce(strip(text).try_cast("int"), F.lit(default))


def env_flag(text: Column, default: bool) -> Column:
    """False for 0, false, no and off; the default where nothing is set."""
    t = F.lower(strip(text))
    return F.when(text.isNull() | (t == ""), F.lit(default)).otherwise(~t.isin("0", "false", "no", "off"))


def unavailable(description: Column) -> Column:
    return description.isNull() | (description == "") | F.startswith(description, F.lit(UNAVAILABLE))


def description_cache(found: DataFrame) -> DataFrame:
    """``doc``, ``image_descriptions``: descriptions by the start of the content's hash, failures left out."""
    x = found.where(~unavailable(F.col("description"))).select("doc", F.substring(F.sha2("content", 256), 1, 16).alias("k"), "description")
    return x.groupBy("doc", "k").agg(F.max("description").alias("v")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("image_descriptions"))


def retryable(status: Column, name: Column) -> Column:
    """Whether a failure is worth another try, by its status or the name of its class."""
    return F.coalesce(status.isin(*RETRY_STATUS) | (status >= 500), F.lit(False)) | F.coalesce(name.rlike("Timeout|Connect"), F.lit(False))


def lookup(rows: DataFrame, known: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """rows with the value that known has for their keys (one row each), or a default; null keys have none."""
    return rows.join(known.select(*keys, value), keys, "left").fillna({value: default})


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps as one; of keys that both hold the right one's value counts. Null maps count as empty ones."""
    only = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(only, right))
