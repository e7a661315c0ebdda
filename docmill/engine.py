"""Whole jobs, composed of the operators: from pages to documents, chunks and an index, and back by search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import stable_id, strip_markdown, strip_page_markers
from docmill.operators import charts, chunking, clean, describe, figures, geometry, headings, ingest, lines, repair, search
from docmill.sources import zotero


class Engine:
    """Jobs over tables of pages, documents and chunks. index_path is where indexes lie."""

    def __init__(self, spark: SparkSession, index_path: str = "indexes") -> None:
        self.spark, self.index_path = spark, index_path

    def index(self, name: str) -> search.Index:
        return search.Index(self.spark, self.index_path, name)

    def indexes(self) -> DataFrame:
        return search.indexes(self.spark, self.index_path)

    def search(self, name: str, query: str, vector: list[float] | None = None, mode: str = "hybrid", k: int = 10, context: bool = False, embed: Callable | None = None) -> DataFrame:
        return self.index(name).search(query, vector, mode, k, context, embed)

    def convert(
        self, pages: DataFrame, expected: DataFrame | None = None, cleanup: bool = True, preserve_pages: bool = False, plaintext: bool = False,
        spans: DataFrame | None = None, objects: DataFrame | None = None, descriptions: DataFrame | None = None,
    ) -> DataFrame:
        """``doc``, ``markdown``, ``error``, ``warning`` of transcribed pages (doc, page_no, markdown).

        Pages are repaired and joined; with objects (figures.PAGE) figures are linked, with descriptions (doc, image_id,
        description, printed) described; with spans (font spans) unnumbered headings get levels; then the text is
        cleaned. expected (doc, page_count) names the pages that there should be: a document that lacks one has an
        error and no text. preserve_pages keeps the page markers.
        """
        fixed = repair.repair(pages.select("doc", "page_no", "markdown"), "markdown")
        counted = fixed.groupBy("doc").agg(F.count("*").alias("ocr_pages"), F.count_if(F.col("markdown").isNull()).alias("missing"))
        whole = counted if expected is None else counted.join(expected.select("doc", "page_count"), "doc", "full")
        whole = whole.select("doc", F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"), F.coalesce("missing", F.lit(0)).alias("missing"), (F.lit(None).cast("int") if expected is None else F.col("page_count")).alias("page_count"))
        joined = lines.join_pages(fixed.where("markdown is not null"), markers=True)
        if objects is not None:
            parts = figures.place_figures(lines.split_pages(lines.explode_lines(joined)), figures.find_figures(objects))
            joined = lines.implode_lines(parts, "markdown", "\n", "part_no", "text")
        if descriptions is not None:
            joined = charts.inject(joined, descriptions)
        if spans is not None:
            joined = lines.implode_lines(headings.font_levels(lines.explode_lines(joined), geometry.span_lines(spans)))
        if cleanup:
            joined = clean.clean_documents(joined)
        if not preserve_pages:
            joined = joined.withColumn("markdown", strip_page_markers(F.col("markdown")))
        if plaintext:
            joined = joined.withColumn("markdown", strip_markdown(F.col("markdown")))
        error, warning = ingest.validate(F.col("ocr_pages"), F.col("page_count"), F.col("markdown"))
        lacking = (F.col("missing") > 0) | (F.coalesce("page_count", F.lit(0)) > F.col("ocr_pages"))
        x = whole.join(joined, "doc", "left").withColumn("error", F.when(lacking, "pages missing").otherwise(error)).withColumn("warning", F.when(~lacking, warning))
        return x.select("doc", F.when(~lacking, F.col("markdown")).alias("markdown"), "error", "warning")

    def pending(self, files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
        """The files (stem, pdf_hash) to be worked on: all, or those the manifest does not hold unchanged."""
        return files if force else ingest.todo(files, manifest)

    def results(self, files: DataFrame, converted: DataFrame) -> DataFrame:
        """Every file with its output, or null where it has none: ``stem``, ``markdown``, ``status``."""
        got = converted.select(F.col("doc").alias("stem"), "markdown", "error")
        state = F.when(F.col("markdown").isNull(), F.when(F.col("error") == "pages missing", "incomplete").otherwise("failed")).when(F.col("error").isNotNull(), "failed").otherwise("done")
        return files.select("stem").join(got, "stem", "left").select("stem", "markdown", state.alias("status"))

    def enhance(self, docs: DataFrame, images: DataFrame, make: Callable[[], describe.Describer], cache: DataFrame | None = None, cleanup: bool = True) -> DataFrame:
        """Documents (doc, markdown) cleaned, and their undescribed images (doc, image_id, content) described.

        A picture is asked once by its content, whatever the number of places it stands in; failures are left out."""
        if cleanup:
            docs = clean.clean_documents(docs)
        todo = images.join(describe.undescribed(images.select("doc", "image_id"), docs), ["doc", "image_id"], "left_semi").withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
        around = todo.join(docs, "doc").withColumn("context", describe.context_window(F.col("markdown"), F.concat(F.lit("!["), F.col("image_id"), F.lit("]("), F.col("image_id"), F.lit(")"))))
        known = cache if cache is not None else self.spark.createDataFrame([], "content_hash string, description string")
        told = known.select("content_hash", "description").unionByName(describe.describe(around.select("content", "context"), known, make)).dropDuplicates(["content_hash"])
        own = todo.select("doc", "image_id", "content_hash").join(told, "content_hash").select("doc", "image_id", "description", F.lit(None).cast("string").alias("printed"))
        return charts.inject(docs, own)

    def chunk(self, docs: DataFrame, source: str | None = None, strategy: str = "recursive", size: int = 1024, embed: Callable | None = None) -> DataFrame:
        """Chunks of documents (doc, markdown) as rows of an index: with ids, sources, sections, pages and metadata."""
        c = chunking.chunk_markdown(docs, source=source, strategy=strategy, size=size, embed=embed)
        for name, value in (("section_path", F.col("section")), ("parent_id", F.lit(None).cast("string")), ("chunk_id", stable_id(F.col("source"), F.lit("chunk"), F.col("chunk_index")))):
            if name not in c.columns:
                c = c.withColumn(name, value)
        about = ["doc_title", "doc_author", "doc_year", "doc_doi", "has_figure", "has_structured_chart_data", "chart_data", "vega_lite_spec", "start_index", "end_index"]
        return c.select(
            F.xxhash64("source", "chunk_index").alias("id"), "source", "chunk_index", "chunk_id", "parent_id", "section", "section_path", "content_type", "text", "token_count", F.to_json(F.struct(*about)).alias("metadata"), "page_start", "page_end",
        )

    def build(self, name: str, docs: DataFrame, source: str | None = None, strategy: str = "recursive", size: int = 1024, embed: Callable | None = None) -> int:
        """Chunk and index documents; those without a text are left out. The number of chunks."""
        return self.index(name).ingest(self.chunk(docs.where("markdown is not null"), source, strategy, size), embed)

    def with_items(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """Documents (doc, markdown) of bibliographic items (doc, ...) under their front matter, with the name of their
        file: what the first author and year make of it where the old name begins without a letter."""
        latest = ingest.latest(items, ["doc"], "date_modified")
        front = latest.join(zotero.front_matter(latest), "zotero_key").select("doc", "front", F.concat_ws(" - ", F.nullif(zotero.first_author(F.col("creators")), F.lit("")), F.nullif(zotero.year(F.col("pub_date")), F.lit("")), "title").alias("__name"))
        x = docs.join(front, "doc", "left")
        stem = F.when(zotero.needs_new_name(F.col("doc")) & F.col("__name").isNotNull(), F.regexp_replace("__name", r'[/\\:*?"<>|]', "_")).otherwise(F.col("doc"))
        return x.select("doc", F.when(F.col("front").isNull(), F.col("markdown")).otherwise(zotero.inject(F.col("markdown"), F.col("front"))).alias("markdown"), stem.alias("stem"))
