"""Files in, files out."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import percent_encode
from docmill.operators.ingest import exclude_names


def pdf_files(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``path``, ``pdf_hash``, ``content`` of the PDF files of a folder and its folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    found = exclude_names(raw, list(exclude))
    return found.select("path", F.sha2("content", 256).alias("pdf_hash"), "content")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id``, ``content`` of the pictures of a folder."""
    raw = spark.read.format("binaryFile").load(folder)
    name = F.regexp_replace("path", "^.*/", "")
    return raw.where(F.lower(name).rlike(r"\.(png|jpe?g|gif|bmp|webp|tiff?)$")).select(name.alias("image_id"), "content")


def zotero_items(spark: SparkSession, path: str) -> DataFrame:
    """Bibliographic items of dumped API replies (one JSON object a line)."""
    creator = "struct<lastName:string,firstName:string,name:string>"
    data = f"data struct<key:string,itemType:string,title:string,date:string,DOI:string,abstractNote:string,url:string,publicationTitle:string,creators:array<{creator}>,tags:array<struct<tag:string>>,collections:array<string>,dateModified:string>"
    x = spark.read.schema(data).json(path).select("data.*")
    return x.select(
        F.col("key").alias("zotero_key"), F.col("itemType").alias("item_type"), "title", F.col("date").alias("pub_date"), F.col("DOI").alias("doi"), F.col("abstractNote").alias("abstract"), "url",
        F.col("publicationTitle").alias("publication"), F.transform("creators", creator_name).alias("creators"), F.transform("tags", lambda t: t["tag"]).alias("tags"), "collections", F.to_timestamp("dateModified").alias("date_modified"),
    )


def creator_name(c: Column) -> Column:
    """'Last, First', 'Last' or the single name."""
    last, first = F.coalesce(c["lastName"], F.lit("")), F.coalesce(c["firstName"], F.lit(""))
    return F.when((last != "") & (first != ""), F.concat(last, F.lit(", "), first)).when(last != "", last).otherwise(F.coalesce(c["name"], F.lit("")))


class Transcriber(Protocol):
    """Turns one page picture into text; raises on failure."""

    def __call__(self, png: bytes, hint: str | None) -> str: ...


def transcribe(pages: DataFrame, make: Callable[[], Transcriber], concurrency: int = 8) -> DataFrame:
    """``doc``, ``page_no``, ``markdown``, ``error`` of page pictures (doc, page_no, png, text_layer).

    One transcriber per task, at most `concurrency` tasks; a failed page is a row with an error, never a
    failed stage. Pages already cached should be taken out before (ingest.cache_todo).
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            rows = []
            for doc, no, png, hint in zip(pdf["doc"], pdf["page_no"], pdf["png"], pdf["text_layer"]):
                try:
                    rows.append((doc, no, ask(png, hint), None))
                except Exception as e:  # noqa: BLE001  (the row carries it)
                    rows.append((doc, no, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "page_no", "markdown", "error"])

    doc = pages.schema["doc"].dataType.simpleString()
    return pages.select("doc", "page_no", "png", "text_layer").repartition(concurrency).mapInPandas(run, f"doc {doc}, page_no int, markdown string, error string")


def with_retry(call: Callable[[], str], retries: int = 3, base: float = 2.0, jitter: float = 1.0, sleep: Callable[[float], None] | None = None) -> str:
    """call(), again after growing waits while the failure is one that can pass."""
    import random
    import time

    for n in range(retries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            status = getattr(e, "status_code", None) or getattr(getattr(e, "response", None), "status_code", None)
            again = isinstance(e, ConnectionError | TimeoutError) or (status is not None and (status == 429 or status >= 500)) or any(k in type(e).__name__ for k in ("Timeout", "Connect"))
            if n == retries or not again:
                raise
            (sleep or time.sleep)(base * 2**n + random.uniform(0, jitter))
    raise AssertionError


def write_atomic(path: str, data: str | bytes) -> None:
    """A file that is either the old or the new one, never half; on mounted folders."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def _write_files(df: DataFrame, folder: str, name: Column, data: Column) -> int:
    """One file per row, each written whole by its task through the file system of the folder; how many."""
    rows = df.select(name.alias("name"), data.cast("binary").alias("data"))
    if folder.startswith("file:") or "://" not in folder:
        root = folder.removeprefix("file://")

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for n, d in zip(b.column("name").to_pylist(), b.column("data").to_pylist()):
                    path = os.path.join(root, n)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    write_atomic(path, d or b"")
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    else:

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyarrow import fs

            target, root = fs.FileSystem.from_uri(folder)  # object stores put a file in place as a whole
            for b in batches:
                for n, d in zip(b.column("name").to_pylist(), b.column("data").to_pylist()):
                    with target.open_output_stream(f"{root}/{n}") as f:
                        f.write(d or b"")
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_documents(docs: DataFrame, folder: str, name: str = "stem", text: str = "markdown", suffix: str = ".md") -> int:
    """One file per document in a shared folder or an object store; the number written. A null text is an empty file."""
    return _write_files(docs, folder, F.concat(F.col(name), F.lit(suffix)), F.coalesce(F.col(text), F.lit("")))


def write_images(images: DataFrame, folder: str) -> int:
    """Pictures (stem, image_id, content) under <stem>_images; names without suffix are PNG. The number written."""
    return _write_files(images, folder, F.concat("stem", F.lit("_images/"), image_file(F.col("image_id"))), F.col("content"))


def write_json(rows: DataFrame, folder: str, name: str = "stem", value: str = "value") -> int:
    """One JSON file per row, of a struct, map or array column."""
    return _write_files(rows, folder, F.concat(F.col(name), F.lit(".json")), F.to_json(F.col(value), {"pretty": "true"}))


def images_out(docs: DataFrame, images: DataFrame, extract: bool, embed: bool) -> DataFrame:
    """Documents (stem, markdown) with references to images (stem, image_id, content) linked to their files or turned
    into data; extracting goes before embedding, and without either documents stay as they are."""
    if not extract and not embed:
        return docs
    own = images.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("image_id", *([] if extract else ["content"])))).alias("__i"))

    def step(text: Column, i: Column) -> Column:
        return link_images(text, i["image_id"], F.col("stem")) if extract else embed_image(text, i["image_id"], i["content"])

    x = docs.join(own, "stem", "left")
    return x.withColumn("markdown", F.when(F.col("__i").isNull(), F.col("markdown")).otherwise(F.aggregate("__i", F.col("markdown"), step))).drop("__i")


def image_file(image_id: Column) -> Column:
    return F.when(image_id.rlike(r"\.[A-Za-z0-9]+$"), image_id).otherwise(F.concat(image_id, F.lit(".png")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def link_images(markdown: Column, image_id: Column, stem: Column) -> Column:
    """An image reference turned into the percent-encoded path of its file; names without suffix are PNG."""
    path = percent_encode(F.concat(stem, F.lit("_images/"), image_file(image_id)))
    return F.replace(markdown, F.concat(F.lit("]("), image_id, F.lit(")")), F.concat(F.lit("]("), path, F.lit(")")))


def embed_image(markdown: Column, image_id: Column, content: Column) -> Column:
    """An image reference turned into a data address."""
    ext = F.lower(F.regexp_extract(image_id, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "jpg", "jpeg").when(ext == "", "png").otherwise(ext)
    data = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    return F.replace(markdown, F.concat(F.lit("]("), image_id, F.lit(")")), F.concat(F.lit("](data:image/"), kind, F.lit(";base64,"), data, F.lit(")")))
