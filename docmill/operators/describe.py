"""Figures and their descriptions: what to ask, what came back, and where it goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import strip
from docmill.operators.ingest import UNAVAILABLE, unavailable


def split_data(description: Column) -> tuple[Column, Column]:
    """(prose, data) of a description: data is what follows a line 'DATA:'; empty if there is none."""
    m = F.split(description, r"(?mi)^\s*\**DATA:\**\s*", 2)
    return strip(m[0]), F.coalesce(strip(F.get(m, F.lit(1))), F.lit(""))


def context_window(text: Column, image_ref: Column, reach: int = 500) -> Column:
    """What stands up to `reach` characters around an image, image references in it as [IMAGE]."""
    at = F.locate("\x01", F.replace(text, image_ref, F.concat(F.lit("\x01"), image_ref)))
    start = F.greatest(at - reach, F.lit(1))
    cut = F.substring(text, start, F.least(at - 1, F.lit(reach)) + F.length(image_ref) + reach)
    return F.when(at > 0, F.regexp_replace(cut, r"!\[[^\]]*\]\([^)]*\)", "[IMAGE]"))


def undescribed(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Images (doc, image_id) that no description follows in their document (doc, markdown)."""
    stem = F.regexp_replace("image_id", r"\.[^.]*$", "")
    x = images.join(docs, "doc")
    seen = F.rlike("markdown", F.concat(F.lit(r"(?s)\Q"), stem, F.lit(r"\E[^)\n]*\)\s*\n>\s*\*\*Figure description:\*\*")))
    return x.where(~seen).select("doc", "image_id")


def strip_generated(lines: DataFrame) -> DataFrame:
    """Lines without hidden comments, image references and description blocks."""
    x = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"<!--.*?-->", ""), r"!\[[^\]]*\]\([^)]*\)", ""))
    return x.where(~F.startswith("line", F.lit(">")))


def reply_text(reply: Column) -> Column:
    """The text of a chat reply (JSON), whose content is a string or a list of typed parts."""
    # as a variant the content keeps its kind: a text that begins with a bracket is no list
    content = F.try_variant_get(F.try_parse_json(reply), "$.choices[0].message.content", "variant")
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), joined).otherwise(F.try_variant_get(content, "$", "string"))


def requests(images: DataFrame, cache: DataFrame) -> DataFrame:
    """``content_hash``, ``content``, ``context`` of what is to be asked: each picture (content, context) once, and none
    that the cache (content_hash, description) holds an answer for."""
    known = cache.where(~unavailable(F.col("description"))).select("content_hash").distinct()
    keyed = images.withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16)).dropDuplicates(["content_hash"])
    return keyed.join(known, "content_hash", "left_anti").select("content_hash", "content", "context")


class Describer(Protocol):
    """Describes one picture in its context; raises on failure."""

    def __call__(self, content: bytes, context: str | None) -> str: ...


def describe(images: DataFrame, cache: DataFrame, make: Callable[[], Describer], concurrency: int = 8) -> DataFrame:
    """``content_hash``, ``description`` of images (content, context) that the cache does not hold.

    Pictures are asked once by content, whatever the number of documents they stand in; a failure is a
    placeholder, which is asked again next time.
    """
    import pandas as pd

    todo = requests(images, cache)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            out = []
            for h, content, context in zip(pdf["content_hash"], pdf["content"], pdf["context"]):
                try:
                    out.append((h, ask(content, context)))
                except Exception as e:  # noqa: BLE001  (the row carries it)
                    out.append((h, f"{UNAVAILABLE}: {type(e).__name__}]"))
            yield pd.DataFrame(out, columns=["content_hash", "description"])

    return todo.repartition(concurrency).mapInPandas(run, "content_hash string, description string")
