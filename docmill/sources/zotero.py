"""Bibliographic items as front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year(pub_date: Column) -> Column:
    """The first year from 1000 to 2999 in a date of any form; '' without one."""
    return F.coalesce(F.regexp_extract(pub_date, r"(?<![0-9])([12][0-9]{3})(?![0-9])", 1), F.lit(""))


def first_author(creators: Column) -> Column:
    """The surname of the first creator; '' without one."""
    return F.coalesce(F.split_part(F.get(creators, F.lit(0)), F.lit(","), F.lit(1)), F.lit(""))


def front_matter(items: DataFrame) -> DataFrame:
    """``zotero_key``, ``front``: the item as a block between dashes; null and empty fields are left out."""
    def field(name: str, value: Column, quoted: bool = True) -> Column:
        shown = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("'")), F.lit('"')) if quoted else value
        return F.when(value != "", F.concat(F.lit(f"{name}: "), shown))

    authors = F.concat(F.lit("["), F.array_join("creators", "; "), F.lit("]"))
    parts = [
        F.lit("---"), field("title", F.col("title")), F.when(F.size("creators") > 0, F.concat(F.lit("authors: "), authors)), field("year", year(F.col("pub_date"))), field("doi", F.col("doi")),
        field("publication", F.col("publication")), F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]"))), F.lit("---"),
    ]
    return items.select("zotero_key", F.concat_ws("\n", *parts).alias("front"))


def inject(markdown: Column, front: Column) -> Column:
    """A document under its front matter, unless it has one."""
    return F.when(F.startswith(markdown, F.lit("---\n")), markdown).otherwise(F.concat(front, F.lit("\n\n"), markdown))


def needs_new_name(stem: Column) -> Column:
    """Whether a file name starts without a letter in its first three characters."""
    return ~F.substring(stem, 1, 3).rlike("[A-Za-z]")


def find_collection(collections: DataFrame, name: str) -> DataFrame:
    """The first collection (group_no, name, ...) of that name in any case; no row without one."""
    return collections.where(F.lower("name") == name.lower()).orderBy("group_no", "name").limit(1)


def find_group(groups: DataFrame, wanted: str) -> DataFrame:
    """Groups (id, name) by number, or by name in any case."""
    return groups.where(F.col("id") == int(wanted)) if wanted.isdigit() else groups.where(F.lower("name") == wanted.lower())
