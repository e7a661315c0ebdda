"""Scores of converted documents."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import strip, words


def word_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(F.col(doc).alias("doc"), F.explode(words(F.col(text))).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


def text_scores(truth: DataFrame, output: DataFrame) -> DataFrame:
    """``doc``, ``recall``, ``precision``: shared words, as multisets. truth, output: doc, word, n."""
    t = truth.groupBy("doc").agg(F.sum("n").alias("nt"))
    o = output.groupBy("doc").agg(F.sum("n").alias("no"))
    both = truth.join(output.withColumnRenamed("n", "m"), ["doc", "word"]).groupBy("doc").agg(F.sum(F.least("n", "m")).alias("both"))
    x = t.join(o, "doc", "left").join(both, "doc", "left").fillna(0)
    return x.select("doc", (F.col("both") / F.col("nt")).alias("recall"), F.when(F.col("no") > 0, F.col("both") / F.col("no")).otherwise(0.0).alias("precision"))


def order_similarity(truth: str, output: str) -> float:
    """How much of the words' order is kept, by matching blocks."""
    import re

    a, b = (re.findall(r"[a-z0-9]{2,}", s.lower().replace("-\n", ""))[:n] for s, n in ((truth, 6000), (output, 8000)))
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return sum(x.size for x in m.get_matching_blocks()) / max(1, len(a))


def tables(lines: DataFrame) -> DataFrame:
    """``doc``, ``tables``, ``cells`` of runs of bar lines that hold a separator row."""
    s = strip(F.col("line"))
    x = lines.select("doc", "line_no", s.alias("s")).withColumn("bar", F.col("s").rlike(r"^\|.*\|$"))
    w = Window.partitionBy("doc").orderBy("line_no")
    x = x.withColumn("g", F.sum((~F.col("bar")).cast("int")).over(w)).where("bar")
    x = x.withColumn("sep", F.col("s").rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")).withColumn("n", F.length(F.regexp_replace("s", r"[^|]", "")) - 1)
    run = x.groupBy("doc", "g").agg(F.max("sep").alias("is"), F.sum(F.when(~F.col("sep"), F.col("n")).otherwise(0)).alias("cells")).where(F.col("is"))
    return run.groupBy("doc").agg(F.count("*").alias("tables"), F.sum("cells").alias("cells"))


def counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Figures, described figures, chart comments and formula spans of a document."""
    t = F.col(text)
    n = lambda p: F.regexp_count(t, F.lit(p))
    return df.select(F.col(doc).alias("doc"), n(r"!\[[^\]]*\]\([^)]+\)").alias("figures"), n(r"\*\*Figure description:\*\*").alias("described"), n("<!-- chart-data:").alias("charts"), n(r"\$[^$\n]+\$").alias("latex"))


def leaked(lines: DataFrame) -> DataFrame:
    """``doc``, ``leaked``: lines of a description that lost their quote mark, up to the next blank line."""
    s = strip(F.col("line"))
    w = Window.partitionBy("doc").orderBy("line_no")
    x = lines.withColumn("s", s)
    state = F.when(F.contains("s", F.lit("**Figure description:**")), 1).when(F.col("s") == "", 0)
    x = x.withColumn("inside", F.coalesce(F.last(state, True).over(w), F.lit(0)))
    return x.groupBy("doc").agg(F.count(F.when((F.col("inside") == 1) & (F.col("s") != "") & ~F.startswith("s", F.lit(">")), 1)).alias("leaked"))


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page_no, markdown) that stand alike in another document too; blank ones are left out."""
    x = pages.where(F.col("markdown").rlike(r"\S")).withColumn("__h", F.sha2("markdown", 256))
    often = x.groupBy("__h").agg(F.count_distinct("doc").alias("n")).where("n > 1").select("__h")
    return x.join(often, "__h", "left_semi").drop("__h")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight; null without any weight."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w > 0, F.sum(value * weight) / w)


def heading_match(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``doc``, ``recall``, ``hierarchy`` of headings: truth (doc, seq, text, depth), found (doc, line_no, text, level).

    In order, each truth takes the next heading whose first four words are equal; hierarchy is the share of
    neighbouring matches that step up, down or stay alike, 1 without any. The match is a fold over the headings of
    one document.
    """
    key = F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""), 1, 4), " ")
    t = truth.select("doc", "seq", key.alias("k"), "depth").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "k", "depth"))).alias("t"))
    f = found.select("doc", "line_no", key.alias("k"), "level").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "k", "level"))).alias("f"))
    state = "struct<at:int,hits:array<struct<depth:int,level:int>>>"

    def step(s: Column, h: Column) -> Column:
        rest = F.slice(F.col("f"), s["at"] + 1, F.greatest(F.lit(0), F.size("f") - s["at"]))
        at = F.array_position(F.transform(rest, lambda x: x["k"]), h["k"]).cast("int")
        hit = F.struct(h["depth"].cast("int").alias("depth"), F.get(rest, at - 1)["level"].cast("int").alias("level"))
        return F.struct(F.when(at > 0, s["at"] + at).otherwise(s["at"]).alias("at"), F.when(at > 0, F.concat(s["hits"], F.array(hit))).otherwise(s["hits"]).alias("hits")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<depth:int,level:int>>").alias("hits")).cast(state)
    none = F.array().cast("array<struct<line_no:int,k:string,level:int>>")
    x = t.join(f, "doc", "left").withColumn("f", F.coalesce(F.col("f").cast("array<struct<line_no:int,k:string,level:int>>"), none))
    x = x.select("doc", F.size("t").alias("n"), F.aggregate("t", start, step)["hits"].alias("h"))
    after = F.slice("h", 2, F.greatest(F.lit(0), F.size("h") - 1))
    alike = F.zip_with(F.slice("h", 1, F.greatest(F.lit(0), F.size("h") - 1)), after, lambda a, b: (F.signum(b["depth"] - a["depth"]) == F.signum(b["level"] - a["level"])).cast("int"))
    pairs = F.aggregate(alike, F.lit(0), lambda s, e: s + e)
    return x.select("doc", F.size("h").alias("matched"), (F.size("h") / F.col("n")).alias("recall"), F.when(F.size("h") > 1, pairs / (F.size("h") - 1)).otherwise(1.0).alias("hierarchy"))


def roll_up(metrics: DataFrame, by: list[str], values: list[str], pages: str = "pages", totals: list[str] | None = None) -> DataFrame:
    """Page-weighted means of values by some columns, sums of totals, and for headings (n_headings, h_recall,
    h_hierarchy, if there) the recall by their number and the hierarchy by the pairs matched."""
    out = [F.round(weighted_mean(F.col(v), F.col(pages)), 6).alias(v) for v in values] + [F.sum(t).alias(t) for t in totals or []]
    if {"n_headings", "h_recall", "h_hierarchy"} <= set(metrics.columns):
        matched = F.round(F.col("h_recall") * F.col("n_headings"))
        out += [F.try_divide(F.sum(matched), F.sum("n_headings")).alias("h_recall"), weighted_mean(F.col("h_hierarchy"), F.greatest(F.lit(0), matched - 1)).alias("h_hierarchy")]
    return metrics.groupBy(*by).agg(F.sum(pages).alias(pages), *out)


def with_total(rows: DataFrame, label: str, values: list[str], name: str = "total") -> DataFrame:
    """Rows with a row of sums below."""
    return rows.select(label, *values).unionByName(rows.agg(*[F.sum(v).alias(v) for v in values]).select(F.lit(name).alias(label), *values))


def heading_truth(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """``doc``, ``seq``, ``text``, ``depth``: numbered headings of a text layer in the strict order of their numbers.

    lines: doc, line_no, line; expected: doc, schemes that count (array). Of a scheme only the very next number is
    taken: one more at the same depth, a first child, or one more at an ancestor's depth.
    """
    from docmill.operators import headings

    _, text = headings.plain(F.col("line"))
    scheme, number = headings.parse_number(F.col("text"))
    x = lines.select("doc", "line_no", text.alias("text")).withColumn("scheme", scheme).withColumn("number", number.cast("array<int>"))
    x = x.join(expected, "doc").where(F.array_contains("schemes", F.col("scheme")))
    own = x.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "number"))).alias("c"))
    state = "struct<last:array<int>,out:array<struct<text:string,depth:int>>>"

    def step(s: Column, c: Column) -> Column:
        last, n = s["last"], c["number"]
        k = F.size(n)
        lead = F.slice(n, 1, k - 1)
        child = (k == F.size(last) + 1) & (lead == last) & (F.element_at(n, -1) == 1)
        next_ = (k <= F.size(last)) & (lead == F.slice(last, 1, k - 1)) & (F.element_at(n, -1) == F.try_element_at(last, k) + 1)
        ok = F.coalesce(child | next_, F.lit(False))
        return F.struct(F.when(ok, n).otherwise(last).alias("last"), F.when(ok, F.concat(s["out"], F.array(F.struct(c["text"].alias("text"), k.alias("depth"))))).otherwise(s["out"]).alias("out")).cast(state)

    start = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast("array<struct<text:string,depth:int>>").alias("out")).cast(state)
    return own.select("doc", F.posexplode(F.aggregate("c", start, step)["out"]).alias("seq", "h")).select("doc", "seq", "h.text", "h.depth")


def table_cells(cells: DataFrame) -> DataFrame:
    """Rows of tables of another tool: cells (doc, table_no, row, col, text) as ``doc``, ``table_no``, ``row``, ``cells``."""
    parts = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.groupBy("doc", "table_no", "row").agg(F.transform(parts, lambda s: s["text"]).alias("cells"))


def pages_at_breaks(df: DataFrame, doc: str, text: str, mark: str = "<!-- page break -->") -> DataFrame:
    """``doc``, ``page_no``, ``markdown`` of texts that another tool parts by a mark."""
    p = df.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\Q" + mark + r"\E", -1)).alias("i", "markdown"))
    return p.select("doc", (F.col("i") + 1).alias("page_no"), "markdown")


def metric_rows(docs: DataFrame, runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs (doc, tool, ...) with what is known of their document and run; those of either that have none are left
    out."""
    return outputs.join(docs, "doc").join(runs, "tool")
