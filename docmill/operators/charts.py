"""Chart data: parse, normalize, ground, render."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Kinds of figures that carry data; fixed values.
CHART_TYPES = ("bar_chart", "line_chart", "scatter_plot", "pie_chart", "area_chart")
CHART = "struct<figure_type:string,title:string,x_axis:struct<label:string,unit:string>,y_axis:struct<label:string,unit:string>,series:array<struct<name:string,points:array<struct<x:string,y:string,label:string>>>>,table:struct<columns:array<string>,rows:array<map<string,string>>>,confidence:string,notes:string>"
COMMENT = "chart-data"


def first_json(text: str | None) -> str | None:
    """The first balanced object in a text; braces in strings don't count."""
    start = text.find("{") if text else -1
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def split_chart_json(description: str) -> tuple[str, dict | None]:
    """(prose, chart) of a description in which CHART_JSON: stands on a line of its own."""
    m = re.search(r"(?im)^(?:[ \t]*-{3,}[ \t]*\n\s*)?[ \t*]*CHART_JSON:[ \t*]*", description)
    if not m:
        return description, None
    return description[: m.start()].rstrip(), _load(description[m.end() :])


def parse_reply(reply: str) -> dict | None:
    """The chart after the last CHART_JSON: of a reply, or of all of it."""
    return _load(reply.rsplit("CHART_JSON:", 1)[-1])


def _load(text: str) -> dict | None:
    raw = first_json(text)
    try:
        got = json.loads(raw) if raw else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def number(y: Column) -> Column:
    """A printed value as a number, its thousands commas removed; null if it is a text or an estimate."""
    return F.replace(F.trim(y), F.lit(","), F.lit("")).try_cast("double")


def value(c: Column) -> Column:
    """A printed value as text: white space collapsed, commas removed, numbers in their shortest form; ~ stays."""
    t = F.regexp_replace(_tidy(c), ",", "")
    short = F.regexp_replace(F.regexp_replace(t, r"^(~?)\+?(-?)0+(?=[0-9])", "$1$2"), r"(\.[0-9]+?)0+$", "$1")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(t.rlike(r"^~?[+-]?[0-9]+(\.[0-9]+)?$"), F.regexp_replace(short, r"^(~?)\+", "$1")).otherwise(t)


_POINTS = "array<struct<x:string,y:string,label:string>>"
_ROWS = "array<map<string,string>>"


def normalize(chart: Column) -> Column:
    """A chart struct (CHART) with white space collapsed, numbers in one form, empty points, series and rows dropped and
    a known confidence; null without any series or row. Columns of the table are those named and those that
    rows have besides, in the order they first appear."""
    def points(s: Column) -> Column:
        every = F.transform(F.coalesce(s["points"], F.array().cast(_POINTS)), lambda p: F.struct(_tidy(p["x"]).alias("x"), value(p["y"]).alias("y"), _tidy(p["label"]).alias("label")))
        return F.filter(every, lambda p: (p["x"] != "") | (F.coalesce(p["y"], F.lit("")) != ""))

    def axis(a: Column) -> Column:
        return F.struct(_tidy(a["label"]).alias("label"), _tidy(a["unit"]).alias("unit"))

    series = F.filter(F.transform(F.coalesce(chart["series"], F.array().cast(f"array<struct<name:string,points:{_POINTS}>>")), lambda s: F.struct(_tidy(s["name"]).alias("name"), points(s).alias("points"))), lambda s: F.size(s["points"]) > 0)
    rows = F.filter(F.transform(F.coalesce(chart["table"]["rows"], F.array().cast(_ROWS)), lambda r: F.transform_values(r, lambda _, v: value(v))), lambda r: r.isNotNull() & (F.size(r) > 0))
    named = F.filter(F.transform(F.coalesce(chart["table"]["columns"], F.array().cast("array<string>")), _tidy), lambda c: c != "")
    columns = F.array_distinct(F.concat(named, F.flatten(F.transform(rows, F.map_keys))))
    table = F.struct(F.when(F.size(rows) > 0, columns).otherwise(F.array().cast("array<string>")).alias("columns"), rows.alias("rows"))
    confidence, kind = F.lower(_tidy(chart["confidence"])), _tidy(chart["figure_type"])
    whole = F.struct(
        F.when(kind != "", kind).otherwise("other").alias("figure_type"), _tidy(chart["title"]).alias("title"), axis(chart["x_axis"]).alias("x_axis"), axis(chart["y_axis"]).alias("y_axis"),
        series.alias("series"), table.alias("table"), F.when(confidence.isin("exact", "estimated", "low"), confidence).otherwise("low").alias("confidence"), _tidy(chart["notes"]).alias("notes"),
    )
    return F.when((F.size(series) > 0) | (F.size(rows) > 0), whole)


def values(chart: Column) -> Column:
    """All numbers of a normalized chart."""
    return F.filter(F.flatten(F.transform(chart["series"], lambda s: F.transform(s["points"], lambda p: number(p["y"])))), lambda v: v.isNotNull())


def has_data(chart: Column) -> Column:
    return chart["figure_type"].isin(*CHART_TYPES) & (F.size(values(chart)) > 0)


def ground(chart: Column, printed: Column) -> Column:
    """The confidence that the text printed in the figure supports: exact stays only if every value, or a
    hundred times it, is printed."""
    seen = F.transform(F.regexp_extract_all(F.replace(F.coalesce(printed, F.lit("")), F.lit(","), F.lit("")), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda t: t.cast("double"))
    raw = F.flatten(F.transform(chart["series"], lambda s: F.transform(s["points"], lambda p: p["y"])))
    close = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b))
    ok = F.forall(raw, lambda y: number(y).isNotNull() & F.exists(seen, lambda t: close(t, number(y)) | close(t, number(y) * 100)))
    return F.when((chart["confidence"] == "exact") & ~(printed.isNotNull() & ok), "estimated").otherwise(chart["confidence"])


def grounded(chart: Column, printed: Column) -> Column:
    """The chart with the confidence that is supported, and a note where it was lowered."""
    now = ground(chart, printed)
    note = F.concat_ws("; ", F.nullif(chart["notes"], F.lit("")), F.lit("values are not all printed in the figure"))
    return F.when(chart.isNotNull(), chart.withField("notes", F.when(now != chart["confidence"], note).otherwise(chart["notes"])).withField("confidence", now))


def _table(columns: Column, rows: Column) -> Column:
    """Lines of a Markdown table; rows are arrays of cells."""
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    return F.concat(F.array(line(columns), line(F.transform(columns, lambda _: F.lit("---")))), F.transform(rows, line))


def render(chart: Column) -> Column:
    """A normalized chart as quoted lines for search: kind, title and confidence, its table, a row for each point and
    its notes; '' for null."""
    def cell(c: Column) -> Column:
        return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))

    none = F.array().cast("array<string>")
    summary = F.concat_ws("; ", F.nullif(chart["figure_type"], F.lit("")), F.nullif(chart["title"], F.lit("")), F.concat(F.lit("confidence="), chart["confidence"]))
    columns = chart["table"]["columns"]
    rows = F.transform(chart["table"]["rows"], lambda r: F.transform(columns, lambda c: cell(F.try_element_at(r, c))))
    points = F.flatten(F.transform(chart["series"], lambda s: F.transform(s["points"], lambda p: F.array(cell(s["name"]), cell(p["x"]), cell(p["y"]), cell(p["label"])))))
    blank = F.array(F.lit(""))
    lines = F.concat(
        F.array(F.lit("**Structured chart data:**"), summary),
        F.when(F.size(rows) > 0, F.concat(blank, _table(columns, rows))).otherwise(none),
        F.when(F.size(points) > 0, F.concat(blank, _table(F.array(*map(F.lit, ("Series", "X", "Y", "Label"))), points))).otherwise(none),
        F.when(chart["notes"] != "", F.array(F.concat(F.lit("Notes: "), chart["notes"]))).otherwise(none),
    )
    return F.when(chart.isNull(), "").otherwise(F.array_join(F.transform(lines, lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n"))


#: Marks of a plot, by what the kind of figure holds; bars else.
MARKS = {"line": "line", "scatter": "point", "area": "area", "matrix": "rect", "heat": "rect"}


def mark(figure_type: Column) -> Column:
    """The mark a plot of a kind uses."""
    t = F.lower(figure_type)
    return F.coalesce(*(F.when(F.contains(t, F.lit(word)), name) for word, name in MARKS.items()), F.lit("bar"))


def plot_values(chart: Column) -> Column:
    """(x, y, series, label) of every point with a number, estimates too; without any those of the first two columns
    of the table."""
    def shown(y: Column) -> Column:
        return F.regexp_replace(y, "^~", "").try_cast("double")

    def full(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    points = F.flatten(F.transform(chart["series"], lambda s: F.transform(s["points"], lambda p: F.struct(F.coalesce(full(p["x"]), full(p["label"]), F.lit("")).alias("x"), shown(p["y"]).alias("y"), full(s["name"]).alias("series"), full(p["label"]).alias("label")))))
    points = F.filter(points, lambda v: v["y"].isNotNull())
    x, y = F.get(chart["table"]["columns"], F.lit(0)), F.get(chart["table"]["columns"], F.lit(1))
    cells = F.transform(chart["table"]["rows"], lambda r: F.struct(F.coalesce(F.try_element_at(r, x), F.lit("")).alias("x"), shown(F.try_element_at(r, y)).alias("y"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("label")))
    return F.when(F.size(points) > 0, points).when(y.isNotNull(), F.filter(cells, lambda v: v["y"].isNotNull()))


def plot_spec(chart: Column) -> Column:
    """A Vega-Lite plot of a normalized chart as JSON; null without values."""
    v = plot_values(chart)

    def title(axis: str, default: str) -> Column:
        label = F.coalesce(F.nullif(chart[axis]["label"], F.lit("")), F.lit(default))
        return F.when(chart[axis]["unit"] != "", F.concat(label, F.lit(" ("), chart[axis]["unit"], F.lit(")"))).otherwise(label)

    def field(name: str, kind: str, label: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), *([] if label is None else [label.alias("title")]))

    spec = F.struct(
        F.lit("https://vega.github.io/schema/vega-lite/v5.json").alias("$schema"), F.coalesce(F.nullif(chart["title"], F.lit("")), F.lit("Extracted chart data")).alias("description"), F.struct(v.alias("values")).alias("data"), mark(chart["figure_type"]).alias("mark"),
        F.struct(field("x", "nominal", title("x_axis", "X")).alias("x"), field("y", "quantitative", title("y_axis", "Y")).alias("y"), F.when(F.exists(v, lambda r: r["series"].isNotNull()), field("series", "nominal")).alias("color")).alias("encoding"),
        F.struct(F.struct(chart["confidence"].alias("confidence"), chart["notes"].alias("notes"), (chart["confidence"] != "exact").alias("approximate")).alias("docmill")).alias("usermeta"),
    )
    return F.when(F.size(v) > 0, F.to_json(spec))


def comment(chart: Column) -> Column:
    """A normalized chart and its plot as a hidden comment; '' for null."""
    body = F.concat(F.lit(f'<!-- {COMMENT}: {{"chart_data": '), F.to_json(chart), F.lit(', "vega_lite_spec": '), F.coalesce(plot_spec(chart), F.lit("null")), F.lit("} -->"))
    return F.coalesce(body, F.lit(""))


_COMMENT = rf"(?s)<!-- {COMMENT}: (\{{.*?\}}) -->"


def comments(text: Column) -> Column:
    """The JSON of every hidden chart comment of a text that can be parsed."""
    return F.filter(F.regexp_extract_all(text, F.lit(_COMMENT), 1), lambda j: F.try_parse_json(j).isNotNull())


def metadata(text: Column) -> tuple[Column, Column, Column]:
    """(has_structured_chart_data, chart_data, vega_lite_spec) of the comments of a text; the last two are JSON, an
    object of one chart and a list of more, null without any."""
    def part(name: str) -> Column:
        every = F.filter(F.transform(comments(text), lambda j: F.get_json_object(j, f"$.{name}")), lambda x: F.startswith(x, F.lit("{")))
        return F.when(F.size(every) == 1, every[0]).when(F.size(every) > 1, F.concat(F.lit("["), F.array_join(every, ", "), F.lit("]")))

    data = part("chart_data")
    return data.isNotNull(), data, F.when(data.isNotNull(), part("vega_lite_spec"))


def images_with_charts(docs: DataFrame, doc: str = "doc", text: str = "markdown") -> DataFrame:
    """``doc``, ``image``, ``json``: the chart comments that stand under an image and its quoted lines."""
    block = rf"(?s)!\[[^\]]*\]\(([^\n]+?)\)[ \t]*\n+(?:>[^\n]*\n)*<!-- {COMMENT}: (\{{.*?\}}) -->"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(block), 1).alias("image"), F.regexp_extract_all(text, F.lit(block), 2).alias("json"))
    return docs.select(F.col(doc).alias("doc"), F.inline(pairs)).toDF("doc", "image", "json")


@F.pandas_udf(StructType().add("prose", "string").add("json", "string"))
def _split(text: pd.Series) -> pd.DataFrame:
    found = [(None, None) if t is None else split_chart_json(t) for t in text]
    return pd.DataFrame({"prose": [p for p, _ in found], "json": [None if c is None else json.dumps(c, ensure_ascii=False) for _, c in found]})


def inject(docs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``doc``, ``markdown``: documents (doc, markdown) with each described image followed by its description.

    descriptions: doc, image_id, description, printed (the text of the figure, or null). Every line of a description is
    quoted; its data table, its chart and a hidden comment with the chart follow, and a blank line ends the quote.
    Placeholders of failures are left out; an image that stands several times is described each time.
    """
    from docmill.operators.describe import split_data
    from docmill.operators.ingest import unavailable

    d = descriptions.where(~unavailable(F.col("description"))).withColumn("__s", _split(F.col("description")))
    d = d.withColumn("__chart", grounded(normalize(F.from_json("__s.json", CHART)), F.col("printed")))
    prose, data = split_data(F.col("__s.prose"))

    def quoted(c: Column) -> Column:
        return F.array_join(F.transform(F.split(c, r"\r?\n"), lambda x: F.when(F.trim(x) == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")

    block = F.concat_ws("\n", quoted(F.concat(F.lit("**Figure description:** "), prose)), F.when(data != "", F.concat(F.lit(">\n"), quoted(data))), F.nullif(render(F.col("__chart")), F.lit("")), F.nullif(comment(F.col("__chart")), F.lit("")))
    literal = F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    blocks = d.select("doc", F.struct("image_id", literal.alias("block")).alias("b")).groupBy("doc").agg(F.array_sort(F.collect_list("b")).alias("blocks"))

    def put(text: Column, b: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(!\[[^\]]*\]\([^)]*?\Q"), b["image_id"], F.lit(r"\E\))\n*")), F.concat(F.lit("$1\n"), b["block"], F.lit("\n\n")))

    x = docs.join(blocks, "doc", "left")
    return x.select("doc", F.when(F.col("blocks").isNull(), F.col("markdown")).otherwise(F.aggregate("blocks", F.col("markdown"), put)).alias("markdown"))


def score(charts: DataFrame, truth: DataFrame) -> DataFrame:
    """``image``, ``hits``: most truths (image, key, value, tolerance) that one series of a chart meets.

    charts: image, series, x, y. A truth is met by a point whose x holds its key, within the tolerance.
    """
    c = charts.withColumn("v", number(F.col("y"))).where("v is not null")
    x = c.join(truth, "image").where(F.contains(F.lower("x"), F.lower("key")) & (F.abs(F.col("v") - F.col("value")) <= F.col("tolerance")))
    return x.groupBy("image", "series").agg(F.count_distinct("key").alias("n")).groupBy("image").agg(F.max("n").alias("hits"))
