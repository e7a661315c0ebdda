"""Queries over charts and page geometry, on values and rectangles derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import charts, figures, geometry
from docmill.plans.fixtures import DOCS_SQL, docs
from docmill.plans.registry import query
from docmill.session import table


def _rects(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    li = table(spark, sf, "lineitem")
    li = li if only is None else li.where(only)
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 700).cast("double")
    return li.select(
        F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 2).alias("x1"), (y0 + F.col("l_quantity")).alias("y1")
    )


_R_ALL = "SELECT l_orderkey // 16 AS page, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0, CAST(l_partkey % 500 AS DOUBLE) + l_quantity * 2 AS x1, CAST(l_suppkey * 7 % 700 AS DOUBLE) + l_quantity AS y1 FROM lineitem"
#: All rectangles as two sides.
_ONE, _OTHER = "l_returnflag = 'A'", "l_returnflag <> 'A'"
_SIDES = f"{{}} AS ({_R_ALL} WHERE {_ONE}), {{}} AS ({_R_ALL} WHERE {_OTHER})"


@query(f"WITH {_SIDES.format('a', 'b')} SELECT a.page, a.id, b.id AS other, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) + 1e-9, 6) AS share FROM a JOIN b ON a.page = b.page AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def j11_rect_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.overlap_share(_rects(spark, sf, _ONE), _rects(spark, sf, _OTHER)).withColumn("share", F.round(F.col("share") + 1e-9, 6))


@query(f"WITH {_SIDES.format('f', 'c')}, g AS (SELECT c.page, c.id AS caption, f.id AS figure, greatest(c.y0 - f.y1, f.y0 - c.y1) AS gap FROM c JOIN f ON c.page = f.page AND c.x0 < f.x1 AND f.x0 < c.x1) SELECT page, caption, arg_min(figure, (gap, figure)) AS figure FROM g WHERE gap BETWEEN -4 AND 40 GROUP BY page, caption")
def j12_nearest_caption(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.nearest_caption(_rects(spark, sf, _ONE), _rects(spark, sf, _OTHER))


@query(f"WITH a AS ({_R_ALL}) SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN x0 >= 500 * 0.45 THEN 1 ELSE 0 END, y0, id) AS place FROM a")
def k04_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.reading_order(_rects(spark, sf).withColumn("width", F.lit(500.0))).select("page", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH a AS ({_R_ALL}) SELECT page, id FROM a WHERE (x1 - x0) * (y1 - y0) >= 0.02 * 350000 / 10 AND x1 - x0 >= 0.12 * 500 AND y1 - y0 >= 0.05 * 70")
def f01_size_filter(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.size_filter(_rects(spark, sf).withColumns({"width": F.lit(500.0), "height": F.lit(70.0)})).select("page", "id")


@query("WITH s AS (SELECT p_brand AS doc, CAST(8 + p_size % 6 AS DOUBLE) AS size, sum(length(p_name)) AS n FROM part GROUP BY 1, 2) SELECT doc, arg_min(size, (-n, size)) AS size FROM s GROUP BY doc")
def a04_body_size(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.body_size(table(spark, sf, "part").select(F.col("p_brand").alias("doc"), (F.lit(8) + F.col("p_size") % 6).cast("double").alias("size"), F.col("p_name").alias("key")))


@query("WITH n AS (SELECT p_brand AS doc, CAST(p_size AS DOUBLE) AS size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2) SELECT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS level FROM n")
def a05_size_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.ranked_sizes(table(spark, sf, "part").select(F.col("p_brand").alias("doc"), F.col("p_size").cast("double").alias("size")))


@query("SELECT l_suppkey AS doc, CAST(l_partkey % 50 AS VARCHAR) AS hash FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) >= 3")
def a06_logos(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.repeated_crops(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 50).cast("string").alias("hash"), F.col("l_linenumber").alias("page_no")))


@query("SELECT l_suppkey AS doc, avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) >= 0.5 AS is_scan FROM lineitem GROUP BY 1")
def f08_scanned(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.scanned(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_linestatus") == "F").alias("is_scan")))


@query("SELECT l_orderkey AS page, l_suppkey % 3 AS box, sum(l_partkey % 80) >= 100 AND sum(CASE WHEN l_partkey % 80 >= 40 THEN l_partkey % 80 ELSE 0 END) >= 0.4 * sum(l_partkey % 80) AND max(l_linenumber) <= 6 AS is_text FROM lineitem GROUP BY 1, 2")
def f04_text_box(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return geometry.text_box(li.select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("box"), (F.col("l_partkey") % 80).alias("chars"), F.col("l_linenumber").alias("marks")))


@query("SELECT p_partkey AS id, p_size / 50.0 < 0.97 OR p_partkey % 7 / 7.0 < 0.97 AS shown FROM part")
def f02_visible(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), geometry.visible(F.array(F.col("p_size") / 50.0, F.col("p_partkey") % 7 / 7.0)).alias("shown"))


@query()
def g02_merged_rects(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.merge_by_page(_rects(spark, sf))


def _raw_charts(spark: SparkSession, sf: str) -> DataFrame:
    """A chart of every part, with untidy strings, an empty point, values of all forms and, for some, a table."""
    p = table(spark, sf, "part")
    num, key = F.col("p_size").cast("string"), F.col("p_partkey")
    point = lambda x, y: F.struct(x.cast("string").alias("x"), y.cast("string").alias("y"), F.lit(None).cast("string").alias("label"))
    ys = F.when(key % 5 == 0, F.concat(F.lit("~"), num)).when(key % 5 == 1, F.concat(F.lit("1,"), F.lpad(num, 3, "0"))).when(key % 5 == 2, F.concat(num, F.lit(".50"))).otherwise(num)
    none = F.array().cast(charts._POINTS)
    series = F.array(F.struct(F.concat(F.lit(" "), F.col("p_brand"), F.lit("  s ")).alias("name"), F.array(point(F.col("p_type"), ys), point(F.lit(" "), F.lit(None))).alias("points")), F.struct(F.lit("empty").alias("name"), none.alias("points")))
    series = F.when(key % 7 < 5, series)
    kind = F.when(key % 3 == 0, "line_chart").when(key % 3 == 1, "bar_chart").otherwise("diagram")
    conf = F.when(key % 4 == 0, "Exact").when(key % 4 == 1, "sure").otherwise(F.lit(None).cast("string"))
    axis = lambda label, unit: F.struct(label.alias("label"), unit.cast("string").alias("unit"))
    rows = F.array(F.create_map(F.lit("Name"), F.concat(F.lit("a|"), F.col("p_brand")), F.lit("Size"), F.concat(F.lit("0"), num)), F.create_map(F.lit("Name"), F.lit("b  c"), F.lit("More"), F.lit("~1,000")))
    grid = F.when(key % 2 == 0, F.struct(F.array(F.lit(" Name "), F.lit(" ")).alias("columns"), rows.alias("rows")))
    raw = F.struct(
        kind.alias("figure_type"), F.concat(F.lit(" a  "), F.col("p_name")).alias("title"), axis(F.lit(" Kind  of "), F.lit(None)).alias("x_axis"), axis(F.lit(None).cast("string"), F.lit(" mm ")).alias("y_axis"),
        series.alias("series"), grid.alias("table"), conf.alias("confidence"), F.when(key % 6 == 0, " two\nlines ").alias("notes"),
    )
    return p.select("p_partkey", "p_size", key.alias("id"), raw.alias("raw"))


def _charts(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_charts(spark, sf).select("id", "p_size", charts.normalize(F.col("raw")).alias("chart"))


_Y = "CASE p_partkey % 5 WHEN 0 THEN '~' || p_size WHEN 1 THEN '1' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 2 THEN p_size || '.5' ELSE CAST(p_size AS VARCHAR) END"
_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'line_chart' WHEN 1 THEN 'bar_chart' ELSE 'diagram' END"
_CONF = "CASE p_partkey % 4 WHEN 0 THEN 'exact' ELSE 'low' END"
_T = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TITLE = _T.format("' a  ' || p_name")
_NAME = _T.format("p_brand || '  s '")
_X = _T.format("p_type")
#: Parts with points, with a table, and with either.
_PTS, _TAB = "(p_partkey % 7 < 5)", "(p_partkey % 2 = 0)"


@query(
    f"SELECT p_partkey AS id, {_TITLE} AS title, CASE WHEN {_PTS} THEN {_NAME} END AS series, CASE WHEN {_PTS} THEN {_X} END AS x, CASE WHEN {_PTS} THEN {_Y} END AS y, {_CONF} AS confidence, CASE WHEN {_PTS} THEN 1 ELSE 0 END AS n, 'Kind of/' AS x_axis, '/mm' AS y_axis, CASE WHEN {_TAB} THEN 'Name,Size,More' ELSE '' END AS columns, "
    f"CASE WHEN {_TAB} THEN p_size || ';~1000' ELSE ';' END AS cells, CASE WHEN p_partkey % 6 = 0 THEN 'two lines' ELSE '' END AS notes FROM part WHERE {_PTS} OR {_TAB}"
)
def g05_normalize(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("chart")
    s = F.get(c["series"], F.lit(0))
    pt = F.get(s["points"], F.lit(0))
    cell = lambda row, col: F.coalesce(F.try_element_at(F.get(c["table"]["rows"], F.lit(row)), F.lit(col)), F.lit(""))
    x = _charts(spark, sf).where("chart is not null")
    return x.select(
        "id", c["title"].alias("title"), s["name"].alias("series"), pt["x"].alias("x"), pt["y"].alias("y"), c["confidence"].alias("confidence"), F.size(c["series"]).alias("n"), F.concat_ws("/", c["x_axis"]["label"], c["x_axis"]["unit"]).alias("x_axis"), F.concat_ws("/", c["y_axis"]["label"], c["y_axis"]["unit"]).alias("y_axis"),
        F.array_join(c["table"]["columns"], ",").alias("columns"), F.concat_ws(";", cell(0, "Size"), cell(1, "More")).alias("cells"), c["notes"].alias("notes"),
    )


@query(f"SELECT p_partkey AS id, CASE WHEN {_PTS} OR {_TAB} THEN {_KIND} <> 'diagram' AND {_PTS} AND p_partkey % 5 <> 0 END AS has_data FROM part")
def p09_has_data(spark: SparkSession, sf: str) -> DataFrame:
    return _charts(spark, sf).select("id", charts.has_data(F.col("chart")).alias("has_data"))


_PRINTED = "(p_partkey % 2 = 0)"
_OK = f"({_PRINTED} AND (NOT {_PTS} OR p_partkey % 5 > 2))"


@query(f"SELECT p_partkey AS id, CASE WHEN {_CONF} = 'exact' AND NOT {_OK} THEN 'estimated' ELSE {_CONF} END AS confidence, concat_ws('; ', CASE WHEN p_partkey % 6 = 0 THEN 'two lines' END, CASE WHEN {_CONF} = 'exact' AND NOT {_OK} THEN 'values are not all printed in the figure' END) AS notes FROM part WHERE {_PTS} OR {_TAB}")
def g06_ground(spark: SparkSession, sf: str) -> DataFrame:
    printed = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Parts 0.25 and "), F.col("p_size").cast("string"), F.lit(" % of all")))
    x = _charts(spark, sf).where("chart is not null").select("id", charts.grounded(F.col("chart"), printed).alias("c"))
    return x.select("id", "c.confidence", "c.notes")


_NL = "chr(10)"
_SUMMARY = f"'> ' || concat_ws('; ', {_KIND}, {_TITLE}, 'confidence=' || {_CONF})"
_GRID = f"'>' || {_NL} || '> | Name | Size | More |' || {_NL} || '> | --- | --- | --- |' || {_NL} || '> | a\\|' || p_brand || ' | ' || p_size || ' |  |' || {_NL} || '> | b c |  | ~1000 |'"
_POINT = f"'>' || {_NL} || '> | Series | X | Y | Label |' || {_NL} || '> | --- | --- | --- | --- |' || {_NL} || '> | ' || {_NAME} || ' | ' || {_X} || ' | ' || {_Y} || ' |  |'"


@query(f"SELECT p_partkey AS id, CASE WHEN {_PTS} OR {_TAB} THEN concat_ws({_NL}, '> **Structured chart data:**', {_SUMMARY}, CASE WHEN {_TAB} THEN {_GRID} END, CASE WHEN {_PTS} THEN {_POINT} END, CASE WHEN p_partkey % 6 = 0 THEN '> Notes: two lines' END) ELSE '' END AS block FROM part")
def g07_render(spark: SparkSession, sf: str) -> DataFrame:
    return _charts(spark, sf).select("id", charts.render(F.col("chart")).alias("block"))


@query(
    f"SELECT p_partkey AS id, CASE WHEN contains({_KIND}, 'line') THEN 'line' ELSE 'bar' END AS mark, {_TITLE} AS title, 'Kind of' AS x_title, 'Y (mm)' AS y_title, CASE WHEN {_PTS} THEN 'series' END AS color, CASE WHEN {_PTS} THEN {_X} ELSE 'a|' || p_brand END AS x, "
    f"CAST(ltrim(CASE WHEN {_PTS} THEN {_Y} ELSE CAST(p_size AS VARCHAR) END, '~') AS DOUBLE) AS y, {_CONF} <> 'exact' AS approximate FROM part WHERE {_PTS} OR {_TAB}"
)
def g08_spec(spark: SparkSession, sf: str) -> DataFrame:
    x = _charts(spark, sf).select("id", charts.plot_spec(F.col("chart")).alias("s")).where("s is not null")
    at = lambda path: F.get_json_object("s", f"$.{path}")
    return x.select(
        "id", at("mark").alias("mark"), at("description").alias("title"), at("encoding.x.title").alias("x_title"), at("encoding.y.title").alias("y_title"), at("encoding.color.field").alias("color"), at("data.values[0].x").alias("x"),
        at("data.values[0].y").cast("double").alias("y"), at("usermeta.docmill.approximate").cast("boolean").alias("approximate"),
    )


@query(f"SELECT p_partkey AS id, ({_PTS} OR {_TAB}) AS has, CASE WHEN {_PTS} OR {_TAB} THEN {_TITLE} END AS title, CASE WHEN {_PTS} OR {_TAB} THEN 2 END AS both FROM part")
def g10_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = charts.comment(F.col("chart"))
    broken = F.lit(f'<!-- {charts.COMMENT}: {{"title": }} -->')
    one, two = (charts.metadata(F.concat(F.lit("x "), c, F.lit(" y "), rest, broken)) for rest in (F.lit(""), c))
    x = _charts(spark, sf).select("id", one[0].alias("has"), F.get_json_object(one[1], "$.title").alias("title"), F.when(two[0], F.json_array_length(two[1])).alias("both"))
    return x


@query("SELECT l_orderkey AS image, max(n) AS hits FROM (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE abs(l_quantity - 25) <= 5 GROUP BY 1, 2) GROUP BY 1")
def e07_chart_score(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("series"), F.concat(F.lit("Key "), F.col("l_linenumber").cast("string")).alias("x"), F.col("l_quantity").cast("string").alias("y"))
    t = li.select(F.col("l_orderkey").alias("image"), F.concat(F.lit("key "), F.col("l_linenumber").cast("string")).alias("key"), F.lit(25.0).alias("value"), F.lit(5.0).alias("tolerance")).distinct()
    return charts.score(c, t)


@query(
    f"WITH {DOCS_SQL} SELECT doc, replace(markdown, '![plot](img-1.png)' || chr(10), '![plot](img-1.png)' || chr(10) || '> **Figure description:** Costs $5 in \\x.' || chr(10) || '>' || chr(10) || '> A second part.' || chr(10) || '>' || chr(10) || '> | a |' || chr(10) || '> |---|' || chr(10) || chr(10)) AS markdown FROM docs"
)
def g11_inject(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    told = d.select("doc", F.explode(F.array(F.struct(F.lit("img-1.png").alias("image_id"), F.lit("Costs $5 in \\x.\n\nA second part.\nDATA:\n| a |\n|---|").alias("description")), F.struct(F.lit("figure").alias("image_id"), F.lit("[Image description unavailable: late]").alias("description")))).alias("t"))
    return charts.inject(d, told.select("doc", "t.*", F.lit(None).cast("string").alias("printed")))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a document for each supplier: an image for each line item of flag A, drawn paths for the others, and a
    line of text for every item."""
    li = table(spark, sf, "lineitem")
    x0, y0 = (F.col("l_partkey") % 400 + 50).cast("double"), (F.col("l_suppkey") * 7 + F.col("l_orderkey") * 13) % 600 + 60.0
    # a page's items are dealt and gathered once, as they are; its lists are made from them
    item = F.struct(x0.alias("x"), y0.alias("y"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 9).cast("byte").alias("k"), F.col("l_returnflag").alias("flag"))
    rows = li.select((F.col("l_orderkey") % 7).cast("string").alias("doc"), F.floor(F.col("l_orderkey") / 64).cast("int").alias("page_no"), item.alias("i")).repartition("doc", "page_no")

    def box(i: Column) -> list[Column]:
        return [i["x"].alias("x0"), i["y"].alias("y0"), (i["x"] + i["q"] * 4).alias("x1"), (i["y"] + i["q"] * 3).alias("y1")]

    def line(i: Column) -> Column:
        text = F.concat(F.when(i["n"] == 1, F.concat(F.lit("Figure "), i["k"].cast("string"), F.lit(" "))).otherwise("label "), i["flag"])
        return F.struct(i["x"].alias("x0"), (i["y"] - 12).alias("y0"), (i["x"] + 60).alias("x1"), (i["y"] - 2).alias("y1"), text.alias("text"), F.lit(0).alias("mono"), i["n"].alias("block"))

    x = rows.groupBy("doc", "page_no").agg(F.collect_list("i").alias("items")).select(
        "doc", "page_no", F.sort_array(F.transform(F.filter("items", lambda i: i["flag"] == "A"), lambda i: F.struct(*box(i)))).alias("images"),
        F.sort_array(F.transform(F.filter("items", lambda i: i["flag"] != "A"), lambda i: F.struct(*box(i), (i["n"] % 3 > 0).alias("shown")))).alias("paths"), F.sort_array(F.transform("items", line)).alias("lines"),
    ).withColumn("clusters", F.transform("paths", lambda i: F.struct(*[i[c].alias(c) for c in ("x0", "y0", "x1", "y1")])))
    none = F.array()
    return x.select("doc", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "images", "paths", "clusters", none.cast(f"array<{figures.RECT}>").alias("tables"), "lines", none.cast("array<struct<x0:double,y0:double,x1:double,y1:double,chars:int>>").alias("hidden"), F.lit(100).alias("chars"))


@query()
def f01_detected_figures(spark: SparkSession, sf: str) -> DataFrame:
    return figures.find_figures(_pages(spark, sf))


@query()
def f11_placed_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures linked into texts of their pages, which hold a placeholder, a caption or neither."""
    p = _pages(spark, sf)
    k = F.col("page_no") % 3
    text = F.when(k == 0, "![figure](figure)\n\nFigure 3: A photo.").when(k == 1, "Text.\n\n![x](figure)\n\nmore").otherwise("Plain text.")
    pages = p.select("doc", F.col("page_no").cast("long").alias("part_no"), "page_no", text.alias("text"))
    return figures.place_figures(pages, figures.find_figures(p))
