"""Queries over lines, pages, headings, chunks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import chunking, clean, evaluate, geometry, headings, lines, repair
from docmill.plans.fixtures import DOCS_SQL, LINES_SQL, PAGES_SQL, STRIP, docs
from docmill.plans.registry import query
from docmill.session import table

_L = f"WITH {DOCS_SQL}, {LINES_SQL}"
_S = STRIP.format("line")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return lines.pages(table(spark, sf, "ocr_results"), "ocr_id", "page_markdowns")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(docs(spark, sf))


_MARKED = f"WITH {PAGES_SQL}, joined AS (SELECT doc, string_agg('<!-- page: ' || page_no || ' -->' || chr(10) || chr(10) || markdown, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM pages GROUP BY doc)"


@query(f"WITH {PAGES_SQL} SELECT doc, string_agg(markdown, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM pages GROUP BY doc")
def t07_join_pages(spark: SparkSession, sf: str) -> DataFrame:
    return lines.join_pages(_pages(spark, sf))


_MLINES = _MARKED + """, l AS (SELECT doc, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no, unnest(string_split(markdown, chr(10))) AS line FROM joined),
o AS (SELECT doc, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
idx AS (SELECT doc, CAST(regexp_extract(line, '(\\d+)', 1) AS INT) AS page_no, CAST(pos AS BIGINT) AS pos FROM o WHERE regexp_matches(line, '^[ \\t]*<!--\\s*page:\\s*\\d+\\s*-->[ \\t]*$'))"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return lines.join_pages(_pages(spark, sf), markers=True)


@query(_MLINES + " SELECT doc, page_no, pos AS offset_chars FROM idx")
def t08_page_index(spark: SparkSession, sf: str) -> DataFrame:
    return lines.page_index(lines.explode_lines(_marked(spark, sf))).select("doc", "page_no", F.col("offset").cast("long").alias("offset_chars"))


_SPANS = ", spans AS (SELECT doc, unnest(range(CAST(floor(length(markdown) / 700) AS BIGINT) + 1)) AS span_no FROM joined), s AS (SELECT doc, CAST(span_no AS INT) AS span_no, span_no * 700 AS a, span_no * 700 + 900 AS b FROM spans)"


def _spans(marked: DataFrame) -> DataFrame:
    n = F.floor(F.length("markdown") / 700).cast("int")
    x = marked.select("doc", F.explode(F.sequence(F.lit(0), n)).alias("span_no"))
    return x.select("doc", "span_no", (F.col("span_no") * 700).cast("long").alias("start"), (F.col("span_no") * 700 + 900).cast("long").alias("end"))


@query(
    _MLINES + _SPANS + """ SELECT s.doc, s.span_no, coalesce((SELECT max_by(page_no, pos) FROM idx i WHERE i.doc = s.doc AND i.pos <= s.a), (SELECT min_by(page_no, pos) FROM idx i WHERE i.doc = s.doc)) AS page_start,
greatest(coalesce((SELECT max_by(page_no, pos) FROM idx i WHERE i.doc = s.doc AND i.pos <= s.a), (SELECT min_by(page_no, pos) FROM idx i WHERE i.doc = s.doc)), coalesce((SELECT max_by(page_no, pos) FROM idx i WHERE i.doc = s.doc AND i.pos < greatest(s.a, s.b)), (SELECT min_by(page_no, pos) FROM idx i WHERE i.doc = s.doc))) AS page_end FROM s"""
)
def t09_page_range(spark: SparkSession, sf: str) -> DataFrame:
    marked = _marked(spark, sf)
    index = lines.page_index(lines.explode_lines(marked)).withColumn("offset", F.col("offset").cast("long"))
    return lines.page_ranges(_spans(marked), index).select("doc", "span_no", "page_start", "page_end")


@query(_MARKED + r" SELECT doc, regexp_replace(regexp_replace(regexp_replace(markdown, '(?m)^[ \t]*<!--[ \t]*page:[ \t]*\d+[ \t]*-->[ \t]*\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS markdown FROM joined")
def t10_strip_markers(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc", T.strip_page_markers(F.col("markdown")).alias("markdown"))


@query(_MLINES + r", g AS (SELECT doc, line_no, line, sum(CASE WHEN regexp_matches(line, '^[ \t]*<!--\s*page:\s*\d+\s*-->[ \t]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS part_no FROM l) SELECT doc, CAST(part_no AS BIGINT) AS part_no, max(CASE WHEN regexp_matches(line, '^[ \t]*<!--\s*page:\s*\d+\s*-->[ \t]*$') THEN CAST(regexp_extract(line, '(\d+)', 1) AS INT) END) AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY doc, part_no")
def t11_split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return lines.split_pages(lines.explode_lines(_marked(spark, sf)))


# --- cleanup ------------------------------------------------------------------------------------

# Written from the description of the pass, marking by marking.
_WITH_CAVEAT = {
    5: ("TOP SECRET", "SCI|NOFORN|SI|TK|HCS|ORCON"), 4: ("SECRET", "NOFORN|REL TO|LIMDIS|ORCON"), 3: ("CONFIDENTIAL", ""), 1: ("UNCLASSIFIED", "FOUO|FOR OFFICIAL USE ONLY|CUI|NOFORN|REL TO|LIMDIS"),
}
_RANK = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{m}(?:\\s*//\\s*(?:{c})[A-Z0-9_\\s/,]*)?') THEN {r}" for r, (m, c) in _WITH_CAVEAT.items()) + " WHEN s IN ('CUI', 'CONTROLLED UNCLASSIFIED INFORMATION', 'FOUO', 'FOR OFFICIAL USE ONLY') THEN 2 ELSE 0 END"
_C01 = f"""b AS (SELECT doc, line_no, line, upper({_S}) AS s FROM lines), r AS (SELECT *, {_RANK} AS rk FROM b),
best AS (SELECT doc, arg_max(s, (rk, length(s), s)) AS best FROM r WHERE rk > 0 GROUP BY doc),
gone AS (SELECT *, rk > 0 OR regexp_full_match(s, 'PAGE\\s+\\d+\\s+OF\\s+\\d+') AS g FROM r),
runs AS (SELECT *, sum(CASE WHEN g OR s = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line_no) AS run, g OR s = '' AS thin FROM gone),
near AS (SELECT *, bool_or(g) OVER (PARTITION BY doc, run, thin) AS hit, row_number() OVER (PARTITION BY doc, run, thin ORDER BY line_no) AS k FROM runs),
left_over AS (SELECT doc, string_agg(CASE WHEN thin AND hit THEN '' ELSE line END, chr(10) ORDER BY line_no) AS t FROM near WHERE NOT (thin AND hit) OR k = 1 GROUP BY doc),
c01 AS (SELECT l.doc, CASE WHEN best IS NOT NULL THEN '> **Classification:** ' || best || chr(10) || chr(10) || regexp_replace(t, '^\n+', '') ELSE t END AS markdown FROM left_over l LEFT JOIN best ON l.doc = best.doc)"""


@query(f"{_L}, {_C01} SELECT doc, markdown FROM c01")
def c01_classification(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", clean.classification(F.col("markdown")).alias("markdown"))


@query(f"WITH {DOCS_SQL} SELECT doc, regexp_replace(markdown, '(?m)^Downloaded by .+$', '', 'g') AS markdown FROM docs")
def c02_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", clean.watermarks(F.col("markdown")).alias("markdown"))


_STARTS = " OR ".join(f"starts_with(s, '{m}')" for m in ("#", "-", "*", "|", ">", "```", "![", "[", "<!--"))
_C03 = f"""x AS (SELECT doc, line_no, line, {_S} AS s FROM lines), y AS (SELECT *, regexp_replace(substring(s, 1, 20), '^\\s+|\\s+$', '', 'g') AS p FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY doc, s) AS n, sum(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, p) AS np FROM y),
c03 AS (SELECT doc, line_no, line FROM z WHERE NOT (s <> '' AND (n >= CASE WHEN length(s) <= 20 THEN 2 ELSE 3 END OR np >= 3) AND NOT ({_STARTS}) AND length(s) <= 150 AND NOT regexp_matches(s, '^[A-Z][a-z]+.*\\([0-9]{{4}}\\)')))"""


@query(f"{_L}, {_C03} SELECT doc, line_no, line FROM c03")
def c03_repeating(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_repeating(_lines(spark, sf))


@query(
    f"""{_L}, x AS (SELECT doc, line_no, line, {_S} AS s FROM lines),
y AS (SELECT *, coalesce(lag(s) OVER w, '') AS b, coalesce(lead(s) OVER w, '') AS a FROM x WINDOW w AS (PARTITION BY doc ORDER BY line_no))
SELECT doc, line_no, line FROM y WHERE NOT (regexp_matches(s, '^[0-9]{{1,4}}$|^[ivxlcdmIVXLCDM]+$') AND (b = '' OR a = '' OR starts_with(b, '#') OR starts_with(a, '#')))"""
)
def c04_page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_page_numbers(_lines(spark, sf))


# DuckDB's expressions cannot look around, so each line is told apart: of placeholders alone, else marks go one by one.
_P = r"!\[[^\]]*\]\(figure\)"
_C05 = rf"""y AS (SELECT doc, line_no, line, regexp_full_match(line, '[ \t]*(?:{_P}[ \t]*)+') AS whole, lag(line) OVER w AS above FROM lines WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
z AS (SELECT doc, line_no, line, whole, coalesce(lag(whole) OVER w, false) AS after_whole FROM y WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
c05 AS (SELECT doc, string_agg(regexp_replace(regexp_replace(regexp_replace(line, '^[ \t]*{_P}[ \t]*|[ \t]*{_P}[ \t]*$', '', 'g'), '[ \t]*{_P}[ \t]*', ' ', 'g'), '^ (?:{_P})', '', 'g'), chr(10) ORDER BY line_no) AS markdown FROM z WHERE NOT whole AND NOT (after_whole AND regexp_full_match(line, '[ \t]*')) GROUP BY doc)"""


@query(f"{_L}, {_C05} SELECT doc, markdown FROM c05")
def c05_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", clean.placeholders(F.col("markdown")).alias("markdown"))


_REJOIN = f"""x AS (SELECT doc, line_no, {_S} AS s FROM lines), nb AS (SELECT doc, line_no, s, row_number() OVER w AS k, lead(s) OVER w AS n, lead(line_no) OVER w AS m FROM x WHERE s <> '' WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
lk AS (SELECT *, coalesce(NOT (starts_with(s, '#') OR starts_with(s, '-') OR starts_with(s, '*') OR starts_with(s, '|') OR starts_with(s, '>') OR starts_with(s, '```') OR starts_with(s, '![') OR starts_with(s, '(') OR starts_with(s, '[')) AND NOT regexp_matches(s, '^<!--\\s*page:\\s*\\d+\\s*-->$') AND NOT regexp_matches(s, '[.!?:;]$') AND m - line_no <= 3 AND regexp_matches(n, '^\\p{{Ll}}'), false) AS l FROM nb),
gr AS (SELECT *, k - sum(CASE WHEN l THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM lk),
fi AS (SELECT *, l AND row_number() OVER (PARTITION BY doc, g, l ORDER BY line_no) % 2 = 1 AS fire FROM gr)"""


@query(f"{_L}, {_REJOIN} SELECT doc, line_no, s || ' ' || n AS joined FROM fi WHERE fire")
def c06_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    before = _lines(spark, sf).withColumnRenamed("line", "old")
    x = clean.rejoin_sentences(_lines(spark, sf)).join(before, ["doc", "line_no"]).where("line <> old")
    return x.select("doc", "line_no", F.col("line").alias("joined"))


@query(f"WITH {DOCS_SQL} SELECT doc, regexp_replace(markdown, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS markdown FROM docs")
def c07_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", clean.collapse_blank(F.col("markdown")).alias("markdown"))


@query()
def c00_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_documents(docs(spark, sf))


# --- headings -----------------------------------------------------------------------------------

_HIDX = f"""o AS (SELECT doc, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
h AS (SELECT doc, CAST(line_no AS INT) AS line_no, CAST(pos AS BIGINT) AS pos, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, regexp_replace(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') AS title FROM o WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S'))"""


@query(f"{_L}, {_HIDX} SELECT doc, line_no, pos AS offset_chars, CAST(level AS INT) AS level, title FROM h")
def n09_heading_index(spark: SparkSession, sf: str) -> DataFrame:
    return headings.heading_index(_lines(spark, sf)).select("doc", "line_no", F.col("offset").cast("long").alias("offset_chars"), "level", "title")


_PATH = """crumb AS (SELECT a.doc, a.pos, a.level, a.title, (SELECT string_agg(b.title, ' > ' ORDER BY b.level) FROM h b WHERE b.doc = a.doc AND b.pos <= a.pos AND b.level <= a.level AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc = a.doc AND c.pos > b.pos AND c.pos <= a.pos AND c.level <= b.level)) AS path FROM h a)"""


@query(f"{_L}, {_HIDX}, {_PATH} SELECT doc, pos AS offset_chars, path FROM crumb")
def j06_breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    return headings.breadcrumbs(headings.heading_index(_lines(spark, sf))).select("doc", F.col("offset").cast("long").alias("offset_chars"), "path")


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, 'FIGBLOCK:\d+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_SLUG = "CASE WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'section' ELSE regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"


@query(
    f"""{_L}, {_HIDX}, {_PATH}, len AS (SELECT doc, length(markdown) AS n FROM docs), st AS (SELECT doc, pos AS a, level, {_CLEAN.format('title')} AS title FROM h UNION ALL SELECT len.doc, 0, 0, '' FROM len LEFT JOIN (SELECT doc, min(pos) AS f FROM h GROUP BY doc) q ON len.doc = q.doc WHERE f IS NULL OR f > 0)
SELECT st.doc, CAST(row_number() OVER w - 1 AS INT) AS section_idx, CAST(a AS BIGINT) AS start_at, CAST(coalesce(lead(a) OVER w, n) AS BIGINT) AS end_at, CAST(level AS INT) AS level, title, CASE WHEN title = '' THEN '' ELSE {_SLUG.format('title')} END AS slug FROM st JOIN len ON st.doc = len.doc WINDOW w AS (PARTITION BY st.doc ORDER BY a)"""
)
def n10_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    s = headings.sections(headings.heading_index(_lines(spark, sf)), d.select("doc", F.length("markdown").alias("length")))
    return s.select("doc", "section_idx", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "level", "title", "slug")


_PLAIN = r"""p AS (SELECT doc, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines), q AS (SELECT doc, line_no, length(regexp_extract(s, '^(#{1,6})\s+.*$', 1)) AS level, CASE WHEN regexp_extract(s, '^(#{1,6})\s+.*$', 1) <> '' THEN regexp_replace(regexp_replace(s, '^#{1,6}\s+', ''), '\s*#*\s*$', '') ELSE s END AS t FROM p WHERE s <> ''),
r AS (SELECT doc, line_no, level, CASE WHEN regexp_full_match(t, '\*\*.+\*\*') AND length(t) > 4 THEN trim(t[3:-3]) WHEN regexp_full_match(t, '__.+__') AND length(t) > 4 THEN trim(t[3:-3]) WHEN regexp_full_match(t, '\*.+\*') THEN trim(t[2:-2]) WHEN regexp_full_match(t, '_.+_') THEN trim(t[2:-2]) ELSE t END AS t FROM q)"""


@query(_L + ", " + _PLAIN + " SELECT doc, CAST(line_no AS INT) AS line_no, CAST(level AS INT) AS level, t AS heading FROM r WHERE level > 0")
def h01_plain(spark: SparkSession, sf: str) -> DataFrame:
    level, text = headings.plain(F.col("line"))
    x = _lines(spark, sf).select("doc", "line_no", level.alias("level"), text.alias("heading"), F.col("line"))
    return x.where("level > 0").select("doc", "line_no", "level", "heading")


_NUMS = _PLAIN + r""", n AS (SELECT doc, line_no, t, regexp_extract(t, '^([IVX]{1,5})\.\s+\S.*$', 1) AS rom, regexp_extract(t, '^([A-H])\.\s+\S.*$', 1) AS let, regexp_extract(t, '^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+\S.*$', 1) AS dec FROM r),
nn AS (SELECT *, list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], rom) AS rp, CASE WHEN dec <> '' THEN list_transform(string_split(dec, '.'), lambda e: CAST(e AS INT)) END AS parts FROM n),
k AS (SELECT doc, line_no, CASE WHEN rom <> '' AND rp > 0 THEN 'roman' WHEN let <> '' THEN 'letter' WHEN dec <> '' AND len(list_filter(parts, lambda e: e > 0 AND e <= 40)) = len(parts) THEN 'decimal' ELSE '' END AS scheme, rp, let, parts FROM nn),
num AS (SELECT doc, line_no, scheme, CASE scheme WHEN 'roman' THEN CAST(rp AS VARCHAR) WHEN 'letter' THEN CAST(ascii(let) - 64 AS VARCHAR) ELSE array_to_string(parts, '.') END AS number FROM k WHERE scheme <> '')"""


@query(_L + ", " + _NUMS + " SELECT doc, CAST(line_no AS INT) AS line_no, scheme, number FROM num")
def h02_numbers(spark: SparkSession, sf: str) -> DataFrame:
    x = _lines(spark, sf)
    _, text = headings.plain(F.col("line"))
    scheme, number = headings.parse_number(text)
    return x.select("doc", "line_no", scheme.alias("scheme"), F.array_join(F.transform(number, lambda p: p.cast("string")), ".").alias("number")).where("scheme <> ''")


@query("SELECT l_orderkey AS a, l_partkey % 9 + 1 AS b, l_linenumber AS c, ((l_partkey % 9 + 1 = l_suppkey % 9 + 1 AND l_linenumber < l_quantity AND l_quantity <= l_linenumber + 2)) AS follows FROM lineitem")
def h04_next_ok(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    prev = F.array((F.col("l_partkey") % 9 + 1).cast("int"), F.col("l_linenumber"))
    num = F.array((F.col("l_suppkey") % 9 + 1).cast("int"), F.col("l_quantity").cast("int"))
    return li.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") % 9 + 1).alias("b"), F.col("l_linenumber").alias("c"), headings.next_ok(prev, num).alias("follows"))


@query(_L + ", x AS (SELECT doc, line_no, CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END AS m FROM lines) SELECT doc, CAST(line_no AS INT) AS line_no, (sum(m) OVER (PARTITION BY doc ORDER BY line_no) % 2 = 1 OR m = 1) AS fenced FROM x")
def w09_fences(spark: SparkSession, sf: str) -> DataFrame:
    return headings.fence_state(_lines(spark, sf)).select("doc", "line_no", "fenced")


@query()
def h03_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return headings.normalize_headings(docs(spark, sf))


# --- text ---------------------------------------------------------------------------------------


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, to in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


_PLAINTEXT = _replaced(
    "markdown", (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", r"\1"), (r"_{1,3}([^_]+)_{1,3}", r"\1"), ("`([^`]+)`", r"\1"),
    (r"(?m)^[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


@query(f"WITH {DOCS_SQL} SELECT doc, {_PLAINTEXT} AS plain FROM docs")
def t13_plaintext(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc", T.strip_markdown(F.col("markdown")).alias("plain"))


@query(
    "WITH t AS (SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce(section, ''), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda t: t <> ''), lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' ') AS e FROM chunks) "
    "SELECT id, CASE WHEN e = '' THEN '\"\"' ELSE e END AS escaped FROM t"
)
def t12_fts_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.fts_query(F.coalesce("section", F.lit(""))).alias("escaped"))


@query("SELECT id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '> ' || x), chr(10)) AS quoted FROM chunks")
def t15_quote(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.quote_block(F.col("text")).alias("quoted"))


@query("WITH w AS (SELECT id, unnest(regexp_extract_all(lower(replace(text, '-' || chr(10), '')), '[a-z0-9]{2,}')) AS word FROM chunks) SELECT word, count(*) AS n FROM w GROUP BY word")
def t19_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || CAST(page_start AS INT) ELSE 'pp. ' || CAST(page_start AS INT) || '–' || CAST(page_end AS INT) END AS cite FROM chunks")
def t21_citation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.page_citation(F.col("page_start").cast("int"), F.col("page_end").cast("int")).alias("cite"))


@query("SELECT event_id, floor(datediff('microsecond', TIMESTAMP '2020-01-01', ts) / 60000000 / 60)::BIGINT || 'h' || lpad(CAST(floor(datediff('microsecond', TIMESTAMP '2020-01-01', ts) / 60000000)::BIGINT % 60 AS VARCHAR), 2, '0') || 'm' AS elapsed FROM events")
def t22_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.elapsed(F.lit("2020-01-01").cast("timestamp"), F.col("ts").cast("timestamp")).alias("elapsed"))


#: Loops and soup of texts b (k, text), from the description: every period, every island, its unit.
LOOPS = r"""w AS (SELECT k, regexp_extract_all(text, '\S+') AS w FROM b), t AS (SELECT k, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM w),
e AS (SELECT x.k, p, x.pos FROM t x CROSS JOIN range(1, 41) r(p) JOIN t y ON y.k = x.k AND y.pos = x.pos + p AND y.tok = x.tok),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY k, p ORDER BY pos) AS g FROM e),
i AS (SELECT k, p, min(pos) AS s FROM g GROUP BY k, p, g HAVING count(*) + p >= greatest(40, 8 * p)),
u AS (SELECT i.k FROM i JOIN t ON t.k = i.k AND t.pos >= i.s AND t.pos < i.s + i.p GROUP BY i.k, i.p, i.s HAVING bool_or(regexp_matches(tok, '[A-Za-z]')) AND NOT bool_or(tok = '|')),
h AS (SELECT k, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM t WHERE regexp_full_match(tok, '[A-Za-z]{1,2}')),
loops AS (SELECT k FROM u UNION SELECT k FROM h GROUP BY k, g HAVING count(*) >= 30)"""


@query(f"WITH b AS (SELECT doc_id AS k, text FROM documents), {LOOPS} SELECT k AS doc, k IN (SELECT k FROM loops) AS has_loop FROM b")
def t01_find_loops(spark: SparkSession, sf: str) -> DataFrame:
    return repair.find_loops(table(spark, sf, "documents"), "doc_id", "text")


@query()
def t05_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(_pages(spark, sf), "markdown")


# --- chunks -------------------------------------------------------------------------------------


@query(
    r"""WITH s AS (SELECT id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM chunks), t AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM s)
SELECT id, CASE WHEN contains(text, '**Figure description:**') OR regexp_matches(text, '!\[[^\]]*\]\([^)]+\)') THEN 'figure' WHEN starts_with(s, '---' || chr(10)) OR starts_with(s, '> **Classification:') THEN 'frontmatter'
WHEN len(regexp_extract_all(s, '(?m)^(?:- \[[0-9]+\]|[A-Z][a-z]+.*\([0-9]{4}\))')) >= 2 THEN 'references' WHEN regexp_matches(s, '(?mi)^#+ Abstract') THEN 'abstract' WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: starts_with(x, '|'))) * 2 > len(ls) THEN 'table' ELSE 'prose' END AS kind FROM t"""
)
def n04_classify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.content_type(F.col("text")).alias("kind"))


@query(r"SELECT id, regexp_replace(regexp_replace(regexp_replace(text, 'FIGBLOCK:\d+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS tidy FROM chunks")
def n03_clean_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.clean_metadata(F.col("text")).alias("tidy"))


@query("SELECT id, substring(sha1(source || '::' || 'section' || '::' || CAST(chunk_index AS VARCHAR) || '::' || coalesce(section_path, '')), 1, 16) AS stable_id FROM chunks")
def n11_stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.stable_id(F.col("source"), F.lit("section"), F.col("chunk_index"), F.coalesce("section_path", F.lit(""))).alias("stable_id"))


@query(f"SELECT DISTINCT section, {_SLUG.format('section')} AS slug FROM chunks WHERE section IS NOT NULL")
def n12_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("section is not null").select("section", T.heading_slug(F.col("section")).alias("slug")).distinct()


@query("SELECT id, coalesce(lag(id) OVER w, 0) AS before, coalesce(lead(id) OVER w, 0) AS after, count(*) OVER (PARTITION BY source, section_path) AS n FROM chunks WINDOW w AS (PARTITION BY source, section_path ORDER BY chunk_index, id)")
def n14_siblings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", F.struct("source", "section_path").alias("parent_id"), F.lit(0).alias("doc"), F.struct("chunk_index", "id").alias("o"), F.col("id").alias("chunk_id"))
    x = chunking.siblings(c.withColumn("chunk_id", F.col("chunk_id").cast("string")), "parent_id", "o")
    long = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0).cast("long"))
    return x.select("id", long("previous_chunk_id").alias("before"), long("next_chunk_id").alias("after"), F.col("section_chunk_count").alias("n"))


@query(
    r"""WITH d AS (SELECT doc_id, text, substring(text, 1, 2000) AS head FROM documents)
SELECT doc_id, regexp_extract(substring(head, 1, 500), '((?:19|20)[0-9]{2})', 1) AS doc_year, regexp_replace(regexp_extract(head, '(10\.[0-9]{4,}/\S+)', 1), '[.),]+$', '') AS doc_doi FROM d"""
)
def n05_metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    m = chunking.document_metadata(F.col("text"), F.lit("a.pdf"))
    return d.select("doc_id", m["doc_year"].alias("doc_year"), m["doc_doi"].alias("doc_doi"))


@query()
def n06_recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(docs(spark, sf), size=128)


@query()
def n06_chunks_with_places(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the page-marked documents with sections, pages, chart data and metadata."""
    return chunking.chunk_markdown(_marked(spark, sf), size=128)


@query(
    f"{_L}, {_HIDX}, {_PATH}, len AS (SELECT doc, length(markdown) AS n FROM docs), st AS (SELECT doc, pos AS a, level FROM h UNION ALL SELECT len.doc, 0, 0 FROM len LEFT JOIN (SELECT doc, min(pos) AS f FROM h GROUP BY doc) q ON len.doc = q.doc WHERE f IS NULL OR f > 0), "
    "se AS (SELECT st.doc, a, coalesce(lead(a) OVER (PARTITION BY st.doc ORDER BY a), n) AS b FROM st JOIN len ON st.doc = len.doc), "
    "c AS (SELECT se.doc, a, b, substring(markdown, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS t FROM se JOIN docs ON docs.doc = se.doc) SELECT doc, CAST(a AS BIGINT) AS start_at, CAST(len(regexp_extract_all(t, '\\S+')) AS BIGINT) AS tokens FROM c WHERE regexp_matches(t, '\\S')"
)
def n07_sections_covered(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of every section together hold as many tokens as the section (figure blocks count as they stand)."""
    d = docs(spark, sf)
    s = headings.sections(headings.heading_index(_lines(spark, sf)), d.select("doc", F.length("markdown").alias("length")))
    c = chunking.hierarchical(s, d, size=64)
    n = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    return c.groupBy("doc", F.col("start").cast("long").alias("start_at")).agg(F.sum(n).alias("tokens"))


def _book(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Page-marked documents whose blocks of a few words are headings, and the spans of a text layer that shows them:
    by their length in one of three sizes, some bold, the rest of the text in ten points."""
    ls = lines.explode_lines(_marked(spark, sf)).withColumn("n", F.size(F.filter(F.split("line", r"\s+"), lambda t: t != "")))
    head = (F.col("n").between(1, 5)) & F.col("line").rlike("^[A-Z][a-z]")
    marked = ls.select("doc", "line_no", F.when(head, F.concat(F.lit("# "), "line")).otherwise(F.col("line")).alias("line"))
    page = F.last(F.when(T.is_page_marker(F.col("line")), F.regexp_extract("line", r"(\d+)", 1).cast("int")), True).over(Window.partitionBy("doc").orderBy("line_no"))
    spans = ls.withColumn("page_no", page).where("n > 0 and page_no is not null").select(
        "doc", "page_no", "line_no", F.lit(0).alias("span_no"), F.col("line").alias("text"), F.when(head, F.element_at(F.array(F.lit(11.0), F.lit(14.0), F.lit(20.0)), F.col("n") % 3 + 1)).otherwise(10.0).alias("size"), F.when(F.col("n") % 2 == 0, "Sans-Bold").otherwise("Sans").alias("font"), F.lit(0).alias("flags"),
    )
    return marked, spans


@query()
def h05_font_levels(spark: SparkSession, sf: str) -> DataFrame:
    marked, spans = _book(spark, sf)
    return lines.implode_lines(headings.font_levels(marked, geometry.span_lines(spans)))


@query()
def n08_sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", "sentence", 256)


@query()
def n08_semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", "semantic", 256)


@query()
def n07_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    s = headings.sections(headings.heading_index(_lines(spark, sf)), d.select("doc", F.length("markdown").alias("length")))
    return chunking.hierarchical(s, d, size=128).drop("doc")


# --- scores -------------------------------------------------------------------------------------

_WC = "SELECT {k} AS doc, word, count(*) AS n FROM (SELECT {k}, unnest(regexp_extract_all(lower(replace({t}, '-' || chr(10), '')), '[a-z0-9]{{2,}}')) AS word FROM {f}) GROUP BY 1, 2"


@query(
    f"WITH {DOCS_SQL}, t AS ({_WC.format(k='ocr_id', t='markdown', f='ocr_results')}), o AS ({_WC.format(k='doc', t='markdown', f='docs')}), a AS (SELECT doc, sum(n) AS n FROM t GROUP BY doc), b AS (SELECT doc, sum(n) AS n FROM o GROUP BY doc), c AS (SELECT t.doc, sum(least(t.n, o.n)) AS n FROM t JOIN o ON t.doc = o.doc AND t.word = o.word GROUP BY t.doc) SELECT a.doc, round(c.n / a.n, 6) AS recall, round(c.n / b.n, 6) AS precision FROM a JOIN b ON a.doc = b.doc JOIN c ON a.doc = c.doc"
)
def e01_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = evaluate.word_counts(table(spark, sf, "ocr_results").where("markdown is not null"), "ocr_id", "markdown")
    x = evaluate.text_scores(t, evaluate.word_counts(docs(spark, sf), "doc", "markdown"))
    return x.select("doc", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    f"""{_L}, x AS (SELECT doc, line_no, {_S} AS s FROM lines), y AS (SELECT *, regexp_matches(s, '^\\|.*\\|$') AS bar FROM x), z AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM y),
r AS (SELECT doc, g, bool_or(regexp_matches(s, '^\\|[\\s:|-]*-[\\s:|-]*\\|$')) AS is_t, sum(CASE WHEN regexp_matches(s, '^\\|[\\s:|-]*-[\\s:|-]*\\|$') THEN 0 ELSE length(regexp_replace(s, '[^|]', '', 'g')) - 1 END) AS cells FROM z WHERE bar GROUP BY doc, g)
SELECT doc, count(*) AS tables, CAST(sum(cells) AS BIGINT) AS cells FROM r WHERE is_t GROUP BY doc"""
)
def e03_tables(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.tables(_lines(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT doc, len(regexp_extract_all(markdown, '!\\[[^\\]]*\\]\\([^)]+\\)'))::INT AS figures, len(regexp_extract_all(markdown, '\\*\\*Figure description:\\*\\*'))::INT AS described, len(regexp_extract_all(markdown, '<!-- chart-data:'))::INT AS charts, len(regexp_extract_all(markdown, '\\$[^$\\n]+\\$'))::INT AS latex FROM docs")
def e05_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.counts(docs(spark, sf), "doc", "markdown")


@query(
    f"""{_L}, x AS (SELECT doc, line_no, {_S} AS s FROM lines), y AS (SELECT *, coalesce(last_value(CASE WHEN contains(s, '**Figure description:**') THEN 1 WHEN s = '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS i FROM x)
SELECT doc, count(*) FILTER (WHERE i = 1 AND s <> '' AND NOT starts_with(s, '>')) AS leaked FROM y GROUP BY doc"""
)
def e06_leaked(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.leaked(_lines(spark, sf))


@query("SELECT model, round(sum(CAST(length(markdown) AS DOUBLE) * page_count) / sum(CASE WHEN markdown IS NOT NULL THEN page_count END), 6) AS mean_chars FROM ocr_results WHERE model IS NOT NULL GROUP BY model")
def e09_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "ocr_results").where("model is not null")
    return o.groupBy("model").agg(F.round(evaluate.weighted_mean(F.length("markdown").cast("double"), F.col("page_count")), 6).alias("mean_chars"))


@query(f"WITH {PAGES_SQL}, w AS (SELECT doc, page_no, len(regexp_extract_all(lower(replace(markdown, '-' || chr(10), '')), '[a-z0-9]{{2,}}')) AS n FROM pages) SELECT doc, count(*) AS text_pages FROM w WHERE n >= 20 GROUP BY doc")
def e12_text_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).where(F.size(T.words(F.col("markdown"))) >= 20).groupBy("doc").agg(F.count("*").alias("text_pages"))


@query(f"WITH {PAGES_SQL}, t AS (SELECT doc, page_no, regexp_replace(markdown, '^\\s+|\\s+$', '', 'g') AS s FROM pages), u AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS k FROM t) SELECT doc, page_no, CASE WHEN length(s) >= 200 AND (length(s) - length(replace(s, '�', ''))) * 100 <= length(s) AND len(list_filter(k, lambda x: regexp_matches(x, '[A-Za-zÀ-ÿ][^A-Za-zÀ-ÿ]*[A-Za-zÀ-ÿ]'))) * 2 >= len(k) THEN substring(s, 1, 12000) END AS layer FROM u")
def p06_text_layer(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("doc", F.col("page_no").cast("long").alias("page_no"), T.usable_text_layer(F.col("markdown")).alias("layer"))
