"""Column functions on text. All stay inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The comment that marks where a page begins; the label can be changed by callers that write files.
PAGE_LABEL = "page"
FENCE = "```"


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: what is used several times in an expression on arrays is not
    shared by the engine."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def page_marker(page_no: Column) -> Column:
    return F.concat(F.lit(f"<!-- {PAGE_LABEL}: "), page_no.cast("string"), F.lit(" -->"))


def is_page_marker(line: Column) -> Column:
    return line.rlike(rf"^[ \t]*<!--\s*{PAGE_LABEL}:\s*\d+\s*-->[ \t]*$")


def strip_page_markers(text: Column) -> Column:
    """Drop marker lines, close the gaps they leave, and trim newlines; texts without one stay as they are."""
    bare = F.regexp_replace(text, rf"(?m)^[ \t]*<!--[ \t]*{PAGE_LABEL}:[ \t]*\d+[ \t]*-->[ \t]*\n?", "")
    closed = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when(F.contains(text, F.lit(f"<!-- {PAGE_LABEL}:")), closed).otherwise(text)


#: A link or a picture, of which its text stays; applied twice, as a link can hold a picture.
_LINK = r"!\[([^\]]*)\]\([^)]+\)|\[([^\]]+)\]\([^)]+\)"
#: Pairs of marks around a run of text without them.
_PAIRS = {"*": r"\*{1,3}", "_": "_{1,3}", "`": "`"}


def strip_markdown(text: Column) -> Column:
    """Markdown as plain text: pictures and links as their text, no heading marks, emphasis, inline code marks or
    rules; runs of blank lines closed. A picture or link without a target stays as it is."""
    for _ in range(2):
        text = F.regexp_replace(text, _LINK, "$1$2")
    text = F.regexp_replace(text, r"(?md)^#{1,6}\s+", "")
    for mark, run in _PAIRS.items():
        text = F.regexp_replace(text, f"{run}([^{mark}]+){run}", "$1")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?md)^[-*_]{3,}\s*$", ""), r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    """Runs of two or more lower-case letters or digits, words broken at a line end joined."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("-\n"), F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)


def fts_query(query: Column) -> Column:
    """Each term of a query quoted, so that operators in it are plain words; '""' for a blank one."""
    terms = F.filter(F.split(F.regexp_replace(query, r"^\s+|\s+$", ""), r"\s+"), lambda t: t != "")
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " ")
    return F.when(quoted == "", F.lit('""')).otherwise(quoted)


def clean_metadata(text: Column) -> Column:
    """Without control characters and held-out block names, white space collapsed."""
    for pattern, to in ((r"\x00FIGBLOCK:\d+\x00", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), (r"FIGBLOCK:\d+", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def heading_slug(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts, joined by '::'."""
    return F.substring(F.sha1(F.concat_ws("::", *[p.cast("string") for p in parts])), 1, 16)


def base_url(url: Column) -> Column:
    """Without white space, trailing slashes and one trailing /v1."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(url), "/+$", ""), "/v1$", ""), "/+$", "")


def percent_encode(path: Column) -> Column:
    """Percent-encoded path; slashes and tildes stay."""
    s = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def quote_block(text: Column) -> Column:
    """Every line as a line of a block quote."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n")


def page_citation(start: Column, end: Column) -> Column:
    """'p. 3', 'pp. 3–4', or null."""
    return F.when(start.isNull(), F.lit(None).cast("string")).when(end.isNull() | (end == start), F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string")))


def elapsed(start: Column, end: Column) -> Column:
    """Time between two stamps as 'HhMMm'."""
    minutes = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000)
    return F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60)


def content_type(text: Column) -> Column:
    """The kind of a chunk by its form: figure, frontmatter, references, abstract, table or prose.

    The lines are looked at once; the first kind whose test holds counts.
    """
    def kind(lines: Column) -> Column:
        entries = F.size(F.filter(lines, lambda x: x.rlike(r"^- \[[0-9]+\]|^[A-Z][a-z]+.*\([0-9]{4}\)")))
        bars = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("|"))))
        first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        tests = {
            "frontmatter": ((first == "---") & (F.size(lines) > 1)) | F.startswith(first, F.lit("> **Classification:")),
            "references": entries >= 2,
            "abstract": F.exists(lines, lambda x: x.rlike(r"(?i)^#+ Abstract")),
            "table": 2 * bars > F.size(lines),
        }
        return F.coalesce(*(F.when(holds, name) for name, holds in tests.items()), F.lit("prose"))

    figure = F.contains(text, F.lit("**Figure description:**")) | text.rlike(r"!\[[^\]]*\]\([^)]+\)")
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != "")
    return F.when(figure, "figure").when(text.isNull(), "prose").otherwise(let(lines, kind))


def usable_text_layer(text: Column, least: int = 200, most: int = 12_000) -> Column:
    """The text layer of a page where it can be trusted, cut to `most` characters, else null: long enough,
    few replacement characters, and half of its tokens words."""
    s = strip(text)
    tokens = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    wordy = F.size(F.filter(tokens, lambda t: t.rlike("[A-Za-zÀ-ÿ][^A-Za-zÀ-ÿ]*[A-Za-zÀ-ÿ]")))
    bad = F.length(s) - F.length(F.replace(s, F.lit("�"), F.lit("")))
    ok = (F.length(s) >= least) & (bad * 100 <= F.length(s)) & (wordy * 2 >= F.size(tokens))
    return F.when(ok, F.substring(s, 1, most))


def title_ok(title: Column, capitals: Column | bool = False) -> Column:
    """Whether a text can be a heading: 1 to 15 words, at most 120 characters, no closing comma or stop, a
    capital or figure first. Where capitals is true four of five letters must be capitals."""
    n = F.size(F.filter(F.split(title, r"\s+"), lambda t: t != ""))
    fits = (n >= 1) & (n <= 15) & (F.length(title) <= 120) & ~title.rlike(r"[.,;]\s*$") & title.rlike(r"^[\p{Lu}0-9]")
    loud = F.regexp_count(title, F.lit(r"\p{Lu}")) * 5 >= F.regexp_count(title, F.lit(r"\p{L}")) * 4
    return fits & (~(F.lit(capitals) if isinstance(capitals, bool) else capitals) | loud)
