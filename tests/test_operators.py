"""Operators on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import charts, chunking, clean, evaluate, geometry, headings, ingest, lines, repair, search

PHRASE = "the quick report was read "


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, markdown string")


def cleaned(spark, op, text):
    return op(lines.explode_lines(docs(spark, text))).orderBy("line_no").select("line").toPandas()["line"].tolist()


# --- pages and lines ---


def test_join_and_split_pages(spark):
    p = spark.createDataFrame([("d", 2, "beta"), ("d", 1, "alpha"), ("d", 3, "gamma")], "doc string, page_no int, markdown string")
    assert lines.join_pages(p).first()["markdown"] == "alpha\n\nbeta\n\ngamma"
    marked = lines.join_pages(p, markers=True)
    assert marked.first()["markdown"].startswith("<!-- page: 1 -->\n\nalpha\n\n<!-- page: 2 -->")
    parts = rows(lines.split_pages(lines.explode_lines(marked)).select("page_no", "text"), "page_no")
    assert [x[0] for x in parts] == [1, 2, 3] and "beta" in parts[1][1]
    assert marked.select(T.strip_page_markers(F.col("markdown"))).first()[0] == "alpha\n\nbeta\n\ngamma"


def test_page_ranges_are_as_of(spark):
    text = "<!-- page: 1 -->\n\naaaa\n\n<!-- page: 2 -->\n\nbbbb"
    d = docs(spark, text, "no markers at all")
    index = lines.page_index(lines.explode_lines(d))
    second = text.index("<!-- page: 2")
    spans = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 3, second + 1), (0, 2, second, second + 3), (0, 3, 5, second), (1, 4, 0, 5)], "doc int, span_no int, start long, end long")
    got = rows(lines.page_ranges(spans, index.withColumn("offset", F.col("offset").cast("long"))).select("span_no", "page_start", "page_end"), "span_no")
    assert got == [(0, 1, 1), (1, 1, 2), (2, 2, 2), (3, 1, 1), (4, None, None)]


# --- cleanup ---


def test_classification_takes_the_highest(spark):
    text = "UNCLASSIFIED\n\nBody (U) stays.\n\nSECRET//NOFORN\n\nPage 2 of 9\nEnd."
    got = docs(spark, text).select(clean.classification(F.col("markdown"))).first()[0]
    assert got.startswith("> **Classification:** SECRET//NOFORN\n\n") and "Page 2" not in got and "(U)" in got
    assert docs(spark, "plain").select(clean.classification(F.col("markdown"))).first()[0] == "plain"


def test_repeating_lines_go_but_structure_stays(spark):
    text = "Journal of Tests\nBody one.\nJournal of Tests\n# Same\n# Same\n# Same\nA line of some length that comes, once\nA line of some length that comes, twice\nA line of some length that comes, thrice"
    assert cleaned(spark, clean.drop_repeating, text) == ["Body one.", "# Same", "# Same", "# Same"]


def test_page_numbers_need_a_blank_or_heading(spark):
    assert cleaned(spark, clean.drop_page_numbers, "text\n\n12\n\nxiv\nmore\n7\nend") == ["text", "", "", "more", "7", "end"]
    assert cleaned(spark, clean.drop_page_numbers, "7\na") == ["a"]


@pytest.mark.parametrize(
    "text, want",
    [("A\n\nSECRET//NOFORN\n\nB", "> **Classification:** SECRET//NOFORN\n\nA\n\nB"), ("SECRET//NOFORN\nThe plan begins now\nB", "> **Classification:** SECRET//NOFORN\n\nThe plan begins now\nB"), ("CUI\n\nUnclassified // FOUO, LIMDIS\nB", "> **Classification:** CUI\n\nB"),
     ("SECRET//LATER\nB", "SECRET//LATER\nB"), ("confidential//anything, here\nB", "> **Classification:** CONFIDENTIAL//ANYTHING, HERE\n\nB"), ("CUI//SP\nB", "CUI//SP\nB"), ("A\nPage 2 of 9\nB", "A\n\nB"), ("", "")],
)
def test_banners_are_lines(spark, text, want):
    assert docs(spark, text).select(clean.classification(F.col("markdown"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [("[![alt](a.png)](b) and ![x](y)", "alt and x"), ("[text]() stays", "[text]() stays"), ("a\n***\nb\n___\nc\n---\nd", "a\n\nb\n\nc\n\nd"), ("## Head\n**b** _i_ `c`", "Head\nb i c"), (" \n", "")],
)
def test_plain_text(spark, text, want):
    assert docs(spark, text).select(T.strip_markdown(F.col("markdown"))).first()[0] == want


def test_headings_are_renumbered_before_sentences_are_rejoined(spark):
    text = "1 Scope\n\nlower case goes on.\n\n1.1 Terms\n\nText.\n\n2 Rules\n\nText."
    got = clean.clean_documents(docs(spark, text)).first()["markdown"].split("\n")
    assert "## 1 Scope" in got and "### 1.1 Terms" in got and "lower case goes on." in got


def test_placeholders(spark):
    got = docs(spark, "Intro.\n\n![x](figure)\n\n![y](figure) Program ![z](figure) Frame\n\nEnd.").select(clean.placeholders(F.col("markdown"))).first()[0]
    assert got == "Intro.\n\nProgram Frame\n\nEnd."


def _greedy(ls):
    out, i = [], 0
    special = ("#", "-", "*", "|", ">", "```", "![", "(", "[")
    while i < len(ls):
        s = ls[i].strip()
        if s and not s.startswith(special) and s[-1] not in ".!?:;":
            j = i + 1
            while j < len(ls) and not ls[j].strip():
                j += 1
            if j < len(ls) and j - i <= 3 and ls[j].strip()[0].islower():
                out.append(s + " " + ls[j].strip())
                i = j + 1
                continue
        out.append(ls[i])
        i += 1
    return out


def test_rejoin_equals_a_greedy_pass_on_random_lines(spark):
    rng = np.random.default_rng(5)
    kinds = ["", "", "goes on", "Stops here.", "breaks off", "# head", "- item", "(see", "Upper case", "ends;"]
    texts = ["\n".join(rng.choice(kinds, rng.integers(1, 14))) for _ in range(300)]
    got = lines.implode_lines(clean.rejoin_sentences(lines.explode_lines(docs(spark, *texts))))
    assert dict(rows(got, "doc")) == {i: "\n".join(_greedy(t.split("\n"))) for i, t in enumerate(texts)}


# --- headings ---


def renumbered(spark, *texts):
    got = headings.normalize_headings(docs(spark, *texts))
    return [r["markdown"] for r in got.orderBy("doc").collect()]


def test_renumber_decimal_and_roman(spark):
    text = "Title\n\n1 Introduction\n\nText.\n\n1.1 Scope\n\nText.\n\n2 Method\n\n3. buy milk\n\n# Notes\n\nText."
    roman = "I. INTRODUCTION\n\nA. FIRST PART\n\nB. SECOND PART\n\nII. METHOD\n\nA. AGAIN"
    one, two, three, four, five = renumbered(spark, text, roman, "1 Only\n\ntext", None, "")
    got = one.split("\n")
    assert "## 1 Introduction" in got and "### 1.1 Scope" in got and "## 2 Method" in got and "3. buy milk" in got and "### Notes" in got
    assert two.count("### ") == 3 and two.count("## I") == 2
    assert three == "1 Only\n\ntext" and four is None and five == ""


def test_numbers_must_follow(spark):
    lists = "1 Scope\n\ntext\n\n2 Terms\n\ntext\n\n5 Too far\n\ntext\n\n3 Rules\n\nA. Letter without roman\n\nI. mixed case of a roman title here"
    skipped = "1 Scope\n\n1.2 One skipped\n\n1.4 Another\n\n1.4.1 Deep\n\n2 Next\n\nRELATED WORK\n\n## **3 Marked**"
    one, two = (x.split("\n") for x in renumbered(spark, lists, skipped))
    assert "5 Too far" in one and "## 3 Rules" in one and "A. Letter without roman" in one and "I. mixed case of a roman title here" in one
    assert [x for x in two if x.startswith("#")] == ["## 1 Scope", "### 1.2 One skipped", "### 1.4 Another", "#### 1.4.1 Deep", "## 2 Next", "## RELATED WORK", "## 3 Marked"]
    flags = rows(headings.is_numbered(lines.explode_lines(docs(spark, lists, "1 One\n\ntext"))), "doc")
    assert flags == [(0, True), (1, False)]


def test_title_run_into_its_text_and_fences(spark):
    text = "1 A\n\nx\n\n1.1 B\nThis paragraph has many more than eight words in it.\n\n2 C\n\n```\n3 D\n```"
    got = renumbered(spark, text)[0].split("\n")
    assert "### 1.1 B" in got and "3 D" in got


def test_breadcrumbs_and_sections(spark):
    text = "before\n# A\n## B\nx\n### C\n## D\n# E"
    ls = lines.explode_lines(docs(spark, text))
    idx = headings.heading_index(ls)
    assert [r[0] for r in rows(headings.breadcrumbs(idx).select("path", "offset"), "offset")] == ["A", "A > B", "A > B > C", "A > D", "E"]
    n = docs(spark, text).select("doc", F.length("markdown").alias("length"))
    s = rows(headings.sections(idx, n).select("start", "end", "title"), "start")
    assert s[0] == (0, 7, "") and s[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert headings.sections(idx, n, preamble=False).count() == 5


def test_tiers_by_anchor(spark):
    sizes = spark.createDataFrame([(1, float(x)) for x in (20, 19.5, 19.25, 19.0, 14)] + [(2, 11.0)], "doc int, size double")
    assert {(r["doc"], r["size"]): r["tier"] for r in headings.tiers(sizes).collect()} == {(1, 20.0): 20.0, (1, 19.5): 20.0, (1, 19.25): 20.0, (1, 19.0): 19.0, (1, 14.0): 14.0, (2, 11.0): 11.0}


def test_levels_by_font_size(spark):
    pages = [
        "# Field Guide to Testing\n\n# Getting Started\n\nText.",
        "# Planning Ahead\n\n# Choosing Tools\n\nText.\n\n```sh\n# install the tools\n```\n\n## Writing Cases\n\n# Chart Title Inside A Figure\n\nText.",
        "### Running Suites\n\n# Reading Results\n\nText.",
    ]
    text = "\n\n".join(f"<!-- page: {i} -->\n\n{p}" for i, p in enumerate(pages, 1))
    numbered = text.replace("# Getting", "# 1. Getting").replace("# Planning", "# 2. Planning").replace("### Running", "### 3. Running")
    shown = [[("Field Guide to Testing", 20, 0), ("Getting Started", 14, 16)], [("Planning", 14, 16), ("Ahead", 14, 16), ("Choosing Tools", 11, 16), ("Writing Cases", 11, 16)], [("Running Suites", 14.4, 16), ("Reading Results", 11, 16)]]
    spans = []
    for doc in (0, 1, 2):
        for page, heads in enumerate(shown, 1):
            for n, (t, size, flags) in enumerate(heads):
                spans.append((doc, page, 2 * n, 0, t, float(size), "Sans", flags))
                spans += [(doc, page, 100 + 10 * n + k, 0, "Ordinary body text set at ten points in the prose of the book.", 10.0, "Sans", 0) for k in range(8)]
    spans = spark.createDataFrame(spans, "doc int, page_no int, line_no int, span_no int, text string, size double, font string, flags int")
    d = docs(spark, text, numbered, "# A\n\n# B", "")
    got = dict(rows(lines.implode_lines(headings.font_levels(lines.explode_lines(d), geometry.span_lines(spans))), "doc"))
    assert [x for x in got[0].replace("# install the tools", "").split("\n") if x.startswith("#")] == [
        "# Field Guide to Testing", "## Getting Started", "## Planning Ahead", "### Choosing Tools", "### Writing Cases", "### Chart Title Inside A Figure", "## Running Suites", "### Reading Results",
    ]
    assert "```sh\n# install the tools\n```" in got[0] and got[1] == numbered and got[2] == "# A\n\n# B" and got[3] == ""


# --- repair ---


@pytest.mark.parametrize(
    "text, loop",
    [(PHRASE * 300, True), ("S. " * 400, True), ("$\\quad$ " * 200, True), ("S. T. " * 4, False), (PHRASE * 3, False), ("| [x] " * 60, False), ("0.0 " * 100, False), ("a b c d " * 200, True), ("alpha x|y " * 60, True), ("| --- " * 6000 + PHRASE * 40, True), ("", False), (None, False)],
)
def test_loops(spark, text, loop):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert repair.find_loops(df, "id", "text").first()["has_loop"] == loop == (repair.collapse_loops(text) != text)


def greedy(tokens):
    """The cuts of a plain scan from the left."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        j = i
        while j < n and len(tokens[j]) <= 2 and tokens[j].isalpha():
            j += 1
        best = (j, 0) if j - i >= repair.MIN_SOUP else None
        for p in range(1, repair.MAX_PERIOD + 1):
            if best or i + p >= n:
                break
            unit = tokens[i : i + p]
            k = i
            while k + p < n and tokens[k] == tokens[k + p]:
                k += 1
            if "|" not in unit and any(c.isalpha() for t in unit for c in t) and k - i + p >= max(repair.MIN_SPAN, repair.MIN_TIMES * p) and k > i:
                best = (k + p, p)
        if best:
            out.append((i, *best))
            i = best[0]
        else:
            i += 1
    return out


def test_cuts_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(400):
        tokens = []
        for _ in range(int(rng.integers(1, 4))):
            tokens += list(rng.choice(["alpha", "be", "42", "|", "c", "dd"], rng.integers(1, 6))) * int(rng.integers(1, 30)) + list(rng.choice(["x1", "yy", "zeta"], rng.integers(0, 4)))
        got = repair.cuts([str(t) for t in tokens])
        assert got == greedy([str(t) for t in tokens])
        hits += len(got)
    assert hits > 100


def test_recovery_of_a_looping_page():
    loop = "Start of it. " + PHRASE * 60
    asked = []

    def ask(what):
        asked.append(what)
        return {"left": "Left text.", "right": "Right text."}.get(what, loop)

    assert repair.recover(ask, lambda: ["left", "right"], lambda t: "") == "Left text.\n\nRight text." and asked == ["page", "page", "left", "right"]
    more = iter(["more words follow here " * 4 + ". " + " ".join(f"w{i}" for i in range(30)), "few"])
    assert repair.recover(lambda w: loop, list, lambda t: next(more)).startswith("Start of it.\nmore words")
    assert repair.recover(lambda w: "fine", list, lambda t: "") == "fine"


def test_collapse_keeps_one_unit():
    got = repair.collapse_loops("Start. " + "one two three. " * 50 + "End.")
    assert got.count("one two three.") == 1 and repair.CUT_NOTE in got and got.startswith("Start.") and got.endswith("End.")
    assert repair.clean_prefix("Start. " + "one two three. " * 50) == "Start."
    assert repair.collapse_loops(None) is None and repair.collapse_loops("") == ""


@pytest.mark.parametrize(
    "src, want",
    [("a $\\rightarrow$ b", "a → b"), ("$\\text{plain words}$", "plain words"), ("$\\textbf{bold}$ x", "**bold** x"), ("5$\\text{\\%}$", "5%"), ("$x^2 + y$", "$x^2 + y$"), ("costs $5 and $6", "costs $5 and $6"), ("`$\\quad$` and\n```\n$\\text{a}$\n```",) * 2,
     ("$\\text{A}\\quad 0.92$", "A 0.92"), ("losses of $\\text{\\$5}$ million", "losses of \\$5 million"), ("$$\\text{Total}\\qquad 42$$", "Total 42"), ("a $\\quad$ b", "a   b"), ("$\\square$ $\\S$ $\\uparrow$ $\\blacksquare$", "☐ § ↑ ■"),
     ("$\\alpha\\quad\\beta$", "$\\alpha \\beta$"), ("$\\operatorname{rank}$", "rank"), ("$$\\times$$",) * 2, ("$\\text{S}\\text{O}\\text{F}$", "SOF")],
)
def test_clean_latex(src, want):
    assert repair.clean_latex(src) == want


# --- chunks ---


def test_chunkers_keep_the_contract():
    text = "# A\n\nOne sentence here. Another one follows it. And a third.\n\n# B\n\n" + "word " * 50 + "\n"
    for cut in chunking.CHUNKERS.values():
        got = cut(text, 12)
        assert all(n <= 12 and len(text[a:b].split()) == n for a, b, n in got)
        assert "".join(text[a:b] for a, b, _ in got).split() == text.split()
        assert cut("", 5) == [] and cut(" \n ", 5) == []


def test_figures_are_never_cut(spark):
    block = "![plot](p.png)\n> **Figure description:** many words in here\n> and more"
    text = "Some text before it goes on.\n\n" + block + "\n\nText after."
    got = chunking.chunk_documents(docs(spark, text), size=6).collect()
    assert any(block in r["text"] for r in got) and not any("FIGBLOCK" in r["text"] for r in got)
    assert {r["content_type"] for r in got if block in r["text"]} == {"figure"}


def test_chunks_know_their_place(spark):
    figure = "![plot](p.png)\n> **Figure description:** many words in here\n> and more of them"
    note = '<!-- chart-data: {"chart_data": {"title": "T"}, "vega_lite_spec": null} -->'
    text = f"<!-- page: 4 -->\n\n# A Title\n\n{figure}\n\nSome text of the first page. More of it.\n\n<!-- page: 5 -->\n\n## Part\n\nText of the second page goes on. {note}"
    got = chunking.chunk_markdown(docs(spark, text, "no pages", None), size=8).orderBy("doc", "chunk_index").collect()
    mine = [r for r in got if r["doc"] == 0]
    # offsets are those of the document, so the text stands where they say
    assert all(r["text"].split()[-1] in text[r["start_index"] : r["end_index"]] for r in mine if r["text"].strip())
    assert {r["section"] for r in mine} <= {"", "A Title", "A Title > Part"}
    last = mine[-1]
    assert (last["page_start"], last["page_end"], last["doc_title"], last["section"]) == (5, 5, "A Title", "A Title > Part")
    assert last["has_structured_chart_data"] and last["chart_data"] == '{"title":"T"}' and mine[0]["page_start"] == 4 and "page:" not in mine[0]["text"]
    other = [r for r in got if r["doc"] == 1]
    assert len(other) == 1 and other[0]["page_start"] is None and not other[0]["has_structured_chart_data"]
    tree = chunking.chunk_markdown(docs(spark, text), strategy="hierarchical", size=8).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in tree] == list(range(len(tree))) and tree[-1]["page_start"] == 5 and tree[-1]["section"] == "Part"


def test_a_failing_embedder_falls_back(spark):
    def broken(sentence):
        raise RuntimeError("no model")

    text = "One sentence here. Another one follows it. And a third."
    got = chunking.chunk_documents(docs(spark, text), strategy="semantic", size=5, embed=broken).orderBy("chunk_index").collect()
    assert [(r["start_index"], r["end_index"], r["token_count"]) for r in got] == chunking.recursive_chunks(text, 5)
    seen = chunking.semantic_chunks(text, 50, embed=lambda s: [1.0, 0.0] if "One" in s else [0.0, 1.0])
    assert len(seen) == 2


def test_hierarchical_ids_and_siblings(spark):
    text = "# Course\nintro words\n## Metrics\n" + "alpha beta. " * 20
    d = docs(spark, text)
    s = headings.sections(headings.heading_index(lines.explode_lines(d)), d.select("doc", F.length("markdown").alias("length")))
    c = chunking.hierarchical(s, d, size=10).orderBy("section_idx", "section_chunk_index").collect()
    assert len({r["chunk_id"] for r in c}) == len(c) and c[0]["previous_chunk_id"] == ""
    inner = [r for r in c if r["section_path"].endswith("Metrics")]
    assert len(inner) > 1 and inner[0]["next_chunk_id"] == inner[1]["chunk_id"] and inner[0]["section_chunk_count"] == len(inner)


def test_document_metadata(spark):
    front = '---\ntitle: "A B"\nauthors: [Doe, Roe]\nyear: 2020\n---\ntext'
    plain = "# The Title\n\nJane Miller, Dept\n\nIn 1999, see 10.1234/ab.c)."
    df = spark.createDataFrame([(1, front, "x.pdf"), (2, plain, "x.pdf"), (3, "nothing", "Doe - 2001 - Long Title.pdf")], "id int, t string, s string")
    m = chunking.document_metadata(F.col("t"), F.col("s"))
    got = rows(df.select("id", *[m[k].alias(k) for k in ("doc_title", "doc_author", "doc_year", "doc_doi")]), "id")
    assert got == [(1, "A B", "Doe", "2020", ""), (2, "The Title", "Jane Miller", "1999", "10.1234/ab.c"), (3, "Long Title", "Doe", "2001", "")]


# --- search ---


def test_bm25_agrees_with_sqlite(spark):
    import sqlite3

    texts = ["page level report", "the report of the page", "level page level", "other words entirely", "Page-level: café report"] + [f"filler {i} words" for i in range(20)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(text, source, section)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("insert into f(rowid, text, source, section) values (?, ?, ?, ?)", [(i, t, "s", "one") for i, t in enumerate(texts)])
    c = spark.createDataFrame([(i, t, "s", "one") for i, t in enumerate(texts)], "id long, text string, source string, section string")
    c = c.union(spark.createDataFrame([(99, None, "", " -- ")], c.schema))
    con.execute("insert into f(rowid, text, source, section) values (99, '', '', ' -- ')")
    for q in ("report", "page-level", "page report", "cafe", "level-page-level"):
        want = {r[0]: -r[1] for r in con.execute("select rowid, bm25(f) from f where f match ?", [" ".join(f'"{t}"' for t in q.split())])}
        got = {r["id"]: r["score"] for r in search.bm25(c, search.phrases_of(q)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), q
    assert search.bm25(c, search.phrases_of("!!!")).count() == 0


def test_postings_agree_with_a_scan(spark, tmp_path):
    c = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(["a b a b", "b a", "c a b", "a a a"])], "id long, text string, source string, section string")
    search.build_postings(c, str(tmp_path / "p"), buckets=4)
    for p in ([["a", "b"]], [["a", "a"]], [["a"], ["b"]]):
        assert dict(rows(search.bm25_postings(spark, str(tmp_path / "p"), p), "id")) == pytest.approx(dict(rows(search.bm25(c, p), "id")))


def test_rank_fusion(spark):
    one = spark.createDataFrame([(1, 1, "text", 0), (2, 2, "text", 0), (3, 1, "semantic", 1), (2, 2, "semantic", 1)], "id long, rank int, method string, list_no int")
    got = search.fuse(one).orderBy(F.col("rrf_score").desc(), "first").select("id", "method", "rrf_score").collect()
    assert [r["id"] for r in got] == [2, 1, 3] and got[0]["method"] == "text+semantic" and abs(got[0]["rrf_score"] - 2 / 62) < 1e-12


def test_failed_ingests_leave_the_index_as_it_was(spark, tmp_path):
    ix = search.Index(spark, str(tmp_path), "lib")
    rows_ = spark.createDataFrame([(1, "a", "s", "threat report"), (2, "b", None, "other words"), (3, None, "s", "no source")], "id long, source string, section string, text string")
    assert ix.ingest(rows_) == 3 and ix.ingest(rows_.limit(0)) == 0
    (tmp_path / "index_name=lib" / "manifest" / "version=7").mkdir()  # not written whole
    (tmp_path / "index_name=lib" / "chunks" / "version=1").mkdir()
    assert ix._version() == 0 and ix.chunks().count() == 3
    assert ix.ingest(spark.createDataFrame([(9, None, "s", "again without source")], rows_.schema)) == 1
    assert sorted(r["id"] for r in ix.chunks().collect()) == [1, 2, 9]
    assert [r["id"] for r in ix.text_search([["again"]]).collect()] == [9] and ix.text_search([["no"]]).count() == 0
    scored = dict(rows(ix.text_search([["source"]]), "id"))
    assert scored == pytest.approx(dict(rows(search.bm25(ix.chunks(), [["source"]]), "id")))


def test_embedding_on_the_way_in_and_context(spark, tmp_path):
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    ix = search.Index(spark, str(tmp_path), "lib")
    c = spark.createDataFrame([(i, "a", i, "p", "s", t, k) for i, (t, k) in enumerate((("one threat", "prose"), ("![x](y.png)", "figure"), (None, "prose")))], "id long, source string, chunk_index int, parent_id string, section string, text string, content_type string")
    assert ix.ingest(c, embed) == 3
    assert [r["embedding"] for r in ix.chunks().orderBy("id").collect()] == [[10.0, 1.0], [11.0, 1.0], [0.0, 1.0]]
    got = ix.search("threat", mode="text", context=True).collect()
    assert [(r["id"], r["context_after"], r["section_context"], r["figure_context"]) for r in got] == [(0, "![x](y.png)", "![x](y.png)", "![x](y.png)")]
    assert {r["id"] for r in ix.search("threat", embed=embed, k=5).collect()} == {0, 1, 2}


def test_indexes_are_listed_with_totals(spark, tmp_path):
    schema = "id long, source string, section string, text string"
    assert search.indexes(spark, str(tmp_path / "none")).count() == 0
    search.Index(spark, str(tmp_path), "one").ingest(spark.createDataFrame([(1, "a", "", "x"), (2, None, "", "y")], schema))
    search.Index(spark, str(tmp_path), "two").ingest(spark.createDataFrame([(1, "a", "", "x")], schema))
    got = {(r["index_name"], r["source"], r["is_total"]): r["chunk_count"] for r in search.indexes(spark, str(tmp_path)).collect()}
    assert got == {("one", "a", False): 1, ("one", None, False): 1, ("one", None, True): 2, ("two", "a", False): 1, ("two", None, True): 1}
    assert search.Index(spark, str(tmp_path / "x.db"), "any").where.endswith("x.db")


def test_term_buckets_agree(spark):
    words = ["a", "threat", "café", "日本", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", search._bucket(F.col("w"), 64).alias("b"))
    assert {r["w"]: r["b"] for r in df.collect()} == {w: search.term_bucket(w, 64) for w in words}


def test_section_context_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    data = [(i, rng.choice("ab"), rng.choice(["p", "q", "", None]), rng.randrange(12), f"t{i}") for i in range(120)]
    c = spark.createDataFrame(data, "id long, source string, parent_id string, chunk_index int, text string")
    got = dict(rows(search.section_context(c.select("id", "source", "parent_id", "chunk_index"), c), "id"))
    for i, s, p, k, _ in data:
        near = sorted((abs(x[3] - k), x[3], x[0], x[4]) for x in data if p and x[1:3] == (s, p) and x[0] != i)[:4]
        assert got[i] == "\n\n".join(x[3] for x in near)


def test_index_ingest_and_search(spark, tmp_path):
    ix = search.Index(spark, str(tmp_path), "lib")
    with pytest.raises(FileNotFoundError):
        ix.chunks()
    schema = "id long, source string, section string, text string, content_type string, embedding array<float>"
    ix.ingest(spark.createDataFrame([(1, "a", "s", "threat report", "prose", [1.0, 0.0]), (2, "b", "s", "other", "references", [0.9, 0.1])], schema))
    ix.ingest(spark.createDataFrame([(3, "a", "s", "threat news", "abstract", [0.0, 1.0])], schema))
    assert sorted(r["id"] for r in ix.chunks().collect()) == [2, 3]
    assert [r["id"] for r in ix.search("threat", mode="text").collect()] == [3]
    assert {r["id"] for r in ix.search("threat", [1.0, 0.0], k=2).collect()} == {2, 3}


# --- ingest ---


def test_validation(spark):
    df = spark.createDataFrame([(0, 0, 10, ""), (1, 5, None, "short"), (2, None, None, " "), (3, 10, 12, "x" * 500), (4, 3, 3, "x" * 99), (5, 3, None, "x" * 99)], "i int, p int, e int, t string")
    e, w = ingest.validate(F.col("p"), F.col("e"), F.col("t"))
    got = rows(df.select("i", e.isNotNull(), w.isNotNull()), "i")
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, False, True), (4, False, False), (5, False, False)]


def test_output_stems(spark):
    f = spark.createDataFrame([("/a/r.pdf", "h1"), ("/lib/r.pdf", "h2222222222"), ("/z/r.pdf", "h1"), ("/y/lib/r.pdf", "h3333333333")], "path string, pdf_hash string")
    assert dict(rows(ingest.output_stems(f), "path")) == {"/a/r.pdf": "r", "/lib/r.pdf": "r (lib)", "/z/r.pdf": "r", "/y/lib/r.pdf": "r (h3333333)"}


def test_names_and_env(spark):
    served = spark.createDataFrame([("host/m1",), ("x/m2",), ("y/m2",)], "id string")
    alias = spark.createDataFrame([("fast", "host/m1")], "alias string, id string")
    names = spark.createDataFrame([("host/m1",), ("fast",), ("m1",), ("m2",), ("no",)], "name string")
    assert dict(rows(ingest.resolve_names(names, served, alias), "name")) == {"host/m1": "host/m1", "fast": "host/m1", "m1": "host/m1", "m2": None, "no": None}
    assert ingest.only_served(served).first()[0] is None and ingest.only_served(served.limit(1)).first()[0] is not None
    assert spark.range(1).select(ingest.env_int(F.lit("x"), 3), ingest.env_flag(F.lit("OFF"), True), T.base_url(F.lit(" http://h/v1/ "))).first()[:] == (3, False, "http://h")


def test_base64_and_retry(spark):
    import base64

    b = base64.b64encode(b"abc").decode()
    df = spark.createDataFrame([(f"data:image/png;base64,{b}",), (b[:2] + "\n" + b[2:],), ("abc",)], "t string")
    assert [r[0] for r in df.select(ingest.base64_bytes(F.col("t"))).collect()] == [b"abc", b"abc", None]
    from docmill.sources.files import with_retry

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert with_retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)


# --- charts ---


def test_chart_json():
    assert charts.first_json('x {"a": "}{", "b": {"c": 1}} y {') == '{"a": "}{", "b": {"c": 1}}'
    prose, chart = charts.split_chart_json('Bars.\n---\n**CHART_JSON:**\n{"title": "T"}')
    assert prose == "Bars." and chart == {"title": "T"}
    assert charts.parse_reply('CHART_JSON: {"a": 1} then CHART_JSON: {"b": 2}') == {"b": 2}
    assert charts.split_chart_json("none")[1] is None and charts.parse_reply("{bad") is None


def test_grounding(spark):
    def chart(*ys):
        return {"figure_type": "bar_chart", "title": "t", "x_axis": None, "y_axis": None, "table": None, "series": [{"name": "s", "points": [{"x": "a", "y": y, "label": None} for y in ys]}], "confidence": "exact", "notes": None}

    schema = f"i int, c {charts.CHART}, p string"
    data = [(0, chart("7", "15"), "Venues 7 15 10"), (1, chart("0.33", "0.2"), "33% 20%"), (2, chart("7", "9"), "7 15"), (3, chart("7"), None), (4, chart("~15"), "15")]
    df = spark.createDataFrame(data, schema).withColumn("n", charts.normalize(F.col("c")))
    assert [r[1] for r in rows(df.select("i", charts.ground(F.col("n"), F.col("p"))), "i")] == ["exact", "exact", "estimated", "estimated", "estimated"]


def test_injection(spark):
    d = spark.createDataFrame([(1, "A ![x](dir/i (1).png)\n\n\nB ![y](j.png)"), (2, "plain"), (3, None)], "doc int, markdown string")
    reply = 'Line one.\n\n- a list\n---\n**DATA:**\n| a |\nCHART_JSON:\n{"figure_type": "bar_chart", "confidence": "exact", "series": [{"name": "s", "points": [{"x": "a", "y": "9.0"}]}]}'
    told = spark.createDataFrame([(1, "i (1).png", reply, "only 7 printed"), (1, "j.png", "[Image description unavailable: x]", None), (9, "k.png", "none", None)], "doc int, image_id string, description string, printed string")
    got = dict(rows(charts.inject(d, told), "doc"))
    assert got[2] == "plain" and got[3] is None
    assert got[1].startswith("A ![x](dir/i (1).png)\n> **Figure description:** Line one.\n>\n> - a list") and got[1].endswith("-->\n\nB ![y](j.png)")
    assert "\n> | a |\n" in got[1] and "confidence=estimated" in got[1] and "values are not all printed" in got[1] and "> | s | a | 9.0 |  |" in got[1]
    found = rows(charts.images_with_charts(docs(spark, got[1])).select("image"), "image")
    assert found == [("dir/i (1).png",)]


def test_normal_forms_of_values(spark):
    forms = [("1,234.50", "1234.5"), ("007", "7"), ("~1,000", "~1000"), (" a  b ", "a b"), ("7.00", "7.0"), ("+5", "5"), ("-0.10", "-0.1"), ("", ""), (None, None), ("0", "0"), ("~x", "~x")]
    df = spark.createDataFrame(forms, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", charts.value(F.col("t")).alias("got")).collect())


# --- geometry and scores ---


def test_regions_in_reading_order():
    ink = np.zeros((60, 100), bool)
    ink[2:6, 20:80] = True
    ink[12:55, 5:45] = True
    ink[12:55, 55:95] = True
    got = geometry.page_regions(ink)
    assert len(got) == 3 and got[0][3] <= got[1][1] + 1 and got[1][0] < got[2][0]
    pie = np.zeros((40, 100), bool)
    pie[5:35, 30:70] = True
    assert geometry.page_regions(pie) == [] and geometry.page_regions(np.zeros((5, 5))) == []
    pie[39, 30:70] = True  # something below: cut at the gap
    assert geometry.page_regions(pie) == [(0, 0, 100, 37.0), (0, 37.0, 100, 40)]


def test_columns_share_a_gutter_and_slivers_join():
    ink = np.zeros((200, 100), bool)
    for a, b in ((0, 60), (66, 130), (136, 190)):  # three bands of two columns
        ink[a:b, 4:45] = ink[a:b, 55:96] = True
    ink[196:199, 10:90] = True  # a footer across the page
    got = geometry.page_regions(ink)
    assert [(x[0], x[2]) for x in got] == [(0, 49.5), (49.5, 100), (0, 100)] and got[0][1:4:2] == got[1][1:4:2] == (0, 190)
    assert geometry.gutter_of(ink[:10]).sum() == 0  # too few rows to have columns
    ink[:, 55:96] = False
    assert not geometry.gutter_of(ink[:60]).any()  # no ink on one side


def test_merging_to_a_fixpoint(spark):
    assert geometry.merge_rects([(0, 0, 1, 1), (10, 0, 11, 1), (5, 0, 6, 1)], 5) == [(0, 0, 11, 1)]
    r = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 3.0, 0.0, 4.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert geometry.merge_by_page(r).count() == 2


def test_heading_match_and_order(spark):
    truth = spark.createDataFrame([(d, i, t, k) for d in (1, 2, 3) for i, (t, k) in enumerate((("1 Intro", 1), ("1.1 Scope", 2), ("2 Method", 1)))], "doc int, seq int, text string, depth int")
    found = spark.createDataFrame([(1, 0, "1 intro", 2), (1, 5, "1.1 Scope", 3), (1, 7, "2 Method", 2), (2, 1, "1 Intro", 2), (2, 3, "2 Method", 3), (2, 9, "1.1 Scope", 3)], "doc int, line_no int, text string, level int")
    got = {r["doc"]: (r["matched"], round(r["recall"], 6), r["hierarchy"]) for r in evaluate.heading_match(truth, found).collect()}
    assert got == {1: (3, 1.0, 1.0), 2: (2, 0.666667, 1.0), 3: (0, 0.0, 1.0)}
    assert evaluate.order_similarity("alpha beta gamma", "alpha beta gamma") == 1.0


def test_heading_truth_is_strict(spark):
    ls = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1 Intro", "3 Too far", "1.1 Scope", "2 items were", "2.2 Skipped", "2.1 Next", "3 Method", "I. ROMAN"])], "doc int, line_no int, line string")
    want = spark.createDataFrame([(1, ["decimal"])], "doc int, schemes array<string>")
    assert rows(evaluate.heading_truth(ls, want).select("seq", "text", "depth"), "seq") == [(0, "1 Intro", 1), (1, "1.1 Scope", 2), (2, "2 items were", 1), (3, "2.1 Next", 2), (4, "3 Method", 1)]


def test_roll_ups(spark):
    m = spark.createDataFrame([("a", "x", 10, 0.5, 4, 0.5, 1.0, 2), ("b", "x", 30, 0.9, 10, 0.8, 0.5, 3), ("c", "y", 0, 0.3, 0, 0.0, 1.0, 4)], "doc string, tool string, pages int, recall double, n_headings int, h_recall double, h_hierarchy double, tables int")
    got = {r["tool"]: r for r in evaluate.roll_up(m, ["tool"], ["recall"], totals=["tables"]).collect()}
    assert got["x"]["recall"] == pytest.approx(0.8) and got["x"]["tables"] == 5 and got["x"]["h_recall"] == pytest.approx(10 / 14) and got["x"]["h_hierarchy"] == pytest.approx((1 * 1.0 + 7 * 0.5) / 8)
    assert got["y"]["recall"] is None
    assert rows(evaluate.with_total(m, "doc", ["tables"]), "tables")[-1] == ("total", 9)


def test_other_tools_outputs(spark):
    d = spark.createDataFrame([(1, "a<!-- page break -->b"), (2, "c")], "doc int, t string")
    assert rows(evaluate.pages_at_breaks(d, "doc", "t"), "doc", "page_no") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    cells = spark.createDataFrame([(1, 0, 0, 1, "y"), (1, 0, 0, 0, "x"), (1, 0, 1, 0, "z")], "doc int, table_no int, row int, col int, text string")
    assert rows(evaluate.table_cells(cells).select("row", "cells"), "row") == [(0, ["x", "y"]), (1, ["z"])]


def test_empty_inputs(spark):
    none = docs(spark, "x").limit(0)
    assert clean.clean_documents(none).count() == 0
    assert lines.join_pages(lines.pages(spark.createDataFrame([], "id int, p array<string>"), "id", "p")).count() == 0
    assert chunking.chunk_documents(none).count() == 0
    assert evaluate.tables(lines.explode_lines(none)).count() == 0
    assert repair.find_loops(none, "doc", "markdown").count() == 0


def test_heading_style_of_all_lines_equals_brute_force(spark, tmp_path):
    import random

    from docmill.plans.more_plans import _spans, j15_heading_style

    rng = random.Random(3)
    words = ["ab", "abab", "part", "partlist", "partlistab", "listab", "hot plate"]
    parts = [(i, f"Brand#{i % 4}", rng.choice(words), rng.randrange(1, 50)) for i in rng.sample(range(1, 400), 200)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["doc"], r["key"]): r["size"] for r in j15_heading_style(spark, str(tmp_path)).collect()}
    by_doc = {}
    for r in geometry.span_lines(_spans(spark, str(tmp_path))).orderBy("page_no", "line_no").collect():
        by_doc.setdefault(r["doc"], []).append(r)
    want, joined = {}, 0
    for doc, lines_ in by_doc.items():
        for head in {x["key"] for x in lines_}:
            for i, x in enumerate(lines_):
                runs = ["".join(y["key"] for y in lines_[i : i + n]) for n in range(1, 5) if i + n <= len(lines_)]
                if (head in runs or len(head) >= 8 and x["key"].startswith(head)) and (x["size"] > 8 or x["bold"] and x["size"] >= 8):
                    want[doc, head] = max(want.get((doc, head), 0), x["size"])
                    joined += head in runs[1:]
    assert joined and {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_rectangles_of_all_rows_are_read(spark, tmp_path):
    from docmill.plans import chart_plans

    rows_ = [(1, 1, 5, 1, 30.0, "A"), (1, 2, 300, 1, 30.0, "N"), (2, 1, 300, 50, 30.0, "R")]
    spark.createDataFrame(rows_, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert chart_plans.g02_merged_rects(spark, str(tmp_path)).count() == 3
    assert chart_plans.k04_reading_order(spark, str(tmp_path)).count() == 3
