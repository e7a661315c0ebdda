"""PDF files read page by page. A reader library is needed where these run; without it they say so."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import usable_text_layer
from docmill.operators.figures import PAGE, is_blank

#: Names of typewriter fonts; render mode of invisible text; fixed values.
_MONO = re.compile(r"mono|courier|consol|menlo|code|typewriter", re.I)
_HIDDEN = 3
#: Dots an inch of a page that is transcribed, of one whose ink is looked at, and of a crop that is tried for ink.
PAGE_DPI, INK_DPI, BLANK_DPI = 200, 50, 36


def library():
    """The PDF library, or an error that names it."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF pages needs the package pymupdf on every executor") from e
    return pymupdf


def _per_file(files: DataFrame, schema: str, read: Callable[[object, str], Iterator[tuple]]) -> DataFrame:
    """Rows that read(document, name) gives for every file (path, content); a file that cannot be opened gives none."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = library()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    doc = pdf.open(stream=bytes(content), filetype="pdf")
                except Exception:  # noqa: BLE001  (page_counts tells which)
                    continue
                with doc:
                    for row in read(doc, path):  # one page at a time is held
                        yield pd.DataFrame([row], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def page_counts(files: DataFrame) -> DataFrame:
    """``path``, ``page_count``: null where a file cannot be read, or no library is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = []
            for content in b["content"]:
                try:
                    with library().open(stream=bytes(content), filetype="pdf") as doc:
                        counts.append(doc.page_count)
                except Exception:  # noqa: BLE001  (null says so)
                    counts.append(None)
            yield pd.DataFrame({"path": b["path"], "page_count": pd.array(counts, dtype="Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, page_count int")


def rasterize(files: DataFrame, dpi: int = PAGE_DPI) -> DataFrame:
    """``doc``, ``page_no``, ``png`` of every page, in colour without transparency."""

    def read(doc, path: str) -> Iterator[tuple]:
        for page in doc:
            yield path, page.number + 1, page.get_pixmap(matrix=library().Matrix(max(dpi, 1) / 72, max(dpi, 1) / 72), alpha=False).tobytes("png")

    return _per_file(files, "doc string, page_no int, png binary", read)


def text_layers(files: DataFrame) -> DataFrame:
    """``doc``, ``page_no``, ``text_layer``: the text of every page, words joined over line ends; null where it can't be
    trusted."""

    def read(doc, path: str) -> Iterator[tuple]:
        for page in doc:
            yield path, page.number + 1, page.get_text("text", flags=library().TEXT_DEHYPHENATE | library().TEXT_PRESERVE_WHITESPACE)

    x = _per_file(files, "doc string, page_no int, text string", read)
    return x.select("doc", "page_no", usable_text_layer(F.col("text")).alias("text_layer"))


def span_rows(files: DataFrame) -> DataFrame:
    """Font spans of every page without an invisible text layer, as geometry.span_lines takes them."""

    def read(doc, path: str) -> Iterator[tuple]:
        for page in doc:
            if _hidden(page):
                continue
            lines = [ln for b in page.get_text("dict")["blocks"] for ln in b.get("lines", ())]
            for n, ln in enumerate(lines):
                for k, s in enumerate(s for s in ln["spans"] if s["text"].strip()):
                    yield path, page.number + 1, n, k, s["text"], float(s["size"]), s["font"], int(s["flags"])

    return _per_file(files, "doc string, page_no int, line_no int, span_no int, text string, size double, font string, flags int", read)


def _box(r) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, r)))


def _hidden(page) -> list[dict]:
    """Invisible text, if it is half of the page's text or more."""
    trace = page.get_texttrace()
    own = [_box(s["bbox"]) | {"chars": len(s["chars"])} for s in trace if s["type"] == _HIDDEN]
    return own if own and 2 * sum(s["chars"] for s in own) >= sum(len(s["chars"]) for s in trace) else []


def page_objects(files: DataFrame) -> DataFrame:
    """Pages with their objects (figures.PAGE)."""

    def read(doc, path: str) -> Iterator[tuple]:
        for page in doc:
            drawings = page.get_drawings()
            shown = [any(c is not None and min(c) < 0.97 for c in (d.get("fill"), d.get("color"))) for d in drawings]
            lines = []
            for n, b in enumerate(b for b in page.get_text("dict")["blocks"] if b.get("type") == 0):
                for ln in b["lines"]:
                    mono = sum(len(s["text"]) for s in ln["spans"] if s["flags"] & 8 or _MONO.search(s["font"]))
                    lines.append(_box(ln["bbox"]) | {"text": "".join(s["text"] for s in ln["spans"]), "mono": mono, "block": n})
            chars = sum(len(s["chars"]) for s in page.get_texttrace())
            yield (
                path, page.number + 1, page.rect.width, page.rect.height, [_box(i["bbox"]) for i in page.get_image_info()], [_box(d["rect"]) | {"shown": s} for d, s in zip(drawings, shown)],
                [_box(r) for r in page.cluster_drawings()], [_box(t.bbox) for t in page.find_tables().tables], lines, _hidden(page), chars,
            )

    return _per_file(files, PAGE, read)


def crops(files: DataFrame, regions: DataFrame, dpi: int = PAGE_DPI) -> DataFrame:
    """``doc``, ``page_no``, ``name``, ``content``: regions (doc, page_no, name, x0, y0, x1, y1) rendered, empty paper left out."""
    own = regions.groupBy("doc").agg(F.collect_list(F.struct("page_no", "name", "x0", "y0", "x1", "y1")).alias("r"))
    x = files.join(own, files["path"] == own["doc"]).select("path", "content", "r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        pdf = library()
        for b in batches:
            for path, content, wanted in zip(b["path"], b["content"], b["r"]):
                with pdf.open(stream=bytes(content), filetype="pdf") as doc:
                    for r in wanted:
                        page, clip = doc[r["page_no"] - 1], pdf.Rect(r["x0"], r["y0"], r["x1"], r["y1"])
                        if not is_blank(np.frombuffer(page.get_pixmap(dpi=BLANK_DPI, clip=clip, colorspace=pdf.csGRAY, alpha=False).samples, np.uint8)):
                            yield pd.DataFrame([(path, r["page_no"], r["name"], page.get_pixmap(dpi=dpi, clip=clip).tobytes("png"))], columns=["doc", "page_no", "name", "content"])

    return x.mapInPandas(run, "doc string, page_no int, name string, content binary")
