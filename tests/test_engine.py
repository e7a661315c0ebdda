"""Whole jobs on small tables."""

from docmill.engine import Engine
from docmill.operators import figures


def test_from_pages_to_search(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "ix"))
    pages = [("a", 1, "Running head\n\n1 Scope of the threat report\n\nThe text breaks off at this line and\n\ngoes on below with $\\text{words}$ of the threat."), ("a", 2, "Running head\n\n1.1 Parts\n\nText of the part.\n\n2 Rules\n\n![figure](figure)\n\nFigure 2: A photo."), ("b", 1, None), ("c", 1, "x")]
    pages = spark.createDataFrame(pages, "doc string, page_no int, markdown string")
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 3)], "doc string, page_count int")
    photo = {"doc": "a", "page_no": 2, "width": 612.0, "height": 792.0, "images": [{"x0": 150.0, "y0": 150.0, "x1": 450.0, "y1": 350.0}], "lines": [{"x0": 150.0, "y0": 380.0, "x1": 300.0, "y1": 389.0, "text": "Figure 2: A photo.", "mono": 0, "block": 1}]}
    objects = spark.createDataFrame([photo], figures.PAGE)
    told = spark.createDataFrame([("a", "p002-f01.png", "A photo of a threat.", None)], "doc string, image_id string, description string, printed string")
    done = engine.convert(pages, expected, objects=objects, descriptions=told, preserve_pages=True)
    got = {r["doc"]: r for r in done.collect()}
    text = got["a"]["markdown"]
    assert got["a"]["error"] is None and "## 1 Scope" in text and "### 1.1 Parts" in text and "at this line and goes on below with words" in text and "Running head" not in text
    assert "![p002-f01.png](p002-f01.png)\n> **Figure description:** A photo of a threat." in text and "<!-- page: 2 -->" in text
    assert got["b"]["error"] == got["d"]["error"] == "pages missing" and got["b"]["markdown"] is None and got["c"]["error"] == "too little text"
    files = spark.createDataFrame([("a",), ("b",), ("e",)], "stem string")
    assert {r["stem"]: r["status"] for r in engine.results(files, done).collect()} == {"a": "done", "b": "incomplete", "e": "failed"}
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    n = engine.build("lib", done.where("error is null"), size=16, embed=embed)
    assert n > 2 and engine.indexes().where("is_total").first()["chunk_count"] == n
    hits = engine.search("lib", "threat photo", mode="text").collect()
    assert len(hits) == 1 and hits[0]["content_type"] == "figure" and hits[0]["page_start"] == 2
    assert engine.search("lib", "threat", embed=embed, context=True, k=3).count() == 3
    plain = engine.convert(pages, plaintext=True).where("doc = 'a'").first()["markdown"]
    assert "#" not in plain and "page:" not in plain


def test_enhancing(spark):
    engine = Engine(spark)
    docs = spark.createDataFrame([("a", "Text.\n\n![i.png](i.png)\n\n![j.png](j.png)\n> **Figure description:** known"), ("b", "![i.png](i.png)")], "doc string, markdown string")
    images = spark.createDataFrame([(d, i, bytearray(c)) for d, i, c in (("a", "i.png", b"1"), ("a", "j.png", b"2"), ("b", "i.png", b"1"))], "doc string, image_id string, content binary")
    got = {r["doc"]: r["markdown"] for r in engine.enhance(docs, images, lambda: lambda content, context: f"picture {bytes(content).decode()}").collect()}
    assert got["a"].count("picture 1") == 1 and "picture 2" not in got["a"] and "> **Figure description:** picture 1" in got["b"]


def test_bibliographic_documents(spark):
    engine = Engine(spark)
    docs = spark.createDataFrame([("123", "text"), ("Doe 2001", "text"), ("x", "text")], "doc string, markdown string")
    items = spark.createDataFrame([("k", "123", "A: Title", "May 2003", None, "P", ["Doe, J."], ["t"], "2020-01-01"), ("k", "123", "Old", "2001", None, "P", ["Doe, J."], [], "2019-01-01"), ("m", "Doe 2001", "B", "n.d.", None, None, [], [], None)], "zotero_key string, doc string, title string, pub_date string, doi string, publication string, creators array<string>, tags array<string>, date_modified string")
    got = {r["doc"]: (r["stem"], r["markdown"]) for r in engine.with_items(docs, items).collect()}
    assert got["123"][0] == "Doe - 2003 - A_ Title" and got["123"][1].startswith('---\ntitle: "A: Title"') and got["Doe 2001"][0] == "Doe 2001" and got["x"] == ("x", "text")
