"""The backlog resumes where it stopped and writes nothing twice."""

from docmill.sources.files import transcribe, write_documents
from docmill.streaming.backlog import run_backlog


def test_backlog_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, t string").write.parquet(src)
    args = (spark, "id int, t string", src, out, ck, lambda d: d, ["id"])
    assert run_backlog(*args) == 2
    assert run_backlog(*args) == 2
    spark.createDataFrame([(3, "c"), (1, "again")], "id int, t string").write.mode("append").parquet(src)
    assert run_backlog(*args) == 3  # a key of an earlier batch is not written again
    got = {r["id"]: r["t"] for r in spark.read.parquet(f"{out}/batch=*").collect()}
    assert got == {1: "a", 2: "b", 3: "c"}


def test_a_failed_page_is_a_row(spark):
    pages = spark.createDataFrame([("d", 1, bytearray(b"x"), None), ("d", 2, bytearray(b""), None)], "doc string, page_no int, png binary, text_layer string")

    def make():
        def ask(png, hint):
            if not png:
                raise TimeoutError("late")
            return "text"

        return ask

    got = {r["page_no"]: (r["markdown"], r["error"]) for r in transcribe(pages, make, 2).collect()}
    assert got == {1: ("text", None), 2: (None, "TimeoutError: late")}


def test_documents_are_written_whole(spark, tmp_path):
    d = spark.createDataFrame([("a", "one"), ("b", None)], "stem string, markdown string")
    assert write_documents(d, str(tmp_path)) == 2
    assert (tmp_path / "a.md").read_text() == "one" and not list(tmp_path.glob(".part-*"))
