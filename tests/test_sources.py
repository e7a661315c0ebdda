"""Readers, sinks and remote services."""

import json

import pytest
from pyspark.sql import functions as F

from docmill.sources import files, pdf, remote, zotero


def test_pages_need_the_library(spark):
    f = spark.createDataFrame([("a.pdf", bytearray(b"no pdf"))], "path string, content binary")
    assert [tuple(r) for r in pdf.page_counts(f).collect()] == [("a.pdf", None)]
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="pymupdf"):
            pdf.rasterize(f).collect()


def test_files_out(spark, tmp_path):
    d = spark.createDataFrame([("a b", "one ![x](i (1)) ![y](z.jpg)"), ("c", None)], "stem string, markdown string")
    i = spark.createDataFrame([("a b", "i (1)", bytearray(b"png")), ("a b", "z.jpg", bytearray(b"jpg"))], "stem string, image_id string, content binary")
    assert files.write_images(i, str(tmp_path)) == 2 and (tmp_path / "a b_images" / "i (1).png").read_bytes() == b"png"
    linked = {r["stem"]: r["markdown"] for r in files.images_out(d, i, True, True).collect()}
    assert linked == {"a b": "one ![x](a%20b_images/i%20%281%29.png) ![y](a%20b_images/z.jpg)", "c": None}
    data = {r["stem"]: r["markdown"] for r in files.images_out(d, i, False, True).collect()}
    assert "](data:image/png;base64,cG5n)" in data["a b"] and "](data:image/jpeg;base64,anBn)" in data["a b"]
    assert files.images_out(d, i, False, False) is d
    assert files.write_json(d.select("stem", F.struct("markdown").alias("value")), f"file://{tmp_path}") == 2
    assert json.loads((tmp_path / "a b.json").read_text())["markdown"].startswith("one")
    with pytest.raises(TypeError):
        files.write_atomic(str(tmp_path / "c"), None)
    assert not list(tmp_path.glob(".part-*"))


def test_settings():
    s = remote.Settings.read("X", {"X_DPI": "300", "X_RETRIES": "many", "X_STREAM": "off", "X_BASE_URL": " http://h/v1/ ", "X_TIMEOUT": "2.5"})
    assert (s.dpi, s.retries, s.stream, s.base_url, s.engine, s.timeout) == (300, 5, False, "http://h", "vlm", 2.5)
    assert remote.Settings.read("X", {}).engine == "hosted" and "secret" not in repr(remote.Settings(api_key="secret"))
    with pytest.raises(PermissionError):
        remote.Settings(engine="hosted").headers()
    with pytest.raises(FileNotFoundError):
        remote.Settings(ca_bundle="/none").verify()
    body = remote.chat_request(s, "read", b"x", 9, history=[{"role": "user", "content": "a"}], stream=True)
    assert body["max_tokens"] == 9 and len(body["messages"]) == 2 and "stream" not in body and body["messages"][1]["content"][1]["image_url"]["url"].endswith("eA==")


def test_streams_are_cut_off():
    def chunk(text):
        return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})

    seen = []
    loop = [chunk("again " * 100) for _ in range(20)]
    got = remote.read_stream(loop, lambda t: seen.append(len(t)) or len(t) > 2000)
    assert len(got) == 3600 and seen == [1800, 3600]
    assert remote.read_stream([chunk("a"), "", ": note", chunk("b"), "data: [DONE]", chunk("c")], lambda t: False) == "ab"
    assert remote.read_stream([json.dumps({"choices": [{"message": {"content": "whole"}}]})], lambda t: False) == "whole" and remote.read_stream([], lambda t: True) == ""
    with pytest.raises(TimeoutError):
        remote.read_stream(loop, lambda t: False, deadline=1.0, clock=lambda: 2.0)


class Service:
    def __init__(self, states):
        self.states, self.cancelled = list(states), []

    def submit(self, requests):
        return "j"

    def status(self, job):
        return self.states.pop(0) if len(self.states) > 1 else self.states[0]

    def cancel(self, job):
        self.cancelled.append(job)

    def results(self, job):
        return [{"custom_id": "a"}]


def test_jobs_are_polled():
    wait = lambda s: None
    assert remote.run_job(Service(["QUEUED", "RUNNING", "SUCCESS"]), [{}], sleep=wait) == [{"custom_id": "a"}]
    assert remote.run_job(Service(["FAILED"]), [{}], sleep=wait) == [] and remote.run_job(Service(["RUNNING"]), []) == []
    slow, now = Service(["RUNNING"]), iter(range(0, 99, 5))
    assert remote.run_job(slow, [{}], limit=20, sleep=wait, clock=lambda: next(now)) == [] and slow.cancelled == ["j"]
    rows = [{"n": i} for i in range(250)]
    assert remote.paged(lambda start, size: rows[start : start + size]) == rows and remote.paged(lambda a, b: []) == []


def test_lookups(spark):
    c = spark.createDataFrame([(2, "Papers", "b"), (1, "papers", "a"), (1, "Other", "c")], "group_no int, name string, key string")
    assert zotero.find_collection(c, "PAPERS").first()["key"] == "a" and zotero.find_collection(c, "none").count() == 0
    g = spark.createDataFrame([(7, "Lab"), (8, "lab two")], "id long, name string")
    assert zotero.find_group(g, "7").first()["name"] == "Lab" and zotero.find_group(g, "LAB").first()["id"] == 7
