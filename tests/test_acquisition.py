"""Revisions as of a time with hot keys, samples, and a stream behind cursors that is stopped and started again."""

import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import history
from glyphmill.sources import providers, tables
from glyphmill.sources.versions import Versions


@pytest.mark.parametrize("size", [500_000, 40])
def test_as_of_with_a_hot_key(spark, monkeypatch, size):
    monkeypatch.setattr(tables, "RANGE_ROWS", size)
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "b", "c", "d", None])
    revisions = [(key(), rng.choice([None, *range(300)]), i) for i in range(300)] + [("late", 290, 999)]
    asked = [(i, key(), rng.choice([None, *range(300)])) for i in range(300)] + [(900, "none", 5), (901, "late", 5), (902, "late", 290), (903, "hot", 7), (903, "hot", 7)]
    got = history.as_of(spark.createDataFrame(asked, "i int, k string, t int"), spark.createDataFrame(revisions, "k string, t int, v int"), "k", "t", ties=["v"]).collect()

    def plain(k, t):
        there = [(t2, v) for k2, t2, v in revisions if k is not None and k2 == k and t is not None and t2 is not None and t2 <= t]
        return max(there)[1] if there else None

    assert sorted(((r["i"], r["revision"]["v"] if r["revision"] else None) for r in got), key=str) == sorted(((i, plain(k, t)) for i, k, t in asked), key=str)


def test_as_of_nothing(spark):
    asked, none = spark.createDataFrame([(1, "a", 2)], "i int, k string, t int"), spark.createDataFrame([], "k string, t int, v int")
    assert history.as_of(asked, none, "k", "t").first()["revision"] is None
    assert history.as_of(asked.where("i > 5"), none, "k", "t").count() == 0


class Pages(BaseHTTPRequestHandler):
    """Two addresses of 30 and 7 pages of three works each; one page is out of order for a while."""

    asked: list = []
    broken: set = set()
    sizes = {"a": 30, "b": 7}

    def do_GET(self):
        parts = urllib.parse.urlparse(self.path)
        name, cursor = parts.path[1:], urllib.parse.parse_qs(parts.query)["cursor"][0]
        page = 0 if cursor == "*" else int(cursor.removeprefix("c/"))
        self.asked.append((name, page))
        if (name, page) in self.broken:
            self.send_response(503)
            self.end_headers()
            return
        works = [{"id": f"{name}{page}-{i}", "doi": f"10.1/{(page * 3 + i) % 40}" if i else None} for i in range(3)]
        more = page + 1 < self.sizes[name]
        body = json.dumps({"results": works, "meta": {"next_cursor": f"c/{page + 1}" if more else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture()
def server():
    Pages.asked, Pages.broken = [], set()
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_cursor_stream_resumes(spark, tmp_path, server):
    """A batch fails on a page, the stream ends, starts again from its checkpoint, is stopped between batches and started once more: no page is lost or doubled."""
    spark.dataSource.register(providers.CursorPages)
    urls = json.dumps([f"{server}/{n}?cursor={{cursor}}" for n in ("a", "b")])
    table = Versions(spark, str(tmp_path / "works"))
    pages = Versions(spark, str(tmp_path / "pages"))
    taken = []

    def put(batch, number):
        batch = batch.persist()
        taken.append(batch.count())
        pages.append_new(batch.select(F.concat_ws("#", F.regexp_extract("url", "/([ab])[?]", 1), "page").alias("id"), "cursor"), "id", ("pages", number))
        works = batch.select(F.explode(F.from_json("body", "results array<struct<id:string,doi:string>>")["results"]).alias("w")).select("w.*")
        table.append_new(works.select(F.coalesce("doi", "id").alias("key"), "id"), "key", ("works", number))
        batch.unpersist()

    def start():
        stream = spark.readStream.format("cursor_pages").option("urls", urls).option("cursor", "meta.next_cursor").option("batch", "4").option("retries", "0").load()
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()

    query = start()
    while sum(taken) < 8:
        query.awaitTermination(1)
    query.stop()
    before = sum(taken)
    Pages.broken = {("a", n) for n in range(12, 30)}
    query = start()  # from where it was; then nothing more comes of the first address
    while sum(taken) < min(before + 1, 14):
        query.awaitTermination(1)
    query.stop()
    Pages.broken = set()
    query = start()
    query.processAllAvailable()
    for _ in range(20):
        if pages.read().count() == 37:
            break
        query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in pages.read().collect()) == sorted([f"a#{i}" for i in range(30)] + [f"b#{i}" for i in range(7)])
    assert sum(taken) >= 37 and max(taken) <= 8  # a batch that was cut off comes again, whole
    works = {(f"{n}{p}-{i}", f"10.1/{(p * 3 + i) % 40}" if i else None) for n, size in Pages.sizes.items() for p in range(size) for i in range(3)}
    keys = [r["key"] for r in table.read().collect()]
    assert len(keys) == len(set(keys)) and set(keys) == {d or w for w, d in works}


def test_a_failed_batch_reads_the_same_pages(server):
    """Offsets are replayed by a reader that was not there: it walks from the start cursor and finds the same pages."""
    options = {"urls": json.dumps([f"{server}/a?cursor={{cursor}}"]), "cursor": "meta.next_cursor", "batch": "5", "retries": "0"}
    one, url = providers.CursorPagesReader(options), f"{server}/a?cursor={{cursor}}"
    first = one.latestOffset()
    second = one.latestOffset()
    planned = [(p.page, p.cursor) for p in one.partitions(first, second)]
    again = providers.CursorPagesReader(options)
    assert [(p.page, p.cursor) for p in again.partitions(first, second)] == planned == [(i, f"c/{i}") for i in range(5, 10)]
    assert again.partitions(second, second) == [] and again.latestOffset()[url]["page"] == 15
    Pages.broken = {("a", 16)}
    assert again.latestOffset()[url]["page"] == 16  # what can be followed, no further
    with pytest.raises(OSError):
        list(again.read(providers.CursorPage(url, 16, "c/16")))
    Pages.broken = set()
    while again.latestOffset()[url]["cursor"]:
        pass
    assert again.front[url] == {"page": 30, "cursor": ""} and again.latestOffset() == again.front


def test_gated_works(spark):
    rows = [(0, "text", "10/a", ["", " by "], "2020-01-01"), (1, "text", " 10/a ", ["by"], "2020-01-01"), (2, " ", "10/b", ["by"], "2020-01-01"), (3, "text", "10/b", [None], "2020-01-01"), (4, "text", "10/b", ["by"], "2023-01-01"),
            (5, "text", "10/b", ["by"], "2019"), (6, "text", "10/b", [], "2019"), (7, "text", None, ["by"], "2019"), (8, "text", None, ["by"], None), (9, None, "10/a", ["by"], "2019"), (10, "text", "", None, "2019")]
    df = spark.createDataFrame(rows, "i int, abstract string, doi string, licenses array<string>, pub_date string")
    got = [r["dropped"] for r in providers.gated_works(df, ["i"]).orderBy("i").collect()]
    assert got == [None, "dup_doi", "no_abstract", "bad_license_empty", "bad_date", None, "dup_doi", None, "bad_date", "no_abstract", "bad_license_empty"]
