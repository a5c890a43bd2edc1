"""Files, lines, sinks and pages from outside, on real files and a server of this machine."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import greedy
from glyphmill.operators import rewrite as H
from glyphmill.plans.source_queries import FILES
from glyphmill.sources import files, providers, sinks, tables
from glyphmill.sources.versions import Versions


def test_folder_of_files(spark, tmp_path):
    for name, size, content, _, _ in FILES:
        (tmp_path / name).write_bytes(content.ljust(size or 0, b"x"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "long.txt").write_text("kata " * 10_000)
    got = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {n: (got[n]["code"], got[n]["text"]) for n, *_ in FILES} == {n: (code, text) for n, _, _, code, text in FILES}
    assert len(got["long.txt"]["text"]) == 30_000 and got["long.txt"]["words"] == 6000 and len(got) == len(FILES) + 1


def test_lines_of_json(spark, tmp_path):
    rows = [{"a": 1, "t": " x "}, {"a": 2, "t": "  "}, {"a": 3}, {"a": 4, "t": "y"}]
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    bad.write_text(good.read_text() + '{"a": 5,\nnull\n')
    schema = "a long, t string"
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(good), schema).collect()) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="bad line"):
        files.read_jsonl(spark, str(bad), schema).collect()
    kept, counts = files.read_jsonl_tolerant(spark, str(bad), schema, ["t"])
    assert sorted((r["a"], r["t"]) for r in kept.collect()) == [(1, "x"), (4, "y")] and counts.first().asDict() == {"good": 2, "bad": 4}


def test_registry(spark, tmp_path):
    (tmp_path / "set" / "a").mkdir(parents=True)
    (tmp_path / "set" / "a" / "x.txt").write_text("satu\ndua")
    entries = spark.createDataFrame([("1", "a/x.txt")], "id string, file string")
    assert files.read_registry(spark, str(tmp_path / "set"), entries).first()["text"] == "satu\ndua"
    with pytest.raises(Exception, match="no such file"):
        files.read_registry(spark, str(tmp_path / "set"), spark.createDataFrame([("2", "b.txt")], "id string, file string")).collect()


def test_sinks(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "rows"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    now = lambda n=None: sorted(map(tuple, table.read(n).collect()))
    assert table.read() is None and table.replace_rows(frame((1, "x")), "id") == -1
    table.append_new(frame((1, "a"), (2, "b")), "id")
    table.append_new(frame((2, "z"), (3, "c"), (3, "c")), "id")
    table.append_new(frame((2, "z"), (3, "c")), "id")
    assert now() == [(1, "a"), (2, "b"), (3, "c")]
    kept = set(table.entry(table.number())["files"])
    at = table.replace_rows(frame((2, "new"), (9, "no"), (2, "newer"), (None, "null")), "id")
    assert now() == [(1, "a"), (2, "newer"), (3, "c")] and now(at - 1) == [(1, "a"), (2, "b"), (3, "c")]
    assert set(table.entry(at)["files"]) & kept  # files without such a key stay
    assert table.append_new(frame((7, "s")), "id", ("q", 4)) == at + 1 == table.append_new(frame((7, "s"), (8, "t")), "id", ("q", 4))
    sinks.write_reports(frame((1, "one\ntwo")), str(tmp_path / "reports"), "v")
    assert [r[0] for r in spark.read.text(str(tmp_path / "reports")).collect()] == ["one", "two"]
    assert frame((1, None)).select(sinks.payload(n=F.col("id"), v=F.col("v"))).first()[0] == '{"n":1,"v":null}'


class Pages(BaseHTTPRequestHandler):
    lost = {"n": 0}

    def do_GET(self):
        if self.path.startswith("/busy") and self.lost["n"] < 1:
            self.lost["n"] += 1
            return self.answer(503, "")
        if self.path.startswith("/gone"):
            return self.answer(404, "")
        page = self.path.rsplit("=", 1)[-1]
        after = {"*": "two", "two": "three"}.get(page)
        return self.answer(200, json.dumps({"meta": {"next_cursor": after}, "results": [{"id": page, "title": page}]}))

    def answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *a):
        pass


def test_pages_of_a_server(spark):
    tables.ship(spark)
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(providers.HttpPages)
    urls = [f"{at}/works?cursor={{cursor}}", f"{at}/busy?cursor=x", f"{at}/gone", "http://127.0.0.1:9/none"]
    found = spark.read.format("http_pages").options(urls=json.dumps(urls), cursor="meta.next_cursor", max_pages="5", backoff="0.01", workers="2").load()
    rows = {(r["url"], r["page"]): r for r in found.collect()}
    assert [rows[urls[0], i]["status"] for i in range(3)] == [200] * 3 and (urls[0], 3) not in rows
    assert rows[urls[1], 0]["status"] == 200 and rows[urls[2], 0]["reason"] == "HTTP 404" and rows[urls[3], 0]["status"] == 0
    titles = found.where("status = 200").select(F.explode(providers.works(F.col("body"))).alias("c")).select("c.title").collect()
    assert sorted(r[0] for r in titles) == ["*", "three", "two", "x"]
    server.shutdown()


def test_two_writers_and_a_reader(spark, tmp_path):
    """Writers at once add the same and other keys and change rows: nothing is lost or doubled, and a reader always finds a table."""
    path, errors, seen = str(tmp_path / "rows"), [], []
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    Versions(spark, path).append_new(frame([(i, "first") for i in range(10)]), "id")
    done = threading.Event()

    def write(n):
        try:
            table = Versions(spark, path)
            for r in range(3):
                table.append_new(frame([(100 + r, "shared"), (1000 * n + r, f"w{n}")]), "id")
                table.replace_rows(frame([(n, f"by {n}, {r}")]), "id")
        except Exception as e:
            errors.append(e)

    def look():
        while not done.is_set():
            try:
                seen.append(Versions(spark, path).read().count())
            except Exception as e:
                errors.append(e)

    writers, reader = [threading.Thread(target=write, args=(n,)) for n in (1, 2)], threading.Thread(target=look)
    for t in [*writers, reader]:
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    want = [(i, f"by {i}, 2" if i in (1, 2) else "first") for i in range(10)] + [(100 + r, "shared") for r in range(3)] + [(1000 * n + r, f"w{n}") for n in (1, 2) for r in range(3)]
    assert not errors and sorted(map(tuple, Versions(spark, path).read().collect())) == sorted(want)
    assert seen == sorted(seen) and seen[0] >= 10


def test_accept_in_order(spark):
    rng = random.Random(6)
    rows = [(q, i, [f"k{rng.randrange(25)}" for _ in range(rng.randrange(4))]) for q in range(3) for i in range(60)] + [(9, i, [f"c{i}", f"c{i + 1}"]) for i in range(12)]
    got = {(r["q"], r["i"]) for r in greedy.accept(spark.createDataFrame(rows, "q int, i int, keys array<string>"), "q", "i", "keys").collect()}
    seen, want = set(), set()
    for q, i, keys in rows:
        mine = {(q, k) for k in keys}
        if not mine & seen:
            seen |= mine
            want.add((q, i))
    assert got == want and (9, 2) in got and (9, 1) not in got


def test_numbering_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 7)
    rng = random.Random(2)
    rows = [(rng.randrange(1000), f"{rng.randrange(1 << 32):08x}", rng.choice("ab") if i % 9 else None) for i in range(300)] + [(None, "0", "a")]
    df = spark.createDataFrame(rows, "n long, h string, g string")
    whole = sorted((r["place"], -1 if r["n"] is None else r["n"]) for r in tables.numbered(df, "n").collect())
    assert [p for p, _ in whole] == list(range(301)) and [n for _, n in whole] == sorted(-1 if n is None else n for n, *_ in rows)
    by = tables.numbered(df.where("n IS NOT NULL"), "h", by=["g"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r["place"], r["h"]) for r in by if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [h for _, h in mine] == sorted(h for _, h in mine)
    assert tables.numbered(df.where("false"), "n").count() == 0


def test_ranges_follow_the_values(spark, monkeypatch):
    """One id of 2^62, clustered ids, a value and a group that most rows have: no range is much larger than the others."""
    monkeypatch.setattr(tables, "RANGE_ROWS", 500)
    seen = []
    monkeypatch.setattr(tables, "written", lambda df, *a, kept=tables.written: seen.append(kept(df, *a)) or seen[-1])
    rng = random.Random(3)
    values = [1 << 62, -(1 << 62)] + [rng.choice([10, 1 << 40]) + rng.randrange(3000) for _ in range(4000)] + [5] * 4000 + [None] * 300
    rows = [(v, rng.choice("abc") if i % 3 else "hot", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n bigint, g string, t int")
    got = tables.numbered(df, "n", ties=["t"]).collect()
    by_place = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r["n"], r["t"]) for r in sorted(got, key=lambda r: r["place"])] == [(n, t) for n, _, t in by_place]
    tables.numbered(df, "n", by=["g"]).collect()
    for ranged in seen:
        sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
        assert len(sizes) >= 15 and max(sizes) <= 1200


def test_query_set_in_blocks(spark, monkeypatch):
    rows, asked = spark.range(50), spark.range(23).toDF("q")
    want = {(a, b) for a in range(50) for b in range(23)}
    assert {tuple(r) for r in tables.against(rows, asked).collect()} == want
    monkeypatch.setattr(tables, "BLOCK_ROWS", 5)
    got = [tuple(r) for r in tables.against(rows, asked).collect()]
    assert len(got) == len(want) and set(got) == want


def test_rewriting_rules_that_sql_has_not(spark):
    df = spark.createDataFrame([(1, "Beberapa anak-anak bermain di taman kota. Beberapa buku-buku lama itu sendiri hilang dari rak.")], "doc_id long, text string")
    assert H.rewrite_sentences(df).first()["new"] == ["Beberapa anak bermain di taman kota.", "Beberapa buku lama itu hilang dari rak."]
    bad = H.rewrite(spark.createDataFrame([(1, None), (2, ""), (3, "Kata kata kata.")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["verdict"], r["out"]) for r in bad) == [(1, "same", ""), (2, "same", ""), (3, "same", "Kata kata kata.")]
