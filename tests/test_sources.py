"""Sources and sinks with their failure rules."""

from __future__ import annotations

import io
import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.sources import pages, paged, readers, sinks


def test_json_and_keyed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "title": "A", "sections": [{"title": "S", "articles": ["x", "y"]}]}, {"id": "2"}]))
    df = readers.json_entities(spark, f"file://{tmp_path}/a.json", "issues")
    assert [(r["id"], r["title"]) for r in df.orderBy("ord").collect()] == [("1", "A"), ("2", None)]
    (tmp_path / "s.json").write_text(json.dumps({"17": {"ojsViews": 5, "monthlyOjsViews": {"2025-01": 5}}, "18": {}}))
    s = readers.keyed_json(spark, f"file://{tmp_path}/s.json", "stats_entry", "id").orderBy("id").collect()
    assert [(r["id"], r["ojsViews"]) for r in s] == [("17", 5), ("18", None)]
    assert readers.optional_json(spark, f"file://{tmp_path}/none.json", "pages").count() == 0


def test_items(spark):
    df = spark.createDataFrame([('[{"date": "2025-01", "value": "3"}]',), ('{"items": [{"date": "2025-02", "value": "4"}]}',), ("broken",)], "v string")
    out = df.select(readers.items(F.col("v"), "date STRING, value STRING").alias("i")).collect()
    assert [[tuple(x) for x in r["i"] or []] for r in out] == [[("2025-01", "3")], [("2025-02", "4")], []]


def test_sheet_is_all_strings(spark, tmp_path):
    (tmp_path / "s.csv").write_text('ID,Note\n1,"a, ""b""\nc"\n2,\n')
    df = readers.sheet(spark, f"file://{tmp_path}/s.csv")
    assert {t for _, t in df.dtypes} == {"string"} and df.count() == 2 and df.first()["Note"] == 'a, "b"\nc'


def test_binaries(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.png").write_bytes(b"1")
    (tmp_path / "c.jpg").write_bytes(b"2")
    files = readers.binaries(spark, f"file://{tmp_path}")
    assert [r["path"].split("/")[-1] for r in readers.pdfs(files).collect()] == ["a.pdf"]
    assert readers.changed(files, spark.createDataFrame([("a.pdf", 10), ("b.pdf", 1)], "name string, length long")).count() == 3
    assert {r["slug"]: r["path"].split(".")[-1] for r in readers.probe(files, [".jpg", ".jpeg", ".png", ".webp"]).collect()} == {"c": "jpg"}


def test_env_pairs():
    assert readers.env_pairs('# c\n\nA = "x=1"\nB=\'y\'\nbad\nA2=z', {"B": "kept"}) == {"B": "kept", "A": "x=1", "A2": "z"}


def answers(*codes):
    seen, left = [], list(codes)

    def open_(request, timeout):
        seen.append(request)
        code = left.pop(0)
        if isinstance(code, Exception):
            raise code
        if code != 200:
            raise urllib.error.HTTPError(request.full_url, code, "x", {}, io.BytesIO())
        r = io.BytesIO(b"ok")
        r.status = 200
        return r

    return open_, seen


def test_fetch_retries_and_gives_up():
    waits = []
    open_, seen = answers(500, OSError(), 200)
    assert paged.fetch("http://x", open_=open_, sleep=waits.append) == b"ok" and len(seen) == 3 and waits == [2.0, 4.0]
    open_, seen = answers(404)
    assert paged.fetch("http://x", open_=open_, sleep=waits.append) is None and len(seen) == 1
    open_, seen = answers(403, 200)
    assert paged.fetch("http://x", "t", open_=open_, sleep=waits.append) == b"ok" and "apiToken=t" in seen[1].full_url and seen[0].headers == {"Authorization": "Bearer t"}
    open_, seen = answers(500, 500, 500)
    assert paged.fetch("http://x", open_=open_, sleep=waits.append) is None


def test_months_and_lists():
    assert paged.months("2025-11-15", "2026-01-02") == [("2025-11-01", "2025-12-01"), ("2025-12-01", "2026-01-01"), ("2026-01-01", "2026-02-01")]
    assert paged.listed(b'{"items": [1]}') == [1] and paged.listed(b"[2]") == [2] and paged.listed(b"<") == [] and paged.listed(None) == [] and paged.listed(b"3") == []


def test_paged_source(spark):
    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlparse

            q = parse_qs(urlparse(self.path).query)
            at = int(q["offset"][0])
            body = json.dumps({"itemsMax": 250, "items": [{"id": i} for i in range(at, min(at + 100, 250))]}).encode()
            self.send_response(500 if at == 200 and "fail" in self.path else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedSource)

    def load(path, **options):
        reader = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/{path}").option("kind", "offset").option("spacing", "0")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load()

    ids = load("x").select(F.get_json_object("value", "$.id").cast("int").alias("i"), "error")
    assert sorted(r["i"] for r in ids.collect()) == list(range(250)) and ids.where("error IS NOT NULL").count() == 0
    assert load("x", tasks="2").count() == 250
    server.shutdown()


def test_paged_source_reports_failures(monkeypatch):
    """A page that fails is a row with its error; without the first page there is no scan; requests keep their distance."""
    waits = []
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    bodies = {"offset=0": b'{"itemsMax": 250, "items": [1]}', "offset=100": None, "offset=200": b"<html>"}
    monkeypatch.setattr(paged, "fetch", lambda url, token="": next((v for k, v in bodies.items() if url.endswith(k)), b"[1, 2]"))
    reader = paged.PagedReader({"url": "http://h/x", "kind": "offset"})
    (part,) = reader.partitions()
    rows = list(reader.read(part))
    assert [(r[0], r[2], r[3] is None) for r in rows] == [("0", "1", True), ("100", None, False), ("200", None, False)] and waits == [paged.SPACING] * 2
    bodies["offset=0"] = None
    with pytest.raises(OSError):
        reader.partitions()
    waits.clear()
    reader = paged.PagedReader({"url": "http://h/{entity}/{metric}", "kind": "grid", "entities": "7, 8/9", "metrics": "abstract,galley", "start": "2025-01-03", "stop": "2025-02-01", "tasks": "2"})
    names = sorted(n for p in reader.partitions() for n, _ in p.pages)
    assert len(names) == 8 and names[0] == "7|abstract|2025-01" and any("8%2F9/galley?start=2025-02-01" in u for p in reader.partitions() for _, u in p.pages)
    list(reader.read(reader.partitions()[0]))
    assert waits == [2 * paged.SPACING] * 3


def test_scraped_isolates_failures(spark):
    df = spark.createDataFrame([(1, "<html><title>T</title><h1>Head &amp; x</h1><p>ISSN: 1234-567X , y</p><a href='/z'>z</a><script>no</script>"), (2, None), (3, "bad")], "id long, html string")

    def project(h):
        if h == "bad":
            raise ValueError("no page")
        return pages.page_record(h)

    out = {r["id"]: r for r in pages.scraped(df, "id", "html", project).collect()}
    assert out[1]["title"] == "Head & x" and out[1]["issn"] == "1234-567X" and list(out[1]["links"]) == ["/z"] and "no" not in out[1]["text"].split()
    assert out[2]["title"] == "" and out[3]["error"] == "ValueError: no page"


def test_flattening_agrees_with_the_parser(spark, sf_dir):
    from quillspark.functions.text import flatten_html

    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", flatten_html(F.col("html")).alias("t"))
    assert all(pages.tree(r["html"]).text() == r["t"] for r in df.collect())


def test_discovered_keeps_the_first_order(spark):
    links = spark.createDataFrame([(0, "b"), (1, "login"), (2, "a"), (3, "b"), (4, "user/x")], "ord long, path string").repartition(3)
    assert [r["path"] for r in pages.discovered(links, "ord", "path", ["login"], ["user/"], ["a", "z"]).collect()] == ["b", "a", "z"]


def test_json_atomic_keeps_what_is_there_when_a_job_fails(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    sinks.json_atomic(spark.createDataFrame([(1,)], "a int"), at)
    with pytest.raises(Exception, match="broken"):
        sinks.json_atomic(spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("a")), at)
    assert [r["a"] for r in spark.read.json(at).collect()] == [1] and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.json_atomic(spark.createDataFrame([(2,)], "a int"), at)
    assert [r["a"] for r in spark.read.json(at).collect()] == [2] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_pages_are_written_and_the_site_is_reset(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    assert sinks.reset_site(spark, folder) == []
    df = spark.createDataFrame([("index.html", "ä"), ("a/b/index.html", "x"), ("a/b/index.html", "x"), ("none.html", None)], "p string, c string")
    out = sinks.write_pages(sinks.rendered(df, F.col("p"), F.col("c")), folder).collect()
    assert sorted((r["path"], r["bytes"]) for r in out) == [("a/b/index.html", 1), ("index.html", 2), ("none.html", 0)]
    assert (tmp_path / "site/a/b/index.html").read_text() == "x" and sorted(p.name for p in (tmp_path / "site").iterdir()) == ["a", "index.html", "none.html"]
    with pytest.raises(Exception, match="leads out"):
        sinks.write_pages(spark.createDataFrame([("../x", "")], "path string, content string"), folder).collect()
    assert sinks.reset_site(spark, folder, keep=("a",)) == ["index.html", "none.html"] and (tmp_path / "site/a/b/index.html").exists()


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, "ä")], "b int, a string")
    assert sinks.keep_previous(df.limit(0), at) and sinks.keep_previous(df, at) and not sinks.keep_previous(df.limit(0), at)
    assert spark.read.json(at).columns == ["a", "b"] and spark.read.json(at).count() == 1
    checks = {"title": F.col("a") != "", "positive": F.col("b") > 0}
    sinks.quality_gate(df, checks)
    with pytest.raises(sinks.QualityError, match="positive: 1 rows"):
        sinks.quality_gate(spark.createDataFrame([(None, "x")], "b int, a string"), checks)
    with pytest.raises(sinks.QualityError, match="3 needed"):
        sinks.quality_gate(df, {}, least_rows=3)
    p = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "g int, ord int, html string")
    assert sinks.single_file(p, ["g", "ord"], "html").first()["html"] == "abc"
