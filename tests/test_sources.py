"""Recordings, replay, fetching, sitemaps, payloads and the stream."""

from __future__ import annotations

import gzip
import io
import json
import os
import socket
import tracemalloc
import urllib.error
import zlib
from email.message import Message

import pytest
from pyspark.sql import functions as F

from sitelens.constants import RUBRIC
from sitelens.operators import manifest, report, sitemap, study
from sitelens.plans import catalogue
from sitelens.sources import fetch, responses, steps
from sitelens.streaming import audit


@pytest.fixture
def recorded(spark, tmp_path):
    answer = lambda text, status=200, error=None: {"final_url": "https://a.example/", "status": status, "headers": {"Content-Type": "text/html"}, "text": text, "error": error, "truncated": False}
    runs = [
        {"format_version": 1, "domain": "a.example", "fetched_at": "2024-01-01T00:00:00", "outcome": "scored", "responses": {"https://a.example/": answer("home"), "https://a.example/robots.txt": answer("User-agent: *\n")}},
        {"format_version": 1, "domain": "b.example", "fetched_at": "2024-01-02T00:00:00", "outcome": "aborted: timeout", "responses": {"https://b.example/": answer("", None, "timeout")}},
    ]
    (tmp_path / "runs.json").write_text("\n".join(map(json.dumps, runs)))
    return responses.read_recordings(spark, f"{tmp_path}/runs.json")


def test_recordings_round_trip(spark, tmp_path, recorded):
    assert recorded.count() == 3
    responses.write_recordings(recorded, f"{tmp_path}/again")
    again = responses.read_recordings(spark, f"{tmp_path}/again")
    assert sorted(map(str, again.collect())) == sorted(map(str, recorded.collect()))
    assert [r["domain"] for r in responses.available(recorded).collect()] == ["a.example", "b.example"]


def test_replay_never_invents_an_answer(spark, recorded):
    asked = spark.createDataFrame([("a.example", "https://a.example/"), ("a.example", "https://a.example/x")], "domain string, url string")
    got = {r["url"]: r for r in responses.replay(asked, recorded).collect()}
    assert got["https://a.example/"]["status"] == 200 and got["https://a.example/"]["error"] is None
    assert got["https://a.example/x"]["status"] is None and got["https://a.example/x"]["error"] == "not in fixture"


def test_manifest_of_recordings(recorded):
    got = {r["domain"]: r for r in manifest.manifest(recorded).collect()}
    assert (got["a.example"]["robots_status"], got["a.example"]["robots_bytes"]) == ("200", "14")
    assert (got["b.example"]["robots_status"], got["b.example"]["robots_sha256"]) == ("", "")


def test_homes_that_fail_abort(spark):
    homes = spark.createDataFrame([("a", "https://www.a.example:8/x", 200, None), ("b", "https://b.example/", 403, None), ("c", "https://c.example/", None, "timeout")], "domain string, final_url string, status int, error string")
    got = {r["domain"]: tuple(r)[1:] for r in responses.resolve_bases(homes).collect()}
    assert got["a"] == ("https://www.a.example:8", "scored", None)
    assert got["b"][1:] == ("aborted", "HTTP 403") and got["c"][1:] == ("aborted", "timeout")


def test_lists(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# all\na.example\n\nb.example # second\n")
    assert [r["domain"] for r in responses.corpus(spark, f"{tmp_path}/c.txt").orderBy("pos").collect()] == ["a.example", "b.example"]
    assert [r["domain"] for r in responses.corpus(spark, f"{tmp_path}/c.txt", inline_comments=False).orderBy("pos").collect()] == ["a.example", "b.example # second"]
    (tmp_path / "k.csv").write_text("domain,category\na.example,news\n")
    assert responses.categories(spark, f"{tmp_path}/k.csv").count() == 1
    (tmp_path / "e.csv").write_text("domain,category\n")
    with pytest.raises(ValueError):
        responses.categories(spark, f"{tmp_path}/e.csv")


class Answer(io.BytesIO):
    def __init__(self, status, body=b"", **headers):
        super().__init__(body)
        self.status, self.headers = status, Message()
        for k, v in headers.items():
            self.headers[k.replace("_", "-")] = v

    def geturl(self):
        return "https://a.example/end"


def test_retries_and_pauses():
    answers, slept = [Answer(429), Answer(503, Retry_After="7"), Answer(200, b"\xe9", Content_Type="text/html; charset=latin-1")], []
    got = fetch.fetch_one("https://a.example/", lambda r, timeout: answers.pop(0), slept.append)
    assert (got["status"], got["text"], got["final_url"], slept) == (200, "é", "https://a.example/end", [20.0, 7.0])
    assert fetch.pause(500, "9999", 0) == 120 and fetch.pause(500, "soon", 1) == 1.0


def raising(error):
    def open_(request, timeout):
        raise error

    return open_


@pytest.mark.parametrize(("error", "said", "tries"), [(urllib.error.URLError(socket.gaierror(-2, "x")), "network: gaierror", 1), (TimeoutError(), "timeout", 3), (urllib.error.URLError(ConnectionRefusedError()), "network: ConnectionRefusedError", 3), (urllib.error.URLError("unknown url type: x"), "unsupported_protocol", 1), (RuntimeError(), "unknown", 3)])
def test_failures_have_names(error, said, tries):
    slept = []
    got = fetch.fetch_one("https://a.example/", raising(error), slept.append)
    assert (got["status"], got["error"], len(slept)) == (None, said, tries - 1)


def test_bodies_are_cut():
    body = lambda raw, encoding, limit: fetch.read_body(io.BytesIO(raw), encoding, limit)
    assert body(b"abcdef", "", 4) == (b"abcd", True)
    assert body(b"not gzip", "gzip", 100) == body(b"not gzip", "deflate", 100) == (b"not gzip", False)
    random = os.urandom(300_000)
    for pack, name in ((gzip.compress, "gzip"), (zlib.compress, "deflate"), (lambda x: zlib.compress(x)[2:-4], "deflate")):
        assert body(pack(random), name, 1_000_000) == (random, False)
        assert body(pack(random), name, 250_000) == (random[:250_000], True)  # the limit is one of unpacked bytes
        assert body(pack(random)[:200_000], name, 1_000_000)[0] == random[: len(body(pack(random)[:200_000], name, 1_000_000)[0])]
    bomb = gzip.compress(b"x" * 50_000_000)
    tracemalloc.start()
    assert body(bomb, "gzip", 1000) == (b"x" * 1000, True)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    assert fetch.decode(b"\xff", "text/html; charset=nope") == "�"


def test_answers_become_recordings(spark, tmp_path):
    kind = "domain string, url string, final_url string, status int, headers map<string,string>, text string, error string, truncated boolean"
    rows = [("a.example", "https://a.example/", "https://a.example/", 200, {"x": "y"}, "home", None, False), ("a.example", "https://a.example/robots.txt", "https://a.example/robots.txt", 404, {}, "", None, False), ("b.example", "https://b.example/", "https://b.example/", None, {}, "", "timeout", False), ("c.example", "https://c.example/x", "https://c.example/x", 200, {}, "", None, False)]
    homes = spark.createDataFrame([(d, f"https://{d}/") for d in ("a.example", "b.example", "c.example")], "domain string, url string")
    made = responses.recorded(spark.createDataFrame(rows, kind), homes)
    responses.write_recordings(made, f"{tmp_path}/runs")
    again = responses.read_recordings(spark, f"{tmp_path}/runs")
    assert {(r["domain"], r["pos"], r["url"]): r["outcome"] for r in again.collect()} == {("a.example", 0, "https://a.example/"): "scored", ("a.example", 1, "https://a.example/robots.txt"): "scored", ("b.example", 0, "https://b.example/"): "aborted: timeout", ("c.example", 0, "https://c.example/x"): "aborted: no home page"}


def test_steps_can_be_removed(spark):
    step = steps.written(spark.range(10), "step")
    folder = step.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert step.count() == 10 and os.path.isdir(folder)
    steps.remove(step)
    assert not os.path.exists(folder)


def test_nested_sitemaps_are_followed_one_level(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/{k}.xml</loc></sitemap>" for k in range(20)) + "</sitemapindex>"
    child = lambda k: f"<urlset><url><loc>https://a.example/p{k}</loc></url></urlset>"
    answers = [("a", "https://a.example/s.xml", 200, None, "text/xml", index)] + [("a", f"https://a.example/{k}.xml", 200, None, "", child(k)) for k in range(20)]
    answers += [("b", "https://b.example/s.xml", 200, None, "", "<urlset><url><loc>u1</loc></url><sitemap><loc>https://b.example/gone.xml</loc></sitemap></urlset>"), ("c", "https://c.example/s.xml", 404, None, "", "")]
    df = spark.createDataFrame(answers, "domain string, url string, status int, error string, content_type string, text string")
    tops = spark.createDataFrame([(d, f"https://{d}.example/s.xml") for d in "abc"], "domain string, url string")
    urls, notes = sitemap.collect(tops, df)
    listed = {}
    for r in urls.collect():
        listed.setdefault(r["domain"], []).append(r["url"])
    assert len(listed["a"]) == 5 and listed["b"] == ["u1"] and "c" not in listed
    assert len([n for n in notes.collect() if n["domain"] == "a"]) == 1 and notes.count() == 3


@pytest.mark.parametrize(("status", "kind", "url", "text", "good"), [(200, "text/xml", "u", "<urlset>", True), (200, "text/html", "u", "<?xml", False), (200, "", "u.gz", "", True), (404, "", "u", "<urlset>", False), (200, "", "u", " <!DOCTYPE html>", False), (200, "", "u", "words", False)])
def test_what_a_sitemap_looks_like(spark, status, kind, url, text, good):
    row = spark.range(1).select(sitemap.looks_like_sitemap(F.lit(status), F.lit(None).cast("string"), F.lit(url), F.lit(kind), F.lit(text)))
    assert row.collect()[0][0] is good


def test_samples_are_the_same_however_the_rows_lie(spark):
    urls = spark.createDataFrame([("a", f"https://a.example/{k}") for k in range(50)] * 2, "domain string, url string")
    one = sitemap.sample(urls, 5, "domain").orderBy("rank").collect()
    assert one == sitemap.sample(urls.repartition(7), 5, "domain").orderBy("rank").collect() and len(one) == 5
    homes = spark.createDataFrame([("a", "https://a.example/")], "domain string, url string")
    picked = sitemap.sample_pages(urls.unionByName(spark.createDataFrame([("a", "https://a.example/x.pdf"), ("a", "https://a.example")], "domain string, url string")), homes)
    assert picked.count() == 5 and not any(r["url"].endswith(".pdf") for r in picked.collect())


def test_payload_holds_every_criterion(spark, sf_dir):
    rows = catalogue.payload_json(spark, sf_dir).collect()
    for r in rows:
        run = json.loads(r["payload"])
        assert [c["check_id"] for c in run["checks"]] == [i for _, i, _ in RUBRIC]
        assert {b: len(v["agents"]) for b, v in run["crawlers"].items()} == {"citation": 11, "user_fetch": 8, "training": 13}
        assert "## Scores" in report.markdown(run) and report.terminal(run)


def test_training_blocks_cost_nothing(spark, sf_dir):
    base = {r["domain"]: r["final_x100"] for r in catalogue.access_score(spark, sf_dir).collect()}
    assert base and all(0 <= v <= 10_000 for v in base.values())


def test_studies_keep_aborted_sites_apart(spark, sf_dir):
    rows = catalogue.site_rows(spark, sf_dir)
    assert rows.where("outcome = 'aborted' AND access IS NOT NULL").count() == 0
    assert study.medians(rows).count() == 1 and study.histogram(rows, "access_letter").count() >= 1


def test_stream_scores_changed_sites_again(spark, tmp_path):
    pages = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    pages([(1, "https://a.example/1", "x" * 2000), (2, "https://b.example/1", "short")]).write.parquet(f"{tmp_path}/in")
    run = lambda: audit.rescore(audit.read_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    run()
    first = {r["domain"]: r["ratio"] for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()}
    pages([(3, "https://b.example/1", "y" * 2000)]).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    second = {r["domain"]: r["ratio"] for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()}
    assert (first, second) == ({"a.example": 1.0, "b.example": 0.0}, {"b.example": 1.0})


def test_verdicts_of_a_batch(spark):
    bodies = spark.createDataFrame([("a", "User-agent: *\nDisallow: /\n"), ("b", "User-agent: *\nDisallow: /\n"), ("c", None)], "domain string, body string")
    got = audit.judge(bodies).groupBy("domain").agg(F.count_if("allowed").alias("n")).collect()
    assert {r["domain"]: r["n"] for r in got} == {"a": 0, "b": 0, "c": 32}
