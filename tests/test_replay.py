"""A recorded corpus, end to end."""

from __future__ import annotations

import json

import pytest

from sitelens.operators import accuracy
from sitelens.plans import replay

SCHEMA = "domain string, url string, final_url string, status int, headers map<string,string>, text string, error string"
PAGE = "<title>A title of its own</title><h1>t</h1><p>" + "word " * 400 + "</p>"


def response(domain, url, text="", status=200, error=None, final=None, **headers):
    return (domain, url, final or url, status, {k.replace("_", "-"): v for k, v in headers.items()}, text, error)


@pytest.fixture(scope="module")
def audit(spark):
    a, b, c = "a.example", "b.example", "c.example"
    urls = "".join(f"<url><loc>https://www.a.example/p{k}</loc></url>" for k in range(9)) + "<url><loc>https://www.a.example/private/x</loc></url><url><loc>https://www.a.example/x.pdf</loc></url><url><loc>https://www.a.example/</loc></url>"
    rows = [
        response(a, "https://a.example/", PAGE, final="https://www.a.example/"),
        response(a, "https://www.a.example/robots.txt", "User-agent: *\nDisallow: /private/\nSitemap: https://www.a.example/map.xml\n\nUser-agent: GPTBot\nDisallow: /\n", content_type="text/plain"),
        response(a, "https://www.a.example/map.xml", f"<urlset>{urls}</urlset>"),
        response(a, "https://www.a.example/llms.txt", "# x\n" + "y" * 200),
        *(response(a, f"https://www.a.example/p{k}", PAGE, 404 if k == 8 else 200) for k in range(9)),
        response(b, "https://b.example/", "", None, "timeout"),
        response(b, "http://b.example/", PAGE, x_robots_tag="noindex"),
        response(b, "http://b.example/robots.txt", "<html>no</html>"),
        response(c, "https://c.example/", "denied", 403),
    ]
    return replay.assemble(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(a,), (b,), (c,), ("d.example",)], "domain string"))


def test_aborts(audit):
    got = {r["domain"]: r["reason"] for r in audit.aborted.collect()}
    assert got == {"c.example": "home page answered HTTP 403", "d.example": "home page unreachable: not in fixture"}


def test_sites(audit):
    got = {r["domain"]: r for r in audit.sites.collect()}
    a, b = got["a.example"], got["b.example"]
    assert (a["base_url"], a["robots_real"], a["declared"], a["reachable"], len(a["llms"])) == ("https://www.a.example", True, "https://www.a.example/map.xml", "https://www.a.example/map.xml", 204)
    assert (b["base_url"], b["robots_real"], b["reachable"], b["llms"]) == ("http://b.example", False, None, None)


def test_pages(audit):
    got = [r for r in audit.pages.collect() if r["domain"] == "a.example"]
    assert sorted(r["pos"] for r in got) == [0, 1, 2, 3, 4]
    assert not any("private" in r["url"] or r["url"].endswith(".pdf") for r in got)


def test_notes(audit):
    said = {(r["domain"], r["pos"]): r["message"] for r in audit.errors.collect()}
    assert "http was used" in said["b.example", 0] and "not robots syntax" in said["b.example", 1]


def test_verdicts_of_a_site(audit):
    shut = {r["token"] for r in audit.verdicts.where("domain = 'a.example' AND NOT allowed").collect()}
    assert shut == {"GPTBot"}
    body = "User-agent: GPTBot\nDisallow: /\n"
    assert not accuracy.literal_verdict(body, "GPTBot")


def test_payloads(audit):
    got = {r["domain"]: json.loads(r["payload"]) for r in replay.payloads(audit).collect()}
    assert set(got) == {"a.example", "b.example"}
    a, b = got["a.example"], got["b.example"]
    assert 90 <= a["scores"]["access"]["score"] <= 100 and a["training_posture"]["state"] == "partial"
    assert b["scores"]["access"]["score"] == 85 and len(b["errors"]) == 2
    assert {c["check_id"]: c["ratio"] for c in b["checks"]}["no_noindex"] == 0
    assert a["robots"]["blanket_disallow"] is False and a["llms_txt"]["present"] is True


def test_one_page_at_least(spark, audit):
    with pytest.raises(ValueError):
        replay.assemble(audit.pages, audit.sites, pages=0)
