"""Group selection, path precedence and what is said about them."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.operators import accuracy, robots


def told(spark, body, path="/"):
    df = spark.createDataFrame([(0, body)], "robots_id int, body string")
    return {r["token"]: r for r in robots.verdicts(df, path).collect()}


@pytest.mark.parametrize(
    ("body", "shut", "let_in"),
    [
        (None, [], ["GPTBot", "Googlebot"]),
        ("User-agent: *\nDisallow: /\n", ["GPTBot", "Googlebot"], []),
        ("User-agent: *\nDisallow:\n", [], ["GPTBot"]),
        ("User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /\n", ["Bingbot"], ["Googlebot"]),
        ("user-agent: gptbot\ndisallow: /\n", ["GPTBot"], ["ClaudeBot"]),
        ("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n", ["GPTBot", "CCBot"], ["ClaudeBot"]),
        ("User-agent: *\nDisallow: /*.pdf$\nDisallow: /search?*\n", [], ["GPTBot"]),
        ("User-agent: *\nDisallow: /\nAllow: /\n", [], ["GPTBot"]),
        ("User-agent: bot\nDisallow: /\n", [], ["GPTBot", "Bingbot"]),
        ("User-agent: Google\nDisallow: /\n", ["Googlebot", "Google-Extended"], ["Bingbot"]),
        ("User-agent: Google\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /\n", ["Google-Extended"], ["Googlebot"]),
        ("User-agent: CCBot\nDisallow: /\n\nUser-agent: CCBot\nAllow: /\n", [], ["CCBot"]),
        ("User-agent: CCBot\nCrawl-delay: 1\n\nUser-agent: Other\nDisallow: /\n", [], ["CCBot"]),
        ("User-agent: CCBot\nSitemap: https://a.example/s.xml\nUser-agent: Other\nDisallow: /\n", [], ["CCBot"]),
        ("User-agent:\nDisallow: /\n\nUser-agent: *\nAllow: /\n", ["GPTBot", "Googlebot"], []),
        ("﻿User-agent: *\nDisallow: /\n", [], ["GPTBot"]),
        ("Disallow: /\nUser-agent: X\nDisallow: /\n", [], ["GPTBot"]),
        ("User-agent: *\x0bDisallow: / Allow: /x\n", ["GPTBot"], []),
    ],
)
def test_verdicts(spark, body, shut, let_in):
    got = told(spark, body)
    assert len(got) == 32
    assert not any(got[t]["allowed"] for t in shut)
    assert all(got[t]["allowed"] for t in let_in)


def test_paths_of_a_page(spark):
    body = "User-agent: *\nDisallow: /a/\nAllow: /a/b\nDisallow: /*.pdf$\n"
    for path, allowed in (("/", True), ("/a/", False), ("/a/bc", True), ("/x.pdf", False), ("/x.pdf?y", True)):
        assert told(spark, body, path)["GPTBot"]["allowed"] is allowed


def test_description_names_three_rules(spark):
    body = "User-agent: GPTBOT\nDisallow: /a\nDisallow: /b\nAllow: /c\nDisallow: /d\nDisallow: /e\n"
    assert told(spark, body)["GPTBot"]["matched_rule"] == "User-agent: GPTBOT | Disallow: /a, Disallow: /b, Allow: /c, and 2 more"
    assert told(spark, "User-agent: GPTBot\n")["GPTBot"]["matched_rule"] == "User-agent: GPTBot (no rules)"
    assert told(spark, "User-agent: GPTBot\n")["CCBot"]["matched_rule"] is None


@pytest.mark.parametrize(("body", "blanket"), [("User-agent: *\nDisallow: /\n", True), ("User-agent: *\nDisallow: /\nAllow: /x/\n", False), ("User-agent: A\nDisallow: /\n", False), ("User-agent: *\nDisallow: /\nAllow:\n", True), (None, False)])
def test_blanket(spark, body, blanket):
    df = spark.createDataFrame([(0, body)], "robots_id int, body string")
    assert robots.blanket_disallow(df).collect()[0]["blanket"] is blanket


def test_allow_lines(spark):
    row = spark.range(1).select(robots.allow_lines(F.array(F.lit("A"), F.lit("B"))).alias("x")).collect()[0]
    assert row["x"] == "User-agent: A\nAllow: /\n\nUser-agent: B\nAllow: /"


line = st.sampled_from(["User-agent: *", "User-agent: GPTBot", "user-agent: Google", "User-agent: googlebot # x", "Disallow: /", "Allow: /", "Disallow:", "Allow: /*", "Disallow: /$", "Crawl-delay: 2", "noise", "", "Sitemap: https://a.example/s.xml"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(line, max_size=8).map("\n".join), min_size=1, max_size=12))
def test_equals_the_literal_reading(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "robots_id int, body string")
    row = accuracy.agreement(accuracy.compare(df)).collect()[0]
    assert row["tool_literal"] == row["total"]


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("/caf%C3%A9", "/café/x", True), ("/café", "/caf%c3%a9", True), ("/%7Euser", "/~user", True), ("/a%2Fb", "/a/b", False), ("/a%2fb", "/a%2Fb", True), ("/100%", "/100%", True), ("/a+b", "/a b", False), ("/a+b", "/a+b/", True),
        ("/%2A", "/x", False), ("/*a*b$", "/xaab", True), ("/*a*b$", "/xabc", False), ("/*ab*ab$", "/ab", False), ("/a$", "/a", True), ("/a$", "/ab", False), ("/a*$", "/abc", True), ("*", "/", True), ("$", "/", False), ("/x*", "/y", False), ("/**b", "/aab", True), ("/a$b", "/a$bc", True), ("", "/", False), ("/*/c", "/a/b/c/d", True),
    ],
)
def test_paths_that_rules_cover(spark, pattern, path, fits):
    assert spark.range(1).select(robots.covers(F.lit(pattern), F.lit(path))).collect()[0][0] is fits


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("/ab*$", max_size=7), st.text("/ab", max_size=8)), min_size=1, max_size=40))
def test_covering_equals_a_regular_expression(spark, pairs):
    got = [r[0] for r in spark.createDataFrame(pairs, "p string, x string").select(robots.covers(F.col("p"), F.col("x"))).collect()]
    for (pattern, path), fits in zip(pairs, got, strict=True):
        ended = pattern.endswith("$")
        expression = ".*".join(map(re.escape, (pattern[:-1] if ended else pattern).split("*"))) + ("$" if ended else "")
        assert fits is bool(pattern and re.match(expression, path)), (pattern, path)


def test_many_stars_take_no_time(spark):
    began = time.time()
    rule = "/" + "*a" * 400 + "*b$"
    urls = spark.createDataFrame([(0, "https://x.example/" + "a" * 2000)], "robots_id int, url string")
    bodies = spark.createDataFrame([(0, f"User-agent: *\nDisallow: {rule}\n")], "robots_id int, body string")
    assert robots.permitted(urls, bodies, "sitelens").count() == 1
    assert time.time() - began < 15
