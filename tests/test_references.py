"""Queries on pages whose character references are cut short, against their SQL."""

from __future__ import annotations

import pytest

from sitelens.functions.html import page_features
from sitelens.plans import catalogue
from tests import oracle

#: titles with whole, unknown and cut references
TITLES = ["Ver&amp", "a&amp;&amp;&amp", "und&amp;&am", "x &quot", "&copy &middot", "a&ampb; c", "R&amp;D &amp;amp", "Fish &amp; chips", "a & b &"]


@pytest.fixture
def cut_dir(spark, tmp_path):
    """Pages of nine lengths with such a title and heading, each closed and open."""
    made = [f"<!DOCTYPE html><html><head><title>{t}</title><script>a&amp&&b</script></head><body><article><h1>{t}</h1><p>{'w ' * 40 * k}{t}</p></article></body>" for k, t in enumerate(TITLES)]
    rows = [(i, f"https://a.example/{i}?x=1", h) for i, h in enumerate([h + "</html>" for h in made] + made)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("html", [f"<title>{t}</title>" for t in TITLES])
def test_only_a_semicolon_ends_a_named_reference(html):
    want = html[7:-8].replace("&quot;", '"').replace("&amp;", "&")
    assert page_features(html, "https://a.example/")["title"] == want


def test_numbers_scripts_and_attributes():
    x = page_features('<title>&#38 &#x26; &lt;</title><link rel="canonical" href="/q?a=1&copy=2&amp;b"><script>a &amp b &amp; c &copy</script>', "https://a.example/")
    assert (x["title"], x["canonical"], x["script_chars"]) == ("& & <", "https://a.example/q?a=1&copy=2&b", len("a &amp b &amp; c &copy"))


def test_page_text_volume(spark, cut_dir):
    oracle.check(spark, cut_dir, catalogue.QUERIES["page_text_volume"], catalogue.ORACLE["page_text_volume"])


def test_title_quality(spark, cut_dir):
    oracle.check(spark, cut_dir, catalogue.QUERIES["title_quality"], catalogue.ORACLE["title_quality"])


def test_calibration_summary(spark, cut_dir):
    oracle.check(spark, cut_dir, catalogue.QUERIES["calibration_summary"], catalogue.ORACLE["calibration_summary"])


def test_stream_audit(spark, cut_dir):
    oracle.check(spark, cut_dir, catalogue.QUERIES["stream_audit"], catalogue.ORACLE["stream_audit"])
