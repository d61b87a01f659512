"""Page features and the scores of a page."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelens.functions.html import page_features
from sitelens.operators import checks


def f(html, url="https://a.example/p"):
    return page_features(html, url)


def test_text_counts_the_title_and_not_scripts():
    x = f('<title>T t</title><script>var a="</p>";</script><style>b</style><noscript>c</noscript><!-- d --><p>e<b>f</b>')
    assert (x["text_chars"], x["script_chars"], x["title"]) == (len("T t e f"), len('var a="</p>";'), "T t")


@pytest.mark.parametrize(
    ("html", "shape"),
    [
        ("<ol><li>a<li>b<li>c</ol>", "steps"),
        ("<table><tr><th>a<tr><td>b<tr><td>c</table>", "comparison_table"),
        ("<details><summary>a</summary>b</details>", "faq"),
        ("<h2>a?</h2><h3>b?</h3>", "faq"),
        ('<script type="application/ld+json">{"@type":"FAQPage"}</script>', "faq"),
        ("<dl><dt>a<dd>b</dl>", "definition_list"),
        ('<blockquote cite="x">a</blockquote>', "attributed_quote"),
        ("<h2>Em resumo</h2>", "summary_box"),
    ],
)
def test_one_shape_each(html, shape):
    x = f(html)
    assert [n for n in checks.SHAPES if x[n]] == [shape]


def test_nested_lists_count_direct_items_only():
    assert not f("<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol>")["steps"]


def test_jsonld():
    x = f('<script type="application/ld+json">[{"@type":"A","author":"x"},{"@graph":[{"@type":["B","c "]}]}]</script><script type="application/ld+json">{</script><script type="application/ld+json"> </script>')
    assert (x["jsonld_types"], x["jsonld_broken"], x["author_mark"], x["date_mark"]) == (["a", "b", "c"], 1, True, False)


def test_canonical_is_resolved():
    assert f('<link rel="x CANONICAL" href="/q">')["canonical"] == "https://a.example/q"
    assert f('<link rel="stylesheet" href="/q">')["canonical"] == ""


def test_sections_count_nested_blocks_again():
    assert f("<h1>t</h1><p>a b</p><h2>s</h2><blockquote><p>c d</p></blockquote>")["block_sizes"] == [2, 4]


def test_nothing_and_broken_markup():
    for html in (None, "", "<", "<p", "<a <b>>", "</p></p>", "<table><td>x"):
        assert f(html)["html_chars"] == len(html or "")


@pytest.mark.parametrize(("text", "script", "score"), [(0, 0, 0), (499, 0, 0), (500, 50_001, 0.25), (500, 50_000, 0.5), (1499, 0, 0.5), (1500, 0, 1), (1500, 150_001, 0.25)])
def test_raw_html_bands(spark, text, script, score):
    assert spark.range(1).select(checks.raw_html_score(F.lit(text), F.lit(script))).collect()[0][0] == score


@pytest.mark.parametrize(("levels", "score"), [([1, 2, 3, 2], 1.0), ([1, 3], 0.6), ([1, 1, 2], 0.4), ([2, 3], 0.0), ([], 0.0), ([1], 1.0), ([1, 1, 3], 0.0)])
def test_heading_scores(spark, levels, score):
    df = spark.createDataFrame([(levels,)], "x array<int>")
    assert df.select(checks.heading_score(F.col("x"))).collect()[0][0] == pytest.approx(score)


@pytest.mark.parametrize(("value", "blocked"), [("noindex", True), ("googlebot: NoIndex, nofollow", True), ("none", True), ("a; b:none", True), ("max-image-preview:large", False), ("", False), ("noindexed", False)])
def test_noindex_directives(spark, value, blocked):
    assert spark.range(1).select(checks.blocks_indexing(F.lit(value))).collect()[0][0] is blocked


@pytest.mark.parametrize(("status", "url", "password", "text", "wall"), [(404, "https://a.example/", False, 9, True), (200, "https://a.example/LOGIN/x", False, 9999, True), (200, "https://a.example/", True, 1499, True), (200, "https://a.example/", True, 1500, False), (200, "https://a.example/?to=/login", False, 9, False)])
def test_walls(spark, status, url, password, text, wall):
    got = spark.range(1).select(checks.wall_reason(F.lit(status), F.lit(url), F.lit(password), F.lit(text))).collect()[0][0]
    assert (got is not None) is wall
