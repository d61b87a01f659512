"""Queries on pages with a `<` that starts no tag or a tag cut by the end of the page, against their SQL."""

from __future__ import annotations

import pytest

from sitelens.functions.html import Tree, page_features
from sitelens.plans import catalogue
from tests import oracle

TITLES = ["I <3 you", "1<2", "a <- b", "x<", "<<", "<&amp;<", "10 <20 <30 & so on"]
PAGE = "<!DOCTYPE html><html><head><title>t</title></head><body><article><h1>t</h1><p>{}</p></article><footer>end.</footer></body></html>"


@pytest.fixture
def made_dir(spark, tmp_path):
    """A function that writes pages and gives their folder."""

    def make(pages: list[str]) -> str:
        rows = [(i, f"https://a.example/{i}?x=1", h) for i, h in enumerate(pages)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/w")
        next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "pages.parquet")
        return str(tmp_path)

    return make


def cut_pages() -> list[str]:
    """Whole pages, and pages cut at each character of the tags after the article."""
    tail = len("<footer>end.</footer></body></html>")
    return [PAGE.format("w " * 30)] + [PAGE.format("w " * (30 + k))[:-k] for k in range(1, tail)]


@pytest.mark.parametrize("title", TITLES)
def test_a_title_is_one_run(title):
    assert page_features(f"<title>{title}</title>", "https://a.example/")["title"] == title.replace("&amp;", "&")


def test_tags_and_comments_part_runs():
    assert [Tree(f"<p>a{x}b").root.texts() for x in ("<!-- c -->", "</i>", "<br>", "<br/>", "<?c>", "<!c>", "</3>")] == ["a b"] * 7
    assert Tree("<p>a<3 <</p>b<4").root.texts() == "a<3 < b<4"
    assert page_features("<script>if(a<3&&b<4&amp)c</script>", "")["script_chars"] == len("if(a<3&&b<4&amp)c")


def test_an_unknown_section_is_a_comment():
    assert [Tree(f"<p>a{x}b").root.texts() for x in ("<![c[d]]>", "<![1]>", "<![endif]>")] == ["a b"] * 3


def test_many_pieces():
    assert len(Tree("<" * 300_000).root.texts()) == 300_000


def test_title_quality(spark, made_dir):
    at = made_dir([PAGE.replace("<title>t", f"<title>{t}").format("w") for t in TITLES])
    oracle.check(spark, at, catalogue.QUERIES["title_quality"], catalogue.ORACLE["title_quality"])


def test_calibration_summary(spark, made_dir):
    at = made_dir([*cut_pages(), PAGE.format("w") + "<a hre"])
    oracle.check(spark, at, catalogue.QUERIES["calibration_summary"], catalogue.ORACLE["calibration_summary"])


def test_stream_audit(spark, made_dir):
    oracle.check(spark, made_dir(cut_pages()), catalogue.QUERIES["stream_audit"], catalogue.ORACLE["stream_audit"])
