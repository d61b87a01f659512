"""The calibration of text lengths on tables in which pages have no HTML, against its SQL."""

from __future__ import annotations

import pytest

from sitelens.operators import study
from sitelens.plans import catalogue
from tests import oracle

WHOLE = "<!DOCTYPE html><html><head><title>t</title></head><body><article><h1>t</h1><p>{}</p></article></body></html>"
CUT = WHOLE.replace("</body></html>", "")


@pytest.mark.parametrize("unread", [1, 2, 3, 4, 5, 9])
def test_calibration_summary_without_html(spark, tmp_path, unread):
    pages = [WHOLE.format("w " * 50), WHOLE.format("w"), *(CUT.format("w " * 20 * k) for k in range(1, 5)), ""] + [None] * unread
    rows = [(i, f"https://a.example/{i}?x=1", h) for i, h in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    got, want = catalogue.QUERIES["calibration_summary"](spark, str(tmp_path)), oracle.duck(str(tmp_path), catalogue.ORACLE["calibration_summary"])
    want = want.astype(object).where(want.notna(), None)[got.columns]
    assert {tuple(r) for r in got.collect()} == set(want.itertuples(index=False, name=None))


def test_calibration(spark):
    made = {"a": [3, 1, None], "b": [None, 2], "c": [None, None], "d": [4, 0]}
    pages = spark.createDataFrame([(g, n) for g, v in made.items() for n in v], "g string, text_chars int")
    assert {tuple(r) for r in study.calibration(pages, "g").collect()} == {("a", 1, 3, 3), ("b", 2, None, 2), ("c", None, None, None), ("d", 0, 4, 4)}
