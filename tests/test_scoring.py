"""Rubric, grades, caps, studies."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitelens import constants as K
from sitelens.functions import text, urls
from sitelens.operators import checks, report, robots, scoring, study
from sitelens.plans import bridge, catalogue


def test_weights_sum_to_a_hundred():
    for category in ("access", "readability"):
        assert sum(w for c, _, w in K.RUBRIC if c == category) == 100
    assert [sum(a[2] == b for a in K.AGENTS) for b in K.BUCKETS] == [11, 8, 13]
    assert len({a[0] for a in K.AGENTS}) == 32


@pytest.mark.parametrize(("score", "letter"), [(100, "A"), (90, "A"), (89.9, "B"), (75, "B"), (60, "C"), (40, "D"), (39.9, "F")])
def test_grades(spark, score, letter):
    assert spark.range(1).select(scoring.grade(F.lit(score))).collect()[0][0] == letter


def scored(spark, ratios, caps=None):
    sites = spark.createDataFrame([("a",)], "domain string")
    rows = [("a", i, float(r)) for (_, i, _), r in zip(K.RUBRIC, ratios, strict=False) if r is not None]
    results = spark.createDataFrame(rows, "domain string, check_id string, ratio double")
    cap = spark.createDataFrame(caps, "domain string, cap int, reason string") if caps else None
    return {r["category"]: r for r in scoring.scores(sites, results, cap).collect()}


def test_a_missing_check_is_a_zero(spark):
    assert scored(spark, [1, 1, 1, 1, None])["access"]["final"] == 95


@pytest.mark.parametrize(("ratios", "score"), [((1, 1, 1, 0, 1), 90.0), ((5 / 11, 7 / 8, 0.8, 1, 1), 67.23), ((0, 2 / 8, 1, 1, 1), 35.0)])
def test_scores_follow_from_counts(spark, ratios, score):
    assert scored(spark, ratios)["access"]["raw"] == score


def test_a_cap_lowers_and_never_raises(spark):
    assert scored(spark, [1, 1, 1, 1, 1], [("a", 20, "x")])["access"]["final"] == 20
    low = scored(spark, [0, 0, 0, 1, 1], [("a", 20, "x")])["access"]
    assert (low["final"], low["cap_applied"]) == (15, None)


def test_gate(spark):
    df = spark.createDataFrame([("a", 59.0), ("b", 60.0)], "domain string, final double")
    assert [r["domain"] for r in scoring.below(df, "60").collect()] == ["a"]
    assert scoring.below(df, " ").count() == 0
    with pytest.raises(ValueError):
        scoring.below(df, "high")


@pytest.mark.parametrize(("values", "middle"), [([1.0], 1), ([1.0, 2.0, 3.0, 10.0], 3), ([5.0, 1.0, 2.0], 2), ([], None)])
def test_upper_median(spark, values, middle):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.agg(study.upper_median("x")).collect()[0][0] == middle


def test_ties_of_fixes_stand_in_rubric_order(spark):
    rows = spark.createDataFrame([("a", 1, "b", 20, 0.5, "f"), ("a", 0, "x", 10, 0.0, "f"), ("a", 2, "y", 50, 1.0, "f"), ("a", 3, "z", 50, 0.0, None)], "domain string, pos int, check_id string, weight int, ratio double, fix string")
    assert [r["check_id"] for r in report.top_fixes(rows).orderBy("rank").collect()] == ["x", "b"]


@pytest.mark.parametrize(("typed", "base"), [("a.example", "https://a.example"), (" http://A.example:80/x ", "http://A.example:80"), ("", None), ("https://", None)])
def test_bases(spark, typed, base):
    assert spark.range(1).select(urls.normalise_base(F.lit(typed))).collect()[0][0] == base


def test_text_helpers(spark):
    words = lambda *w: text.join_words(F.array(*map(F.lit, w)))
    got = spark.range(1).select(words("a"), words("a", "b"), words("a", "b", "c"), text.percentage(F.lit(1), F.lit(8)), text.percentage(F.lit(0), F.lit(0)), text.escape_cell(F.lit("a|b")), text.first_sentence(F.lit("One two. Three."))).collect()[0]
    assert tuple(got) == ("a", "a and b", "a, b and c", 12.5, 0.0, "a\\|b", "One two")


def test_a_failing_check_is_an_error_of_its_site_alone(spark, sf_dir, monkeypatch):
    """At every other site the check gives a ratio of 3, which stops nothing else."""
    sites = bridge.sites(spark, sf_dir)
    pages = catalogue.featured(spark, sf_dir)
    verdicts = catalogue.site_verdicts(sites)
    sound = checks.CHECKS["llms_txt"]
    broken = lambda c: (F.when(F.length("domain") % 2 == 0, 3.0).when(F.length("domain") % 3 == 0, F.lit(None)).otherwise(sound[0](c)[0]), *sound[0](c)[1:])
    monkeypatch.setitem(checks.CHECKS, "llms_txt", (broken, sound[1]))
    ran = checks.attempted(sites, pages, verdicts).cache()
    bad = {r["domain"] for r in sites.collect() if len(r["domain"]) % 2 == 0 or len(r["domain"]) % 3 == 0}
    assert {r["domain"] for r in checks.failures(ran).collect()} == bad and bad
    good = checks.sound(ran)
    assert good.count() == 13 * sites.count() - len(bad)
    rows = report.check_rows(sites, good)
    told = {(r["domain"], r["check_id"]): r for r in rows.collect()}
    assert len(told) == 13 * sites.count()
    for (domain, check_id), r in told.items():
        missing = check_id == "llms_txt" and domain in bad
        assert (r["evidence"] == "the check did not run") == missing and r["title"] == (check_id if missing else K.CHECK_TITLES[check_id])
    scores = scoring.scores(sites, good)
    made = report.payload(sites.withColumn("blanket", F.lit(False)), rows, scores, verdicts, pages, report.additions(good), checks.failures(ran))
    for r in made.collect():
        run = json.loads(r["payload"])
        assert len(run["checks"]) == 13 and (len(run["errors"]) == 1) == (r["domain"] in bad) and run["content_signals"] is None
        assert all(e.startswith("llms_txt: no ratio from 0 to 1 but ") for e in run["errors"])


def test_fixes_have_parts(spark, sf_dir):
    for r in catalogue.QUERIES["payload_json"](spark, sf_dir).collect():
        run = json.loads(r["payload"])
        for c in run["checks"]:
            assert isinstance(c["details"], dict) and c["title"]
            assert c["fix"] is None or (c["fix"]["summary"] and c["fix"]["docs_url"].startswith("https://") and set(c["fix"]) == {"summary", "snippet", "docs_url"})
            assert (c["fix"] is None) == (c["severity"] == "ok") or c["check_id"] in ("user_fetch_crawlers_allowed", "no_noindex") or c["evidence"].startswith("No page")
        own = next(c for c in run["checks"] if c["check_id"] == "citation_crawlers_allowed")
        assert own["fix"] is None or own["fix"]["snippet"].startswith("User-agent: ")
        for agent in run["crawlers"]["training"]["agents"]:
            assert agent["note"] and (agent["docs"] or agent["token"] == "Bytespider")


def test_page_of_crawlers(spark):
    agents = robots.agents(spark)
    page = "# Crawlers\n\nProse.\n\n" + "".join(f"{h}\n\nold\n\n" for h, _ in report.SECTIONS.values()) + "## After\n\nMore.\n"
    made = report.rebuilt(page, agents)
    assert not report.is_current(page, agents) and report.is_current(made, agents)
    assert made.startswith("# Crawlers\n\nProse.\n\n## Crawlers that cite\n\n11 crawlers, worth 50 points.\n") and made.endswith("## After\n\nMore.\n") and "\nold\n" not in made
    assert "| `GPTBot` | [OpenAI](https://developers.openai.com/api/docs/bots) | yes | Collects pages for training |" in made and "| `Bytespider` | ByteDance |" in made
    with pytest.raises(ValueError):
        report.rebuilt("# no headings", agents)
    assert set(K.CRAWLER_NOTES) == {a[0] for a in K.AGENTS} and all(a[5] == bool(K.CRAWLER_DOCS.get(a[0], K.VENDOR_DOCS.get(a[1]))) for a in K.AGENTS)


def test_the_first_four_faulty_pages_are_shown(spark):
    """In page order, repeated rows and ties included, however the rows are dealt; a site without faults says nothing."""
    rows = [("a.example", i, 404 if i % 2 else 200, f"https://a.example/{i}") for i in range(40)] + [("b.example", 0, 200, "https://b.example/"), ("c.example", 3, 404, "https://c.example/y"), ("c.example", 3, 404, "https://c.example/x"), ("c.example", 3, 404, "https://c.example/x"), ("d.example", None, None, None)]
    pages = spark.createDataFrame(rows, "domain string, pos int, status int, url string").withColumn("_wall", F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    for df in (pages, pages.repartition(7)):
        told = {r[0]: r[1] for r in checks.first_faults(df, ["pages_reachable"]).collect()}
        assert told == {
            "a.example": "; ".join(f"https://a.example/{i} (HTTP 404)" for i in (1, 3, 5, 7)),
            "c.example": "https://c.example/x (HTTP 404); https://c.example/x (HTTP 404); https://c.example/y (HTTP 404)",
        }
    plan = checks.first_faults(pages, ["pages_reachable"])._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert checks.first_faults(pages.limit(0), ["pages_reachable"]).count() == 0
