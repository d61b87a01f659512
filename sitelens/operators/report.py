"""The payload of a site and what is rendered from it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.constants import BUCKETS, CHECK_TITLES, RUBRIC
from sitelens.functions.text import escape_cell, first_sentence
from sitelens.operators.robots import allow_lines
from sitelens.operators.signals import signals

LIMITATIONS = [
    "Only the home page and a few pages chosen by hash are read.",
    "Pages are read as they are sent; scripts aren't run.",
    "robots.txt is judged at the root of the site.",
    "Whether the text is true or useful isn't judged.",
    "Whether an assistant cites the site isn't measured.",
]
ROBOTS_CHECKS = ("citation_crawlers_allowed", "user_fetch_crawlers_allowed")


def check_rows(sites: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each site and criterion in rubric order; one that didn't run is a zero that says so."""
    wanted = sites.select("domain").withColumn("check", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(c).alias("category"), F.lit(i).alias("check_id"), F.lit(CHECK_TITLES[i]).alias("title"), F.lit(w).alias("weight")) for k, (c, i, w) in enumerate(RUBRIC)]))).select("domain", "check.*")
    joined = wanted.join(results.drop("category"), ["domain", "check_id"], "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    return joined.select("domain", "pos", "category", "check_id", F.when(F.col("severity").isNull(), F.col("check_id")).otherwise(F.col("title")).alias("title"), "weight", F.bround(ratio, 4).alias("ratio"), F.bround(F.col("weight") * ratio, 2).alias("earned"), F.coalesce("severity", F.lit("warning")).alias("severity"), F.coalesce("evidence", F.lit("the check did not run")).alias("evidence"), "fix", F.coalesce("details", F.lit("{}")).alias("details"))


def top_fixes(rows: DataFrame, count: int = 5) -> DataFrame:
    """domain, rank, check_id, cost: the fixes that would gain most, in rubric order where they gain the same."""
    cost = F.col("weight") * (1 - F.col("ratio"))
    order = Window.partitionBy("domain").orderBy(F.desc("cost"), "pos")
    return rows.where(F.col("fix").isNotNull() & (F.col("ratio") < 1)).withColumn("cost", cost).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("domain", "rank", "check_id", "cost")


def additions(results: DataFrame) -> DataFrame:
    """domain, additions: the lines for robots.txt that all fixes ask for, without crawlers that don't follow it."""
    detail = "STRUCT<blocked: ARRAY<STRING>, blocked_but_ignore_robots: ARRAY<STRING>>"
    own = results.where(F.col("check_id").isin(*ROBOTS_CHECKS) & F.col("fix").isNotNull()).withColumn("d", F.from_json("details", detail))
    useful = F.filter("d.blocked", lambda t: ~F.array_contains(F.coalesce("d.blocked_but_ignore_robots", F.array().cast("array<string>")), t))
    order = F.when(F.col("check_id") == ROBOTS_CHECKS[0], 0).otherwise(1)
    tokens = own.groupBy("domain").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), useful.alias("t")))), lambda x: x["t"])).alias("tokens"))
    line = results.where((F.col("check_id") == "sitemap_available") & (F.col("fix.snippet") != "")).select("domain", F.col("fix.snippet").alias("line"))
    both = results.select("domain").distinct().join(tokens, "domain", "left").join(line, "domain", "left")
    blocks = F.filter(F.array(F.when(F.size("tokens") > 0, allow_lines(F.col("tokens"))), F.col("line")), lambda x: x.isNotNull())
    return both.select("domain", F.array_join(blocks, "\n\n").alias("additions"))


def crawlers(verdicts: DataFrame) -> DataFrame:
    """domain, crawlers: a struct for each bucket with its counts and its crawlers in order."""
    agent = F.struct("pos", "token", "vendor", "allowed", "matched_rule", "obeys_robots", "ai_only", "docs", "note")
    per = verdicts.groupBy("domain").agg(*(F.struct(F.count_if((F.col("bucket") == b) & F.col("allowed")).alias("allowed"), F.count_if(F.col("bucket") == b).alias("total"), F.array_sort(F.collect_list(F.when(F.col("bucket") == b, agent))).alias("agents")).alias(b) for b in BUCKETS))
    return per.select("domain", F.struct(*BUCKETS).alias("crawlers"))


def content_signals(declared: DataFrame) -> DataFrame:
    """domain, content_signals of the sites that say anything. declared: domain, body."""
    told = signals(declared.select(F.col("domain").alias("robots_id"), "body"))
    note = F.lit("For information; what a site declares about AI use is never scored.").alias("note")
    return told.select(F.col("robots_id").alias("domain"), F.struct("declared", "unknown_keys", F.col("boilerplate_only").alias("terms_without_a_signal"), "summary", "raw", note).alias("content_signals"))


WITH_NULLS = {"ignoreNullFields": "false"}


def joined_json(object_: Column, name: str, value: Column) -> Column:
    """A JSON object with one more field, whose value is JSON already."""
    return F.concat(F.substring(object_, F.lit(1), F.length(object_) - 1), F.lit(f',"{name}":'), value, F.lit("}"))


def payload(sites: DataFrame, rows: DataFrame, scores: DataFrame, verdicts: DataFrame, pages: DataFrame, additions_: DataFrame, errors: DataFrame | None = None, declared: DataFrame | None = None, version: str = "0.1") -> DataFrame:
    """domain, payload (JSON of the whole run). sites: domain, base_url, declared, reachable, llms, robots_status, robots_real,
    blanket; errors: domain, pos, message; declared: domain, body of robots.txt, for its content signals."""
    from sitelens.operators.robots import posture

    entry = joined_json(F.to_json(F.struct("check_id", "category", "title", "weight", "ratio", "earned", "severity", "evidence", "fix"), WITH_NULLS), "details", F.col("details"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("text")))), lambda x: x["text"])
    checks = rows.groupBy("domain").agg(in_order.alias("checks"))
    score = scores.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct(F.col("final").alias("score"), F.col("raw").alias("raw_score"), "letter", "cap_applied"))))).alias("scores"))
    listed = pages.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "status"))).alias("pages"))
    out = sites.join(checks, "domain").join(score, "domain").join(crawlers(verdicts), "domain", "left").join(listed, "domain", "left").join(additions_, "domain", "left")
    if errors is not None:
        noted = errors.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]).alias("errors"))
        out = out.join(noted, "domain", "left")
    else:
        out = out.withColumn("errors", F.array().cast("array<string>"))
    said = content_signals(declared) if declared is not None else content_signals(sites.select("domain", F.lit(None).cast("string").alias("body")))
    out = out.join(said, "domain", "left")
    train = F.col("crawlers.training")
    made = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit("sitelens").alias("name"), F.lit(version).alias("version")).alias("tool"),
        F.struct("domain", "base_url", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.size("pages").alias("pages_sampled")).alias("run"),
        "scores",
        F.struct(posture(train["allowed"], train["total"]).alias("state"), train["allowed"].alias("allowed"), train["total"].alias("total"), F.lit("For information; it is never scored.").alias("note")).alias("training_posture"),
        "content_signals",
        "crawlers",
        F.struct(F.concat("base_url", F.lit("/robots.txt")).alias("url"), F.col("robots_status").alias("status"), F.col("robots_real").alias("is_real"), F.col("blanket").alias("blanket_disallow")).alias("robots"),
        F.struct("declared", "reachable").alias("sitemap"),
        F.struct(F.coalesce(F.trim("llms") != "", F.lit(False)).alias("present"), F.length(F.coalesce("llms", F.lit(""))).alias("length")).alias("llms_txt"),
        "pages",
        F.coalesce("additions", F.lit("")).alias("robots_txt_additions"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        F.array(*map(F.lit, LIMITATIONS)).alias("limitations"),
    )
    return out.select("domain", F.size("checks").alias("n_checks"), joined_json(F.to_json(made, WITH_NULLS), "checks", F.concat(F.lit("["), F.array_join("checks", ","), F.lit("]"))).alias("payload"))


def _actions(run: dict) -> list[dict]:
    failed = [c for c in run["checks"] if c.get("fix") and c["ratio"] < 1]
    return sorted(failed, key=lambda c: -c["weight"] * (1 - c["ratio"]))[:5]


def _cell(value) -> str:
    return str(value).replace("|", "\\|")


def markdown(run: dict) -> str:
    """The report of one payload."""
    out = [f"# {run['run']['domain']}", "", f"{run['run']['pages_sampled']} pages read at {run['run']['generated_at']}.", "", "## Scores", "", "| | score | grade |", "| --- | --- | --- |"]
    for name, s in run["scores"].items():
        out.append(f"| {name} | {s['score']:g} | {s['letter']} |" + (f" capped: {s['cap_applied']}" if s.get("cap_applied") else ""))
    out += ["", "## What to change first", ""]
    for k, c in enumerate(_actions(run), 1):
        out.append(f"{k}. {c['title']}: {c['weight'] * (1 - c['ratio']):.1f} points. {c['evidence']} {c['fix']['summary']} ([more]({c['fix']['docs_url']}))")
    if not _actions(run):
        out.append("Nothing.")
    if run.get("content_signals"):
        out += ["", "## Content signals", "", run["content_signals"]["summary"]]
    if run["robots_txt_additions"]:
        out += ["", "Lines for robots.txt:", "", "```", run["robots_txt_additions"].rstrip("\n"), "```"]
    for category in ("access", "readability"):
        out += ["", f"## Checks: {category}", "", "| check | points | severity | evidence |", "| --- | --- | --- | --- |"]
        out += [f"| {_cell(c['title'])} | {c['earned']:g} of {c['weight']} | {c['severity']} | {_cell(c['evidence'])} |" for c in run["checks"] if c["category"] == category]
    for bucket, b in (run.get("crawlers") or {}).items():
        out += ["", f"## Crawlers: {bucket} ({b['allowed']} of {b['total']})", "", "| crawler | allowed | rule |", "| --- | --- | --- |"]
        out += [f"| {a['token']} | {'yes' if a['allowed'] else 'no'} | {_cell(a.get('matched_rule') or '')} |" for a in b["agents"]]
    out += ["", "## Notes", "", *(f"- {x}" for x in [*run["errors"], *run["limitations"]])]
    return "\n".join(out) + "\n"


def terminal(run: dict) -> str:
    """A short report of one payload."""
    out = [run["run"]["domain"]]
    out += [f"  {name:12} {s['score']:6.2f} {s['letter']}" for name, s in run["scores"].items()]
    for bucket, b in (run.get("crawlers") or {}).items():
        rules = sorted({a["matched_rule"] for a in b["agents"] if not a["allowed"] and a.get("matched_rule")})
        out.append(f"  {bucket}: {b['allowed']} of {b['total']}" + "".join(f"\n      {r}" for r in rules))
    out += [f"  {c['weight'] * (1 - c['ratio']):4.1f} points: {c['check_id']}" for c in _actions(run)]
    return "\n".join(out) + "\n"


@F.pandas_udf(T.StringType())
def render_markdown(payload_: pd.Series) -> pd.Series:
    return payload_.map(lambda p: markdown(json.loads(p)))


@F.pandas_udf(T.StringType())
def render_terminal(payload_: pd.Series) -> pd.Series:
    return payload_.map(lambda p: terminal(json.loads(p)))


SECTIONS = {"citation": ("## Crawlers that cite", 50), "user_fetch": ("## Crawlers that fetch for a person", 20), "training": ("## Crawlers that train", 0)}


def crawler_table(agents: DataFrame) -> DataFrame:
    """bucket, document: how many crawlers each bucket has, what they are worth, and a table of them by name, each with a link to its
    vendor's page where there is one, and what it does."""
    vendor = F.when(F.col("docs").isNotNull(), F.concat(F.lit("["), "vendor", F.lit("]("), "docs", F.lit(")"))).otherwise(F.col("vendor"))
    line = F.concat(F.lit("| `"), "token", F.lit("` | "), escape_cell(vendor), F.lit(" | "), "obeys_robots", F.lit(" | "), escape_cell(first_sentence(F.col("note"))), F.lit(" |"))
    rows = agents.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(F.lower("token").alias("k"), line.alias("line")))).alias("rows"))
    worth = F.create_map(*[F.lit(x) for b, (_, w) in SECTIONS.items() for x in (b, w)])
    count = F.concat(F.size("rows").cast("string"), F.lit(" crawlers, worth "), F.element_at(worth, F.col("bucket")).cast("string"), F.lit(" points."))
    return rows.select("bucket", F.concat(count, F.lit("\n\n| crawler | vendor | follows robots.txt | what it does |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("document"))


def rebuilt(page: str, agents: DataFrame) -> str:
    """A page of documentation with what stands under each bucket's heading, up to the next heading, made anew; the rest is left
    as it is. A page without one of the headings is an error."""
    made = {r["bucket"]: r["document"] for r in crawler_table(agents).collect()}  # three rows
    parts = re.split(r"(?m)^(?=## )", page)
    for bucket, (heading, _) in SECTIONS.items():
        own = [k for k, part in enumerate(parts) if part.split("\n", 1)[0].rstrip() == heading]
        if not own:
            raise ValueError(f"no heading {heading!r}")
        parts[own[0]] = f"{heading}\n\n{made[bucket]}\n" + ("\n" if own[0] + 1 < len(parts) else "")
    return "".join(parts)


def is_current(page: str, agents: DataFrame) -> bool:
    """Whether a page says what the table of crawlers says."""
    return rebuilt(page, agents) == page
