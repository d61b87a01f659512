"""Three independent readings of robots.txt at the root of a site, compared."""

from __future__ import annotations

import re
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.robots import verdicts


def literal_verdict(body: str | None, token: str) -> bool:
    """Straight from RFC 9309, line by line: the reading the relational one is held against."""
    if body is None:
        return True
    groups: list[dict] = []
    in_names = False
    for line in body.splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not in_names:
                groups.append({"names": [], "rules": []})
            groups[-1]["names"].append(value.lower())
        elif field in ("allow", "disallow") and groups:
            groups[-1]["rules"].append((field == "allow", value))
        in_names = field == "user-agent"
    names = {n for g in groups for n in g["names"] if n != "*" and token.lower().startswith(n)}
    name = max(names, key=len) if names else "*"
    best = (-1, True)
    for allow, pattern in (r for g in groups if name in g["names"] for r in g["rules"]):
        end = pattern.endswith("$")
        expression = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
        if pattern and re.match(expression + ("$" if end else ""), "/"):
            best = max(best, (len(pattern), allow))
    return best[1]


def library_verdict(body: str | None, token: str) -> bool:
    """The standard library's reading, which takes names as parts of the user agent."""
    if body is None:
        return True
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return parser.can_fetch(token, "https://example.invalid/")


@F.pandas_udf(T.BooleanType())
def literal(body: pd.Series, token: pd.Series) -> pd.Series:
    return pd.Series([literal_verdict(b, t) for b, t in zip(body, token, strict=True)])


@F.pandas_udf(T.BooleanType())
def library(body: pd.Series, token: pd.Series) -> pd.Series:
    return pd.Series([library_verdict(b, t) for b, t in zip(body, token, strict=True)])


def compare(bodies: DataFrame) -> DataFrame:
    """robots_id, token, bucket and the three verdicts; bodies of null are passed over."""
    real = bodies.where("body IS NOT NULL")
    return verdicts(real).join(real, "robots_id").select("robots_id", "token", "bucket", F.col("allowed").alias("tool"), literal("body", "token").alias("literal"), library("body", "token").alias("stdlib"))


def agreement(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("tool") == F.col("literal")).alias("tool_literal"), F.count_if(F.col("tool") == F.col("stdlib")).alias("tool_stdlib"), F.count("*").alias("total"))


def skipped(outcomes: DataFrame) -> DataFrame:
    """outcome, n of the sites that weren't compared, most first. outcomes: domain, outcome (`compared` or why not)."""
    return outcomes.where("outcome <> 'compared'").groupBy("outcome").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "outcome")


def outcomes(sites: DataFrame, aborted: DataFrame) -> DataFrame:
    """domain, outcome of sites (domain, robots_real) and those that were aborted (domain)."""
    said = F.when(F.col("gone").isNotNull(), "aborted").when(~F.col("robots_real"), "no_robots").otherwise("compared")
    return sites.select("domain", "robots_real").join(aborted.select("domain", F.lit(True).alias("gone")), "domain", "full_outer").select("domain", said.alias("outcome"))


def disagreements(compared: DataFrame) -> DataFrame:
    return compared.where("tool <> literal OR tool <> stdlib").orderBy("robots_id", "token")


def worth_reading(compared: DataFrame) -> DataFrame:
    """Bodies that block a crawler other than for training: the ones to check by hand."""
    return compared.where("bucket <> 'training' AND NOT tool").select("robots_id").distinct().orderBy("robots_id")
