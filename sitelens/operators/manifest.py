"""Fingerprints of recorded robots.txt files, and what changed between two recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import path


def digest(text: Column) -> tuple[Column, Column]:
    return F.sha2(text, 256), F.octet_length(text)


def manifest(responses: DataFrame) -> DataFrame:
    """A row for each domain with the first recorded /robots.txt. responses: domain, pos, url, status, error, text, fetched_at, outcome."""
    own = F.struct("url", "status", "error", "text")
    hit = path(F.col("url")) == "/robots.txt"
    rows = responses.groupBy("domain").agg(F.first("fetched_at").alias("fetched_at"), F.first("outcome").alias("outcome"), F.min_by(F.when(hit, own), F.when(hit, F.col("pos"))).alias("r"))
    good = F.col("r.status") == 200
    sha, size = digest(F.coalesce("r.text", F.lit("")))
    state = F.when(F.col("r").isNull(), "").otherwise(F.coalesce(F.col("r.status").cast("string"), F.col("r.error"), F.lit("error")))
    return rows.select("domain", "fetched_at", "outcome", F.coalesce("r.url", F.lit("")).alias("robots_url"), state.alias("robots_status"), F.when(good, sha).otherwise("").alias("robots_sha256"), F.when(good, size.cast("string")).otherwise("").alias("robots_bytes"))


def hashed(rows: DataFrame) -> DataFrame:
    return rows.where("robots_sha256 <> ''")


def missing(corpus: DataFrame, responses: DataFrame) -> DataFrame:
    return corpus.join(responses.select("domain").distinct(), "domain", "left_anti")


def difference(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """domain, state: MATCH, CHANGED or UNREACHABLE. live: domain, status, text."""
    sha, _ = digest(F.coalesce("text", F.lit("")))
    now = live.select("domain", F.when(F.col("status") == 200, sha).alias("sha"))
    state = F.when(F.col("sha").isNull(), "UNREACHABLE").when(F.col("sha") == F.col("robots_sha256"), "MATCH").otherwise("CHANGED")
    return hashed(recorded).join(now, "domain", "left").select("domain", state.alias("state"))


def tally(differences: DataFrame) -> DataFrame:
    return differences.groupBy("state").agg(F.count("*").alias("n"))


def pick(rows: DataFrame, names: list[str] | None = None, count: int | None = None) -> DataFrame:
    """The rows named, or the first `count` by SHA-256 of the domain."""
    if names:
        return rows.where(F.col("domain").isin(names))
    ordered = rows.orderBy(F.sha2("domain", 256))
    return ordered.limit(count) if count is not None else ordered
