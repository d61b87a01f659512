"""Sitemaps: what answers as one, the URLs it lists, and samples that are the same on every run."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.constants import NESTED_SITEMAPS, PAGES_SAMPLED, SITEMAP_URLS
from sitelens.functions.urls import is_page

TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<[?!][^>]*>|<[^>]*\Z|<(/?)([^\s/>]+)[^>]*?(/?)>|([^<]+)", re.S)


def looks_like_sitemap(status: Column, error: Column, url: Column, content_type: Column, text: Column) -> Column:
    """Whether an answer is plausibly a sitemap; compressed ones are taken at their name."""
    typed = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 600), r"^\s+", ""))
    packed = F.endswith(url, F.lit(".gz")) | F.contains(typed, F.lit("gzip"))
    page = F.contains(typed, F.lit("html")) | F.startswith(head, F.lit("<!doctype html")) | F.contains(head, F.lit("<html"))
    xml = F.startswith(head, F.lit("<?xml")) | F.contains(head, F.lit("<urlset")) | F.contains(head, F.lit("<sitemapindex"))
    return F.coalesce(error.isNull() & (status == 200) & (packed | (~page & xml)), F.lit(False))


def locations(text: str | None) -> list[dict]:
    """kind (page or nested) and url of every loc, in order. Namespaces are passed over, entities other than the five of XML
    and numbers stay as they are, and a document that breaks off gives what came before."""
    stack: list[str] = []
    out: list[dict] = []
    held: list[str] | None = None
    for m in TAG.finditer(text or ""):
        cdata, closing, name, empty, plain = m.groups()
        if name:
            local = name.rsplit(":", 1)[-1]
            if closing:
                if local == "loc" and held is not None:
                    if url := "".join(held).strip():
                        out.append({"kind": "nested" if stack[-2:-1] == ["sitemap"] else "page", "url": url})
                    held = None
                if local in stack:
                    while stack.pop() != local:
                        pass
            elif not empty:
                stack.append(local)
                held = [] if local == "loc" else None
        elif held is not None:
            held.append(cdata if cdata is not None else html.unescape(plain) if plain else "")
    if held and (url := "".join(held).strip()):
        out.append({"kind": "nested" if stack[-2:-1] == ["sitemap"] else "page", "url": url})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("url", T.StringType())])))
def parse(text: pd.Series) -> pd.Series:
    return text.map(locations)


def sample(urls: DataFrame, count: int, *keys: str) -> DataFrame:
    """keys, url, rank of the first `count` distinct URLs of each key by their SHA-256."""
    order = Window.partitionBy(*keys).orderBy(F.sha2("url", 256))
    return urls.select(*keys, "url").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def collect(sitemaps: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs (domain, pos, url) listed by each domain's sitemap and the sitemaps nested in it, and notes (domain, message).

    sitemaps: domain, url. answers: domain, url, status, error, content_type, text. At most NESTED_SITEMAPS nested ones are
    followed, chosen by hash, one level deep; none is begun once SITEMAP_URLS are listed, and no more are kept."""
    fields = ("status", "error", "content_type", "text")
    good = answers.withColumn("good", looks_like_sitemap(F.col("status"), F.col("error"), F.col("url"), F.col("content_type"), F.col("text")))
    top = sitemaps.join(good.select("domain", "url", "good", *fields), ["domain", "url"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    listed = top.where("good").select("domain", F.posexplode(parse("text")).alias("pos", "loc")).select("domain", "pos", "loc.kind", "loc.url")
    nested = listed.where("kind = 'nested'")
    counts = nested.groupBy("domain").agg(F.count("*").alias("n"))
    by_hash = Window.partitionBy("domain").orderBy(F.sha2("url", 256))
    by_place = Window.partitionBy("domain").orderBy("pos")
    few = nested.join(counts.where(F.col("n") <= NESTED_SITEMAPS), "domain").select("domain", "url", F.row_number().over(by_place).alias("turn"))
    many = nested.join(counts.where(F.col("n") > NESTED_SITEMAPS), "domain", "left_semi").select("domain", "url").distinct().withColumn("turn", F.row_number().over(by_hash)).where(F.col("turn") <= NESTED_SITEMAPS)
    children = few.unionByName(many).join(good.select("domain", "url", "good", "text"), ["domain", "url"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    below = children.where("good").select("domain", "turn", F.posexplode(parse("text")).alias("pos", "loc")).where("loc.kind = 'page'").select("domain", "turn", "pos", F.col("loc.url").alias("url"))
    pages = listed.where("kind = 'page'").select("domain", F.lit(0).alias("turn"), "pos", "url").unionByName(below)
    # a nested sitemap is read only while those before it list fewer than the limit
    sizes = pages.groupBy("domain", "turn").agg(F.count("*").alias("n"))
    before = Window.partitionBy("domain").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("turn") <= 1) | (F.col("before") < SITEMAP_URLS)).select("domain", "turn")
    place = Window.partitionBy("domain").orderBy("turn", "pos")
    urls = pages.join(begun, ["domain", "turn"], "left_semi").withColumn("pos", F.row_number().over(place) - 1).where(F.col("pos") < SITEMAP_URLS).select("domain", "pos", "url")
    notes = (
        top.where("NOT good").select("domain", F.concat(F.lit("no sitemap could be read at "), "url").alias("message"))
        .unionByName(counts.where(F.col("n") > NESTED_SITEMAPS).select("domain", F.concat(F.lit("the sitemap index lists "), F.col("n").cast("string"), F.lit(f" sitemaps, {NESTED_SITEMAPS} were followed")).alias("message")))
        .unionByName(children.where("NOT good").select("domain", F.concat(F.lit("no nested sitemap could be read at "), "url").alias("message")))
    )
    return urls, notes


def find(candidates: DataFrame) -> DataFrame:
    """domain, reachable, declared: the first candidate that answers as a sitemap and the first that robots.txt names.

    candidates: domain, pos, url, declared BOOLEAN, final_url, good BOOLEAN."""
    return candidates.groupBy("domain").agg(
        F.min_by(F.when(F.col("good"), F.col("final_url")), F.when(F.col("good"), F.col("pos"))).alias("reachable"),
        F.min_by(F.when(F.col("declared"), F.col("url")), F.when(F.col("declared"), F.col("pos"))).alias("declared"),
    )


def sample_pages(urls: DataFrame, homes: DataFrame, allowed: Column | None = None, count: int = PAGES_SAMPLED) -> DataFrame:
    """domain, rank, url: the home page (rank 0) and count - 1 other pages by hash. urls: domain, url; homes: domain, url."""
    home = homes.select("domain", F.col("url").alias("home"))
    other = urls.join(home, "domain").where(is_page(F.col("url")) & (F.rtrim(F.col("url"), F.lit("/")) != F.rtrim(F.col("home"), F.lit("/"))))
    if allowed is not None:
        other = other.where(allowed)
    picked = sample(other, count - 1, "domain")
    return homes.select("domain", F.lit(0).alias("rank"), "url").unionByName(picked.select("domain", "rank", "url"))
