"""The audit as a stream: responses arrive, what changed is judged anew.

Features of a page and the verdicts of a robots.txt depend on one response each, so they are computed as it arrives; sites whose
rows changed in a micro-batch are scored again from the stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelens.functions import html
from sitelens.operators import checks, robots


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of pages from files of parquet: page_id, url, html."""
    return spark.readStream.schema("page_id BIGINT, url STRING, html STRING").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def page_facts(pages: DataFrame) -> DataFrame:
    """Stateless: features of each page with its raw-HTML score."""
    f = F.col("f")
    made = pages.withColumn("f", html.features(F.col("html"), F.col("url"))).drop("html")
    return made.select("page_id", "url", f["text_chars"].alias("text_chars"), f["script_chars"].alias("script_chars"), f["title"].alias("title"), checks.raw_html_score(f["text_chars"], f["script_chars"]).alias("score"))


def judge(bodies: DataFrame) -> DataFrame:
    """Verdicts of a micro-batch of robots.txt bodies (domain, body), a body judged once however many sites send it."""
    keyed = bodies.withColumn("robots_id", F.coalesce(F.sha2("body", 256), F.lit("none")))
    return keyed.select("domain", "robots_id").join(robots.verdicts(keyed.dropDuplicates(["robots_id"]).select("robots_id", "body")), "robots_id").drop("robots_id")


def write_facts(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the facts of all pages that are there to parquet, exactly once."""
    return page_facts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescore(stream: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the share of a site's pages that carry their text. For each micro-batch, its facts go to the store, and the sites they
    belong to are aggregated again over everything stored; a batch that runs twice writes the same folders."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        facts = page_facts(batch).withColumn("domain", F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
        facts.write.mode("overwrite").parquet(f"{store}/batch={number}")
        changed = spark.read.parquet(f"{store}/batch={number}").select("domain").distinct()
        every = spark.read.option("basePath", store).parquet(store).where(F.col("batch") <= number).join(changed, "domain", "left_semi")
        latest = every.groupBy("domain", "url").agg(F.max_by("score", F.struct("batch", "page_id")).alias("score"))
        sites = latest.groupBy("domain").agg(F.avg("score").alias("ratio"), F.count("*").alias("pages"))
        sites.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
