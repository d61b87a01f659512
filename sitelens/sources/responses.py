"""Recorded HTTP responses and the small files beside them: the base relation of every audit.

A recording is a JSON object a domain, {format_version, domain, fetched_at, outcome, responses: {url: response}}, one a line or a
file, compressed or not. As a table it has a row a response, in recorded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.text import strip

FORMAT = 1
RESPONSE = "STRUCT<final_url: STRING, status: INT, headers: MAP<STRING, STRING>, text: STRING, error: STRING, truncated: BOOLEAN>"
RECORDING = f"format_version INT, domain STRING, fetched_at STRING, outcome STRING, responses MAP<STRING, {RESPONSE}>"


def read_recordings(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """domain, fetched_at, outcome, pos, url, final_url, status, headers (lower-case keys), text, error, truncated."""
    read = spark.read.schema(RECORDING).option("multiLine", one_per_file).json(path)
    each = read.select("domain", "fetched_at", "outcome", F.posexplode(F.map_entries("responses")).alias("pos", "r"))
    headers = F.transform_keys(F.coalesce("r.value.headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    return each.select("domain", "fetched_at", "outcome", "pos", F.col("r.key").alias("url"), "r.value.final_url", "r.value.status", headers.alias("headers"), "r.value.text", "r.value.error", F.coalesce("r.value.truncated", F.lit(False)).alias("truncated"))


def write_recordings(responses: DataFrame, path: str) -> None:
    """The inverse of read_recordings, a line a domain, compressed."""
    value = F.struct("final_url", "status", "headers", "text", "error", "truncated")
    by_place = lambda a, b: (a["pos"] - b["pos"]).cast("int")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", value.alias("value"))), by_place), lambda x: F.struct(x["url"], x["value"]))
    per = responses.groupBy("domain").agg(F.first("fetched_at").alias("fetched_at"), F.first("outcome").alias("outcome"), F.map_from_entries(entries).alias("responses"))
    line = F.to_json(F.struct(F.lit(FORMAT).alias("format_version"), "domain", "fetched_at", "outcome", "responses"))
    per.select(line.alias("value")).write.option("compression", "gzip").text(path)


def recorded(answers: DataFrame, homes: DataFrame) -> DataFrame:
    """Answers of fetch() as recordings: fetched_at, pos in the order of the URLs, and the outcome of their site, which its home page
    decides. homes: domain, url of the home page."""
    own = answers.join(homes, ["domain", "url"], "left_semi")
    outcome = resolve_bases(own).select("domain", F.concat_ws(": ", "outcome", "reason").alias("outcome"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("url")) - 1
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return answers.join(outcome, "domain", "left").select("domain", now.alias("fetched_at"), F.coalesce("outcome", F.lit("aborted: no home page")).alias("outcome"), place.alias("pos"), "url", "final_url", "status", "headers", "text", "error", "truncated")


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """An answer for each request (domain, url): the recorded one, or an error that says there is none; never a made-up status."""
    found = requests.join(responses.withColumn("recorded", F.lit(True)), ["domain", "url"], "left")
    return found.withColumn("error", F.when(F.col("recorded").isNull(), "not in fixture").otherwise(F.col("error"))).drop("recorded")


def available(responses: DataFrame) -> DataFrame:
    return responses.select("domain").distinct().orderBy("domain")


def corpus(spark: SparkSession, path: str, inline_comments: bool = True) -> DataFrame:
    """pos (rising), domain of a list of domains; lines that begin with # go, and with inline_comments what follows a #."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    cut = F.substring_index("line", "#", 1) if inline_comments else F.when(~F.startswith(F.ltrim("line"), F.lit("#")), F.col("line"))
    return text.select("pos", strip(cut).alias("domain")).where("domain <> ''")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """domain, category of a CSV file with a header; an empty one is an error."""
    df = spark.read.schema("domain STRING, category STRING").option("header", True).csv(path)
    if df.limit(1).count() == 0:
        raise ValueError(f"{path} names no category")
    return df


def content_type(headers: Column) -> Column:
    return F.coalesce(F.element_at(headers, "content-type"), F.lit(""))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("lineSep", "\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def resolve_bases(homes: DataFrame) -> DataFrame:
    """domain, base_url, outcome, reason: after redirects the final host is the base; a home page that failed or didn't answer 200
    aborts the site. homes: domain, final_url, status, error."""
    from sitelens.functions.urls import origin

    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~(F.col("status") == 200), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return homes.select("domain", origin(F.col("final_url")).alias("base_url"), F.when(reason.isNull(), "scored").otherwise("aborted").alias("outcome"), reason.alias("reason"))
