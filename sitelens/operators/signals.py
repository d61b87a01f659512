"""Content-Signal declarations in robots.txt; reported, never scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.constants import SIGNAL_KEYS, SIGNAL_LINE, SIGNAL_TERMS
from sitelens.functions.text import join_words, strip

MEANING = {
    "search": "showing up in AI search",
    "ai-train": "training of models",
    "ai-input": "use as input of an answer",
    "ai-personalization": "personalised results",
    "ai-retrieval": "retrieval for an answer",
}


def raw_lines(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(SIGNAL_LINE), F.lit(1))


def terms_only(body: Column) -> Column:
    """Whether the terms are published without a declaration."""
    return (F.size(raw_lines(body)) == 0) & F.rlike(body, F.lit(SIGNAL_TERMS)) & F.contains(F.lower(body), F.lit("content-signal"))


def pairs(bodies: DataFrame) -> DataFrame:
    """robots_id, pos, key, value of every pair with a key, in order."""
    each = bodies.where("body IS NOT NULL").select("robots_id", F.posexplode(raw_lines(F.col("body"))).alias("line", "text"))
    each = each.select("robots_id", "line", F.posexplode(F.split("text", ",")).alias("item", "pair")).where(F.contains("pair", F.lit("=")))
    each = each.select("robots_id", (F.col("line") * 10_000 + F.col("item")).alias("pos"), F.lower(strip(F.substring_index("pair", "=", 1))).alias("key"), F.lower(strip(F.regexp_replace("pair", "^[^=]*=", ""))).alias("value"))
    return each.where("key <> ''")


def declared(bodies: DataFrame) -> DataFrame:
    """robots_id, key, value, known: the last value of each key we know, and each other key without a value."""
    known = F.col("key").isin(SIGNAL_KEYS)
    last = pairs(bodies).groupBy("robots_id", "key").agg(F.max_by("value", "pos").alias("value"))
    return last.select("robots_id", "key", F.when(known, F.col("value")).alias("value"), known.alias("known"))


def signals(bodies: DataFrame) -> DataFrame:
    """robots_id, declared MAP, unknown_keys, raw, boilerplate_only, present, summary of the bodies that say anything. Expressions
    over one row a body."""
    text = lambda x, part: F.lower(strip(F.substring_index(x, "=", 1) if part == "key" else F.regexp_replace(x, "^[^=]*=", "")))
    said = bodies.where("body IS NOT NULL").select("robots_id", raw_lines(F.col("body")).alias("lines"), terms_only(F.col("body")).alias("boilerplate_only")).where("size(lines) > 0 OR boilerplate_only")
    items = F.filter(F.flatten(F.transform("lines", lambda line: F.split(line, ","))), lambda x: F.contains(x, F.lit("=")))
    named = F.filter(F.transform(items, lambda x: F.struct(text(x, "key").alias("key"), text(x, "value").alias("value"))), lambda x: x["key"] != "")
    last = lambda k: F.get(F.reverse(F.filter("pairs", lambda x: x["key"] == k)), F.lit(0))
    known = F.filter(F.array(*map(last, sorted(SIGNAL_KEYS))), lambda x: x.isNotNull())
    unknown = F.array_distinct(F.transform(F.filter("pairs", lambda x: ~x["key"].isin(SIGNAL_KEYS)), lambda x: x["key"]))
    all_ = said.withColumn("pairs", named).withColumns({"known": known, "unknown_keys": unknown})
    present = F.size("pairs") > 0
    return all_.select("robots_id", F.map_from_entries("known").alias("declared"), "unknown_keys", F.array_join("lines", "; ").alias("raw"), "boilerplate_only", present.alias("present"), summary(F.col("known"), F.col("boilerplate_only")).alias("summary"))


def summary(known: Column, terms: Column) -> Column:
    """One sentence from the keys that have a meaning, in their order."""
    meaning = F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv])
    told = lambda answer: F.transform(F.filter(known, lambda x: (x["value"] == answer) & x["key"].isin(list(MEANING))), lambda x: F.element_at(meaning, x["key"]))
    yes, no = told("yes"), told("no")
    parts = F.filter(F.array(F.when(F.size(yes) > 0, F.concat(F.lit("allows "), join_words(yes))), F.when(F.size(no) > 0, F.concat(F.lit("refuses "), join_words(no)))), lambda x: x.isNotNull())
    return F.when(terms, "The terms are published, but nothing is declared.").when(F.size(parts) == 0, "A declaration without a key we know.").otherwise(F.concat(F.lit("The site "), F.array_join(parts, ", and "), F.lit(".")))
