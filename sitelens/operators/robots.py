"""robots.txt as relations: lines, groups, the group that speaks to a crawler, and its verdict.

Bodies come as (robots_id, body). Many sites share a body, so callers make robots_id a digest of it and join verdicts back.
A body is dealt to one task by its id; lines of one body are ordered by pos throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.constants import AGENTS, CRAWLER_DOCS, CRAWLER_NOTES, ROBOTS_DIRECTIVE, RULES_SHOWN, VENDOR_DOCS
from sitelens.functions.text import lines, strip


def agents(spark: SparkSession) -> DataFrame:
    """The crawlers, in report order; a fixed, small table."""
    rows = [(i, *a, CRAWLER_DOCS.get(a[0], VENDOR_DOCS.get(a[1])), CRAWLER_NOTES[a[0]]) for i, a in enumerate(AGENTS)]
    return spark.createDataFrame(rows, "pos int, token string, vendor string, bucket string, obeys_robots string, ai_only boolean, documented boolean, docs string, note string")


def looks_like_robots(body: Column, content_type: Column) -> Column:
    """Whether a body that answered 200 is robots syntax and not a page."""
    head = F.lower(F.regexp_replace(F.substring(body, 1, 500), r"^(?U)\s+", ""))
    page = F.startswith(head, F.lit("<!doctype")) | F.contains(head, F.lit("<html"))
    typed = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")) & F.contains(F.lower(F.substring(body, 1, 5000)), F.lit("<html"))
    return ~page & ~typed & F.rlike(body, F.lit(ROBOTS_DIRECTIVE))


def read_response(status: Column, error: Column, body: Column, content_type: Column) -> tuple[Column, Column, Column]:
    """Body to use (null: as if there were none), whether it is real, and a note if something is odd."""
    real = error.isNull() & F.coalesce(status == 200, F.lit(False)) & F.coalesce(looks_like_robots(body, content_type), F.lit(False))
    note = (
        F.when(error.isNotNull(), F.concat(F.lit("robots.txt could not be read: "), error))
        .when(status >= 500, F.concat(F.lit("robots.txt answered "), status.cast("string"), F.lit(", taken as absent")))
        .when((status == 200) & ~real, F.lit("robots.txt answered 200 with something that is not robots syntax"))
    )
    return F.when(real, body), real, note


def directives(bodies: DataFrame) -> DataFrame:
    """robots_id, pos, field (lower case), value of every line that has a colon once comments are cut."""
    cut = bodies.where("body IS NOT NULL").select("robots_id", F.posexplode(lines(F.col("body"))).alias("pos", "line"))
    cut = cut.select("robots_id", "pos", F.substring_index("line", "#", 1).alias("line")).where(F.contains("line", F.lit(":")))
    return cut.select("robots_id", "pos", F.lower(strip(F.substring_index("line", ":", 1))).alias("field"), strip(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def grouped(lines_: DataFrame) -> DataFrame:
    """Adds group_id: a user-agent line opens a group unless the directive before it is one too; 0 stands before any group."""
    order = Window.partitionBy("robots_id").orderBy("pos")
    names = F.col("field") == "user-agent"
    opens = names & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    return lines_.withColumn("group_id", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def groups(bodies: DataFrame) -> DataFrame:
    """robots_id, group_id, agent, n_rules: each name with the number of allow and disallow rules of its group."""
    g = grouped(directives(bodies)).where("group_id > 0")
    size = Window.partitionBy("robots_id", "group_id")
    counted = g.withColumn("n_rules", F.count_if(F.col("field").isin("allow", "disallow")).over(size))
    return counted.where("field = 'user-agent'").select("robots_id", "group_id", F.col("value").alias("agent"), "n_rules")


def tables(bodies: DataFrame, path: str | None = None) -> DataFrame:
    """One row a body: its agent lines and its rules as arrays in order; with a path, whether each rule covers it."""
    g = grouped(directives(bodies)).where("group_id > 0")
    item = F.struct("pos", "group_id", "field", "value", *([covers(F.col("value"), F.lit(path)).alias("fits")] if path is not None else []))
    rows = g.groupBy("robots_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("field") == "user-agent", item))).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("field").isin("allow", "disallow"), item))).alias("rules"),
    )
    return bodies.where("body IS NOT NULL").select("robots_id").join(rows, "robots_id", "left")


def each(tokens: list[str]) -> Column:
    """A row for each token."""
    return F.explode(F.array(*map(F.lit, tokens)))


def folded(path: Column) -> Column:
    """A path or pattern with its percent escapes undone, but for those of /, *, $ and %, so that spellings of one path agree."""
    kept = F.regexp_replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    for code in ("25", "2F", "2A", "24"):
        kept = F.regexp_replace(kept, f"(?i)%{code}", f"%25{code}")
    return F.coalesce(F.try_url_decode(kept), path)


def covers(pattern: Column, path: Column) -> Column:
    """Whether a rule's path covers a path from its start: * is any run, a last $ is the end; an empty rule covers nothing. The
    parts between stars are looked for one after the other, each at the first place after the one before, which finds a way if
    there is one, in time that grows with the length of both."""
    ended = F.endswith(pattern, F.lit("$"))
    parts = F.split(folded(F.when(ended, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)), r"\*")
    bound = F.struct(ended.alias("ended"), parts.alias("parts"), folded(path).alias("own"))
    # bound to a name, so that each is computed once
    return F.get(F.transform(F.array(bound), lambda x: (pattern != "") & _in_order(x["ended"], x["parts"], x["own"])), F.lit(0))


def _in_order(ended: Column, parts: Column, own: Column) -> Column:
    n = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.get(parts, n - 1)
    found = lambda at, part: F.call_function("locate", part, own, at)
    # the place after what is found so far; 0 for no way
    step = lambda at, part: F.when((at == 0) | (part == ""), at).when(found(at, part) == 0, 0).otherwise(found(at, part) + F.length(part))
    between = F.slice(parts, F.lit(2), F.greatest(n - F.when(ended, 2).otherwise(1), F.lit(0)))
    place = F.aggregate(between, F.when(F.startswith(own, first), F.length(first) + 1).otherwise(0), step)
    ends = (place > 0) & F.endswith(own, last) & (F.length(own) - F.length(last) + 1 >= place)
    return F.when(~ended, place > 0).when(n == 1, own == first).otherwise(ends)


def selected(bodies: DataFrame, tokens: list[str], path: str | None = None) -> DataFrame:
    """robots_id, token, winner (null: no group speaks to it), rules: for each body and crawler, the longest user-agent value
    that begins the token, case aside, else *; rules of all groups that declare it, in order."""
    listed = tables(bodies, path).withColumn("token", each(tokens))
    name = lambda x: F.lower(x["value"])
    hits = F.filter("names", lambda x: (x["value"] != "*") & F.startswith(F.lower(F.col("token")), name(x)))
    longest = F.array_max(F.transform(hits, lambda x: F.length(x["value"])))
    starred = F.filter("names", lambda x: x["value"] == "*")
    with_hits = listed.withColumn("hits", hits).withColumn("longest", longest)
    chosen = F.when(F.size("hits") > 0, F.filter("hits", lambda x: F.length(x["value"]) == F.col("longest"))).otherwise(starred)
    picked = with_hits.withColumn("chosen", chosen).withColumn("ids", F.transform("chosen", lambda x: x["group_id"]))
    return picked.select("robots_id", "token", F.get("chosen", F.lit(0))["value"].alias("winner"), F.filter("rules", lambda r: F.array_contains("ids", r["group_id"])).alias("rules"))


def decide(rules: Column, path: Column | None = None) -> Column:
    """Whether the rules allow a path (or the one tables() was given): the longest that covers it decides, allow before disallow,
    and none allows."""
    fits = F.filter(rules, lambda r: r["fits"] if path is None else covers(r["value"], path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["value"]).alias("size"), (r["field"] == "allow").alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def describe(winner: Column, rules: Column) -> Column:
    """One readable line: the group's name and its first rules."""
    shown = F.array_join(F.transform(F.slice(rules, 1, RULES_SHOWN), lambda r: F.concat(F.initcap(r["field"]), F.lit(": "), r["value"])), ", ")
    hidden = F.size(rules) - RULES_SHOWN
    more = F.when(hidden > 0, F.concat(F.lit(", and "), hidden.cast("string"), F.lit(" more"))).otherwise("")
    name = F.concat(F.lit("User-agent: "), winner)
    return F.when(winner.isNull(), F.lit(None)).when(F.size(rules) == 0, F.concat(name, F.lit(" (no rules)"))).otherwise(F.concat(name, F.lit(" | "), shown, more))


def verdicts(bodies: DataFrame, path: str = "/") -> DataFrame:
    """robots_id, every column of agents(), allowed, matched_rule. A null body allows everything."""
    spark = bodies.sparkSession
    known = agents(spark)
    tokens = [a[0] for a in AGENTS]
    told = selected(bodies, tokens, path).select("robots_id", "token", decide(F.col("rules")).alias("allowed"), describe(F.col("winner"), F.col("rules")).alias("matched_rule"))
    silent = bodies.where("body IS NULL").select("robots_id", each(tokens).alias("token")).select("robots_id", "token", F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("matched_rule"))
    return told.unionByName(silent).join(F.broadcast(known), "token")


def blanket_disallow(bodies: DataFrame) -> DataFrame:
    """robots_id, blanket: whether the * group shuts out everything and allows nothing."""
    rules = F.col("rules")
    shut = F.exists(rules, lambda r: (r["field"] == "disallow") & (r["value"] == "/"))
    opened = F.exists(rules, lambda r: (r["field"] == "allow") & (r["value"] != ""))
    told = selected(bodies, ["*"]).select("robots_id", F.coalesce(F.col("winner").isNotNull() & shut & ~opened, F.lit(False)).alias("blanket"))
    return told.unionByName(bodies.where("body IS NULL").select("robots_id", F.lit(False).alias("blanket")))


def bucket_counts(verdicts_: DataFrame, *keys: str) -> DataFrame:
    return verdicts_.groupBy(*keys, "bucket").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("total"))


def sitemaps(bodies: DataFrame) -> DataFrame:
    """robots_id, pos, url of the sitemaps a body declares."""
    return directives(bodies).where("field = 'sitemap' AND value <> ''").select("robots_id", "pos", F.col("value").alias("url"))


def as_star_group(rules: Column) -> Column:
    """The rules of a group as a robots.txt of its own for everyone."""
    body = F.transform(rules, lambda r: F.concat(F.initcap(r["field"]), F.lit(": "), r["value"], F.lit("\n")))
    return F.concat(F.lit("User-agent: *\n"), F.array_join(body, ""))


def allow_lines(tokens: Column) -> Column:
    """Groups to paste that let these crawlers in."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("User-agent: "), t, F.lit("\nAllow: /"))), "\n\n")


def posture(allowed: Column, total: Column) -> Column:
    """Whether a site is open to model training; never scored."""
    return F.when(total == 0, "unknown").when(allowed == total, "open").when(allowed == 0, "closed").otherwise("partial")


def permitted(urls: DataFrame, bodies: DataFrame, token: str) -> DataFrame:
    """Those of the URLs (robots_id, url, ...) that a body lets a client of this token read; a null body allows all."""
    rules = selected(bodies, [token]).select("robots_id", "rules")
    where = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    return urls.join(rules, "robots_id", "left").where(decide(F.col("rules"), where)).drop("rules")
