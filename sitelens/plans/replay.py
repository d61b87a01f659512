"""From recorded responses to audited sites, for all domains at once.

Every step is a join of the addresses it asks for with the responses; nothing is asked that an audit of one site wouldn't ask.
Steps that others rest on are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.constants import PAGES_SAMPLED
from sitelens.functions import html, urls
from sitelens.operators import checks, report, robots, scoring, sitemap
from sitelens.sources.responses import content_type
from sitelens.sources.steps import balanced, written

TOKEN = "sitelens"
FIELDS = ("final_url", "status", "headers", "text", "error")


@dataclass
class Audit:
    """sites: domain, base_url, robots_id, robots_status, robots_real, blanket, declared, reachable, llms; pages: domain, pos, url,
    status, headers, html; verdicts with domain; errors: domain, pos, message; aborted: domain, reason; declared: domain, body of robots.txt as it came."""

    sites: DataFrame
    pages: DataFrame
    verdicts: DataFrame
    errors: DataFrame
    aborted: DataFrame
    declared: DataFrame


def answers(requests: DataFrame, responses: DataFrame, url: Column, name: str) -> DataFrame:
    """Adds a struct `name` with the recorded answer at url; one that isn't recorded has only an error."""
    own = responses.select(F.col("domain").alias("_d"), F.col("url").alias("_u"), F.struct(*FIELDS).alias("_r"))
    empty = F.struct(url.alias("final_url"), F.lit(None).cast("int").alias("status"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("").alias("text"), F.lit("not in fixture").alias("error"))
    asked = requests.withColumn("_url", url)
    found = asked.join(own, (F.col("domain") == F.col("_d")) & (F.col("_url") == F.col("_u")), "left")
    return found.withColumn(name, F.coalesce("_r", empty)).drop("_d", "_u", "_r", "_url")


def assemble(responses: DataFrame, domains: DataFrame, pages: int = PAGES_SAMPLED) -> Audit:
    """domains: domain. pages: how many to read of each site, 1 at least."""
    if pages < 1:
        raise ValueError("at least one page is read")
    note = lambda df, pos, message: df.select("domain", F.lit(pos).alias("pos"), message.alias("message")).where("message IS NOT NULL")
    base = domains.select("domain").withColumn("base", urls.normalise_base(F.col("domain")))
    plain = F.regexp_replace("base", "^https://", "http://")
    tried = answers(answers(base, responses, F.concat("base", F.lit("/")), "h1"), responses, F.concat(plain, F.lit("/")), "h2")
    fell = F.col("h1.error").isNotNull() & F.startswith("base", F.lit("https://")) & F.col("h2.status").isNotNull()
    home = tried.withColumn("home", F.when(fell, F.col("h2")).otherwise(F.col("h1"))).withColumn("fell", fell)
    reason = F.when(F.col("base").isNull(), "no host").when(F.col("home.error").isNotNull(), F.concat(F.lit("home page unreachable: "), F.col("home.error"))).when(F.col("home.status") != 200, F.concat(F.lit("home page answered HTTP "), F.col("home.status").cast("string")))
    home = written(home.select("domain", "base", "home", "fell", F.col("h1.error").alias("https_error")), "homes")
    judged = written(home.withColumn("reason", reason), "judged")
    aborted = judged.where("reason IS NOT NULL").select("domain", "reason")
    ok = written(judged.where("reason IS NULL").withColumn("base_url", urls.origin(F.col("home.final_url"))), "reached")
    notes = [note(ok, 0, F.when(F.col("fell"), F.concat(F.lit("https failed ("), F.col("https_error"), F.lit("), http was used"))))]

    asked = answers(ok.select("domain", "base_url"), responses, F.concat("base_url", F.lit("/robots.txt")), "r")
    body, real, odd = robots.read_response(F.col("r.status"), F.col("r.error"), F.col("r.text"), content_type(F.col("r.headers")))
    told = asked.select("domain", "base_url", F.col("r.status").alias("robots_status"), real.alias("robots_real"), body.alias("body"), odd.alias("odd"), F.coalesce(body, F.when(F.col("r.status") == 200, F.col("r.text"))).alias("sent"))
    told = written(told, "robots").withColumn("robots_id", F.coalesce(F.sha2("body", 256), F.lit("none")))
    notes.append(note(told, 1, F.col("odd")))
    bodies = written(told.select("robots_id", "body").dropDuplicates(["robots_id"]), "bodies")
    verdicts = written(told.select("domain", "robots_id").join(robots.verdicts(bodies), "robots_id"), "verdicts")

    declared = told.join(robots.sitemaps(bodies), "robots_id").select("domain", "pos", "url", F.lit(True).alias("declared"))
    guessed = told.select("domain", F.lit(1_000_000).alias("pos"), F.concat("base_url", F.lit("/sitemap.xml")).alias("url"), F.lit(False).alias("declared"))
    candidates = answers(declared.unionByName(guessed), responses, F.col("url"), "r")
    good = sitemap.looks_like_sitemap(F.col("r.status"), F.col("r.error"), F.col("r.final_url"), content_type(F.col("r.headers")), F.col("r.text"))
    found = sitemap.find(candidates.select("domain", "pos", "url", "declared", F.col("r.final_url").alias("final_url"), good.alias("good")))
    llms = answers(told.select("domain", "base_url"), responses, F.concat("base_url", F.lit("/llms.txt")), "r")
    llms = llms.select("domain", checks.read_llms(F.col("r.status"), F.col("r.error"), F.col("r.text")).alias("llms"))
    sites = told.select("domain", "base_url", "robots_id", "robots_status", "robots_real").join(found, "domain", "left").join(llms, "domain").join(robots.blanket_disallow(bodies), "robots_id")
    sites = written(sites, "sites")
    notes.append(note(sites, 2, F.when(F.col("reachable").isNull() & F.col("declared").isNotNull(), F.concat(F.lit("no sitemap answers at "), "declared"))))

    listed, more = sitemap.collect(sites.where("reachable IS NOT NULL").select("domain", F.col("reachable").alias("url")), responses.withColumn("content_type", content_type(F.col("headers"))))
    listed = written(listed, "listed")
    notes.append(more.select("domain", F.lit(3).alias("pos"), "message"))
    allowed = robots.permitted(listed.select("domain", "url").join(sites.select("domain", "robots_id"), "domain"), bodies, TOKEN)
    picked = sitemap.sample_pages(allowed.select("domain", "url"), sites.select("domain", F.col("base_url").alias("url")), count=pages).where("rank > 0")
    read = written(answers(written(picked, "picked"), responses, F.col("url"), "r"), "read")
    notes.append(note(read, 4, F.when(F.col("r.error").isNotNull(), F.concat(F.lit("page "), F.col("url"), F.lit(": "), F.col("r.error")))))
    row = lambda pos, r: [pos.cast("int").alias("pos"), F.col(f"{r}.final_url").alias("url"), F.coalesce(F.col(f"{r}.status"), F.lit(0)).alias("status"), F.col(f"{r}.headers").alias("headers"), F.col(f"{r}.text").alias("html")]
    all_pages = ok.select("domain", *row(F.lit(0), "home")).unionByName(read.where("r.error IS NULL").select("domain", *row(F.col("rank"), "r")))
    errors = notes[0]
    for n in notes[1:]:
        errors = errors.unionByName(n)
    return Audit(sites, all_pages, verdicts, written(errors, "errors"), aborted, told.select("domain", F.col("sent").alias("body")))


def features(audit: Audit) -> DataFrame:
    """Pages with their features in place of their HTML, written for the checks and the payload."""
    return written(balanced(audit.pages).withColumn("f", html.features(F.col("html"), F.col("url"))).drop("html"), "features")


def payloads(audit: Audit) -> DataFrame:
    """domain, n_checks, payload of every site that wasn't aborted."""
    pages = features(audit)
    ran = written(checks.attempted(audit.sites, pages, audit.verdicts), "results")
    results = checks.sound(ran)
    scores = scoring.scores(audit.sites, results, scoring.caps(audit.verdicts, audit.sites.select("domain", "blanket")))
    return report.payload(audit.sites, report.check_rows(audit.sites, results), scores, audit.verdicts, pages, report.additions(results), audit.errors.unionByName(checks.failures(ran)), audit.declared)
