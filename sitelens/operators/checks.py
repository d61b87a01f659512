"""The thirteen checks. A check is a set of aggregates over the pages of a site and an expression over them.

Page rows: domain, pos, url, status, headers MAP, f (features struct). Readability looks at pages that answered 200 only, the
access checks at all. All aggregates are taken in one grouping by domain and joined with one over the site's verdicts; the
checks are then expressions over a row a site. `@check` registers one, so a new check is a function here and a line in the
rubric. A check gives ratio, severity, evidence, fix (summary and snippet, null for none) and details as JSON. One whose ratio isn't
between 0 and 1 has failed at that site: it is an error of the site, and the other checks and sites go on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import constants as K
from sitelens.functions.text import strip
from sitelens.functions.urls import authority, path
from sitelens.operators.robots import allow_lines


# ---- scores of one page -------------------------------------------------------------------------------------------------


def raw_html_score(text_chars: Column, script_chars: Column) -> Column:
    heavy = F.try_divide(script_chars, text_chars) > K.SCRIPT_HEAVY
    return F.when(text_chars < K.TEXT_EMPTY, 0.0).when(heavy, 0.25).when(text_chars < K.TEXT_THIN, 0.5).otherwise(1.0)


def skipped_levels(levels: Column) -> Column:
    """Pairs of neighbouring heading levels that jump down by more than one."""
    neighbours = F.arrays_zip(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, 2, 1_000_000).alias("b"))
    return F.filter(neighbours, lambda p: p["b"] > p["a"] + 1)


def heading_score(levels: Column) -> Column:
    tops = F.size(F.filter(levels, lambda x: x == 1))
    return F.when(tops == 0, 0.0).otherwise(F.when(tops == 1, K.ONE_H1).otherwise(0.0) + F.when(F.size(skipped_levels(levels)) == 0, K.NO_SKIPS).otherwise(0.0))


def field_score(value: Column, bounds: tuple[int, int]) -> Column:
    return F.when(value == "", 0.0).when(F.length(value).between(*bounds), 1.0).otherwise(0.5)


def citable_score(sizes: Column) -> Column:
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    share = F.array_max(sizes) / total
    slope = (K.ONE_BLOCK - share) / (K.ONE_BLOCK - K.WELL_SECTIONED)
    return F.when(total < K.WORDS_TO_JUDGE, 1.0).when(share <= K.WELL_SECTIONED, 1.0).when(share >= K.ONE_BLOCK, 0.0).otherwise(slope)


def meta_names(metas: Column) -> Column:
    """Names under any of the three attributes of metas that have content."""
    field = lambda k: lambda m: m[k]
    filled = F.filter(metas, lambda m: m["content"] != "")
    return F.array_distinct(F.concat(*(F.transform(filled, field(k)) for k in ("name", "property", "itemprop"))))


def has_author(f: Column) -> Column:
    return F.arrays_overlap(meta_names(f["metas"]), F.array(*map(F.lit, K.AUTHOR_METAS))) | f["author_mark"]


def has_date(f: Column) -> Column:
    return F.arrays_overlap(meta_names(f["metas"]), F.array(*map(F.lit, K.DATE_METAS))) | f["date_mark"]


def canonical_fault(canonical: Column, url: Column) -> Column:
    """Why a canonical is no use; null if it is fine."""
    return F.when(canonical == "", "no canonical").when(~authority(canonical).eqNullSafe(authority(url)), F.concat(F.lit("canonical names another host: "), canonical))


def blocks_indexing(value: Column) -> Column:
    return F.exists(F.split(value, "[,;:]"), lambda x: F.lower(F.trim(x)).isin(K.NOINDEX_DIRECTIVES))


def noindex_reasons(headers: Column, metas: Column) -> Column:
    header = F.coalesce(F.element_at(headers, "x-robots-tag"), F.lit(""))
    from_header = F.when(blocks_indexing(header), F.array(F.concat(F.lit("X-Robots-Tag: "), header))).otherwise(F.array().cast("array<string>"))
    listed = F.filter(metas, lambda m: m["name"].isin(K.NOINDEX_METAS) & blocks_indexing(m["content"]))
    return F.concat(from_header, F.transform(listed, lambda m: F.concat(F.lit("meta "), m["name"], F.lit(": "), m["content"])))


def wall_reason(status: Column, url: Column, has_password: Column, text_chars: Column) -> Column:
    """Why a page can't be read without an account; null if it can."""
    where = F.lower(path(url))
    login = reduce(lambda a, b: a | b, (F.contains(where, F.lit(m)) for m in K.LOGIN_PATHS))
    gated = has_password & (text_chars < K.TEXT_BEHIND_GATE)
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(login, F.concat(F.lit("an address for signing in: "), where)).when(gated, F.concat(F.lit("a password field and only "), text_chars.cast("string"), F.lit(" characters")))


def detect_platform(html: Column, headers: Column, metas: Column) -> Column:
    """What published a home page: its generator if that is one we know, else the first sign in its source."""
    declared = F.transform(F.filter(metas, lambda m: m["name"] == "generator"), lambda m: F.lower(m["content"]))
    name = F.create_map(*[F.lit(x) for g in K.GENERATORS for x in (g, "WordPress" if g == "wordpress" else g.capitalize())])
    hits = F.flatten(F.transform(declared, lambda d: F.filter(F.array(*map(F.lit, K.GENERATORS)), lambda g: F.contains(d, g))))
    blob = F.concat(F.substring(html, 1, K.PLATFORM_CHARS), F.lit(" "), F.array_join(F.map_values(headers), " "))
    shows = lambda patterns: F.rlike(blob, F.lit("(?i)" + "|".join(patterns)))
    signs = F.coalesce(*(F.when(shows(patterns), name_) for name_, patterns in K.PLATFORM_SIGNS))
    return F.when(html.isNull(), "unknown").when(F.size(hits) > 0, F.element_at(name, F.get(hits, F.lit(0)))).otherwise(F.coalesce(signs, F.lit("custom or unidentified")))


# ---- facts of a site ----------------------------------------------------------------------------------------------------


def crawler_lists(bucket: str) -> list[Column]:
    """Counts and lists of a bucket's crawlers, in report order, as aggregates by domain."""
    own, shut, effective = F.col("bucket") == bucket, ~F.col("allowed"), F.col("obeys_robots") == "yes"
    listed = lambda c, what: F.transform(F.array_sort(F.collect_list(F.when(own & c, F.struct(F.col("pos"), what.alias("x"))))), lambda r: r["x"])
    told = F.concat(F.col("token"), F.coalesce(F.concat(F.lit(" ["), F.col("matched_rule"), F.lit("]")), F.lit("")))
    return [
        F.count_if(own & ~shut).alias("allowed"), F.count_if(own).alias("total"), listed(~shut, F.col("token")).alias("open"), listed(shut, F.col("token")).alias("blocked"),
        listed(shut & effective, F.col("token")).alias("effective"), listed(shut & ~effective, F.col("token")).alias("ignored"), listed(shut, told).alias("told"),
        F.count_if(own & F.col("ai_only")).alias("ai_only"), F.count_if(own & F.col("ai_only") & shut).alias("ai_only_blocked"),
    ]


def blackout(c: Column) -> Column:
    """Whether everything that only feeds AI answers is shut out while others that cite get in."""
    return (c["ai_only"] > 0) & (c["ai_only_blocked"] == c["ai_only"]) & (c["allowed"] > 0)


def crawler_facts(verdicts: DataFrame) -> DataFrame:
    """domain, citation and user_fetch structs."""
    return verdicts.groupBy("domain").agg(*(F.struct(*crawler_lists(b)).alias(b) for b in ("citation", "user_fetch")))


CHECKS: dict[str, tuple[Callable, dict[str, Callable[[], Column]]]] = {}
#: What a check says of a page that fails it; null of one that doesn't. The first SHOWN pages of a site are found as `told`.
FAULTS: dict[str, Callable[[], Column]] = {}
SHOWN = 4


def check(check_id: str, fault: Callable[[], Column] | None = None, **aggregates: Callable[[], Column]):
    """Registers a check; its aggregates are taken by domain and found under their names, after the check's."""

    def register(f: Callable) -> Callable:
        CHECKS[check_id] = (f, aggregates)
        if fault:
            FAULTS[check_id] = fault
        return f

    return register


def of(n: Column, total: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" of "), total.cast("string"))


def remedy(needed: Column, summary: Column | str, snippet: Column | str = "") -> Column:
    """A fix: what to do, and the lines to paste where there are any; null where none is needed."""
    said = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(needed, F.struct(said(summary).alias("summary"), said(snippet).alias("snippet")))


def first_faults(pages: DataFrame, wanted: list[str]) -> DataFrame:
    """domain and, for each of these checks, `<check>__told`: what is said of the first SHOWN pages that fail it, in page order.
    The rank is limited before the shuffle, so a site of many faulty pages sends SHOWN rows a task and check."""
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("check_id"), FAULTS[i]().alias("text")) for i in wanted]))
    order = Window.partitionBy("domain", "check_id").orderBy("pos", "text")
    first = pages.select("domain", "pos", said.alias("x")).select("domain", "pos", "x.*").where("text IS NOT NULL").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SHOWN)
    listed = lambda i: F.array_sort(F.collect_list(F.when(F.col("check_id") == i, F.struct("k", "text"))))
    return first.groupBy("domain").agg(*(F.array_join(F.transform(listed(i), lambda x: x["text"]), "; ").alias(f"{i}__told") for i in wanted))


def ok200() -> Column:
    return F.col("status") == 200


def mean(score: Column) -> Column:
    return F.avg(F.when(ok200(), score))


def _graded(n: Column, total: Column) -> Column:
    return F.when(n == total, "ok").when(n == 0, "critical").otherwise("warning")


@check("citation_crawlers_allowed")
def citation(c):
    v = F.col("citation")
    severity = F.when(v["allowed"] == v["total"], "ok").when(blackout(v) | (v["allowed"] == 0), "critical").otherwise("warning")
    evidence = F.concat(of(v["allowed"], v["total"]), F.lit(" citation crawlers may read the site."), F.when(F.size(v["blocked"]) > 0, F.concat(F.lit(" Shut out: "), F.array_join(v["told"], ", "), F.lit("."))).otherwise(""), F.when(blackout(v), " Search engines still get in, but nothing that only feeds AI answers does.").otherwise(""))
    return F.coalesce(F.try_divide(v["allowed"], v["total"]), F.lit(0.0)), severity, evidence, remedy(F.size(v["blocked"]) > 0, "Let these crawlers in.", allow_lines(v["blocked"])), F.struct(v["open"].alias("allowed"), v["blocked"].alias("blocked"), blackout(v).alias("ai_only_blackout"))


@check("user_fetch_crawlers_allowed")
def user_fetch(c):
    v = F.col("user_fetch")
    reached = v["allowed"] + F.size(v["ignored"])
    severity = F.when(v["allowed"] == v["total"], "ok").when(v["allowed"] > 0, "warning").otherwise("critical")
    evidence = F.concat(of(v["allowed"], v["total"]), F.lit(" crawlers that fetch for a person are allowed."), F.when(F.size(v["blocked"]) > 0, F.concat(F.lit(" Shut out: "), F.array_join(v["told"], ", "), F.lit("."))).otherwise(""), F.when(F.size(v["ignored"]) > 0, F.concat(F.lit(" These don't follow robots.txt: "), F.array_join(v["ignored"], ", "), F.lit("."))).otherwise(""))
    return F.coalesce(F.try_divide(reached, v["total"]), F.lit(0.0)), severity, evidence, remedy(F.size(v["effective"]) > 0, "Let these crawlers in; those that don't follow robots.txt can't be told there.", allow_lines(v["effective"])), F.struct(v["open"].alias("allowed"), v["blocked"].alias("blocked"), v["ignored"].alias("blocked_but_ignore_robots"))


def page_wall() -> Column:
    return wall_reason(F.col("status"), F.col("url"), F.col("f.has_password"), F.col("f.text_chars"))


@check("pages_reachable", n=lambda: F.count_if(F.col("_wall").isNull()), fault=lambda: F.concat(F.col("url"), F.lit(" ("), F.col("_wall"), F.lit(")")))
def reachable(c):
    n, total = c("n"), F.col("pages")
    return F.coalesce(F.try_divide(n, total), F.lit(0.0)), F.when(total == 0, "warning").otherwise(_graded(n, total)), F.concat(of(n, total), F.lit(" pages can be read without an account. "), c("told")), remedy(n < total, "Serve these pages to a client without an account."), F.struct(n.alias("open"), total.alias("pages"))


@check("sitemap_available")
def sitemap(c):
    """From the site's columns declared and reachable (URLs or null)."""
    found, named = F.col("reachable").isNotNull(), F.col("declared").isNotNull()
    severity = F.when(found & named, "ok").when(found, "info").otherwise("warning")
    evidence = F.when(found & named, F.concat(F.lit("robots.txt names a sitemap, and one answers at "), F.col("reachable"), F.lit("."))).when(found, F.concat(F.lit("A sitemap answers at "), F.col("reachable"), F.lit(", but robots.txt doesn't name it."))).when(named, F.concat(F.lit("robots.txt names "), F.col("declared"), F.lit(", where no sitemap answers."))).otherwise("There is no sitemap.")
    unnamed = F.when(found, "Name the sitemap in robots.txt.").when(named, "Make the sitemap answer at the address in robots.txt, or change the line.").otherwise("Publish a sitemap and name it in robots.txt.")
    fix = remedy(~(found & named), unnamed, F.when(found, F.concat(F.lit("Sitemap: "), F.col("reachable"))).otherwise(""))
    return found.cast("double"), severity, evidence, fix, F.struct("declared", "reachable")


def page_noindex() -> Column:
    return noindex_reasons(F.col("headers"), F.col("f.metas"))


@check("no_noindex", n=lambda: F.count_if(F.size(F.col("_noindex")) == 0), fault=lambda: F.when(F.size(F.col("_noindex")) > 0, F.concat(F.col("url"), F.lit(" ("), F.array_join(F.col("_noindex"), ", "), F.lit(")"))))
def noindex(c):
    n, total = c("n"), F.col("pages")
    return F.coalesce(F.try_divide(n, total), F.lit(0.0)), F.when(total == 0, "warning").otherwise(_graded(n, total)), F.concat(of(n, total), F.lit(" pages may be indexed. "), c("told")), remedy(n < total, "Take the noindex directive off pages that are meant to be found."), F.struct(n.alias("clean"), total.alias("pages"))


def page_raw() -> Column:
    return raw_html_score(F.col("f.text_chars"), F.col("f.script_chars"))


@check("raw_html_content", ratio=lambda: mean(F.col("_raw")), weak=lambda: F.count_if(ok200() & (F.col("_raw") < 1)), fault=lambda: F.when(ok200() & (F.col("_raw") < 1), F.concat(F.col("url"), F.lit(" ("), F.col("f.text_chars").cast("string"), F.lit(" characters of text)"))))
def raw_html(c):
    severity = F.when(c("weak") == 0, "ok").when(c("ratio") < 0.34, "critical").otherwise("warning")
    return c("ratio"), severity, F.concat(of(F.col("readable") - c("weak"), F.col("readable")), F.lit(" pages carry their text in the HTML that is sent. "), c("told")), remedy(c("weak") > 0, "Render the text on the server."), F.struct(c("weak").alias("weak"))


def page_known() -> Column:
    return F.arrays_overlap("f.jsonld_types", F.array(*map(F.lit, K.JSONLD_TYPES)))


@check("jsonld_valid", n=lambda: F.count_if(ok200() & F.col("_known")), broken=lambda: F.sum(F.when(ok200(), F.col("f.jsonld_broken"))))
def jsonld(c):
    n, total, broken = c("n"), F.col("readable"), c("broken")
    severity = F.when((n == total) & (broken == 0), "ok").when((n == 0) | (broken > 0), "warning").otherwise("info")
    return F.try_divide(n, total), severity, F.concat(of(n, total), F.lit(" pages carry JSON-LD of a type that is understood; "), broken.cast("string"), F.lit(" blocks can't be parsed.")), remedy((n < total) | (broken > 0), "Add one valid JSON-LD block a page that says what the page is."), F.struct(n.alias("with_recognised_type"), broken.alias("broken_blocks"))


def page_outline() -> Column:
    return heading_score(F.transform("f.headings", lambda h: h["level"]))


@check("heading_structure", ratio=lambda: mean(F.col("_outline")), weak=lambda: F.count_if(ok200() & (F.col("_outline") < 1)), fault=lambda: F.when(ok200() & (F.col("_outline") < 1), F.col("url")))
def headings(c):
    severity = F.when(c("weak") == 0, "ok").when(c("ratio") < 0.5, "warning").otherwise("info")
    return c("ratio"), severity, F.concat(of(F.col("readable") - c("weak"), F.col("readable")), F.lit(" pages have one h1 and skip no level. "), c("told")), remedy(c("weak") > 0, "Use one h1 and go down one level at a time."), F.struct(c("weak").alias("weak"))


def page_title() -> Column:
    return F.when(ok200() & (F.col("f.title") != ""), F.col("f.title"))


@check(
    "title_and_description",
    t=lambda: mean(F.col("_title_score")),
    d=lambda: mean(F.col("_description_score")),
    titles=lambda: F.count(F.col("_title")),
    distinct=lambda: F.count_distinct(F.col("_title")),
    odd=lambda: F.count_if(~F.length(F.col("_title")).between(*K.TITLE_RANGE)),
    plain=lambda: F.count_if(ok200() & (F.col("f.description") == "")),
)
def titles(c):
    unique = (c("titles") > 0) & (c("titles") == c("distinct"))
    full = (c("t") == 1) & (c("d") == 1) & unique
    ratio = F.when(full, 1.0).otherwise(K.TITLE_SHARE * c("t") + K.DESCRIPTION_SHARE * c("d") + K.UNIQUE_SHARE * unique.cast("double"))
    return ratio, F.when(full, "ok").otherwise("warning"), F.concat((F.col("readable") - c("titles")).cast("string"), F.lit(" pages have no title, "), c("plain").cast("string"), F.lit(" no description; titles are "), F.when(unique, "all different.").otherwise("not all different.")), remedy(~full, "Give each page a title and a description of its own, of the usual length."), F.struct(unique.alias("titles_unique"), c("odd").alias("titles_outside_range"), c("plain").alias("no_description"))


@check("author_and_dates", a=lambda: F.count_if(ok200() & F.col("_author")), d=lambda: F.count_if(ok200() & F.col("_date")))
def authorship(c):
    total = F.col("readable")
    full = (c("a") == total) & (c("d") == total)
    return F.try_divide(c("a") + c("d"), 2 * total), F.when(full, "ok").otherwise("warning"), F.concat(of(c("a"), total), F.lit(" pages name an author, "), of(c("d"), total), F.lit(" a date.")), remedy(~full, "Name the author and the date in the page's markup."), F.struct(c("a").alias("with_author"), c("d").alias("with_date"))


def page_canonical() -> Column:
    return canonical_fault(F.col("f.canonical"), F.col("url"))


@check("canonical", n=lambda: F.count_if(ok200() & F.col("_canonical").isNull()), fault=lambda: F.when(ok200() & F.col("_canonical").isNotNull(), F.concat(F.col("url"), F.lit(" ("), F.col("_canonical"), F.lit(")"))))
def canonical(c):
    full = c("n") == F.col("readable")
    return F.try_divide(c("n"), F.col("readable")), F.when(full, "ok").otherwise("warning"), F.concat(of(c("n"), F.col("readable")), F.lit(" pages name a canonical address on their own host. "), c("told")), remedy(~full, "Add a canonical link to each page, on its own host."), F.struct(c("n").alias("sound"))


def llms_ratio(body: Column) -> Column:
    return F.when(F.length(strip(F.coalesce(body, F.lit("")))) >= K.LLMS_CHARS, 1.0).otherwise(0.0)


def read_llms(status: Column, error: Column, body: Column) -> Column:
    """The body of llms.txt, or null if it isn't there or is a page."""
    head = F.lower(F.regexp_replace(F.substring(body, 1, 500), r"^(?U)\s+", ""))
    return F.when(error.isNull() & (status == 200) & ~F.startswith(head, F.lit("<!doctype")) & ~F.contains(head, F.lit("<html")), body)


@check("llms_txt")
def llms(c):
    """From the site's column llms (body or null)."""
    good = llms_ratio(F.col("llms")) == 1
    return llms_ratio(F.col("llms")), F.when(good, "ok").otherwise("info"), F.when(good, "llms.txt is there.").when(F.col("llms").isNull(), "There is no llms.txt.").otherwise("llms.txt is all but empty."), remedy(~good, "Publish an llms.txt that lists the pages worth reading."), F.struct(F.length(F.coalesce("llms", F.lit(""))).alias("length"))


SHAPES = ("steps", "comparison_table", "faq", "definition_list", "attributed_quote", "summary_box")


@check("answer_shaped_content", citable=lambda: mean(F.col("_citable")), **{n: lambda n=n: F.coalesce(F.bool_or(ok200() & F.col("f")[n]), F.lit(False)) for n in SHAPES})
def answers(c):
    found = reduce(lambda a, b: a + b, (c(n).cast("int") for n in SHAPES))
    full = (found >= K.SHAPES_WANTED) & (c("citable") == 1)
    ratio = K.SHAPE_SHARE * F.least(found, F.lit(K.SHAPES_WANTED)) / K.SHAPES_WANTED + K.CITABLE_SHARE * c("citable")
    return F.when(full, 1.0).otherwise(ratio), F.when(full, "ok").otherwise("info"), F.concat(found.cast("string"), F.lit(" of 6 shapes that answers are taken from.")), remedy(~full, "Offer steps, tables, questions with answers or definitions, in sections."), F.struct(*(c(n).alias(n) for n in SHAPES), found.alias("found"), c("citable").alias("citable"))


#: What the aggregates read of a page, computed once a page.
PAGE: dict[str, Callable[[], Column]] = {
    "_wall": page_wall,
    "_noindex": page_noindex,
    "_raw": page_raw,
    "_known": page_known,
    "_outline": page_outline,
    "_title": page_title,
    "_title_score": lambda: field_score(F.col("f.title"), K.TITLE_RANGE),
    "_description_score": lambda: field_score(F.col("f.description"), K.DESCRIPTION_RANGE),
    "_author": lambda: has_author(F.col("f")),
    "_date": lambda: has_date(F.col("f")),
    "_canonical": page_canonical,
    "_citable": lambda: citable_score(F.col("f.block_sizes")),
}


#: Readability checks that need a page that answered 200.
OF_PAGES = frozenset(i for c, i, _ in K.RUBRIC if c == "readability" and i != "llms_txt")


FIX = "struct<summary:string,snippet:string,docs_url:string>"


def attempted(sites: DataFrame, pages: DataFrame, verdicts: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """domain, pos, check_id, category, ratio, severity, evidence, fix, details, error (null unless the check failed) for every site
    and check (or those named).

    sites: domain, declared, reachable, llms. pages are read twice (for counts, and for the pages that faults are shown of), so they
    are kept or written; nothing gathers all pages of a site."""
    wanted = [(k, c, i) for k, (c, i, _) in enumerate(K.RUBRIC) if not only or i in only]
    aggregates = [a().alias(f"{i}__{n}") for _, _, i in wanted for n, a in CHECKS[i][1].items()]
    facts = pages.withColumns({n: c() for n, c in PAGE.items()})
    per_site = facts.groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(ok200()).alias("readable"), *aggregates)
    shown = [i for _, _, i in wanted if i in FAULTS]
    if shown:
        per_site = per_site.join(first_faults(facts, shown), "domain", "left").withColumns({f"{i}__told": F.coalesce(f"{i}__told", F.lit("")) for i in shown})
    row = sites.join(per_site, "domain", "left").join(crawler_facts(verdicts), "domain", "left").withColumn("pages", F.coalesce("pages", F.lit(0))).withColumn("readable", F.coalesce("readable", F.lit(0)))
    made = []
    for k, category, i in wanted:
        ratio, severity, evidence, fix, details = CHECKS[i][0](lambda n, i=i: F.col(f"{i}__{n}"))
        unread = (F.col("readable") == 0) if i in OF_PAGES else F.lit(False)
        fault = F.when(unread | F.coalesce(ratio.between(0, 1), F.lit(False)), F.lit(None)).otherwise(F.concat(F.lit(f"{i}: no ratio from 0 to 1 but "), F.coalesce(ratio.cast("string"), F.lit("none"))))
        linked = F.when(~unread & fix.isNotNull(), F.struct(fix["summary"].alias("summary"), fix["snippet"].alias("snippet"), F.lit(K.CHECK_DOCS[i]).alias("docs_url")))
        made.append(
            F.struct(
                F.lit(k).alias("pos"), F.lit(i).alias("check_id"), F.lit(category).alias("category"), F.when(unread, 0.0).otherwise(ratio).cast("double").alias("ratio"), F.when(unread, "warning").otherwise(severity).alias("severity"),
                F.when(unread, "No page answered 200, so there was nothing to read.").otherwise(evidence).alias("evidence"), linked.cast(FIX).alias("fix"), F.when(unread, "{}").otherwise(F.to_json(details)).alias("details"), fault.cast("string").alias("error"),
            )
        )
    return row.select("domain", F.explode(F.array(*made)).alias("x")).select("domain", "x.*")


def sound(attempted_: DataFrame) -> DataFrame:
    """The checks that ran: domain, check_id, category, ratio, severity, evidence, fix, details."""
    return attempted_.where("error IS NULL").drop("error", "pos")


def failures(attempted_: DataFrame) -> DataFrame:
    """domain, pos, message of those that failed, after the errors of the crawl."""
    return attempted_.where("error IS NOT NULL").select("domain", (F.col("pos") + 100).alias("pos"), F.col("error").alias("message"))


def checks(sites: DataFrame, pages: DataFrame, verdicts: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """sound() of attempted()."""
    return sound(attempted(sites, pages, verdicts, only))
