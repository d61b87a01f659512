"""Every registered query of the audit engine, each beside its SQL for the oracle. Inputs are those of bridge.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens import constants as K
from sitelens.functions import html, text, urls
from sitelens.operators import accuracy, checks, manifest, report, robots, scoring, signals, sitemap, study
from sitelens.plans import bridge as B
from sitelens.sources.steps import balanced, shared_dir
from sitelens.streaming import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "access_score"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- shared plans -------------------------------------------------------------------------------------------------------


def kept(df: DataFrame) -> DataFrame:
    """For what several parts of one plan read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def featured(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """Pages with their features and platform in place of their HTML; kept where more than one grouping reads them."""
    p = balanced(B.pages(spark, sf_dir)).withColumn("f", html.features(F.col("html"), F.col("url")))
    p = p.withColumn("platform", checks.detect_platform(F.col("html"), F.col("headers"), F.col("f.metas"))).drop("html")
    return kept(p) if keep else p


def site_verdicts(sites: DataFrame) -> DataFrame:
    """A body is judged once, however many sites share it."""
    return sites.select("domain", "robots_id").join(robots.verdicts(B.site_bodies(sites)), "robots_id")


def site_blanket(sites: DataFrame) -> DataFrame:
    return sites.select("domain", "robots_id").join(robots.blanket_disallow(B.site_bodies(sites)), "robots_id").select("domain", "blanket")


def audited(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sites, verdicts and check results."""
    s = B.sites(spark, sf_dir)
    v = kept(site_verdicts(s))
    twice = not only or bool(set(only) & set(checks.FAULTS))
    return s, v, checks.checks(s, featured(spark, sf_dir, keep=twice), v, only)


def site_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """sites (with blanket), pages, verdicts, check results and scores."""
    s = B.sites(spark, sf_dir)
    s = kept(s.join(site_blanket(s), "domain"))
    v = kept(site_verdicts(s))
    p = featured(spark, sf_dir, keep=True)
    r = kept(checks.checks(s, p, v))
    return s, p, v, r, scoring.scores(s, r, scoring.caps(v, s.select("domain", "blanket")))


ACCESS = tuple(i for c, i, _ in K.RUBRIC if c == "access")

# ---- shared SQL ---------------------------------------------------------------------------------------------------------

_AGENTS = B.values([(i, *a[:5]) for i, a in enumerate(K.AGENTS)], "t", "pos, token, vendor, bucket, obeys, ai_only")
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = rf"""{B.SQL_BODIES},
l0 AS (SELECT robots_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT robots_id, string_split_regex(body, '\r\n|[\n\r]') AS a FROM r WHERE body IS NOT NULL)),
d AS (SELECT robots_id, pos, lower({_STRIP.format("split_part(c, ':', 1)")}) AS field, {_STRIP.format("substr(c, strpos(c, ':') + 1)")} AS value
      FROM (SELECT robots_id, pos, split_part(line, '#', 1) AS c FROM l0) WHERE strpos(c, ':') > 0)"""
_GROUPS = f"""{_LINES},
g AS (SELECT *, sum(opens) OVER (PARTITION BY robots_id ORDER BY pos) AS gid
      FROM (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY robots_id ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM d)),
an AS (SELECT robots_id, gid, pos, value AS agent FROM g WHERE gid > 0 AND field = 'user-agent'),
ru AS (SELECT robots_id, gid, pos, field, value FROM g WHERE gid > 0 AND field IN ('allow', 'disallow'))"""
_REGEX = r"'^' || regexp_replace(regexp_replace(regexp_replace(value, '([\\.\[\](){}+?^|$])', '\\\1', 'g'), '\\\$$', '$'), '\*+', '.*', 'g')"


def _select(tokens: str) -> str:
    return rf"""{_GROUPS},
ag AS (SELECT * FROM {tokens}),
w AS (SELECT r.robots_id, ag.token, max(CASE WHEN an.agent <> '*' AND starts_with(lower(ag.token), lower(an.agent)) THEN length(an.agent) END) AS size
      FROM r CROSS JOIN ag LEFT JOIN an ON an.robots_id = r.robots_id GROUP BY ALL),
m AS (SELECT w.robots_id, w.token, an.gid, an.pos, an.agent FROM w JOIN an ON an.robots_id = w.robots_id AND lower(an.agent) = CASE WHEN w.size IS NULL THEN '*' ELSE lower(left(w.token, w.size)) END),
wn AS (SELECT robots_id, token, arg_min(agent, pos) AS winner FROM m GROUP BY ALL),
mr AS (SELECT x.robots_id, x.token, ru.pos, ru.field, ru.value, row_number() OVER (PARTITION BY x.robots_id, x.token ORDER BY ru.pos) AS k
       FROM (SELECT DISTINCT robots_id, token, gid FROM m) x JOIN ru ON ru.robots_id = x.robots_id AND ru.gid = x.gid)"""


_VERDICTS = rf"""{_select(_AGENTS)},
dec AS (SELECT robots_id, token, arg_max(field = 'allow', 2 * length(value) + (field = 'allow')::INT) AS allowed FROM mr WHERE value <> '' AND regexp_matches('/', {_REGEX}) GROUP BY ALL),
v AS (SELECT r.robots_id, ag.*, coalesce(dec.allowed, TRUE) AS allowed FROM r CROSS JOIN ag LEFT JOIN dec ON dec.robots_id = r.robots_id AND dec.token = ag.token)"""
_BLANKET = f"""{_select("(VALUES ('*')) AS t(token)")},
b AS (SELECT r.robots_id, coalesce(bool_or(field = 'disallow' AND value = '/') AND NOT bool_or(field = 'allow' AND value <> ''), FALSE) AS blanket FROM r LEFT JOIN mr ON mr.robots_id = r.robots_id GROUP BY r.robots_id)"""
_SITES = f"{B.SQL_PAGES},{B.SQL_SITES}"
_SITE_VERDICTS = f"{_SITES},{_VERDICTS},\nsv AS (SELECT s.domain, v.* FROM s JOIN v USING (robots_id))"
_TEXT = r"""length(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
 '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')))"""
_SCRIPT = "coalesce(list_sum(list_transform(regexp_extract_all(html, '<script[^>]*>(.*?)</script>', 1, 's'), lambda x: length(x))), 0)"
_LEVELS = "list_transform(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script[^>]*>.*?</script>', '', 'gs'), '<h([1-6])', 1), lambda x: x::INT)"
_TITLE = r"replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')".replace('\\"', '"')
_FEATURES = f"""
tx AS (SELECT *, {_TEXT} AS text_chars, {_SCRIPT} AS script_chars, {_LEVELS} AS levels_all, {_TITLE} AS title FROM p),
sc AS (SELECT *, CASE WHEN text_chars < {K.TEXT_EMPTY} THEN 0 WHEN script_chars > {K.SCRIPT_HEAVY} * text_chars THEN 0.25 WHEN text_chars < {K.TEXT_THIN} THEN 0.5 ELSE 1 END AS raw_score,
              len(list_filter(levels_all, lambda x: x = 1)) AS h1, len(list_filter(range(2, len(levels_all) + 1), lambda i: levels_all[i] > levels_all[i - 1] + 1)) AS jumps,
              CASE WHEN has THEN description ELSE '' END AS descr FROM tx)"""
_LOGIN = "|".join(K.LOGIN_PATHS)
_PAGE_FACTS = f"""
pf AS (SELECT *, status = 200 AND NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '{_LOGIN}') AS open,
              NOT (x_robots = '{B.X_ROBOTS[5]}') AND NOT (has AND noindex) AS clean FROM p)"""
_ACCESS = f"""{_SITE_VERDICTS},{_PAGE_FACTS},
cf AS (SELECT domain, count(*) FILTER (WHERE bucket = 'citation' AND allowed) AS ca, count(*) FILTER (WHERE bucket = 'citation') AS ct,
              count(*) FILTER (WHERE bucket = 'user_fetch' AND (allowed OR obeys <> 'yes')) AS ur, count(*) FILTER (WHERE bucket = 'user_fetch') AS ut FROM sv GROUP BY domain),
pa AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE open) AS open, count(*) FILTER (WHERE clean) AS clean FROM pf GROUP BY domain),
ra AS (SELECT s.domain, s.robots_id, cf.ca, 50.0 * cf.ca / cf.ct + 20.0 * cf.ur / cf.ut + 15.0 * pa.open / pa.n + CASE WHEN s.reachable IS NULL THEN 0 ELSE 10 END + 5.0 * pa.clean / pa.n AS exact
       FROM s JOIN cf USING (domain) JOIN pa USING (domain))"""
_LETTER = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 75 THEN 'B' WHEN {0} >= 60 THEN 'C' WHEN {0} >= 40 THEN 'D' ELSE 'F' END"
#: bodies whose * group shuts everything, as a relation of its own beside the verdicts
_SHUT = f"sh AS (WITH {_BLANKET} SELECT * FROM b)"
_SCORED = f"""{_ACCESS},{_SHUT},
fa AS (SELECT domain, raw, cap, CASE WHEN raw > cap THEN cap ELSE raw END AS final FROM (
       SELECT ra.domain, round_even(ra.exact, 2) AS raw, CASE WHEN ra.ca = 0 THEN CASE WHEN sh.blanket THEN {K.CAP_BLANKET} ELSE {K.CAP_NO_CITATION} END END AS cap FROM ra JOIN sh ON sh.robots_id = ra.robots_id))"""

# ---- pages --------------------------------------------------------------------------------------------------------------


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT page_id, text_chars::INT AS text_chars, script_chars::INT AS script_chars, title, h1::INT AS h1_count FROM sc")
def page_text_volume(spark, sf_dir):
    f = F.col("f")
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), f["text_chars"].alias("text_chars"), f["script_chars"].alias("script_chars"), f["title"].alias("title"), F.size(F.filter(f["headings"], lambda h: h["level"] == 1)).alias("h1_count"))


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT domain, count(*) AS pages, count(*) FILTER (WHERE raw_score < 1) AS weak, sum(4 * raw_score)::BIGINT AS quarters FROM sc WHERE status = 200 GROUP BY domain")
def raw_html_content_by_site(spark, sf_dir):
    p = featured(spark, sf_dir).where("status = 200").withColumn("s", checks.page_raw())
    return p.groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(F.col("s") < 1).alias("weak"), F.sum(4 * F.col("s")).cast("long").alias("quarters"))


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT page_id, unnest(range(1, len(levels_all) + 1))::INT AS pos, unnest(levels_all) AS level FROM sc")
def heading_outline(spark, sf_dir):
    p = featured(spark, sf_dir).select(F.col("pos").alias("page_id"), F.posexplode("f.headings").alias("k", "h"))
    return p.select("page_id", (F.col("k") + 1).alias("pos"), F.col("h.level").alias("level"))


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT page_id, jumps::INT AS jumps, h1::INT AS h1, (CASE WHEN h1 = 0 THEN 0 ELSE CASE WHEN h1 = 1 THEN 6 ELSE 0 END + CASE WHEN jumps = 0 THEN 4 ELSE 0 END END)::INT AS tenths FROM sc")
def skipped_levels(spark, sf_dir):
    levels = F.transform("f.headings", lambda h: h["level"])
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), F.size(checks.skipped_levels(levels)).alias("jumps"), F.size(F.filter(levels, lambda x: x == 1)).alias("h1"), F.round(10 * checks.heading_score(levels)).cast("int").alias("tenths"))


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT page_id, length(title)::INT AS title_len, CASE WHEN title = '' THEN 'empty' WHEN length(title) BETWEEN 10 AND 70 THEN 'good' ELSE 'odd' END AS title_class, CASE WHEN descr = '' THEN 'empty' WHEN length(descr) BETWEEN 50 AND 160 THEN 'good' ELSE 'odd' END AS description_class FROM sc")
def title_quality(spark, sf_dir):
    named = lambda v, b: F.when(checks.field_score(v, b) == 0, "empty").when(checks.field_score(v, b) == 1, "good").otherwise("odd")
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), F.length("f.title").alias("title_len"), named(F.col("f.title"), K.TITLE_RANGE).alias("title_class"), named(F.col("f.description"), K.DESCRIPTION_RANGE).alias("description_class"))


@query(f"WITH {B.SQL_PAGES},{_FEATURES} SELECT domain, count(*) AS pages, count(DISTINCT nullif(title, '')) AS distinct_titles, count(nullif(title, '')) > 0 AND count(DISTINCT nullif(title, '')) = count(nullif(title, '')) AS is_unique FROM sc WHERE status = 200 GROUP BY domain")
def title_uniqueness(spark, sf_dir):
    title = checks.page_title()
    p = featured(spark, sf_dir).where("status = 200").groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct(title).alias("distinct_titles"), F.count(title).alias("titles"))
    return p.select("domain", "pages", "distinct_titles", ((F.col("titles") > 0) & (F.col("titles") == F.col("distinct_titles"))).alias("is_unique"))


@query(f"WITH {B.SQL_PAGES} SELECT page_id, CASE WHEN has AND types <> '' THEN len(string_split(types, ',')) ELSE 0 END::INT AS n_types, (has AND recognised > 0) AS recognised, CASE WHEN has THEN broken ELSE 0 END::INT AS broken FROM p")
def jsonld_types(spark, sf_dir):
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), F.size("f.jsonld_types").alias("n_types"), checks.page_known().alias("recognised"), F.col("f.jsonld_broken").alias("broken"))


@query(f"WITH {B.SQL_PAGES} SELECT page_id, has AND author AS has_author, has AND dated AS has_date FROM p")
def author_dates(spark, sf_dir):
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), checks.has_author(F.col("f")).alias("has_author"), checks.has_date(F.col("f")).alias("has_date"))


@query(f"WITH {B.SQL_PAGES} SELECT domain, count(*) AS pages, count(*) FILTER (WHERE NOT (has AND canonical = 'own')) AS faults FROM p WHERE status = 200 GROUP BY domain")
def canonical_faults(spark, sf_dir):
    return featured(spark, sf_dir).where("status = 200").groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(checks.page_canonical().isNotNull()).alias("faults"))


@query(f"WITH {B.SQL_PAGES},{_PAGE_FACTS} SELECT page_id, NOT clean AS flagged FROM pf")
def noindex_flags(spark, sf_dir):
    return featured(spark, sf_dir).select(F.col("pos").alias("page_id"), (F.size(checks.page_noindex()) > 0).alias("flagged"))


@query(f"WITH {B.SQL_PAGES},{_PAGE_FACTS} SELECT domain, count(*) FILTER (WHERE open) AS reachable, count(*) AS total FROM pf GROUP BY domain")
def login_walls(spark, sf_dir):
    return featured(spark, sf_dir).groupBy("domain").agg(F.count_if(checks.page_wall().isNull()).alias("reachable"), F.count("*").alias("total"))


@query(f"WITH {B.SQL_PAGES} SELECT domain, {', '.join(f'''bool_or(has AND substr(shapes, {k + 1}, 1) = '1') AS {n}''' for k, n in enumerate(checks.SHAPES))} FROM p WHERE status = 200 GROUP BY domain")
def answer_shapes(spark, sf_dir):
    return featured(spark, sf_dir).where("status = 200").groupBy("domain").agg(*(F.bool_or(F.col("f")[n]).alias(n) for n in checks.SHAPES))


_SECTIONS = B.sql_each([x[1:] for x in B.SECTIONS], "html, largest, total", "greatest(largest, page_id % 97) AS largest", "total + page_id % 97 AS total")


def sections(spark, sf_dir) -> DataFrame:
    """page_id and the sizes of the sections of a page for every page: one of the fixed ones with a last section of its own."""
    p = B.each(spark, sf_dir, [(h,) for _, h, _, _ in B.SECTIONS], "html string")
    own = F.concat("html", F.lit("<h2>own</h2><p>"), F.expr("repeat('w ', cast(page_id % 97 as int))"), F.lit("</p>"))
    return p.select("page_id", html.features(own, F.lit("https://a.example/"))["block_sizes"].alias("sizes"))


@query(f"SELECT page_id, largest::INT AS largest, total::INT AS total FROM {_SECTIONS}")
def block_sections(spark, sf_dir):
    return sections(spark, sf_dir).select("page_id", F.array_max("sizes").alias("largest"), F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("total"))


@query(f"SELECT page_id, CASE WHEN t < {K.WORDS_TO_JUDGE} OR a <= {K.WELL_SECTIONED} * t THEN 1000 WHEN a >= {K.ONE_BLOCK} * t THEN 0 ELSE round(1000 * ({K.ONE_BLOCK} - a / t) / ({K.ONE_BLOCK} - {K.WELL_SECTIONED})) END::INT AS citable FROM (SELECT page_id, largest::DOUBLE AS a, total::DOUBLE AS t FROM {_SECTIONS})")
def citable_pages(spark, sf_dir):
    return sections(spark, sf_dir).select("page_id", F.round(1000 * checks.citable_score(F.col("sizes"))).cast("int").alias("citable"))


@query(f"SELECT page_id, platform FROM {B.sql_each([(p,) for _, _, p in B.PLATFORMS], 'platform', 'platform')}")
def platform_detect(spark, sf_dir):
    """Every page with one of the fixed heads before its own HTML."""
    head = B.each(spark, sf_dir, [(h,) for _, h, _ in B.PLATFORMS], "head string").select("page_id", "head")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").join(head, "page_id").select("page_id", "url", F.concat("head", "html").alias("html"))
    p = p.withColumn("f", html.features(F.col("html"), F.col("url")))
    return p.select("page_id", checks.detect_platform(F.col("html"), F.create_map(F.lit("server"), F.lit("x")), F.col("f.metas")).alias("platform"))


@query(f"""WITH {B.SQL_PAGES},{_FEATURES} SELECT k AS kind, min(text_chars)::INT AS least, (array_agg(text_chars ORDER BY text_chars))[count(*) // 2 + 1]::INT AS upper_median, max(text_chars)::INT AS most
FROM (SELECT CASE WHEN contains(html, '</html>') THEN 'closed' ELSE 'open' END AS k, text_chars FROM sc) GROUP BY k""")
def calibration_summary(spark, sf_dir):
    p = B.pages(spark, sf_dir).withColumn("f", F.when(F.col("html").isNotNull(), html.features(F.col("html"), F.col("url"))))
    p = p.select(F.when(F.contains("html", F.lit("</html>")), "closed").otherwise("open").alias("kind"), *study.calibration_row(F.col("f")))
    return study.calibration(p, "kind")


# ---- URLs ---------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS origin, CASE WHEN length(url) > 60 THEN left(url, 57) || '...' ELSE url END AS short FROM pages")
def url_normalise(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", urls.normalise_base(F.col("url")).alias("origin"), text.shorten(F.col("url")).alias("short"))


_SUFFIXED = "SELECT url || suffix AS url FROM pages, (VALUES (''), ('x.PDF'), ('x.html'), ('x.js?a=1'), ('x.json#b')) AS t(suffix)"


@query(f"SELECT url, NOT regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\\.(pdf|jpg|jpeg|png|gif|webp|svg|mp4|mp3|zip|xml|json|css|js)$') AS is_page FROM ({_SUFFIXED})")
def is_page_filter(spark, sf_dir):
    suffix = F.explode(F.array(*map(F.lit, ["", "x.PDF", "x.html", "x.js?a=1", "x.json#b"])))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", suffix.alias("suffix")).select(F.concat("url", "suffix").alias("url"))
    return p.select("url", urls.is_page(F.col("url")).alias("is_page"))


@query(f"""WITH {B.SQL_PAGES} SELECT domain, rank, url FROM (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY sha256(url)) AS rank FROM (SELECT DISTINCT domain, url FROM p
WHERE NOT regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\\.(pdf|jpg|jpeg|png|gif|webp|svg|mp4|mp3|zip|xml|json|css|js)$'))) WHERE rank <= {K.PAGES_SAMPLED}""")
def hash_sample_pages(spark, sf_dir):
    return sitemap.sample(B.pages(spark, sf_dir).where(urls.is_page(F.col("url"))), K.PAGES_SAMPLED, "domain").withColumn("rank", F.col("rank").cast("long"))


# ---- robots.txt ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT robots_id, pos::INT AS pos, field, value FROM d")
def robots_tokens(spark, sf_dir):
    return robots.directives(B.bodies(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT an.robots_id, an.gid::BIGINT AS group_id, an.agent, (SELECT count(*) FROM ru WHERE ru.robots_id = an.robots_id AND ru.gid = an.gid) AS n_rules FROM an")
def robots_groups(spark, sf_dir):
    return robots.groups(B.bodies(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT robots_id, token, allowed FROM v")
def agent_verdicts(spark, sf_dir):
    return robots.verdicts(B.bodies(spark, sf_dir)).select("robots_id", "token", "allowed")


@query(f"""WITH {_VERDICTS} SELECT v.robots_id, v.token, CASE WHEN wn.winner IS NULL THEN NULL WHEN t.n IS NULL THEN 'User-agent: ' || wn.winner || ' (no rules)'
ELSE 'User-agent: ' || wn.winner || ' | ' || t.shown || CASE WHEN t.n > 3 THEN ', and ' || (t.n - 3) || ' more' ELSE '' END END AS matched_rule
FROM v LEFT JOIN wn USING (robots_id, token) LEFT JOIN (SELECT robots_id, token, count(*) AS n, string_agg(upper(left(field, 1)) || substr(field, 2) || ': ' || value, ', ' ORDER BY k) FILTER (WHERE k <= 3) AS shown FROM mr GROUP BY ALL) t USING (robots_id, token)""")
def matched_rule(spark, sf_dir):
    return robots.verdicts(B.bodies(spark, sf_dir)).select("robots_id", "token", "matched_rule")


@query(f"WITH {_BLANKET} SELECT robots_id, blanket FROM b")
def blanket_disallow(spark, sf_dir):
    return robots.blanket_disallow(B.bodies(spark, sf_dir))


@query(f"WITH {_SITE_VERDICTS} SELECT domain, bucket, count(*) FILTER (WHERE allowed) AS allowed, count(*) AS total FROM sv GROUP BY domain, bucket")
def bucket_counts(spark, sf_dir):
    return robots.bucket_counts(site_verdicts(B.sites(spark, sf_dir)), "domain")


@query(f"WITH {_SITE_VERDICTS} SELECT domain, CASE WHEN bool_and(allowed) THEN 'open' WHEN NOT bool_or(allowed) THEN 'closed' ELSE 'partial' END AS posture FROM sv WHERE bucket = 'training' GROUP BY domain")
def training_posture(spark, sf_dir):
    n = robots.bucket_counts(site_verdicts(B.sites(spark, sf_dir)), "domain").where("bucket = 'training'")
    return n.select("domain", robots.posture(F.col("allowed"), F.col("total")).alias("posture"))


@query(rf"""SELECT page_id, status = 200 AND NOT (starts_with(lower(ltrim(left(body, 500))), '<!doctype') OR contains(lower(left(body, 500)), '<html')) AND NOT (contains(kind, 'html') AND contains(lower(left(body, 5000)), '<html'))
AND regexp_matches(body, '(?im)^\s*(user-agent|disallow|allow|sitemap|crawl-delay)\s*:') AS is_real FROM {B.sql_each([x[1:] for x in B.RESPONSES], 'status, kind, body', 'status', 'kind', "body || '# ' || page_id AS body")}""")
def robots_validity(spark, sf_dir):
    df = B.each(spark, sf_dir, [x[1:] for x in B.RESPONSES], "status int, kind string, body string")
    own = F.concat("body", F.lit("# "), F.col("page_id").cast("string"))
    _, real, _ = robots.read_response(F.col("status"), F.lit(None).cast("string"), own, F.col("kind"))
    return df.select("page_id", real.alias("is_real"))


@query(rf"""WITH {B.SQL_BODIES},
c AS (SELECT robots_id, unnest(m) AS line, unnest(range(len(m))) AS k FROM (SELECT robots_id, regexp_extract_all(body, '(?im)^\s*content-signal\s*:\s*(.+?)\s*$', 1) AS m FROM r WHERE body IS NOT NULL)),
p AS (SELECT robots_id, 10000 * k + i AS pos, lower(trim(split_part(pair, '=', 1))) AS key, lower(trim(substr(pair, strpos(pair, '=') + 1))) AS value
      FROM (SELECT robots_id, k, unnest(string_split(line, ',')) AS pair, unnest(range(len(string_split(line, ',')))) AS i FROM c) WHERE contains(pair, '='))
SELECT robots_id, key, CASE WHEN known THEN value END AS value, known FROM (SELECT robots_id, key, arg_max(value, pos) AS value, key IN ({', '.join(map(B.quoted, K.SIGNAL_KEYS))}) AS known FROM p WHERE key <> '' GROUP BY ALL)""")
def content_signals(spark, sf_dir):
    return signals.declared(B.bodies(spark, sf_dir))


def _listed(x: str) -> str:
    return f"CASE WHEN len({x}) = 1 THEN {x}[1] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ' and ' || {x}[len({x})] END"


@query(rf"""WITH {B.SQL_BODIES},
c AS (SELECT robots_id, unnest(m) AS line, unnest(range(len(m))) AS k FROM (SELECT robots_id, regexp_extract_all(body, '(?im)^\s*content-signal\s*:\s*(.+?)\s*$', 1) AS m FROM r WHERE body IS NOT NULL)),
p AS (SELECT robots_id, 10000 * k + i AS pos, lower(trim(split_part(pair, '=', 1))) AS key, lower(trim(substr(pair, strpos(pair, '=') + 1))) AS value
      FROM (SELECT robots_id, k, unnest(string_split(line, ',')) AS pair, unnest(range(len(string_split(line, ',')))) AS i FROM c) WHERE contains(pair, '=')),
u AS (SELECT robots_id, key, arg_max(value, pos) AS value FROM p WHERE key <> '' GROUP BY ALL),
y AS (SELECT u.robots_id, coalesce(list(m.meaning ORDER BY u.key) FILTER (WHERE m.meaning IS NOT NULL AND u.value = 'yes'), []) AS yes, coalesce(list(m.meaning ORDER BY u.key) FILTER (WHERE m.meaning IS NOT NULL AND u.value = 'no'), []) AS no,
             count(*) FILTER (WHERE u.key NOT IN ({', '.join(map(B.quoted, K.SIGNAL_KEYS))})) AS unknown FROM u LEFT JOIN {B.values(list(signals.MEANING.items()), 'm', 'key, meaning')} ON m.key = u.key GROUP BY u.robots_id)
SELECT y.robots_id, y.unknown::INT AS n_unknown, w.raw, TRUE AS present, CASE WHEN len(yes) + len(no) = 0 THEN 'A declaration without a key we know.' ELSE 'The site ' || CASE WHEN len(yes) > 0 THEN 'allows ' || {_listed('yes')} ELSE '' END
 || CASE WHEN len(yes) > 0 AND len(no) > 0 THEN ', and ' ELSE '' END || CASE WHEN len(no) > 0 THEN 'refuses ' || {_listed('no')} ELSE '' END || '.' END AS summary
FROM y JOIN (SELECT robots_id, string_agg(line, '; ' ORDER BY k) AS raw FROM c GROUP BY robots_id) w USING (robots_id)""")
def content_signal_summary(spark, sf_dir):
    return signals.signals(B.bodies(spark, sf_dir)).select("robots_id", F.size("unknown_keys").alias("n_unknown"), "raw", "present", "summary")


# ---- sitemaps and llms.txt ----------------------------------------------------------------------------------------------


@query(f"""SELECT page_id, pos, kind, replace(url, '.example', '.' || page_id || '.example') AS url FROM (SELECT q.page_id, t.pos, t.kind, t.url FROM pages q
JOIN {B.values([(i, k, kind, u) for i, _, locs in B.SITEMAPS for k, (kind, u) in enumerate(locs)], 't', 'id, pos, kind, url')} ON q.page_id % {len(B.SITEMAPS)} = t.id)""")
def sitemap_locs(spark, sf_dir):
    df = B.each(spark, sf_dir, [(x,) for _, x, _ in B.SITEMAPS], "xml string")
    df = df.withColumn("xml", F.replace("xml", F.lit(".example"), F.concat(F.lit("."), F.col("page_id").cast("string"), F.lit(".example"))))
    return df.select("page_id", F.posexplode(sitemap.parse("xml")).alias("pos", "loc")).select("page_id", "pos", "loc.kind", "loc.url")


@query(f"WITH {_SITES} SELECT domain, CASE WHEN reachable IS NULL THEN 'warning' WHEN declared IS NULL THEN 'info' ELSE 'ok' END AS severity, CASE WHEN reachable IS NULL THEN 0 ELSE 1 END::DOUBLE AS ratio FROM s")
def sitemap_status(spark, sf_dir):
    return audited(spark, sf_dir, ("sitemap_available",))[2].select("domain", "severity", "ratio")


@query(f"WITH {_SITES} SELECT domain, llms IS NOT NULL AS present, length(coalesce(llms, ''))::INT AS length, CASE WHEN length(trim(coalesce(llms, ''), chr(10) || ' ')) >= {K.LLMS_CHARS} THEN 1 ELSE 0 END::DOUBLE AS ratio FROM s")
def llms_txt_check(spark, sf_dir):
    s = B.sites(spark, sf_dir)
    return s.select("domain", F.col("llms").isNotNull().alias("present"), F.length(F.coalesce("llms", F.lit(""))).alias("length"), checks.llms_ratio(F.col("llms")).alias("ratio"))


# ---- checks and scores --------------------------------------------------------------------------------------------------


@query(f"""WITH {_SITE_VERDICTS}, c AS (SELECT domain, count(*) FILTER (WHERE allowed) AS allowed, count(*) AS total, bool_and(NOT allowed) FILTER (WHERE ai_only) AND count(*) FILTER (WHERE allowed) > 0 AS blackout FROM sv WHERE bucket = 'citation' GROUP BY domain)
SELECT domain, allowed, total, CASE WHEN allowed = total THEN 'ok' WHEN blackout OR allowed = 0 THEN 'critical' ELSE 'warning' END AS severity, blackout FROM c""")
def citation_check(spark, sf_dir):
    v = site_verdicts(B.sites(spark, sf_dir))
    c = F.col("citation")
    severity = checks.citation(None)[1]
    return checks.crawler_facts(v).select("domain", c["allowed"].alias("allowed"), c["total"].alias("total"), severity.alias("severity"), checks.blackout(c).alias("blackout"))


@query(f"WITH {_SITE_VERDICTS} SELECT domain, count(*) FILTER (WHERE allowed OR obeys <> 'yes') AS reachable, count(*) AS total FROM sv WHERE bucket = 'user_fetch' GROUP BY domain")
def user_fetch_check(spark, sf_dir):
    u = F.col("user_fetch")
    return checks.crawler_facts(site_verdicts(B.sites(spark, sf_dir))).select("domain", (u["allowed"] + F.size(u["ignored"])).alias("reachable"), u["total"].alias("total"))


@query(f"WITH {_SCORED} SELECT domain, round(100 * raw)::BIGINT AS raw_x100, round(100 * final)::BIGINT AS final_x100, {_LETTER.format('final')} AS letter, CASE WHEN raw > cap THEN cap ELSE 0 END::INT AS cap FROM fa")
def access_score(spark, sf_dir):
    s, v, r = audited(spark, sf_dir, ACCESS)
    out = scoring.scores(s, r, scoring.caps(v, site_blanket(s))).where("category = 'access'")
    cap = F.when(F.col("cap_applied").isNotNull(), F.col("final").cast("int")).otherwise(0)
    return out.select("domain", F.round(100 * F.col("raw")).cast("long").alias("raw_x100"), F.round(100 * F.col("final")).cast("long").alias("final_x100"), "letter", cap.alias("cap"))


_READABILITY = f"""{_SITES},{_FEATURES},
rd AS (SELECT s.domain, count(x.page_id) AS n, sum(4 * raw_score) AS raw4, count(*) FILTER (WHERE has AND recognised > 0) AS jl, sum(CASE WHEN h1 = 0 THEN 0 ELSE CASE WHEN h1 = 1 THEN 6 ELSE 0 END + CASE WHEN jumps = 0 THEN 4 ELSE 0 END END) AS hd,
              sum(CASE WHEN title = '' THEN 0 WHEN length(title) BETWEEN 10 AND 70 THEN 2 ELSE 1 END) AS t2, sum(CASE WHEN descr = '' THEN 0 WHEN length(descr) BETWEEN 50 AND 160 THEN 2 ELSE 1 END) AS d2,
              count(nullif(title, '')) > 0 AND count(DISTINCT nullif(title, '')) = count(nullif(title, '')) AS uni, count(*) FILTER (WHERE has AND author) + count(*) FILTER (WHERE has AND dated) AS ad, count(*) FILTER (WHERE has AND canonical = 'own') AS ca
       FROM s LEFT JOIN (SELECT * FROM sc WHERE status = 200) x ON x.domain = s.domain GROUP BY s.domain)"""


@query(f"""WITH {_READABILITY} SELECT domain, u.check_id, CASE WHEN n = 0 THEN 0 ELSE round(1000000 * u.ratio) END::BIGINT AS millionths FROM (SELECT domain, n, unnest([
 {{'check_id': 'raw_html_content', 'ratio': raw4 / (4.0 * n)}}, {{'check_id': 'jsonld_valid', 'ratio': jl / (1.0 * n)}}, {{'check_id': 'heading_structure', 'ratio': hd / (10.0 * n)}},
 {{'check_id': 'title_and_description', 'ratio': 0.5 * t2 / (2.0 * n) + 0.3 * d2 / (2.0 * n) + CASE WHEN uni THEN 0.2 ELSE 0 END}}, {{'check_id': 'author_and_dates', 'ratio': ad / (2.0 * n)}}, {{'check_id': 'canonical', 'ratio': ca / (1.0 * n)}}]) AS u FROM rd)""")
def readability_checks(spark, sf_dir):
    named = ("raw_html_content", "jsonld_valid", "heading_structure", "title_and_description", "author_and_dates", "canonical")
    return audited(spark, sf_dir, named)[2].select("domain", "check_id", F.round(1_000_000 * F.col("ratio")).cast("long").alias("millionths"))


def _words(x: str) -> str:
    return rf"len(list_filter(string_split_regex(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+'), lambda w: w <> ''))"


#: words of the blocks of each page (a: of the largest section, t: of all), read by patterns: lists before the article, what the article
#: holds beside its headings, and the snippet, of which the one without a heading belongs to the article's section
_BLOCKS = rf"""
b0 AS (SELECT page_id, contains(html, '</article>') AS has, regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs') AS clean FROM pages),
b1 AS (SELECT page_id, has, array_to_string(regexp_extract_all(clean, '<ul>(.*?)</ul>', 1, 's'), ' ') AS lists, regexp_replace(split_part(regexp_extract(clean, '<article>(.*)', 1, 's'), '</article>', 1), '<h[1-6][^>]*>.*?</h[1-6]>', ' ', 'gs') AS art FROM b0),
b2 AS (SELECT page_id, {_words('lists')} AS lists, {_words('art')} + CASE WHEN has AND NOT regexp_matches(art, '</p>\s*$') THEN w.held + CASE WHEN page_id % {len(B.MARKS)} = 4 AND k < 7 THEN 1 ELSE 0 END ELSE 0 END AS art, CASE WHEN has THEN w.blocks ELSE 0 END AS blocks, k
       FROM b1 JOIN {B.values([(i, *w) for i, w in enumerate(B.SNIPPET_WORDS)], 'w', 'k, blocks, held')} ON w.k = page_id % {len(B.SNIPPET_WORDS)}),
bw AS (SELECT page_id, greatest(lists, art + CASE WHEN k = 10 THEN blocks ELSE 0 END)::DOUBLE AS a, (lists + art + blocks)::DOUBLE AS t FROM b2)"""
_ANSWERS = f"""{_BLOCKS},
an_ AS (SELECT domain, avg(CASE WHEN t < {K.WORDS_TO_JUDGE} OR a <= {K.WELL_SECTIONED} * t THEN 1 WHEN a >= {K.ONE_BLOCK} * t THEN 0 ELSE ({K.ONE_BLOCK} - a / t) / ({K.ONE_BLOCK} - {K.WELL_SECTIONED}) END) AS citable,
        {' + '.join(f"bool_or(has AND substr(shapes, {k + 1}, 1) = '1')::INT" for k in range(len(checks.SHAPES)))} AS found FROM p JOIN bw USING (page_id) WHERE status = 200 GROUP BY domain),
aw AS (SELECT s.domain, coalesce(CASE WHEN found >= {K.SHAPES_WANTED} AND citable = 1 THEN 1 ELSE {K.SHAPE_SHARE} * least(found, {K.SHAPES_WANTED}) / {K.SHAPES_WANTED} + {K.CITABLE_SHARE} * citable END, 0) AS answers FROM s LEFT JOIN an_ USING (domain))"""


@query(f"WITH {_SITES},{_ANSWERS} SELECT domain, round(1000000 * answers)::BIGINT AS millionths FROM aw")
def answer_shaped_check(spark, sf_dir):
    return audited(spark, sf_dir, ("answer_shaped_content",))[2].select("domain", F.round(1_000_000 * F.col("ratio")).cast("long").alias("millionths"))


_READABLE = f"""{_READABILITY},{_ANSWERS},
rs AS (SELECT rd.domain, round_even(round(CASE WHEN n = 0 THEN 0 ELSE 30 * raw4 / (4.0 * n) + 20.0 * jl / n + 15 * hd / (10.0 * n) + 10 * (0.5 * t2 / (2.0 * n) + 0.3 * d2 / (2.0 * n) + CASE WHEN uni THEN 0.2 ELSE 0 END) + 10 * ad / (2.0 * n) + 5.0 * ca / n + 5 * answers END
       + CASE WHEN length(trim(coalesce(s.llms, ''), chr(10) || ' ')) >= {K.LLMS_CHARS} THEN 5 ELSE 0 END, 9), 2)::DOUBLE AS raw FROM rd JOIN aw USING (domain) JOIN s USING (domain))"""


@query(f"WITH {_READABLE} SELECT domain, raw, {_LETTER.format('raw')} AS letter FROM rs")
def readability_score(spark, sf_dir):
    return site_scores(spark, sf_dir)[4].where("category = 'readability'").select("domain", "raw", "letter")


@query(f"WITH {_READABLE} SELECT {_LETTER.format('raw')} AS letter, count(*) AS sites FROM rs GROUP BY 1")
def readability_histogram(spark, sf_dir):
    return readability_score(spark, sf_dir).groupBy("letter").agg(F.count("*").alias("sites"))


@query(f"WITH {_SCORED} SELECT letter, count(*) AS sites FROM (SELECT {_LETTER.format('final')} AS letter FROM fa) GROUP BY letter")
def grade_histogram(spark, sf_dir):
    return access_score(spark, sf_dir).groupBy("letter").agg(F.count("*").alias("sites"))


@query(f"WITH {_SCORED} SELECT domain FROM fa WHERE final < 75")
def score_gate(spark, sf_dir):
    s = access_score(spark, sf_dir).withColumn("final", F.col("final_x100") / 100)
    return scoring.below(s, "75").select("domain")


@query(f"""WITH {_SITE_VERDICTS} SELECT domain, count(*) FILTER (WHERE ai_only AND NOT allowed) AS ai_only_blocked, bool_and(NOT allowed) FILTER (WHERE ai_only) AND bool_and(allowed) FILTER (WHERE token IN ('Googlebot', 'Bingbot')) AS ai_blackout,
 NOT bool_and(allowed) FILTER (WHERE token = 'OAI-SearchBot') AS blocks_oai_searchbot, NOT bool_and(allowed) FILTER (WHERE token = 'GPTBot') AS blocks_gptbot FROM sv GROUP BY domain""")
def ai_blackout(spark, sf_dir):
    return study.crawler_facts(site_verdicts(B.sites(spark, sf_dir))).drop("training_posture")


# ---- reports ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ACCESS}, cost AS (SELECT domain, unnest([{{'i': 'citation_crawlers_allowed', 'p': 0, 'c': 50 * (1 - 1.0 * ca / ct)}}, {{'i': 'user_fetch_crawlers_allowed', 'p': 1, 'c': 20 * (1 - 1.0 * ur / ut)}},
 {{'i': 'pages_reachable', 'p': 2, 'c': 15 * (1 - 1.0 * open / n)}}, {{'i': 'sitemap_available', 'p': 3, 'c': CASE WHEN reachable IS NULL THEN 10 ELSE 0 END}}, {{'i': 'no_noindex', 'p': 4, 'c': 5 * (1 - 1.0 * clean / n)}}]) AS x
 FROM s JOIN cf USING (domain) JOIN pa USING (domain))
SELECT domain, rank, check_id, round(1000 * cost)::BIGINT AS cost_x1000 FROM (SELECT domain, x.i AS check_id, x.c AS cost, row_number() OVER (PARTITION BY domain ORDER BY x.c DESC, x.p)::INT AS rank FROM cost WHERE x.c > 0) WHERE rank <= 5""")
def top_fixes(spark, sf_dir):
    s, _, r = audited(spark, sf_dir, ACCESS)
    rows = r.join(F.broadcast(scoring.rubric(spark).select("check_id", "pos", "weight")), "check_id")
    return report.top_fixes(rows).select("domain", "rank", "check_id", F.round(1000 * F.col("cost")).cast("long").alias("cost_x1000"))


@query(f"""WITH {_SITE_VERDICTS}, t AS (SELECT domain, string_agg('User-agent: ' || token || chr(10) || 'Allow: /', chr(10) || chr(10) ORDER BY pos) AS lines
 FROM sv WHERE NOT allowed AND (bucket = 'citation' OR (bucket = 'user_fetch' AND obeys = 'yes')) GROUP BY domain)
SELECT s.domain, concat_ws(chr(10) || chr(10), t.lines, CASE WHEN s.reachable IS NOT NULL AND s.declared IS NULL THEN 'Sitemap: ' || s.reachable END) AS additions FROM s LEFT JOIN t ON t.domain = s.domain""")
def robots_additions(spark, sf_dir):
    return report.additions(audited(spark, sf_dir, ACCESS)[2])


@query()
def payload_json(spark, sf_dir):
    s, p, v, r, scores = site_scores(spark, sf_dir)
    said = s.select("domain", "robots_id").join(B.site_bodies(s), "robots_id").select("domain", "body")
    made = report.payload(s, report.check_rows(s, r), scores, v, p, report.additions(r), declared=said)
    return made.select("domain", "n_checks", F.regexp_replace("payload", '"generated_at":"[^"]*"', '"generated_at":""').alias("payload"))


_TITLES = "|".join(K.CHECK_TITLES.values())


@query(f"""WITH {_SCORED}, tr AS (SELECT domain, count(*) FILTER (WHERE allowed) AS allowed, CASE WHEN bool_and(allowed) THEN 'open' WHEN NOT bool_or(allowed) THEN 'closed' ELSE 'partial' END AS state FROM sv WHERE bucket = 'training' GROUP BY domain),
said AS (SELECT s.domain, regexp_matches(r.body, '(?im)^\\s*content-signal\\s*:') AS signals FROM s JOIN ({f"WITH {B.SQL_BODIES} SELECT * FROM r"}) r ON r.robots_id = s.robots_id)
SELECT s.domain, 13 AS n_checks, round(100 * fa.final)::INT AS access_x100, tr.state, tr.allowed::INT AS training_allowed, (SELECT count(*) FROM p WHERE p.domain = s.domain)::INT AS pages, sh.blanket, coalesce(s.declared, '') AS declared, length(coalesce(s.llms, ''))::INT AS llms_length,
 coalesce(said.signals, FALSE) AS signals, '{_TITLES}' AS titles, CASE WHEN cf.ca < cf.ct THEN '{K.CHECK_DOCS["citation_crawlers_allowed"]}' ELSE '' END AS citation_docs, cf.ct::INT AS citation_total, '{K.AGENTS[0][0]}' AS first_crawler
FROM s JOIN fa USING (domain) JOIN tr USING (domain) JOIN cf USING (domain) JOIN sh ON sh.robots_id = s.robots_id JOIN said USING (domain)""")
def payload_fields(spark, sf_dir):
    """What the JSON of a payload says, read back from it."""
    p = payload_json(spark, sf_dir).cache()
    at = lambda path: F.get_json_object("payload", f"$.{path}")
    text_ = lambda path: F.coalesce(at(path), F.lit(""))
    titles = F.array_join(F.from_json(at("checks[*].title"), "array<string>"), "|")
    return p.select(
        "domain", "n_checks", F.round(100 * at("scores.access.score").cast("double")).cast("int").alias("access_x100"), at("training_posture.state").alias("state"), at("training_posture.allowed").cast("int").alias("training_allowed"), at("run.pages_sampled").cast("int").alias("pages"),
        at("robots.blanket_disallow").cast("boolean").alias("blanket"), text_("sitemap.declared").alias("declared"), at("llms_txt.length").cast("int").alias("llms_length"), at("content_signals.raw").isNotNull().alias("signals"), titles.alias("titles"),
        text_("checks[0].fix.docs_url").alias("citation_docs"), at("crawlers.citation.total").cast("int").alias("citation_total"), at("crawlers.citation.agents[0].token").alias("first_crawler"),
    )


@query(f"""SELECT bucket, count(*)::INT AS crawlers, string_agg('`' || token || '`', ' ' ORDER BY lower(token)) AS tokens FROM (SELECT * FROM {_AGENTS}) GROUP BY bucket""")
def crawler_documents(spark, sf_dir):
    """The tables of crawlers, with the names read back from them."""
    made = report.crawler_table(robots.agents(spark))
    names = F.regexp_extract_all("document", F.lit("(?m)^\\| (`[^`]+`)"), F.lit(1))
    return made.select("bucket", F.regexp_extract("document", "^([0-9]+) crawlers", 1).cast("int").alias("crawlers"), F.array_join(names, " ").alias("tokens"))


@query()
def markdown_reports(spark, sf_dir):
    return payload_json(spark, sf_dir).select("domain", report.render_markdown("payload").alias("report"), report.render_terminal("payload").alias("summary"))


# ---- studies ------------------------------------------------------------------------------------------------------------


def site_rows(spark, sf_dir) -> DataFrame:
    s, p, v, r, scores = site_scores(spark, sf_dir)
    platforms = p.groupBy("domain").agg(F.min_by("platform", "pos").alias("platform"))
    return study.measure(s, v, r, scores, platforms, s.where("aborted IS NOT NULL").select("domain", F.col("aborted").alias("reason")))


_STUDY = f"""{_SCORED},
st AS (SELECT domain, count(*) FILTER (WHERE ai_only AND NOT allowed) AS blocked, bool_and(NOT allowed) FILTER (WHERE ai_only) AND bool_and(allowed) FILTER (WHERE token IN ('Googlebot', 'Bingbot')) AS dark,
              bool_and(allowed) FILTER (WHERE token = 'OAI-SearchBot') AS oai, bool_and(allowed) FILTER (WHERE token = 'GPTBot') AS gpt,
              CASE WHEN bool_and(allowed) FILTER (WHERE bucket = 'training') THEN 'open' WHEN NOT bool_or(allowed) FILTER (WHERE bucket = 'training') THEN 'closed' ELSE 'partial' END AS posture FROM sv GROUP BY domain),
rows_ AS (SELECT s.*, fa.final, st.blocked, st.dark, st.oai, st.gpt, st.posture, p.platform FROM s JOIN fa USING (domain) JOIN st USING (domain) JOIN p ON p.page_id = s.least)"""


@query(f"""WITH {_STUDY}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE blocked > 0) AS a, count(*) FILTER (WHERE dark) AS b, count(*) FILTER (WHERE NOT gpt AND oai) AS c, count(*) FILTER (WHERE NOT gpt AND NOT oai) AS d,
 count(*) FILTER (WHERE trim(coalesce(llms, '')) <> '') AS e, count(*) FILTER (WHERE reachable IS NOT NULL) AS f, count(*) FILTER (WHERE NOT robots_real) AS g FROM rows_ WHERE aborted IS NULL)
SELECT u.metric, u.c AS count, CASE WHEN n = 0 THEN 0 ELSE round_even(100.0 * u.c / n, 1) END::DOUBLE AS share FROM (SELECT n, unnest([{{'metric': 'blocks_any_ai_only', 'c': a}}, {{'metric': 'ai_blackout', 'c': b}}, {{'metric': 'blocked_training_only', 'c': c}},
 {{'metric': 'blocked_training_and_search', 'c': d}}, {{'metric': 'llms_txt', 'c': e}}, {{'metric': 'sitemap', 'c': f}}, {{'metric': 'no_robots_txt', 'c': g}}]) AS u FROM t)""")
def study_headline(spark, sf_dir):
    named = ["blocks_any_ai_only", "ai_blackout", "blocked_training_only", "blocked_training_and_search", "llms_txt", "sitemap", "no_robots_txt"]
    return study.headline(site_rows(spark, sf_dir)).where(F.col("metric").isin(named))


_MEDIAN = "(array_agg({0} ORDER BY {0}) FILTER (WHERE aborted IS NULL))[count(*) FILTER (WHERE aborted IS NULL) // 2 + 1]"


@query(f"""WITH {_STUDY} SELECT coalesce(category, 'unknown') AS category, count(*) AS domains, count(*) FILTER (WHERE aborted IS NULL) AS scored, count(aborted) AS aborted, round_even(100.0 * count(aborted) / count(*), 1)::DOUBLE AS abort_share,
 CASE WHEN count(*) = count(aborted) THEN 0 ELSE round_even(100.0 * count(*) FILTER (WHERE aborted IS NULL AND blocked > 0) / count(*) FILTER (WHERE aborted IS NULL), 1) END::DOUBLE AS blocks_any_ai_only, {_MEDIAN.format('final')}::DOUBLE AS median_access FROM rows_ GROUP BY ALL""")
def study_by_category(spark, sf_dir):
    categories = B.sites(spark, sf_dir).where("category IS NOT NULL").select("domain", "category")
    return study.by_category(site_rows(spark, sf_dir), categories).select("category", "domains", "scored", "aborted", "abort_share", "blocks_any_ai_only", "median_access")


@query(f"WITH {_STUDY} SELECT platform, count(*) AS sites, {_MEDIAN.format('final')}::DOUBLE AS median_access FROM rows_ WHERE aborted IS NULL GROUP BY platform")
def study_by_platform(spark, sf_dir):
    return study.by_platform(site_rows(spark, sf_dir)).select("platform", "sites", "median_access")


@query(f"WITH {_STUDY} SELECT posture AS training_posture, count(*) AS n FROM rows_ WHERE aborted IS NULL GROUP BY posture")
def posture_histogram(spark, sf_dir):
    return study.histogram(site_rows(spark, sf_dir), "training_posture")


@query(f"WITH {_STUDY} SELECT domain, CASE WHEN aborted IS NULL THEN 'scored' ELSE 'aborted' END AS outcome, CASE WHEN aborted IS NULL THEN final ELSE -1 END::DOUBLE AS access, row_number() OVER (ORDER BY domain)::INT AS place FROM rows_")
def study_rows(spark, sf_dir):
    """The rows of a study as they are written, in order."""
    rows = study.in_order(site_rows(spark, sf_dir).select("domain", "outcome", F.coalesce("access", F.lit(-1.0)).alias("access")))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("domain")))


@query(f"WITH {_SITES} SELECT CASE WHEN aborted IS NOT NULL THEN 'aborted' ELSE 'no_robots' END AS outcome, count(*) AS n FROM s WHERE aborted IS NOT NULL OR NOT robots_real GROUP BY 1")
def accuracy_skipped(spark, sf_dir):
    s = B.sites(spark, sf_dir)
    return accuracy.skipped(accuracy.outcomes(s.where("aborted IS NULL"), s.where("aborted IS NOT NULL")))


@query(f"WITH {_SITES} SELECT split_part(aborted, ':', 1) AS reason, count(*) AS n FROM s WHERE aborted IS NOT NULL GROUP BY 1")
def abort_reasons(spark, sf_dir):
    s = B.sites(spark, sf_dir).where("aborted IS NOT NULL").select("domain", F.col("aborted").alias("reason"), F.lit("aborted").alias("outcome"))
    return study.abort_reasons(s)


@query(f"WITH {_SITES} SELECT domain, coalesce(TRY_CAST(regexp_extract(aborted, '(?:^|\\s)([0-9]+)(?:\\s|$)', 1) AS INT), -1) AS status, aborted = 'HTTP 403' AS refused FROM s WHERE aborted IS NOT NULL")
def abort_notes(spark, sf_dir):
    s = B.sites(spark, sf_dir).where("aborted IS NOT NULL")
    return s.select("domain", F.coalesce(urls.status_in(F.col("aborted")), F.lit(-1)).alias("status"), F.contains(urls.abort_note(F.col("aborted")), F.lit("refuses")).alias("refused"))


@query(f"WITH {_SITES}, t AS (SELECT CASE WHEN robots_real AND llms IS NULL AND reachable IS NULL THEN 'crashed' WHEN aborted IS NULL THEN 'scored' ELSE 'aborted' END AS outcome FROM s) SELECT outcome, count(*) AS n, (SELECT round_even(100.0 * count(*) FILTER (WHERE outcome <> 'crashed') / count(*), 1) FROM t)::DOUBLE AS completed_share FROM t GROUP BY outcome")
def robustness_report(spark, sf_dir):
    """Sites with a robots.txt but neither sitemap nor llms.txt are taken as crashed."""
    s = B.sites(spark, sf_dir)
    odd = F.col("robots_real") & F.col("llms").isNull() & F.col("reachable").isNull()
    return study.robustness(s.select("domain", F.when(odd, "crashed: x").when(F.col("aborted").isNull(), "scored").otherwise(F.concat(F.lit("aborted: "), "aborted")).alias("outcome")))


@query(f"""WITH {_SITES}, x AS (SELECT domain FROM s WHERE declared IS NOT NULL OR llms IS NULL), y AS (SELECT domain FROM s WHERE aborted IS NULL AND (reachable IS NOT NULL OR llms IS NOT NULL))
SELECT domain, 'uncategorised' AS side FROM x WHERE domain NOT IN (SELECT domain FROM s WHERE category IS NOT NULL) UNION ALL SELECT domain, 'stale' FROM y WHERE domain NOT IN (SELECT domain FROM x) UNION ALL SELECT domain, 'missing' FROM x WHERE domain NOT IN (SELECT domain FROM y)""")
def coverage_anti_join(spark, sf_dir):
    """The list: sites that declare a sitemap or have no llms.txt; recorded: those not aborted that have one or the other."""
    s = B.sites(spark, sf_dir)
    listed = s.where("declared IS NOT NULL OR llms IS NULL").select("domain")
    recorded = s.where("aborted IS NULL AND (reachable IS NOT NULL OR llms IS NOT NULL)").select("domain")
    return study.coverage(listed, s.where("category IS NOT NULL").select("domain"), recorded)


# ---- accuracy and manifests ---------------------------------------------------------------------------------------------


@query()
def accuracy_agreement(spark, sf_dir):
    return accuracy.agreement(accuracy.compare(B.bodies(spark, sf_dir)))


@query(f"WITH {_VERDICTS} SELECT v.robots_id, v.token, v.allowed AS literal FROM v JOIN r USING (robots_id) WHERE r.body IS NOT NULL")
def literal_verdicts(spark, sf_dir):
    return accuracy.compare(B.bodies(spark, sf_dir)).select("robots_id", "token", "literal")


@query(f"WITH {_VERDICTS} SELECT DISTINCT robots_id FROM v WHERE bucket <> 'training' AND NOT allowed")
def worth_reading(spark, sf_dir):
    return accuracy.worth_reading(accuracy.compare(B.bodies(spark, sf_dir)))


@query("SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, page_id, sha256(html) AS sha256, strlen(html)::INT AS bytes FROM pages")
def manifest_fingerprint(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sha, size = manifest.digest(F.col("html"))
    return p.select(urls.authority(F.col("url")).alias("domain"), "page_id", sha.alias("sha256"), size.alias("bytes"))


@query(f"""SELECT domain, CASE WHEN robots_real THEN '200' ELSE '404' END AS robots_status, CASE WHEN robots_real THEN sha256(body) ELSE '' END AS robots_sha256, CASE WHEN robots_real THEN strlen(body)::VARCHAR ELSE '' END AS robots_bytes
FROM (WITH {_SITES},{B.SQL_BODIES} SELECT s.domain, s.robots_real, r.body FROM s JOIN r USING (robots_id))""")
def robots_manifest(spark, sf_dir):
    s = B.sites(spark, sf_dir)
    s = s.join(B.site_bodies(s), "robots_id")
    own = s.select("domain", F.lit(1).alias("pos"), F.concat("base_url", F.lit("/robots.txt")).alias("url"), F.col("robots_status").alias("status"), F.lit(None).cast("string").alias("error"), F.col("body").alias("text"), F.lit("2024-01-01T00:00:00").alias("fetched_at"), F.lit("scored").alias("outcome"))
    home = own.withColumns({"pos": F.lit(0), "url": F.regexp_replace("url", "robots.txt$", ""), "text": F.lit("home")})
    return manifest.manifest(own.unionByName(home)).select("domain", "robots_status", "robots_sha256", "robots_bytes")


@query(f"SELECT page_id || '.' || domain AS domain, CASE WHEN status IS NULL OR status <> 200 THEN 'UNREACHABLE' WHEN recorded = live THEN 'MATCH' ELSE 'CHANGED' END AS state FROM {B.sql_each([x[1:] for x in B.SNAPSHOTS], 'recorded, status, live', 'recorded', 'status', 'live')}")
def manifest_diff(spark, sf_dir):
    df = B.each(spark, sf_dir, [x[1:] for x in B.SNAPSHOTS], "recorded string, status int, live string").withColumn("domain", F.concat(F.col("page_id").cast("string"), F.lit("."), "domain"))
    return manifest.difference(df.select("domain", F.sha2("recorded", 256).alias("robots_sha256")), df.select("domain", "status", F.col("live").alias("text")))


# ---- streaming ----------------------------------------------------------------------------------------------------------


@query(f"WITH {B.SQL_PAGES.replace('s.added || m.mark ||', '')},{_FEATURES} SELECT page_id, text_chars::INT AS text_chars, script_chars::INT AS script_chars, title FROM sc")
def stream_audit(spark, sf_dir):
    """The pages read as a stream, written by an exactly-once sink and read back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = audit.read_pages(spark, f"{sf_dir}/pages.parquet*")  # a pattern: one file or a folder of them
    audit.write_facts(stream, f"{base}/facts", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/facts").select("page_id", "text_chars", "script_chars", "title")
