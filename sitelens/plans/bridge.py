"""Recorded-looking inputs made from the table of pages by fixed rules, for both engines.

A site is the authority of a page's URL. What a crawl would add (status, headers, robots.txt, sitemaps, llms.txt, markup) is
chosen from the lists below by page_id, or by the least page_id of a site. The same lists become DataFrames here and VALUES in
the SQL of the oracle, so that neither engine's result rests on the other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import urls

BODIES = [
    None,
    "User-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow: /\nAllow: /open/\n",
    "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n",
    "User-agent: GPTBot\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private/\n",
    "User-agent: *\nDisallow:\nSitemap: https://a.example/sitemap.xml\n",
    "user-agent: gptbot\ndisallow: /\n",
    "# all\nUser-agent: * # everyone\nDisallow: /tmp/ # scratch\n# end\n",
    "User-agent: *\nDisallow: /*.pdf$\nDisallow: /search?*\n",
    "User-agent: *\nDisallow: /\nAllow: /\n",
    "User-agent: bot\nDisallow: /\n",
    "User-agent: Fetch\nDisallow: /\n",
    "User-agent: Google\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /\n",
    "User-agent: CCBot\nDisallow: /\n\nUser-agent: CCBot\nAllow: /\n",
    "User-agent: CCBot\nCrawl-delay: 1\n\nUser-agent: Other\nDisallow: /\n",
    "User-agent: OAI-SearchBot\nDisallow: /\nUser-agent: Claude-SearchBot\nUser-agent: PerplexityBot\nDisallow: /\nDisallow: /a\nDisallow: /b\nDisallow: /c\n",
    "Disallow: /early\nUser-agent:\nDisallow: /\n\nUser-agent: *\nAllow: /\n",
    "User-agent: Perplexity-User\nUser-agent: Claude-User\nDisallow: /\nContent-Signal: search=yes, ai-train=no\n",
    "User-agent: *\r\nDisallow: /*$\r\nSitemap: https://b.example/map.xml\r\nContent-Signal: ai-input=no,colour=blue,search=yes\r\nContent-signal: search=no\r\n",
]

#: html to add to an article and what it holds: JSON-LD types, how many are recognised, broken blocks, author, date, canonical,
#: heading levels, shapes (steps, table, faq, definitions, quote, summary), description, noindex
SNIPPETS = [
    ("", "", 0, 0, False, False, "", "", "000000", "", False),
    ('<script type="application/ld+json">{"@type":"NewsArticle","author":{"name":"A"},"datePublished":"2024-01-01"}</script>', "newsarticle", 1, 0, True, True, "", "", "000000", "", False),
    ('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Organization","Thing"]}]}</script>', "webpage,organization,thing", 2, 0, False, False, "", "", "000000", "", False),
    ('<script type="application/ld+json">{"@type":"Widget"}</script><script type="application/ld+json">{"@type":</script>', "widget", 0, 1, False, False, "", "", "000000", "", False),
    ('<meta name="author" content="A"><meta property="article:published_time" content="2024-01-01"><meta name="description" content="A description that is long enough to count in full for the check.">', "", 0, 0, True, True, "", "", "000000", "A description that is long enough to count in full for the check.", False),
    ('<link rel="canonical" href="/x"><meta name="description" content="Too short">', "", 0, 0, False, False, "own", "", "000000", "Too short", False),
    ('<link rel="canonical" href="https://other.example/x">', "", 0, 0, False, False, "other", "", "000000", "", False),
    ("<h2>Quick summary</h2><p>one two three</p><h3>b</h3><p>four</p>", "", 0, 0, False, False, "", "23", "000001", "", False),
    ("<h3>Skipped</h3><ol><li>a</li><li>b</li><li>c</li></ol>", "", 0, 0, False, False, "", "3", "100000", "", False),
    ("<h1>Again</h1><table><tr><th>a</th></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>", "", 0, 0, False, False, "", "1", "010000", "", False),
    ('<dl><dt>a</dt><dd>b</dd></dl><blockquote>c <cite>d</cite></blockquote><time datetime="2024-01-01">e</time><span class="byline">f</span>', "", 0, 0, True, True, "", "", "000110", "", False),
    ('<meta name="robots" content="noindex, follow"><h2>What?</h2><p>This.</p><h2>Why?</h2><p>That.</p>', "", 0, 0, False, False, "", "22", "001000", "", True),
]
#: words of a snippet in blocks of its own, and in scripts that an unclosed paragraph before it would hold
SNIPPET_WORDS = [(0, 0), (0, 1), (0, 1), (0, 2), (0, 0), (0, 0), (0, 0), (4, 0), (3, 0), (3, 0), (4, 0), (2, 0)]
X_ROBOTS = {5: "googlebot: noindex, nofollow", 6: "max-image-preview:large"}
LLMS = [None, "soon", "# Site\n" + "- [page](https://a.example/page): what it says\n" * 4]
SITEMAP_KINDS = 4
CATEGORY_LIST = ["news", "blog", "saas", "reference", "platform"]
ABORTS = ["HTTP 403", "HTTP 500: server error", "timeout", "network: refused"]

#: id, status, content type, body
RESPONSES = [
    (0, 200, "text/plain", "User-agent: *\nDisallow: /a\n"),
    (1, 200, "text/html", "<!DOCTYPE html><html><body>User-agent: *</body></html>"),
    (2, 200, "text/plain", "just some words\n"),
    (3, 200, "text/html", "Sitemap: https://a.example/sitemap.xml\n"),
    (4, 200, "text/plain", "<html><head></head></html>"),
    (5, 404, "text/plain", "User-agent: *\nDisallow: /\n"),
    (6, 503, "text/plain", ""),
    (7, 200, "text/plain", "  allow : /x\n"),
]
#: id, xml, and what it lists: (kind, url) in order
SITEMAPS = [
    (0, "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>https://a.example/1</loc></url><url><loc> https://a.example/2.pdf </loc></url><url><loc>https://a.example/3?a=1&amp;b=2</loc></url></urlset>", [("page", "https://a.example/1"), ("page", "https://a.example/2.pdf"), ("page", "https://a.example/3?a=1&b=2")]),
    (1, "<sitemapindex><sitemap><loc>https://a.example/m1.xml</loc></sitemap><sitemap><loc>https://a.example/m2.xml</loc></sitemap></sitemapindex>", [("nested", "https://a.example/m1.xml"), ("nested", "https://a.example/m2.xml")]),
    (2, "<urlset><url><loc>https://b.example/1</loc></url><url><loc>https://b.example/2</lo", [("page", "https://b.example/1"), ("page", "https://b.example/2")]),
    (3, "", []),
    (4, "no xml at all", []),
    (5, "<ns:urlset><ns:url><ns:loc><![CDATA[https://c.example/x]]></ns:loc><image:image><image:loc>https://c.example/i.png</image:loc></image:image></ns:url></ns:urlset>", [("page", "https://c.example/x"), ("page", "https://c.example/i.png")]),
]
#: id, html, words of the largest section and of all
SECTIONS = [
    (0, "<h1>t</h1><p>" + "w " * 800 + "</p>", 800, 800),
    (1, "<h1>t</h1>" + "".join(f"<h2>s{k}</h2><p>" + "w " * 120 + "</p>" for k in range(6)), 120, 720),
    (2, "<h1>t</h1><p>" + "w " * 50 + "</p>", 50, 50),
    (3, "<p>" + "w " * 150 + "</p><h2>s</h2><ul><li>" + "w " * 100 + "</li></ul><h2>s</h2><p>" + "w " * 50 + "</p>", 150, 300),
    (4, "<blockquote><p>" + "w " * 100 + "</p></blockquote><h2>s</h2><p>" + "w " * 100 + "</p>", 200, 300),
]
#: id, html of a home page, what published it
PLATFORMS = [
    (0, '<meta name="generator" content="WordPress 6.4"><p>x</p>', "WordPress"),
    (1, '<meta name="Generator" content="Hugo 0.1"><link href="/wp-content/a.css">', "Hugo"),
    (2, '<link href="/wp-includes/a.css"><script src="https://cdn.shopify.com/x.js"></script>', "WordPress"),
    (3, '<script src="https://cdn.shopify.com/x.js"></script>', "Shopify"),
    (4, '<script id="__NEXT_DATA__">{}</script>', "Next.js"),
    (5, "<p>hand made</p>", "custom or unidentified"),
    (6, None, "unknown"),
    (7, "<script>var  prestashop = {}</script>", "PrestaShop"),
]
#: html to add to a page and what it says about what published it
MARKS = [
    ("", "custom or unidentified"),
    ('<meta name="generator" content="Hugo 0.1">', "Hugo"),
    ('<link rel="x" href="/wp-includes/a.css">', "WordPress"),
    ('<script src="https://cdn.shopify.com/x.js"></script>', "Shopify"),
    ('<script id="__NEXT_DATA__">{}</script>', "Next.js"),
]
#: domain, recorded body, live status, live body
SNAPSHOTS = [("a.example", "User-agent: *\n", 200, "User-agent: *\n"), ("b.example", "User-agent: *\n", 200, "User-agent: x\n"), ("c.example", "User-agent: *\n", 503, ""), ("d.example", "", 200, ""), ("e.example", "x", None, None)]


_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], name: str, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS {name}({columns})"


def pick(values_: list, index) -> object:
    """Element `index` of a fixed list as a column."""
    return F.get(F.array(*[F.lit(v) for v in values_]), index.cast("int"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, pos, url, status, headers, html of every page."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id")
    added = F.concat(pick([s[0] for s in SNIPPETS], k % len(SNIPPETS)), pick([m[0] for m in MARKS], k % len(MARKS)), F.lit("</article>"))
    login = F.concat(urls.origin(F.col("url")), F.lit("/login?next=1"))
    header = F.when(k % 13 == 5, X_ROBOTS[5]).when(k % 13 == 6, X_ROBOTS[6])
    headers = F.when(header.isNull(), F.create_map(F.lit("server"), F.lit("x"))).otherwise(F.create_map(F.lit("x-robots-tag"), header))
    return raw.select(
        urls.authority(F.col("url")).alias("domain"), k.alias("pos"), F.when(k % 17 == 3, login).otherwise(F.col("url")).alias("url"),
        F.when(k % 23 == 7, 404).otherwise(200).alias("status"), headers.alias("headers"), F.replace("html", F.lit("</article>"), added).alias("html"),
    )


def each(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: str) -> DataFrame:
    """page_id, domain and one of the fixed rows for every page, in turn."""
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {columns}")
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.authority(F.col("url")).alias("domain"))
    return raw.join(F.broadcast(fixed), F.col("page_id") % len(rows) == F.col("k")).drop("k")


def sql_each(rows: list[tuple], columns: str, *picked: str) -> str:
    """The same in SQL: a relation of page_id, domain and what is picked of the fixed rows."""
    return f"""(SELECT q.page_id, regexp_extract(q.url, '{_AUTHORITY}', 1) AS domain, {', '.join(picked)} FROM pages q JOIN {values([(i, *r) for i, r in enumerate(rows)], 't', 'k, ' + columns)} ON q.page_id % {len(rows)} = t.k)"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots_id, body: one for every page, each with a rule of its own."""
    own = F.concat("body", F.lit("Disallow: /"), F.col("page_id").cast("string"), F.lit("/\n"))
    return each(spark, sf_dir, [(b,) for b in BODIES], "body string").select(F.col("page_id").alias("robots_id"), own.alias("body"))


def site_bodies(sites_: DataFrame) -> DataFrame:
    """The bodies of the sites, which are those of their first pages."""
    m = F.col("robots_id")
    return sites_.select("robots_id", F.concat(pick(BODIES, m % len(BODIES)), F.lit("Disallow: /"), m.cast("string"), F.lit("/\n")).alias("body"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, least, base_url, robots_id, robots_status, robots_real, declared, reachable, llms, category, aborted reason."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    per = raw.groupBy(urls.authority(F.col("url")).alias("domain")).agg(F.min("page_id").alias("least"))
    m, base = F.col("least"), F.concat(F.lit("https://"), "domain")
    kind = m % SITEMAP_KINDS
    return per.select(
        "domain", "least", base.alias("base_url"), m.alias("robots_id"), F.when(m % len(BODIES) == 0, 404).otherwise(200).alias("robots_status"), (m % len(BODIES) != 0).alias("robots_real"),
        F.when(kind.isin(0, 2), F.concat(base, F.lit("/map.xml"))).alias("declared"), F.when(kind == 0, F.concat(base, F.lit("/map.xml"))).when(kind == 1, F.concat(base, F.lit("/sitemap.xml"))).alias("reachable"),
        pick(LLMS, m % len(LLMS)).alias("llms"), F.when(m % 7 != 6, pick(CATEGORY_LIST, m % len(CATEGORY_LIST))).alias("category"), F.when(m % 11 == 4, pick(ABORTS, m % len(ABORTS))).alias("aborted"),
    )


SQL_BODIES = f"""
r AS (SELECT page_id AS robots_id, body || 'Disallow: /' || page_id || '/' || chr(10) AS body FROM {sql_each([(b,) for b in BODIES], "body", "body")})"""
SQL_PAGES = f"""
p AS (SELECT q.page_id, regexp_extract(q.url, '{_AUTHORITY}', 1) AS domain, q.url AS url0,
             CASE WHEN q.page_id % 17 = 3 THEN regexp_extract(q.url, '{_AUTHORITY}', 0) || '/login?next=1' ELSE q.url END AS url,
             CASE WHEN q.page_id % 23 = 7 THEN 404 ELSE 200 END AS status,
             CASE q.page_id % 13 WHEN 5 THEN '{X_ROBOTS[5]}' WHEN 6 THEN '{X_ROBOTS[6]}' ELSE '' END AS x_robots,
             replace(q.html, '</article>', s.added || m.mark || '</article>') AS html, contains(q.html, '</article>') AS has, s.*, CASE WHEN contains(q.html, '</article>') THEN m.platform ELSE '{MARKS[0][1]}' END AS platform
      FROM pages q JOIN {values([(i, *m) for i, m in enumerate(MARKS)], "m", "k, mark, platform")} ON m.k = q.page_id % {len(MARKS)} JOIN {values([(i, *s) for i, s in enumerate(SNIPPETS)], "s", "k, added, types, recognised, broken, author, dated, canonical, levels, shapes, description, noindex")} ON s.k = q.page_id % {len(SNIPPETS)})"""
SQL_SITES = f"""
s AS (SELECT domain, least, 'https://' || domain AS base_url, least AS robots_id, least % {len(BODIES)} <> 0 AS robots_real,
             CASE WHEN least % 4 IN (0, 2) THEN 'https://' || domain || '/map.xml' END AS declared,
             CASE least % 4 WHEN 0 THEN 'https://' || domain || '/map.xml' WHEN 1 THEN 'https://' || domain || '/sitemap.xml' END AS reachable,
             l.llms, CASE WHEN least % 7 <> 6 THEN c.category END AS category, CASE WHEN least % 11 = 4 THEN a.reason END AS aborted
      FROM (SELECT domain, min(page_id) AS least FROM p GROUP BY domain) h
      JOIN {values(list(enumerate(LLMS)), "l", "k, llms")} ON l.k = least % {len(LLMS)}
      JOIN {values(list(enumerate(CATEGORY_LIST)), "c", "k, category")} ON c.k = least % {len(CATEGORY_LIST)}
      JOIN {values(list(enumerate(ABORTS)), "a", "k, reason")} ON a.k = least % {len(ABORTS)})"""
