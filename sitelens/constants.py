"""Fixed values of the audit: crawlers, rubric, vocabularies and thresholds.

FIXED VALUES. Results are only comparable if these are exactly so; nothing here is derived.
"""

from __future__ import annotations

#: token, vendor, bucket, obeys_robots, ai_only, documented
AGENTS = [
    ("OAI-SearchBot", "OpenAI", "citation", "yes", True, True),
    ("Claude-SearchBot", "Anthropic", "citation", "yes", True, True),
    ("PerplexityBot", "Perplexity", "citation", "yes", True, True),
    ("Googlebot", "Google", "citation", "yes", False, True),
    ("Bingbot", "Microsoft", "citation", "yes", False, True),
    ("Applebot", "Apple", "citation", "yes", False, True),
    ("Meta-WebIndexer", "Meta", "citation", "yes", False, True),
    ("MistralAI-Index", "Mistral", "citation", "yes", False, True),
    ("DuckAssistBot", "DuckDuckGo", "citation", "yes", False, True),
    ("Amzn-SearchBot", "Amazon", "citation", "yes", False, True),
    ("YouBot", "You.com", "citation", "yes", False, True),
    ("ChatGPT-User", "OpenAI", "user_fetch", "disputed", False, True),
    ("Claude-User", "Anthropic", "user_fetch", "yes", False, True),
    ("Perplexity-User", "Perplexity", "user_fetch", "no", False, True),
    ("MistralAI-User", "Mistral", "user_fetch", "yes", False, True),
    ("Meta-ExternalFetcher", "Meta", "user_fetch", "no", False, True),
    ("Amzn-User", "Amazon", "user_fetch", "no", False, True),
    ("Google-GeminiNotebook", "Google", "user_fetch", "no", False, True),
    ("Google-Agent", "Google", "user_fetch", "no", False, True),
    ("GPTBot", "OpenAI", "training", "yes", False, True),
    ("ClaudeBot", "Anthropic", "training", "yes", False, True),
    ("anthropic-ai", "Anthropic", "training", "yes", False, True),
    ("Google-Extended", "Google", "training", "yes", False, True),
    ("Applebot-Extended", "Apple", "training", "yes", False, True),
    ("CCBot", "Common Crawl", "training", "yes", False, True),
    ("meta-externalagent", "Meta", "training", "yes", False, True),
    ("MistralAI-Training", "Mistral", "training", "yes", False, True),
    ("Bytespider", "ByteDance", "training", "disputed", False, False),
    ("Amazonbot", "Amazon", "training", "yes", False, True),
    ("Diffbot", "Diffbot", "training", "disputed", False, True),
    ("omgilibot", "Webz.io", "training", "yes", False, True),
    ("webzio-extended", "Webz.io", "training", "yes", False, True),
]
BUCKETS = ("citation", "user_fetch", "training")
#: where a vendor documents its crawlers; one that documents none has no link
VENDOR_DOCS = {
    "OpenAI": "https://developers.openai.com/api/docs/bots",
    "Anthropic": "https://support.claude.com/en/articles/8896518",
    "Perplexity": "https://docs.perplexity.ai/guides/bots",
    "Microsoft": "https://www.bing.com/webmasters/help/which-crawlers-does-bing-use-8c184ec0",
    "Apple": "https://support.apple.com/en-us/119829",
    "Meta": "https://developers.facebook.com/docs/sharing/webmasters/web-crawlers",
    "Mistral": "https://docs.mistral.ai/robots",
    "DuckDuckGo": "https://duckduckgo.com/duckduckgo-help-pages/results/duckassistbot/",
    "Amazon": "https://developer.amazon.com/amazonbot",
    "You.com": "https://you.com/docs/youbot",
    "Common Crawl": "https://commoncrawl.org/ccbot",
    "Diffbot": "https://www.diffbot.com/docs/crawl/faq/robots-txt",
    "Webz.io": "https://webz.io/",
}
#: the same for a vendor with several pages
CRAWLER_DOCS = {
    "Googlebot": "https://developers.google.com/search/docs/crawling-indexing/google-common-crawlers",
    "Google-Extended": "https://developers.google.com/search/docs/crawling-indexing/google-common-crawlers",
    "Google-GeminiNotebook": "https://developers.google.com/search/docs/crawling-indexing/google-user-triggered-fetchers",
    "Google-Agent": "https://developers.google.com/search/docs/crawling-indexing/google-user-triggered-fetchers",
}
#: what a crawler is for, in our words
CRAWLER_NOTES = {
    "OAI-SearchBot": "Finds pages for search in ChatGPT. Not the one that collects for training.",
    "Claude-SearchBot": "Finds pages for search in Claude.",
    "PerplexityBot": "Finds pages that Perplexity shows and links.",
    "Googlebot": "Builds the index of Google Search, which AI overviews draw on.",
    "Bingbot": "Builds the index of Bing, which Copilot draws on.",
    "Applebot": "Builds the index behind Siri and Spotlight.",
    "Meta-WebIndexer": "Finds pages that Meta AI cites and links.",
    "MistralAI-Index": "Builds the search index of Mistral's assistant.",
    "DuckAssistBot": "Finds sources for assisted answers of DuckDuckGo.",
    "Amzn-SearchBot": "Finds pages for search with Alexa.",
    "YouBot": "Builds the index of You.com.",
    "ChatGPT-User": "Opens a page that a user of ChatGPT asks about. Rules may not apply to it.",
    "Claude-User": "Opens a page that a user of Claude asks about.",
    "Perplexity-User": "Opens a page that a user of Perplexity asks about. It mostly passes over robots.txt.",
    "MistralAI-User": "Opens a page that a user of Mistral's assistant asks about.",
    "Meta-ExternalFetcher": "Opens a link that a user of Meta AI gives. It may pass over robots.txt.",
    "Amzn-User": "Opens a page for a question to Alexa. It may pass over robots.txt.",
    "Google-GeminiNotebook": "Opens a page that a user adds to a notebook. It passes over robots.txt.",
    "Google-Agent": "Opens pages for an agent that a user sends. It passes over robots.txt.",
    "GPTBot": "Collects pages for training. Search in ChatGPT doesn't need it.",
    "ClaudeBot": "Collects pages for training.",
    "anthropic-ai": "An old name that sites still have rules for.",
    "Google-Extended": "A name for rules only: whether Gemini may use what is crawled.",
    "Applebot-Extended": "A name for rules only: whether Apple may train on what is crawled.",
    "CCBot": "Fills an open archive that many training sets come from.",
    "meta-externalagent": "Collects pages for training and indexing.",
    "MistralAI-Training": "Collects pages for training.",
    "Bytespider": "Collects pages; its vendor doesn't document it.",
    "Amazonbot": "Collects pages for products and training.",
    "Diffbot": "Collects pages as data. Customers can switch rules off.",
    "omgilibot": "An old name of the crawler after it.",
    "webzio-extended": "Collects pages for training sets that are sold.",
}

#: category, check_id, weight, in report order; the weights of a category sum to 100
RUBRIC = [
    ("access", "citation_crawlers_allowed", 50),
    ("access", "user_fetch_crawlers_allowed", 20),
    ("access", "pages_reachable", 15),
    ("access", "sitemap_available", 10),
    ("access", "no_noindex", 5),
    ("readability", "raw_html_content", 30),
    ("readability", "jsonld_valid", 20),
    ("readability", "heading_structure", 15),
    ("readability", "title_and_description", 10),
    ("readability", "author_and_dates", 10),
    ("readability", "canonical", 5),
    ("readability", "llms_txt", 5),
    ("readability", "answer_shaped_content", 5),
]
#: title and page to read more of each check
CHECK_TITLES = {
    "citation_crawlers_allowed": "Citation crawlers allowed",
    "user_fetch_crawlers_allowed": "User fetch crawlers allowed",
    "pages_reachable": "Pages reachable",
    "sitemap_available": "Sitemap available",
    "no_noindex": "No noindex",
    "raw_html_content": "Content in raw HTML",
    "jsonld_valid": "Valid JSON-LD",
    "heading_structure": "Heading structure",
    "title_and_description": "Title and meta description",
    "author_and_dates": "Author and dates",
    "canonical": "Canonical",
    "llms_txt": "llms.txt",
    "answer_shaped_content": "Answer shaped content",
}
CHECK_DOCS = {
    "citation_crawlers_allowed": "https://developers.openai.com/api/docs/bots",
    "user_fetch_crawlers_allowed": "https://support.claude.com/en/articles/8896518",
    "pages_reachable": "https://developers.google.com/search/docs/appearance/structured-data/paywalled-content",
    "sitemap_available": "https://developers.google.com/search/docs/crawling-indexing/sitemaps/build-sitemap",
    "no_noindex": "https://developers.google.com/search/docs/crawling-indexing/block-indexing",
    "raw_html_content": "https://developers.google.com/search/docs/crawling-indexing/javascript/javascript-seo-basics",
    "jsonld_valid": "https://developers.google.com/search/docs/appearance/structured-data/search-gallery",
    "heading_structure": "https://developers.google.com/search/docs/fundamentals/seo-starter-guide",
    "title_and_description": "https://developers.google.com/search/docs/appearance/snippet",
    "author_and_dates": "https://developers.google.com/search/docs/appearance/structured-data/article",
    "canonical": "https://developers.google.com/search/docs/crawling-indexing/consolidate-duplicate-urls",
    "llms_txt": "https://llmstxt.org/",
    "answer_shaped_content": "https://llmstxt.org/",
}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
LOWEST_GRADE = "F"
CAP_NO_CITATION, CAP_BLANKET = 20, 10

LOGIN_PATHS = ["/login", "/signin", "/sign-in", "/entrar", "/wp-login", "/auth/", "/conta/entrar", "/iniciar-sessao"]
TEXT_BEHIND_GATE = 1500
NOINDEX_DIRECTIVES = ["noindex", "none"]
NOINDEX_METAS = ["robots", "googlebot", "bingbot", "applebot"]
JSONLD_TYPES = [
    "aboutpage", "article", "blogposting", "book", "breadcrumblist", "collectionpage", "contactpage", "corporation", "course",
    "event", "faqpage", "howto", "itempage", "jobposting", "localbusiness", "medicalwebpage", "newsarticle", "offer",
    "organization", "person", "podcastepisode", "product", "qapage", "recipe", "restaurant", "review", "scholarlyarticle",
    "service", "softwareapplication", "techarticle", "videoobject", "webpage", "website",
]
FAQ_TYPES = ["faqpage", "qapage"]
AUTHOR_METAS = ["article:author", "author", "citation_author", "dc.creator", "twitter:creator"]
DATE_METAS = ["article:modified_time", "article:published_time", "citation_publication_date", "datemodified", "datepublished", "dc.date", "dc.date.issued", "og:updated_time"]
BLOCK_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table", "blockquote", "dl"]
SUMMARY_MARKERS = ["key takeaways", "quick summary", "in short", "tl;dr", "em resumo", "resumo", "principais conclusoes", "principais conclusões", "o essencial"]
NON_PAGE_SUFFIXES = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp4", ".mp3", ".zip", ".xml", ".json", ".css", ".js"]
SIGNAL_KEYS = ["search", "ai-train", "ai-input", "use", "ai-personalization", "ai-retrieval"]
GENERATORS = ["wordpress", "shopify", "wix", "squarespace", "webflow", "prestashop", "magento", "drupal", "joomla", "hubspot", "ghost", "gatsby", "hugo", "jekyll"]
PLATFORM_SIGNS = [
    ("WordPress", ["/wp-content/", "/wp-includes/", "/wp-json/"]),
    ("Shopify", [r"cdn\.shopify\.com", r"Shopify\.theme", r"shopifycdn\."]),
    ("Wix", [r"static\.wixstatic\.com", r"wixsite\.com"]),
    ("Squarespace", [r"static1\.squarespace\.com", "squarespace-cdn"]),
    ("Webflow", [r"assets\.website-files\.com", r"uploads-ssl\.webflow"]),
    ("PrestaShop", [r"var\s+prestashop\s*=", "/modules/ps_"]),
    ("Magento", [r"/static/version\d", "Magento_[A-Z]"]),
    ("Drupal", ["/sites/default/files/", r"Drupal\.settings"]),
    ("Next.js", ["__NEXT_DATA__", "/_next/static/"]),
]
PLATFORM_CHARS = 200_000
SHELL_IDS = ["root", "app", "__next", "__nuxt", "main-app", "svelte"]
SHELL_TEXT = 50
CATEGORIES = ["b2b", "blog", "ecommerce", "education", "government", "news", "parked", "platform", "reference", "saas", "storefront"]

#: raw HTML: characters of text and the ratio of script to text
TEXT_EMPTY, TEXT_THIN, SCRIPT_HEAVY = 500, 1500, 100
#: lengths of titles and descriptions that count in full, and the shares of the check
TITLE_RANGE, DESCRIPTION_RANGE = (10, 70), (50, 160)
TITLE_SHARE, DESCRIPTION_SHARE, UNIQUE_SHARE = 0.5, 0.3, 0.2
ONE_H1, NO_SKIPS = 0.6, 0.4
SHAPES_WANTED, SHAPE_SHARE, CITABLE_SHARE = 3, 0.6, 0.4
WORDS_TO_JUDGE, WELL_SECTIONED, ONE_BLOCK = 200, 0.35, 0.80
STEPS, TABLE_ROWS, QUESTIONS = 3, 3, 2
LLMS_CHARS = 100
RULES_SHOWN = 3
PAGES_SAMPLED, NESTED_SITEMAPS, SITEMAP_URLS = 5, 5, 5000
BODY_BYTES = 5_000_000

#: patterns: a line that makes a body robots syntax, a content signal, and the words of its terms
ROBOTS_DIRECTIVE = r"(?im)^\s*(user-agent|disallow|allow|sitemap|crawl-delay)\s*:"
SIGNAL_LINE = r"(?im)^\s*content-signal\s*:\s*(.+?)\s*$"
SIGNAL_TERMS = r"(?i)content[ -]signals?\s*:"
