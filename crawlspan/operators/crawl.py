"""From HTML to crawl rows: extraction, indexability, robots rules, sitemaps, filters of what to crawl."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSEEN = frozenset(("script", "style", "noscript", "template"))
CHROME = frozenset(("nav", "header", "footer", "aside"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("p div section article li td th tr h1 h2 h3 h4 h5 h6 br blockquote pre dd dt main ul ol table".split())
# Fixed value: snippets of common analytics.
ANALYTICS = re.compile(r"googletagmanager\.com|google-analytics\.com|gtag\(|plausible\.io|matomo|_paq\b|usefathom\.com|clarity\.ms|cloudflareinsights\.com|mixpanel|heap-\d|segment\.com/analytics", re.I)
MAX_CHUNKS, MAX_CHUNK, MIN_CHUNK, MAX_ANCHOR = 40, 1500, 20, 300

FIELDS = """url string, title string, meta_description string, h1 string, h1_count int, h2_count int, heading_skips int, word_count int, lang string, charset string, canonical_url string, canonical_count int,
canonical_relative boolean, robots string, viewport string, noindex boolean, json_ld array<string>, og_tags map<string,string>, twitter_tags map<string,string>, hreflang array<struct<lang:string,href:string>>,
internal_links int, external_links int, image_count int, images_without_alt int, images_missing_dimensions int, rel_next boolean, rel_prev boolean, rel_amphtml string, mixed_content_count int,
has_microdata boolean, has_rdfa boolean, has_favicon boolean, has_analytics boolean, body_chunks array<struct<heading:string,level:int,text:string>>,
links array<struct<target:string,anchor:string,internal:boolean,placement:string,rel:string>>"""


def squeeze(s: str) -> str:
    return " ".join(s.split())


class Reader(HTMLParser):
    """One pass over a page; errors of nesting end at the nearest matching tag."""

    def __init__(self, url: str, header_robots: str | None):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.words = url, [], []
        self.base_host = (urlsplit(url).hostname or "").removeprefix("www.")
        self.r: dict = {k: None for k in ("title", "meta_description", "h1", "lang", "charset", "canonical_url", "robots", "viewport", "rel_amphtml")}
        self.r |= {"url": url, "h1_count": 0, "h2_count": 0, "heading_skips": 0, "canonical_count": 0, "canonical_relative": False, "json_ld": [], "og_tags": {}, "twitter_tags": {}, "hreflang": [], "image_count": 0, "images_without_alt": 0, "images_missing_dimensions": 0}
        self.r |= {"rel_next": False, "rel_prev": False, "mixed_content_count": 0, "has_microdata": False, "has_rdfa": False, "has_favicon": False, "links": []}
        self.header_robots, self.level, self.anchor, self.heading, self.ld = header_robots or "", 0, None, None, None
        self.chunks, self.chunk = [], {"heading": "", "level": 0, "text": []}
        self.roots: list[tuple[str, dict]] = []

    def inside(self, tags) -> bool:
        return any(t in tags for t in self.open)

    def end_chunk(self):
        text = squeeze("".join(self.chunk["text"]))[:MAX_CHUNK]
        if self.chunk["heading"] or len(text) > MIN_CHUNK:
            self.chunks.append({"heading": self.chunk["heading"], "level": self.chunk["level"], "text": text, "root": self.chunk.get("root", "")})

    def resource(self, a: dict, name: str):
        if self.url.lower().startswith("https:") and (a.get(name) or "").lower().startswith("http:"):
            self.r["mixed_content_count"] += 1

    def handle_starttag(self, tag, attrs):
        a, r = {k: v or "" for k, v in attrs}, self.r
        given = {k for k, _ in attrs}
        if "itemscope" in given:
            r["has_microdata"] = True
        if "typeof" in given or "vocab" in given:
            r["has_rdfa"] = True
        if tag == "html":
            r["lang"] = a.get("lang") or None
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            if a.get("charset"):
                r["charset"] = a["charset"]
            simple = {"description": "meta_description", "robots": "robots", "viewport": "viewport"}
            if name in simple and r[simple[name]] is None:
                r[simple[name]] = content
            elif name.startswith("og:"):
                r["og_tags"].setdefault(name, content)
            elif name.startswith("twitter:"):
                r["twitter_tags"].setdefault(name, content)
        elif tag == "link":
            rel, href = a.get("rel", "").lower().split(), a.get("href", "")
            if "canonical" in rel:
                r["canonical_count"] += 1
                if r["canonical_url"] is None:
                    r["canonical_url"], r["canonical_relative"] = urljoin(self.url, href), not re.match("https?://", href, re.I)
            if "alternate" in rel and a.get("hreflang"):
                r["hreflang"].append({"lang": a["hreflang"], "href": urljoin(self.url, href)})
            r["rel_next"] |= "next" in rel
            r["rel_prev"] |= "prev" in rel
            r["has_favicon"] |= any("icon" in x for x in rel)
            if "amphtml" in rel:
                r["rel_amphtml"] = href
            if "stylesheet" in rel:
                self.resource(a, "href")
        elif tag == "img":
            r["image_count"] += 1
            r["images_without_alt"] += "alt" not in given
            r["images_missing_dimensions"] += "width" not in given and "height" not in given
        if tag in ("img", "script", "iframe", "video", "audio", "source", "embed"):
            self.resource(a, "src")
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []
        elif re.fullmatch("h[1-6]", tag):
            level = int(tag[1])
            r["heading_skips"] += bool(self.level) and level > self.level + 1
            self.level = level
            r["h1_count"] += level == 1
            r["h2_count"] += level == 2
            self.heading = []
        elif tag == "a" and "href" in given:
            self.end_anchor()
            self.anchor = (a["href"], [], a.get("rel", ""))
        if tag in BLOCK:
            self.words.append(" ")
            self.chunk["text"].append(" ")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            if tag == "a":
                self.end_anchor()
            if re.fullmatch("h[1-6]", tag) and self.heading is not None:
                text = squeeze("".join(self.heading))
                if tag == "h1" and self.r["h1"] is None:
                    self.r["h1"] = text or None
                if not self.inside(CHROME):
                    self.end_chunk()
                    self.chunk = {"heading": text, "level": int(tag[1]), "text": [], "root": self.root()}
                self.heading = None
            if tag == "script" and self.ld is not None:
                self.r["json_ld"].append("".join(self.ld).strip())
                self.ld = None
            while self.open and self.open.pop() != tag:
                pass
        if tag in BLOCK:
            self.words.append(" ")
            self.chunk["text"].append(" ")

    def root(self) -> str:
        return next((t for t in ("main", "article") if t in self.open), "body")

    def end_anchor(self):
        if self.anchor is None:
            return
        href, text, rel = self.anchor
        self.anchor = None
        try:
            target = urljoin(self.url, href.strip())
            u = urlsplit(target)
        except ValueError:
            return
        if u.scheme not in ("http", "https") or "/cdn-cgi/" in u.path:
            return
        place = "navigation" if self.inside(("nav", "header")) else "footer" if self.inside(("footer",)) else "body"
        self.r["links"].append({"target": target, "anchor": squeeze("".join(text))[:MAX_ANCHOR], "internal": (u.hostname or "").removeprefix("www.") == self.base_host, "placement": place, "rel": rel})

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
            return
        if "title" in self.open and self.r["title"] is None and not self.inside(("svg",)):
            self.r["title"] = squeeze(data) or None
            return
        if self.inside(UNSEEN) or self.inside(("head", "title")):
            return
        self.words.append(data)
        if self.anchor is not None:
            self.anchor[1].append(data)
        if self.heading is not None:
            self.heading.append(data)
        elif not self.inside(CHROME):
            self.chunk.setdefault("root", self.root())
            self.chunk["text"].append(data)

    def result(self, html: str) -> dict:
        self.end_anchor()
        self.end_chunk()
        r = self.r
        best = next((t for t in ("main", "article") if any(c["root"] == t for c in self.chunks)), None)
        r["body_chunks"] = [{k: c[k] for k in ("heading", "level", "text")} for c in self.chunks if best is None or c["root"] == best][:MAX_CHUNKS]
        r["word_count"] = len("".join(self.words).split())
        r["has_analytics"] = bool(ANALYTICS.search(html))
        r["noindex"] = "noindex" in f"{r['robots'] or ''} {self.header_robots}".lower()
        r["internal_links"] = sum(x["internal"] for x in r["links"])
        r["external_links"] = len(r["links"]) - r["internal_links"]
        return r


def read(html: str | None, url: str | None, header_robots: str | None = None) -> dict:
    p = Reader(url or "", header_robots)
    p.feed(html or "")
    p.close()
    return p.result(html or "")


def extract(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, html[, x_robots_tag]) -> one extracted row per page, links nested."""
    header = F.col("x_robots_tag") if "x_robots_tag" in pages.columns else F.lit(None).cast("string")
    names = [f.name for f in pages.sparkSession.createDataFrame([], FIELDS).schema]
    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            out = pd.DataFrame([read(h, u, x) for h, u, x in zip(b["html"], b["url"], b["_header"], strict=True)], columns=names)
            for c in keep:
                out[c] = b[c].to_numpy()
            yield out

    return pages.select(*keep, "url", "html", header.alias("_header")).mapInPandas(run, FIELDS + (", " + kept if kept else ""))


def indexability(status: Column, content_type: Column, header_robots: Column, noindex: Column, canonical: Column, key: Column) -> Column:
    """The first reason that keeps a page out of the index; null if there is none."""
    c = F.when(status >= 500, "http-5xx").when(status >= 400, "http-4xx").when(status >= 300, "redirect").when(~F.coalesce(F.lower(content_type).rlike("^(text/html|application/xhtml[+]xml)"), F.lit(False)), "non-html")
    return c.when(F.coalesce(F.lower(header_robots).contains("noindex"), F.lit(False)), "noindex-header").when(noindex, "noindex-meta").when(canonical != key, "canonicalised")


def robots_rules(text: str, agent: str) -> list[tuple[str, bool]]:
    """(path, allow) of the groups that name the agent most closely; groups that do so equally add up."""
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    naming = False
    for line in text.splitlines():
        field, colon, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif field in ("allow", "disallow") and groups and value:
            groups[-1][1].append((value, field == "allow"))
        naming = field == "user-agent"
    score = lambda names: max((0 if n == "*" else len(n) if n in agent.lower() else -1 for n in names), default=-1)
    best = max((score(n) for n, _ in groups), default=-1)
    return [r for n, rules in groups if best >= 0 and score(n) == best for r in rules]


def allowed(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """urls + allowed: by the longest rule (path, allow) that the path begins with, allow before disallow. rules is one site's robots.txt, so it is small by its format's size limit."""
    r = rules.select(F.col("path").alias("rule"), "allow").dropDuplicates()
    u = urls.withColumn("_id", F.monotonically_increasing_id())
    hit = u.join(F.broadcast(r), F.col(path).startswith(F.col("rule"))).groupBy("_id").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allowed"))
    return u.join(hit, "_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_id")


def sitemap_rows(files: DataFrame) -> DataFrame:
    """(value: a sitemap's XML, other columns) -> the other columns, url, lastmod; numeric and named entities are decoded."""
    others = [c for c in files.columns if c != "value"]

    def run(batches):
        for b in batches:
            b = b.copy()
            b["url"] = [unescape(x).strip() for x in b["raw"]]
            yield b.drop(columns="raw")

    blocks = F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), 1)
    # without <url> blocks, bare <loc>s count
    u = files.select(*others, F.explode(F.when(F.size(blocks) > 0, blocks).otherwise(F.regexp_extract_all("value", F.lit(r"(<loc>[^<]*</loc>)"), 1))).alias("u"))
    u = u.select(*others, F.regexp_extract("u", r"<loc>\s*([^<]*?)\s*</loc>", 1).alias("raw"), F.try_to_date(F.substring(F.regexp_extract("u", r"<lastmod>\s*([^<]*)", 1), 1, 10)).alias("lastmod")).where("raw <> ''")
    schema = u.drop("raw").withColumn("url", F.lit("")).schema
    return u.select(*others, "lastmod", "raw").mapInPandas(run, schema)


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(value: a sitemap's XML) -> url, lastmod; the first of equal URLs."""
    return sitemap_rows(files.select("value")).groupBy("url").agg(F.min("lastmod").alias("lastmod"))


def news_items(files: DataFrame) -> DataFrame:
    """(value: an RSS feed) -> title, link, source, published; 'headline - source' gives the source where the feed has none."""
    i = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("i"))
    get = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    i = i.select(get("title").alias("headline"), get("link").alias("link"), get("source").alias("own"), get("pubDate").alias("published"))
    return i.select(F.when(F.col("own") == "", F.regexp_replace("headline", r" - [^-]*$", "")).otherwise(F.col("headline")).alias("title"), "link", F.when(F.col("own") == "", F.regexp_extract("headline", r" - ([^-]*)$", 1)).otherwise(F.col("own")).alias("source"), "published")


# Endings of files whose body a crawl doesn't need.
ASSETS = """jpg jpeg png gif webp avif svg svgz ico bmp tif tiff heic psd pdf zip rar 7z gz tgz tar bz2 mp4 mpeg mpg m4v webm mov avi mkv flv wmv mp3 m4a aac opus weba wav ogg oga flac wma
css js mjs cjs map woff woff2 ttf otf eot dmg exe msi apk bin doc docx xls xlsx ppt pptx""".split()
# URLs that a crawl leaves out.
SKIPPED = (
    r"[?&](sps_query|s|q|search|keyword|orderby|sort_by|add-to-cart|fl_builder|elementor-preview)=",
    r"[?&](pf_|filter[._]|dppref|variant=)",
    r"[?&](client_id|redirect_uri|response_type)=|/authentication/|/oauth/|/login_with_shop/",
    r"/search(-results)?/",
    r"[?&]replytocom=",
    r"/(wp-json|wp-admin|wp-login\.php|xmlrpc\.php)(/|$|\?)",
    r"/(cart|checkout|my-account|basket)(/|$)",
)


def is_asset(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "").rlike(rf"(?i)\.({'|'.join(ASSETS)})$")


def crawlable(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a page is worth fetching: no pattern to skip, no asset, and a web address."""
    return ~url.rlike("(?i)" + "|".join((*SKIPPED, *extra))) & ~is_asset(url) & ~url.rlike("(?i)^(mailto|tel|javascript):")


def sitemap_tree(files: DataFrame, roots: list[str], max_sitemaps: int = 60, max_urls: int = 100_000) -> DataFrame:
    """(url, value: XML) of fetched sitemaps -> url, lastmod of the pages that the roots lead to, through sitemap indexes.

    An index adds its children, breadth first, up to max_sitemaps files in all; at most max_urls pages are kept,
    in order of file and URL. A file that isn't there or is met again adds nothing.
    """
    spark, done, todo = files.sparkSession, [], list(dict.fromkeys(roots))[:max_sitemaps]
    while todo:
        done += todo
        level = files.where(F.col("url").isin(todo) & F.col("value").rlike(r"(?i)<sitemapindex[\s>]"))
        children = level.select("url", F.posexplode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+?)\s*</loc>"), 1)).alias("at", "child"))
        place = {u: i for i, u in enumerate(todo)}
        found = sorted(children.limit(max_sitemaps * 1000).collect(), key=lambda r: (place[r.url], r.at))
        seen = set(done)
        todo = [u for u in dict.fromkeys(unescape(r.child) for r in found) if u not in seen][: max_sitemaps - len(done)]
    order = spark.createDataFrame(list(enumerate(done)), "file int, url string")
    pages = files.join(F.broadcast(order), "url").where(~F.col("value").rlike(r"(?i)<sitemapindex[\s>]"))
    listed = sitemap_rows(pages.select("file", "value"))
    one = listed.groupBy("url").agg(F.min_by("lastmod", F.struct("file", F.col("lastmod").isNull())).alias("lastmod"), F.min("file").alias("file"))
    return one.orderBy("file", "url").limit(max_urls).select("url", "lastmod")
