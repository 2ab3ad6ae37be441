"""HTML extraction by consensus host paths.

Each page's containers are scored by the text that stands in them; the best vote, with their paths of
tags and classes (numbers generalised; as 64-bit hashes, each of its parent's and its own name), for
their host's containers. Votes are added up in Spark. A host's winners are the paths with at least
``QUORUM`` of its pages' votes, so that hosts with several templates have several; every page is extracted
again from the containers at the first of them that it has text at, or from its own best container
where it has none.

What isn't part of an article goes by its tag, role or name. Names that articles use, too ("related",
"notice"), are evidence only: such a container goes if it is short or mostly links. A form goes unless it
holds most of the page, a fieldset or label if it has something to fill in. Reading a page takes time and
memory in proportion to its length, however deep or broken its tags are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, python_batches

#: Hosts whose winning paths are broadcast, at most; beyond, hosts are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Paths a page votes for, and the share of a host's pages that a winning path has.
VOTES, QUORUM = 3, 0.1
#: A container with a name that only hints at boilerplate goes if it has less text (characters) or more of it in links.
SHORT, LINKED = 400, 0.3

CONTAINERS = frozenset("html body main article section div nav header footer aside form table tbody thead tfoot tr td th ul ol dl blockquote figure fieldset details center menu dialog".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr figcaption caption legend summary option title head hgroup".split())
BOILERPLATE = frozenset("nav footer aside menu dialog head button select object canvas audio video".split())
#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template svg iframe textarea math title".split())
#: Containers that are never chosen and pass their text on in full: the article is around them, not in them.
WITHIN = frozenset("blockquote ul ol dl table tbody thead tfoot tr figure fieldset form label details center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|side-?bar|footer|masthead|site-?header|page-?header|top-?bar|ads?|adverts?|advertisement|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|"
    r"cookies?|consent|gdpr|pop-?up|newsletter|subscribe|subscription|signup|sign-?in|login|breadcrumbs?|"
    r"comments?|comment-?list|disqus|pagination|pager|toolbar|skip-?link)(?:$|[\s_-])",
    re.I,
)
HINTS = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|post|article|entry|user|global|js)[_-])?(?:banner|notices?|modal|overlay|share|sharing|social|related|recommended|respond|replies|search(?:-?form)?|widgets?|copyright|alerts?)"
    r"(?:[_-](?:box|bar|block|list|container|wrap(?:per)?|section|area|items?|links?|inner|content|panel|posts?|articles?|buttons?|message|text|top|bottom|left|right|\d+))*",
    re.I,
)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NUMBER = re.compile(r"\d+")
#: Why a container may go: for certain, by a name that hints, as a form, by something to fill in.
STAYS, GOES, HINTED, FORM, FILLED = range(5)


@cache
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class Page:
    """A page's containers, each with its parent before it, and blocks of text in page order.

    blocks: (container, text, characters inside links). Container 0 is the page itself.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.cause, self.fields = [-1], [""], [0], [STAYS], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.read(html)
        self.gone = self.decide()

    def read(self, html: str) -> None:
        stack, open_ = [0], Counter()
        text: list[str] = []
        linked: list[str] = []
        dropped, links, at, n = 0, False, 0, len(html)

        def close():
            if text:
                if not dropped and (t := " ".join(unescape("".join(text)).split())):
                    self.blocks.append((stack[-1], t, len(" ".join(unescape("".join(linked)).split()))))
                text.clear()
            linked.clear()

        def say(s):
            if not dropped:
                text.append(s)
                if links:
                    linked.append(s)

        def pop(to: int):
            nonlocal dropped
            while len(stack) > to:
                c = stack.pop()
                open_[self.tag[c]] -= 1
                dropped -= self.cause[c] == GOES

        while at < n:
            i = html.find("<", at)
            if i < 0 or i + 1 == n:
                say(html[at:])
                break
            if i > at:
                say(html[at:i])
            if not (m := TAG.match(html, i)):
                c = html[i + 1]
                if c in "!?" or c == "/" and html[i + 2 : i + 3] not in ("", " ") and not html[i + 2].isalpha():
                    end = html.find("-->", i + 4) + 2 if html.startswith("<!--", i) else html.find(">", i)
                    if end < 2:
                        break  # the rest is an unfinished comment
                    at = end + 1
                elif (html[i + 2 : i + 3] if c == "/" else c).isalpha() and c.isascii():
                    break  # the rest is an unfinished tag
                else:
                    say("<")
                    at = i + 1
                continue
            at = m.end()
            shut, tag = m[1], m[2].lower()
            if tag in RAW:
                if not shut and not m[3].endswith("/"):
                    if not (e := end_of(tag).search(html, at)):
                        break
                    at = html.find(">", e.end()) + 1 or n
            elif tag == "br":
                say(" ")
            elif tag == "a":
                links = not shut
            elif tag in ("input", "select", "textarea", "button") and not shut and 'type="hidden"' not in m[3]:
                self.fields[stack[-1]] += 1
            if tag in BLOCKS or tag in BOILERPLATE or tag == "label":
                close()
                if tag not in CONTAINERS and tag not in BOILERPLATE and tag != "label":
                    continue
                if shut:
                    if open_[tag]:
                        links = False
                        to = len(stack) - 1
                        while self.tag[stack[to]] != tag:
                            to -= 1
                        pop(to)
                elif not m[3].endswith("/") or tag in CONTAINERS:
                    if tag == "body" and open_["head"]:
                        to = len(stack) - 1
                        while self.tag[stack[to]] != "head":
                            to -= 1
                        pop(to)
                    cause, name = self.look(tag, m[3], open_)
                    up = stack[-1]
                    self.parent.append(up)
                    self.tag.append(tag)
                    self.path.append(xxhash.xxh64_intdigest(name, self.path[up]))
                    self.cause.append(cause)
                    self.fields.append(0)
                    stack.append(len(self.tag) - 1)
                    open_[tag] += 1
                    dropped += cause == GOES
        close()

    @staticmethod
    def look(tag: str, attributes: str, open_: Counter) -> tuple[int, str]:
        """Whether the element may be boilerplate, and its name in a path."""
        goes = tag in BOILERPLATE or tag == "header" and not open_["article"] and not open_["main"]
        cause, name = STAYS, tag
        if attributes and not attributes.isspace():
            a = {k.lower(): unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(attributes)}
            own = a.get("class", "").split()
            if own:
                name += "." + ".".join(sorted({NUMBER.sub("N", c.lower()) for c in own}))
            elif a.get("id"):
                name += "#" + NUMBER.sub("N", a["id"].lower())
            if tag not in ("html", "body", "article", "main"):
                names = [*own, a.get("id", "")]
                goes = goes or bool(NAMES.search(" ".join(names))) or a.get("role", "").lower() in ROLES
                cause = HINTED if any(map(HINTS.fullmatch, names)) else STAYS
            goes = goes or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or tag == "label" and "for" in a
        if goes:
            return GOES, name
        return (FORM if tag == "form" else FILLED if tag in ("fieldset", "label") else cause), name

    def decide(self) -> list[bool]:
        """Of each container, whether it goes, by itself or with one around it."""
        n = len(self.tag)
        own, linked, fields = [0] * n, [0] * n, list(self.fields)
        for c, t, k in self.blocks:
            own[c] += len(t)
            linked[c] += k
        for c in range(n - 1, 0, -1):
            up = self.parent[c]
            own[up] += own[c]
            linked[up] += linked[c]
            fields[up] += fields[c]
        gone = [False] * n
        for c in range(1, n):
            k = self.cause[c]
            gone[c] = gone[self.parent[c]] or k == GOES or k == HINTED and (own[c] < SHORT or linked[c] > LINKED * own[c]) or k == FORM and 2 * own[c] <= own[0] or k == FILLED and fields[c] > 0
        return gone

    def scores(self) -> dict[int, float]:
        """Text outside links counts in full for the container it stands in and by half, a quarter ... for those outside, passed on in full by those of WITHIN; an article or main element counts double."""
        score = [0.0] * len(self.tag)
        for c, text, link in self.blocks:
            if not self.gone[c]:
                score[c] += max(0.0, len(text) - 2.0 * link)
        for c in range(len(score) - 1, 0, -1):
            score[self.parent[c]] += score[c] if self.tag[c] in WITHIN else score[c] / 2
        return {c: s * 2 if self.tag[c] in ("article", "main") else s for c, s in enumerate(score) if s > 0 and self.tag[c] not in WITHIN}

    def votes(self) -> list[tuple[int, float]]:
        by: dict[int, float] = {}
        for c, s in self.scores().items():
            by[self.path[c]] = by.get(self.path[c], 0.0) + s
        return sorted(by.items(), key=lambda x: (-x[1], x[0]))[:VOTES]

    def inside(self, chosen: set[int]) -> list[str]:
        """Text of the blocks in any of the containers, but of what goes."""
        within = [False] * len(self.tag)
        for c in range(len(within)):
            within[c] = c in chosen or c > 0 and within[self.parent[c]]
        return [t for c, t, _ in self.blocks if within[c] and not self.gone[c]]

    def text(self, paths) -> str:
        """The text at the first of the paths that has any, else at the best container, else all."""
        for p in paths:
            if (at := {c for c, q in enumerate(self.path) if q == p}) and (found := self.inside(at)):
                return "\n\n".join(found)
        s = self.scores()
        return "\n\n".join(self.inside({min(s, key=lambda c: (-s[c], c)) if s else 0}))


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; '' for null or no host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def winners(pages: DataFrame) -> DataFrame:
    """host, paths: each host's winning paths, the one with most votes first. A page's votes are shares of its best path's score."""

    def run(batches):
        for b in batches:
            out = []
            for h, x in zip(b["host"], b["html"], strict=True):
                if isinstance(x, str) and (v := Page(x).votes()):
                    out += [(h, signed(p), s / v[0][1], math.log1p(s)) for p, s in v]
            yield pd.DataFrame(out, columns=["host", "path", "share", "mass"])

    votes = python_batches(pages).select(host(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, path long, share double, mass double")
    # rounded: sums of doubles in another order may differ in the last digits
    sums = cut(votes.groupBy("host", "path").agg(F.round(F.sum("share"), 3).alias("share"), F.round(F.sum("mass"), 3).alias("mass"), F.count_if(F.col("share") == 1).alias("firsts")))
    # each page has one first choice, but for ties
    total = sums.groupBy("host").agg(F.sum("firsts").alias("pages"))
    won = sums.join(total, "host").where(F.col("share") >= QUORUM * F.col("pages"))
    return won.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("share"), (-F.col("mass")).alias("mass"), "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row.

    Null html counts as empty: text '', 0 characters. A null url's page votes with the pages without a
    host. Unclosed elements end with the page, which drops an unfinished tag, comment or script. Repeated
    rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    best = cut(winners(pages))
    hosts = best.limit(BROADCAST_HOSTS + 1).count()
    best = F.broadcast(best) if hosts <= BROADCAST_HOSTS else best
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            text = [Page(x).text([] if p is None else [q % (1 << 64) for q in p.tolist()]) if isinstance(x, str) else "" for x, p in zip(b["html"], b["paths"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = python_batches(pages).select("page_id", "url", "html", host(F.col("url")).alias("host")).join(best, "host", "left")
    return rows.select("page_id", "url", "html", "paths").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
