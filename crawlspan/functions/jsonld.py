"""JSON-LD: flattening captured blocks into nodes and validating them against required fields.

Structure of unknown depth, so this is Python, run once per page and shared by every check over it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

# The fields that rich results require, by type; alternatives in one group; fields that a nested object must carry; types restricted to narrow contexts.
ARTICLE = ("headline", "author", "datePublished", "image")
PLACE = ("name", "address")
REQUIRED = {
    "Article": ARTICLE, "BlogPosting": ARTICLE, "NewsArticle": ARTICLE, "Product": ("name",), "Organization": ("name", "url", "logo"), "BreadcrumbList": ("itemListElement",),
    "WebSite": ("url",), "Event": ("name", "startDate", "location"), "Recipe": ("name", "image"), "VideoObject": ("name", "thumbnailUrl", "uploadDate"),
    "JobPosting": ("title", "description", "datePosted", "hiringOrganization"), "LocalBusiness": PLACE, "Course": ("name", "description", "provider"), "FAQPage": ("mainEntity",),
    "QAPage": ("mainEntity",), "Review": ("author", "reviewRating"), "AggregateRating": ("ratingValue",), "Movie": ("name",), "Book": ("name", "author"), "SoftwareApplication": ("name",),
    "Dataset": ("name", "description"), "Hotel": PLACE, "LodgingBusiness": PLACE, "Resort": PLACE, "BedAndBreakfast": PLACE, "Restaurant": PLACE,
    "TouristAttraction": ("name",), "TouristDestination": ("name",), "Trip": ("name",), "TouristTrip": ("name",),
}
ANY_OF = {"Product": [("offers", "review", "aggregateRating")], "JobPosting": [("jobLocation", "jobLocationType", "applicantLocationRequirements")]}
NESTED = {"Product": ("offers", ("price", "priceCurrency")), "SoftwareApplication": ("offers", ("price", "priceCurrency")), "Review": ("reviewRating", ("ratingValue",)), "JobPosting": ("jobLocation", ("address",))}
RESTRICTED = ("FAQPage", "HowTo")
URL_FIELDS = ("image", "logo", "thumbnailurl", "contenturl", "url")
DATE_FIELDS = ("datepublished", "datemodified", "startdate", "enddate", "uploaddate", "dateposted", "validfrom")
ISO_DATE = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d)?(\.\d+)?(Z|[+-]\d\d:\d\d)?)?")

NODES = "array<struct<type:string,block:int,json:string>>"
ISSUES = "array<struct<kind:string,type:string,detail:string,fields:array<string>>>"


def on_driver(kind: str):
    """A pandas UDF that is made when it is applied: workers import this module without a JVM to parse types."""
    return lambda f: lambda column: F.pandas_udf(f, kind)(column)


def parse(block: str):
    try:
        return json.loads(block), True
    except (TypeError, ValueError):
        return None, False


def flatten(value) -> list[dict]:
    """The nodes of a parsed block: members of lists and of @graph, else the object itself."""
    out, todo = [], [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            graph = v.get("@graph")
            if isinstance(graph, list):
                todo = graph + todo
            else:
                out.append(v)
        elif isinstance(v, list):
            todo = v + todo
    return out


def first_type(node: dict) -> str | None:
    t = node.get("@type")
    t = t[0] if isinstance(t, list) and t else t
    return t if isinstance(t, str) else None


def given(node: dict, field: str) -> bool:
    return node.get(field) not in (None, "")


def absolute(value) -> bool:
    """False only for what is surely not an absolute URL."""
    if isinstance(value, str):
        return value.lower().startswith(("http://", "https://"))
    if isinstance(value, dict):
        return absolute(value.get("url", value.get("@id")))
    return all(map(absolute, value)) if isinstance(value, list) else True


def value_issues(node: dict, of: str) -> list[dict]:
    rules = (
        (lambda k: k in URL_FIELDS, lambda v: v is None or absolute(v), "not an absolute URL"),
        (lambda k: k in DATE_FIELDS, lambda v: not isinstance(v, str) or ISO_DATE.fullmatch(v), "not an ISO-8601 date"),
        (lambda k: k == "pricecurrency", lambda v: not isinstance(v, str) or re.fullmatch("[A-Z]{3}", v), "not an ISO-4217 code"),
        (lambda k: k == "price", lambda v: v is None or (isinstance(v, (int, float)) and not isinstance(v, bool)) or (isinstance(v, str) and re.fullmatch(r"\d+(\.\d+)?", v)), "not a plain number"),
    )
    return [{"kind": "value", "type": of, "detail": f"{k}: {what}", "fields": [k]} for k, v in node.items() for names, fine, what in rules if names(k.lower()) and not fine(v)]


def nested(node: dict, of: str) -> list[dict] | None:
    """The objects under the type's nested field; None if the field is absent."""
    if of not in NESTED or NESTED[of][0] not in node:
        return None
    v = node[NESTED[of][0]]
    return [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]


def lacks(node: dict, of: str) -> list[tuple[str, list[str]]]:
    """What is missing of a type's required fields: (where, fields)."""
    out = []
    if miss := [f for f in REQUIRED.get(of, ()) if not given(node, f)]:
        out.append(("required", miss))
    for inner in (nested(node, of) or ()) if of in REQUIRED else ():
        field, subs = NESTED[of]
        if miss := [f"{field}.{s}" for s in subs if not given(inner, s)]:
            out.append((field, miss))
    out += [("one of", list(g)) for g in ANY_OF.get(of, ()) if not any(given(node, f) for f in g)]
    return out


def complete(node: dict, of: str) -> bool:
    return of in REQUIRED and not lacks(node, of) and (of not in NESTED or bool(nested(node, of)))


def number(v) -> float | None:
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    return float(v) if not isinstance(v, str) or re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", v) else None


def rating_issues(nodes: list[dict]) -> list[dict]:
    """Ratings outside their scale, scales upside down, and scales that differ between a page's nodes."""
    out, scales = [], set()
    for n in nodes:
        t = first_type(n)
        r = n if t == "AggregateRating" else n.get("reviewRating") if t == "Review" else None
        if not isinstance(r, dict):
            continue
        value, best, worst = (number(r.get(k)) for k in ("ratingValue", "bestRating", "worstRating"))
        low, high = 1.0 if worst is None else worst, 5.0 if best is None else best
        if best is not None and worst is not None and worst > best:
            out.append({"kind": "value", "type": t, "detail": "worstRating above bestRating", "fields": ["worstRating", "bestRating"]})
        if value is not None and not low <= value <= high:
            out.append({"kind": "value", "type": t, "detail": f"ratingValue {value:g} outside {low:g} to {high:g}", "fields": ["ratingValue"]})
        if best is not None or worst is not None:
            scales.add((low, high))
    if len(scales) > 1:
        out.append({"kind": "value", "type": None, "detail": "rating scales differ between nodes", "fields": ["bestRating", "worstRating"]})
    return out


def context_fine(c) -> bool:
    if isinstance(c, list):
        return any(isinstance(x, str) and "schema.org" in x.lower() for x in c)
    return isinstance(c, dict) or isinstance(c, str) and "schema.org" in c.lower()


def validate(blocks) -> list[dict]:
    """Issues of a page's blocks. A complete node of a type clears its siblings of missing fields."""
    out, every = [], []
    for block in blocks if blocks is not None else ():
        value, ok = parse(block)
        if not ok:
            out.append({"kind": "parse", "type": None, "detail": "the block isn't JSON", "fields": []})
            continue
        nodes = flatten(value)
        every += nodes
        for n in nodes:
            if "@context" in n and not context_fine(n["@context"]):
                out.append({"kind": "context", "type": first_type(n), "detail": "@context isn't schema.org", "fields": ["@context"]})
            t = first_type(n)
            if t is None:
                out.append({"kind": "type", "type": None, "detail": "a node has no @type", "fields": ["@type"]})
                continue
            if t in RESTRICTED:
                out.append({"kind": "forbidden", "type": t, "detail": f"{t} results are restricted", "fields": []})
            out += [{"kind": "required", "type": t, "detail": f"{where}: {', '.join(fields)}", "fields": fields} for where, fields in lacks(n, t)]
            for inner in (nested(n, t) or ()) if t in REQUIRED else ():
                out += value_issues(inner, t)
            out += value_issues(n, t)
        if isinstance(value, dict) and "@context" not in value and not isinstance(value.get("@graph"), list):
            out.append({"kind": "context", "type": first_type(value), "detail": "the block has no @context", "fields": ["@context"]})
    done = {t for n in every if (t := first_type(n)) and complete(n, t)}
    return [i for i in out + rating_issues(every) if not (i["kind"] == "required" and i["type"] in done)]


@on_driver(ISSUES)
def issues(blocks: pd.Series) -> pd.Series:
    return blocks.map(validate)


@on_driver(NODES)
def nodes(blocks: pd.Series) -> pd.Series:
    """Typed nodes of a page with their JSON."""
    return blocks.map(lambda bs: [{"type": first_type(n), "block": i, "json": json.dumps(n)} for i, b in enumerate(bs if bs is not None else ()) for n in flatten(parse(b)[0])])


def dates(value) -> list[str]:
    """All modification and publication dates anywhere in a value."""
    if isinstance(value, dict):
        return [v for k, v in value.items() if k in ("dateModified", "datePublished") and isinstance(v, str)] + [d for v in value.values() for d in dates(v)]
    return [d for v in value for d in dates(v)] if isinstance(value, list) else []


@on_driver("string")
def newest_date(blocks: pd.Series) -> pd.Series:
    """The latest ISO date of a page's nodes."""
    return blocks.map(lambda bs: max((d[:10] for b in (bs if bs is not None else ()) for d in dates(parse(b)[0]) if re.match(r"\d{4}-\d\d-\d\d", d)), default=None))


def has_author(value) -> bool:
    if isinstance(value, list):
        return any(map(has_author, value))
    name = value.get("name") if isinstance(value, dict) else value
    return isinstance(name, str) and bool(name.strip())


@on_driver("boolean")
def named_author(node: pd.Series) -> pd.Series:
    return node.map(lambda j: has_author(json.loads(j).get("author")) if j else False)
