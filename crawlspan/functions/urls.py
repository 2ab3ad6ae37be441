"""URL keys and shapes, as native Column expressions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, by prefix and by name.
TRACKING_PREFIXES = "utm_ mc_ hsa_ _hs pk_ piwik_ matomo_".split()
TRACKING_NAMES = "gclid gbraid wbraid dclid fbclid msclkid twclid ttclid igshid mkt_tok yclid ref ref_src spm vero_id oly_anon_id oly_enc_id _ga _gl gclsrc".split()


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    out = n.isin(*TRACKING_NAMES)
    for p in TRACKING_PREFIXES:
        out = out | n.startswith(p)
    return out


def url_key(url: Column, host_form: str = "asis", force_https: bool = True) -> Column:
    """The one key of a page: scheme, host form, default port, fragment, tracking parameters, parameter order and a trailing slash don't count. What doesn't parse as http(s) stays as it is."""
    raw = F.trim(url)
    safe = F.replace(raw, F.lit(" "), F.lit("%20"))
    netloc = F.regexp_extract(safe, r"(?i)^https?://([^/?#]*)([^?#]*)(\?[^#]*)?", 1)
    scheme = F.lower(F.regexp_extract(safe, r"(?i)^(https?)://", 1))
    host = F.regexp_replace(F.regexp_replace(F.lower(netloc), "^[^@]*@", ""), ":(80|443)$", "")
    bare = F.regexp_replace(host, r"^www\.", "")
    host = bare if host_form == "apex" else F.concat(F.lit("www."), bare) if host_form == "www" else host
    path = F.regexp_extract(safe, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(safe, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, "^([^=]*)", 1)))
    encode = lambda s: F.url_encode(F.coalesce(F.try_url_decode(s), s))
    pairs = F.transform(pairs, lambda p: F.struct(encode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), encode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    key = F.concat(F.lit("https") if force_https else scheme, F.lit("://"), host, path, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when((scheme == "") | (host == ""), raw).otherwise(key)


def url_key_py(url: str, host_form: str = "asis", force_https: bool = True) -> str:
    """The same key with urllib, for tests to hold the expression against."""
    raw = url.strip()
    u = urlsplit(raw.replace(" ", "%20"))
    if u.scheme.lower() not in ("http", "https") or not u.netloc:
        return raw
    host = re.sub(r":(80|443)$", "", u.netloc.lower().rpartition("@")[2])
    bare = host.removeprefix("www.")
    host = {"apex": bare, "www": "www." + bare}.get(host_form, host)
    path = u.path or "/"
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    drop = lambda k: k.lower() in TRACKING_NAMES or k.lower().startswith(tuple(TRACKING_PREFIXES))
    pairs = sorted((quote_plus(k, safe="*").replace("~", "%7E"), quote_plus(v, safe="*").replace("~", "%7E")) for k, v in parse_qsl(u.query, keep_blank_values=True) if not drop(k))
    text = "&".join(f"{k}={v}" for k, v in pairs)
    return f"{'https' if force_https else u.scheme.lower()}://{host}{path}{'?' + text if text else ''}"


def host_form(property_url: str) -> str:
    if property_url.startswith("sc-domain:"):
        return "apex"
    host = urlsplit(property_url).netloc.lower()
    return "www" if host.startswith("www.") else "asis"


def brand_token(host: str) -> str | None:
    """First label of a host, letters and digits only; None under three."""
    label = re.sub("[^a-z0-9]", "", host.lower().removeprefix("www.").split(".")[0])
    return label if len(label) >= 3 else None


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def morphology(url: Column) -> Column:
    """A URL's shape: numbers, identifiers and parameter names instead of what they are."""
    odd = lambda s: s.rlike("[-_0-9]") | (F.length(s) > 24)
    ext = lambda s: F.lower(F.regexp_extract(s, r"^.+\.([A-Za-z0-9]{1,5})$", 1))
    stem = lambda s: F.regexp_extract(s, r"^(.+)\.[A-Za-z0-9]{1,5}$", 1)
    shape = lambda s: F.when(s.rlike("^[0-9]+$"), "[NUM]").when(ext(s) != "", F.when(odd(stem(s)), F.concat(F.lit("[SLUG]."), ext(s))).otherwise(s)).when(odd(s), "[SLUG]").otherwise(s)
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), shape)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != ""), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1)))))
    return F.concat(F.lit("/"), F.array_join(segments, "/"), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))
