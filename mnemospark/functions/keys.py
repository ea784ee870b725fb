"""Columns that identify or clean things: URLs, repositories, DOIs, titles, dates, and text broken by a wrong charset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that say nothing about a page, on every host and on one; and hosts that are one.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "igshid", "si", "t", "ref_src", "ref_url", "mc_cid", "mc_eid"]
HOST_TRACKING = {"x.com": ["s"]}
HOST_ALIASES = {"twitter.com": "x.com", "mobile.twitter.com": "x.com", "m.twitter.com": "x.com", "mobile.x.com": "x.com", "m.youtube.com": "youtube.com"}
# First parts of paths that belong to the site and not to an owner of repositories.
NO_OWNERS = ["about", "apps", "codespaces", "collections", "contact", "customer-stories", "enterprise", "explore", "features", "join", "login", "marketplace", "new", "notifications", "orgs", "pricing", "search", "settings", "sponsors", "topics", "trending"]
# Phrases in which a text would diagnose or prescribe; without white space, and with single spaces.
UNSAFE_TIGHT = [r"と診断(し|され)ます", r"診断は[^。]{0,20}です", r"(服用|内服)を(中止|開始)(してください|すべきです|します)", r"(増量|減量|処方)(してください|すべきです|します)", r"薬を(やめ|始め)(てください|るべきです)"]
UNSAFE_SPACED = [r"\byou (have|should (take|stop|start))\b", r"\b(diagnos(is|ed) is|I diagnose)\b"]
_SPLIT_URL = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\[\]]+)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def stripped(text: Column | str) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _mapped(value: Column, pairs: dict[str, str]) -> Column:
    out = value
    for old, new in pairs.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def _decoded(value: Column) -> Column:
    """Percent codes as text; what is no code stays."""
    return F.coalesce(F.try_url_decode(value), value)


def _without(pairs: Column, name, names: list[str]) -> Column:
    return F.filter(pairs, lambda p: ~name(p).isin(names))


def normal_url(url: Column, more_tracking: list[str] | None = None) -> Column:
    """One form of each page's address: host and scheme in lower case, no user, default port, tracking or fragment.

    Other parameters are sorted; short links to videos and forms of preprints become one. Null for what is not http.
    """
    whole = lambda u: F.array(F.struct(*(F.regexp_extract(u, _SPLIT_URL, i).alias(f"p{i}") for i in range(1, 6))))
    # A lambda's argument is a value: the pattern is matched once for each part, however often the parts are used.
    return F.get(F.transform(whole(stripped(url)), lambda p: _normal(p, more_tracking or [])), F.lit(0))


def _normal(parts: Column, more_tracking: list[str]) -> Column:
    part = lambda i: parts[f"p{i}"]
    scheme = F.lower(part(1))
    host = _mapped(F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"\.+$", ""), r"^www\.", ""), HOST_ALIASES)
    port = F.regexp_replace(part(3), "^0+(?=.)", "")
    place = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), host).otherwise(F.concat(host, F.lit(":"), port))
    video = F.regexp_extract(part(4), "^/+([^/]+)", 1)
    short = (host == "youtu.be") & (video != "")
    paper = F.regexp_replace(F.regexp_extract(part(4), r"(?i)^/(?:abs|pdf|html)/(.+?)(?:\.pdf)?$", 1), r"v\d+$", "")
    path = F.when(short, "/watch").when((host == "arxiv.org") & (paper != ""), F.concat(F.lit("/abs/"), paper)).otherwise(part(4))
    query = F.when(short, F.concat_ws("&", F.concat(F.lit("v="), video), F.nullif(part(5), F.lit("")))).otherwise(part(5))
    name = lambda p: F.lower(_decoded(F.substring_index(p, "=", 1)))
    noise = lambda p: name(p).isin(TRACKING + more_tracking) | name(p).startswith("utm_")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~noise(p))
    for one, names in HOST_TRACKING.items():
        kept = F.when(host == one, _without(kept, name, names)).otherwise(kept)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    again = lambda t: F.replace(F.url_encode(_decoded(t)), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(value(p)).alias("v")))), lambda p: F.concat(again(p["k"]), F.lit("="), again(p["v"])))
    joined = F.array_join(pairs, "&")
    whole = F.concat(scheme, F.lit("://"), F.when(short, "youtube.com").otherwise(place), F.regexp_replace(path, "/+$", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when((host != "") & F.coalesce(port.try_cast("int") <= 65535, port == ""), whole)


def repository(url: Column) -> Column:
    """host/owner/name of a repository that the normal form of a URL lies in."""
    path = F.regexp_extract(normal_url(url), r"^https?://github\.com/+([^?]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    owner, name = F.lower(F.get(parts, F.lit(0))), F.regexp_replace(F.lower(F.get(parts, F.lit(1))), r"\.git$", "")
    return F.when((F.size(parts) >= 2) & ~owner.isin(NO_OWNERS) & (name != ""), F.concat(F.lit("github.com/"), owner, F.lit("/"), name))


def doi(value: Column) -> Column:
    """A DOI from its bare form, one with a doi: before it, or a URL of the resolver."""
    bare = stripped(value)
    linked = F.regexp_extract(bare, r"(?i)^https?://(?:dx\.)?doi\.org/(.+)$", 1)
    bare = F.when(linked != "", _decoded(F.replace(linked, F.lit("+"), F.lit("%2B")))).otherwise(bare)
    bare = F.regexp_replace(F.lower(stripped(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))), "/+$", "")
    return F.when(bare.startswith("10.") & F.contains(bare, F.lit("/")), bare)


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


def title_of(text: Column, most: int = 60, ellipsis: str = "…") -> Column:
    """The first line, cut to so many characters."""
    line = stripped(F.substring_index(stripped(text), "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit(ellipsis))).otherwise(line)


def clipped(text: Column, most: int) -> Column:
    one = stripped(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("…"))).otherwise(one)


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; the text itself where that fails."""
    raw = F.encode(F.regexp_replace(text, r"[^\x00-\xff]", "?"), "ISO-8859-1").cast("string")
    return F.coalesce(F.when(text.rlike(r"^[\x00-\xff]*$"), F.try_validate_utf8(raw)), text)


def content_id(prefix: str, *parts: Column) -> Column:
    """An id from content, the same at every import."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), F.lit(24)))


def any_date(text: Column) -> Column:
    """A day written as in ISO, with slashes, or month first."""
    return F.coalesce(*(F.try_to_date(stripped(text), f) for f in ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M/d/yy")))


def number(text: Column) -> Column:
    return F.replace(stripped(text), F.lit(","), F.lit("")).try_cast("double")


def when(text: Column) -> Column:
    """raw, earliest, latest, precision of a day or month that may be approximate (~); earliest is null if unreadable."""
    core = stripped(F.regexp_replace(stripped(text), "^~", ""))
    day = F.when(core.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(core, "yyyy-M-d"))
    month = F.when(core.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(core, F.lit("-1")), "yyyy-M-d"))
    about = stripped(text).startswith("~")
    precision = F.when(text.isNull(), "unknown").when(about, "approximate").when(day.isNotNull(), "date").when(month.isNotNull(), "month")
    return F.struct(stripped(text).alias("raw"), F.coalesce(day, month).alias("earliest"), F.coalesce(day, F.last_day(month)).alias("latest"), precision.alias("precision"))


def unsafe_phrases(text: Column) -> Column:
    """The patterns, of phrases that diagnose or prescribe, which a text matches."""
    tight, spaced = F.regexp_replace(text, r"\s+", ""), F.regexp_replace(text, r"\s+", " ")
    found = [F.when(tight.rlike(f"(?i){p}"), F.lit(p)) for p in UNSAFE_TIGHT] + [F.when(spaced.rlike(f"(?i){p}"), F.lit(p)) for p in UNSAFE_SPACED]
    return F.array_compact(F.array(*found))
