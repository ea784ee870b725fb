"""What texts mention: URLs as they stand, and entities (pages and repositories) with the places where they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters of a URL, what prose leaves at its end, and the same for entities, whose rules differ.
URL = r"(?i)https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
JUNK = ".,;:!?'\""
ENTITY_URL = r"(?i)https?://[^\s<>\"')\]]+"
ENTITY_JUNK = r"[.,;:!?)\]>\"」。，．]+$"
ENTITY_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "referrer", "source"]
REPOSITORY = r"(?i)(?:https?://)?github\.com/([\w.\-]{1,100})/([\w.\-]{1,100})"
REPOSITORY_JUNK = r"(?:\.git|[.,;:!?)\]\"'。，．]+)$"
NO_ENTITY_OWNERS = ["orgs", "teams", "apps", "marketplace", "sponsors", "features", "pricing", "contact", "about", "login", "logout", "join", "settings", "notifications", "explore", "trending", "topics", "collections", "events", "pulls", "issues", "search"]
NO_NAMES = ["blob", "tree", "commit", "pull", "issues", "wiki", "actions", "releases", "tags", "branches", "compare"]


#: In these patterns white space and word characters are those of Unicode.
_WIDE = "(?U)"


def _loose_end(url: Column) -> Column:
    """A URL without its last character, if that is junk or a closing bracket that nothing opens."""
    count = lambda c: F.length(url) - F.length(F.replace(url, F.lit(c), F.lit("")))
    last = F.right(url, F.lit(1))
    loose = last.isin(list(JUNK)) | ((last == ")") & (count("(") < count(")"))) | ((last == "]") & (count("[") < count("]")))
    return F.when(loose, F.left(url, F.length(url) - 1)).otherwise(url)


def urls_in(text: Column) -> Column:
    """The URLs of a text, each once, in the order of their first places.

    Junk can only stand in the run of it at the end, whose length says how often the last character is looked at.
    """
    tail = lambda u: F.length(F.regexp_extract(u, r"[.,;:!?'\")\]]*$", 0))
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.aggregate(F.sequence(F.lit(0), tail(u)), u, lambda so_far, _: _loose_end(so_far)))
    return F.array_distinct(F.filter(trimmed, lambda u: u != ""))


def _found(text: Column, pattern: str, groups: int) -> Column:
    """Each match: its groups g0 (the whole), g1, ..., and where it starts, in characters from 0."""
    between = F.split(text, _WIDE + pattern, -1)
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(_WIDE + pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)), between.alias("before"))
    placed = F.aggregate(
        F.filter(parts, lambda p: p["g0"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, p: F.struct((s["at"] + F.length(p["before"]) + F.length(p["g0"])).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(p["before"]))).alias("starts")), lambda s: s["starts"],
    )
    return F.filter(F.arrays_zip(*(parts[f"g{g}"].alias(f"g{g}") for g in range(groups + 1)), placed.alias("start")), lambda p: p["start"].isNotNull())


def _entity(kind: str, name: Column, external: Column, surface: Column, start: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("canonical_name"), external.alias("external_id"), surface.alias("surface"), start.cast("long").alias("start_offset"), (start + F.length(surface)).cast("long").alias("end_offset"))


def _without_tracking(query: Column) -> Column:
    """The pairs of a query string that have a value and say something, encoded anew in their order."""
    decoded = lambda t: F.coalesce(F.try_url_decode(t), F.replace(t, F.lit("+"), F.lit(" ")))
    encoded = lambda t: F.replace(F.replace(F.url_encode(t), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v"), (F.instr(p, "=") > 0).alias("is_pair")))
    told = F.filter(pairs, lambda p: p["is_pair"] & (p["v"] != "") & ~F.lower(p["k"]).isin(ENTITY_TRACKING))
    return F.array_join(F.transform(told, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def pages(text: Column) -> Column:
    """Pages that a text names: a detector. Hosts with an open bracket are none."""

    def entity(m: Column) -> Column:
        surface = F.regexp_replace(m["g0"], ENTITY_JUNK, "")
        part = lambda i: F.regexp_extract(surface, r"^([^:]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
        host, query = F.lower(part(2)), _without_tracking(part(4))
        name = F.concat(F.lower(part(1)), F.lit("://"), host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return _entity("url", name, F.nullif(host, F.lit("")), surface, m["start"])

    return F.filter(F.transform(_found(text, ENTITY_URL, 0), entity), lambda e: ~F.coalesce(F.contains(e["external_id"], F.lit("[")), F.lit(False)))


def repositories(text: Column) -> Column:
    """Repositories that a text names: a detector."""

    def entity(m: Column) -> Column:
        name = F.regexp_replace(m["g2"], REPOSITORY_JUNK, "")
        surface = F.left(m["g0"], F.length(m["g0"]) - F.length(m["g2"]) + F.length(name))
        key = F.concat(F.lower(m["g1"]), F.lit("/"), F.lower(name))
        return _entity("repo", F.concat(F.lit("https://github.com/"), key), key, surface, m["start"])

    good = lambda e: ~F.substring_index(e["external_id"], "/", 1).isin(NO_ENTITY_OWNERS) & ~F.substring_index(e["external_id"], "/", -1).isin(["", *NO_NAMES])
    return F.filter(F.transform(_found(text, REPOSITORY, 2), entity), good)


#: From a text column to an array of kind, canonical_name, external_id, surface, start_offset, end_offset.
DETECTORS = (pages, repositories)


def mentions(units: DataFrame, detectors=DETECTORS) -> DataFrame:
    """unit_id, kind, canonical_name, external_id, surface, start_offset, end_offset of all that the detectors find.

    units: unit_id, text. Texts without a link are passed over before any pattern runs.
    """
    text = F.col("text")
    linked = units.where(text.rlike("(?i)https?://|github\\.com/")) if detectors is DETECTORS else units
    return linked.select("unit_id", F.explode(F.concat(*(d(text) for d in detectors))).alias("e")).select("unit_id", "e.*")


def entities(found: DataFrame) -> DataFrame:
    """kind, canonical_name, external_id of what is mentioned, each once."""
    return found.groupBy("kind", "canonical_name").agg(F.min("external_id").alias("external_id"))
