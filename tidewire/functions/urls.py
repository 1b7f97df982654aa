"""URL identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, by prefix and by name.
TRACKING_PREFIXES = ["utm_", "at_"]
TRACKING_NAMES = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "cmpid", "ncid", "ito", "sh", "smid"]


def _name(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def canonical_url(raw: Column) -> Column:
    """One spelling a document: no fragment, lower-case scheme and host, no default port, no tracking parameters, the others sorted by
    name (equal names keep their order), no slash at the end of a path; null for all but absolute http(s) URLs."""
    url = F.trim(raw)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    authority = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(_name(p)).isin(TRACKING_NAMES) & ~F.lower(_name(p)).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(_name(p).alias("name"), i.alias("at"), p.alias("pair"))))
    kept = F.array_join(F.transform(keyed, lambda x: x["pair"]), "&")
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    sound = scheme.isin("http", "https") & authority.rlike(r"^[^\s@]+$")
    return F.when(sound, whole)


def publisher_domain(url: Column) -> Column:
    """The host of a canonical URL, without ``www.`` and port."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), r":\d+$", ""), r"^www\.", "")


def related(a: Column, b: Column) -> Column:
    """Whether two domains are equal or one lies under the other, on a dot boundary."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def suffixes(domain: Column) -> Column:
    """A domain and all domains it lies under, longest first."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
