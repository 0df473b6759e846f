"""Canonical URLs and URL hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters whose lower-cased name starts with one of these are tracking noise.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_", "ref", "cmpid", "ocid")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _form_decode(text: Column) -> Column:
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(text), plain)


def _form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no fragment, no tracking parameters; order kept."""
    clean = F.trim(url)
    part = lambda i: F.regexp_extract(clean, _PARTS, i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    path = F.coalesce(F.nullif(F.regexp_replace(part(3), "/+$", ""), F.lit("")), F.lit("/"))
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            _form_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)
