"""Title token sets, fingerprints and Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored in title token sets.
TITLE_STOP_WORDS = [
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "are", "at", "by", "with", "as", "from",
    "its", "it", "be", "this", "that", "after", "over",
]


def title_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9&]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOP_WORDS)))


def title_fingerprint(title: Column) -> Column:
    return F.array_join(F.array_sort(title_tokens(title)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two distinct-element arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))
