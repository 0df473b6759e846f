"""Headlines that merely report a price move already contained in the previous close."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9\-'&]*)"), F.lit(1))


def price_report(title: Column, move_words=None, fundamental_nouns=None, price_level: str | None = None,
                 magnitude: str | None = None) -> Column:
    """True when a price level, or a sized move, is not about a fundamental quantity named just before it."""
    moves = list(move_words or lx.MOVE_WORDS)
    nouns = list(fundamental_nouns or lx.FUNDAMENTAL_NOUNS)
    level = price_level or lx.PRICE_LEVEL
    size = magnitude or lx.MAGNITUDE

    def decide(words: Column) -> Column:
        def fundamental_before(i: Column) -> Column:
            start = F.greatest(i - 4, F.lit(0))
            return F.exists(F.slice(words, start + 1, i - start), lambda t: t.isin(nouns))

        prefix = F.regexp_extract(title, rf"(?is)^(.*?)(?:{level})", 1)
        level_report = title.rlike(f"(?i)(?:{level})") & ~fundamental_before(F.size(_words(prefix)))
        indexed = F.filter(F.transform(words, lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
                           lambda x: x["t"].isin(moves))
        move_report = title.rlike(size) & F.exists(indexed, lambda x: ~fundamental_before(x["i"]))
        return level_report | move_report

    return F.transform(F.array(_words(title)), decide).getItem(0)
