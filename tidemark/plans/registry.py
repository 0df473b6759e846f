"""All registered queries and their SQL checks."""

from __future__ import annotations

from tidemark.plans import article_queries, ingest_queries, market_queries, news_queries, stream_queries, study_queries

MODULES = [news_queries, study_queries, article_queries, market_queries, stream_queries, ingest_queries]


def _merge(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(module, attribute)
        if set(part) & set(out):
            raise ValueError(f"duplicate names in {module.__name__}")
        out.update(part)
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracles() -> dict:
    return _merge("ORACLES")
