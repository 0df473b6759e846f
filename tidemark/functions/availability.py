"""When could an article have been used? Column expressions for availability and eligibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timestamps import next_midnight, plus_hours

STATUSES = ("verified_pre_market", "published_before_cutoff", "collected_after_event", "unknown")
PRECISIONS = ("exact", "minute", "hour", "date_only", "unknown")
ELIGIBILITY = ("verified", "timestamp_before", "post_cutoff", "uncertain")
# Eligibility classes each availability policy may use.
POLICIES = {
    "verified": ("verified",),
    "exact_timestamp": ("verified", "timestamp_before"),
    "provider_timestamp": ("verified", "timestamp_before", "uncertain"),
}


def is_precise(precision: Column, tz_status: Column) -> Column:
    return precision.isin("exact", "minute", "hour") & (F.coalesce(tz_status, F.lit("")) != "unknown")


def provider_available_at(published: Column, precision: Column, tz_status: Column) -> Column:
    """Earliest use implied by the provider stamp alone, read conservatively."""
    coarse = precision.isin("date_only", "unknown") | (F.coalesce(tz_status, F.lit("")) == "unknown")
    return F.when(coarse, next_midnight(published)).when(precision == "hour", plus_hours(published, 1)).otherwise(published)


def available_at(published: Column, precision: Column, fetched: Column, tz_status: Column) -> Column:
    return F.least(provider_available_at(published, precision, tz_status), fetched)


def eligibility(published: Column, precision: Column, tz_status: Column, fetched: Column, cutoff: Column) -> Column:
    before = provider_available_at(published, precision, tz_status) <= cutoff
    return (
        F.when(fetched <= cutoff, "verified")
        .when(~before, "post_cutoff")
        .when(is_precise(precision, tz_status), "timestamp_before")
        .otherwise("uncertain")
    )


def visible_at(published: Column, precision: Column, tz_status: Column, fetched: Column, policy: str) -> Column:
    """First instant from which an item is both available and eligible under ``policy``.

    Eligibility only ever improves as the cut-off moves forward, so "eligible at cut-off C" is exactly
    ``visible_at <= C``: one column replaces an items x cut-offs evaluation. Null means never.
    """
    provider = provider_available_at(published, precision, tz_status)
    if policy == "verified":
        return fetched
    if policy == "exact_timestamp":
        return F.when(is_precise(precision, tz_status), F.least(provider, fetched)).otherwise(fetched)
    if policy == "provider_timestamp":
        return F.least(provider, fetched)
    raise ValueError(f"unknown availability policy {policy!r}")


def article_status(fetched: Column, opens: Column, closes: Column, precision: Column, tz_status: Column) -> Column:
    """Article-level class relative to its first usable session (null session -> unknown)."""
    return (
        F.when(fetched.isNull() | opens.isNull(), "unknown")
        .when(fetched <= opens, "verified_pre_market")
        .when(~is_precise(precision, tz_status), "unknown")
        .when(fetched <= closes, "published_before_cutoff")
        .otherwise("collected_after_event")
    )
