"""Timestamp parsing with provenance, and exchange-time helpers. All results are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "Asia/Kolkata"
OPEN_TIME = "09:15:00"
CLOSE_TIME = "15:30:00"
MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})(:\d{2})?(:\d{2}(?:\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
_MAIL = (
    r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"(?:\s+([+-]\d{4}|[A-Z]{1,3}))?$"
)
# Offsets (minutes) of the zone names a mail-style date may carry.
_ZONE_NAMES = {"GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
               "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def plus_days(ts: Column, days: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(int(round(days * MICROS_PER_DAY))), ts)


def plus_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(int(round(hours * MICROS_PER_HOUR))), ts)


def next_midnight(ts: Column) -> Column:
    return ntz(F.date_add(F.to_date(ts), 1))


def clock_precision(ts: Column) -> Column:
    """exact (seconds present) | minute | hour, from the clock fields of a timestamp."""
    return (
        F.when(F.extract(F.lit("SECOND"), ts) > 0, "exact")
        .when(F.minute(ts) > 0, "minute")
        .otherwise("hour")
    )


def stored_precision(ts: Column, provider: Column) -> Column:
    """Precision of a stored stamp. Search-feed stamps at exactly 07:00:00 are dates without a time."""
    seven = (F.hour(ts) == 7) & (F.minute(ts) == 0) & (F.extract(F.lit("SECOND"), ts) == 0)
    return (
        F.when(ts.isNull(), "unknown")
        .when((provider == "google_news_rss") & seven, "date_only")
        .otherwise(clock_precision(ts))
    )


def _offset_minutes(tz: Column) -> Column:
    digits = F.regexp_replace(F.substring(tz, 2, 6), ":", "")
    hours = F.substring(digits, 1, 2).cast("int")
    minutes = F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    named = F.lit(None).cast("int")
    for name, value in _ZONE_NAMES.items():
        named = F.when(tz == name, F.lit(value)).otherwise(named)
    signed = F.when(F.substring(tz, 1, 1) == "-", -(hours * 60 + minutes)).when(
        F.substring(tz, 1, 1) == "+", hours * 60 + minutes
    )
    return F.coalesce(signed, named)


def _zone_label(minutes: Column) -> Column:
    size = F.abs(minutes)
    label = F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.when(minutes == 0, "UTC").otherwise(label)


def parse_timestamp(value: Column, provider_timezone: Column | None = None) -> Column:
    """struct(utc, precision, timezone, tz_status, raw) of a textual timestamp.

    A value without an offset is stored as if UTC; it counts as documented only when the provider documents
    its zone, otherwise its status is ``unknown``. Nothing is ever upgraded.
    """
    documented = F.lit(None).cast("string") if provider_timezone is None else provider_timezone
    raw = F.nullif(F.trim(value), F.lit(""))
    part = lambda i: F.nullif(F.regexp_extract(raw, _ISO, i), F.lit(""))
    mail = lambda i: F.nullif(F.regexp_extract(raw, _MAIL, i), F.lit(""))

    iso_local = F.concat(part(1), F.lit(" "), part(2), F.coalesce(part(3), F.lit(":00")),
                         F.coalesce(part(4), F.lit(":00"))).try_cast("timestamp_ntz")
    iso_offset = _offset_minutes(part(5))
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(mail(2)))
    mail_local = F.concat(
        mail(3), F.lit("-"), F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lit("-"),
        F.lpad(mail(1), 2, "0"), F.lit(" "), F.lpad(mail(4), 2, "0"), F.lit(":"), mail(5), F.lit(":"),
        F.coalesce(mail(6), F.lit("00")),
    ).try_cast("timestamp_ntz")
    # "-0000" means "UTC, origin unknown".
    mail_offset = F.when(mail(7) != "-0000", _offset_minutes(mail(7)))

    is_date = raw.rlike(_DATE)
    date_value = ntz(raw.try_cast("date"))
    naive_status = F.when(documented.isNotNull(), "provider_documented").otherwise("unknown")
    shift = lambda ts, minutes: F.timestamp_add("MINUTE", -F.coalesce(minutes, F.lit(0)), ts)

    def info(utc, precision, zone, status):
        return F.struct(utc.alias("utc"), precision.alias("precision"), zone.cast("string").alias("timezone"),
                        status.alias("tz_status"), raw.alias("raw"))

    none = F.lit(None).cast("string")
    return (
        F.when(is_date & date_value.isNotNull(), info(date_value, F.lit("date_only"), documented, naive_status))
        .when(iso_local.isNotNull() & part(5).isNull(),
              info(iso_local, clock_precision(iso_local), documented, naive_status))
        .when(iso_local.isNotNull(),
              info(shift(iso_local, iso_offset), clock_precision(iso_local), _zone_label(iso_offset), F.lit("explicit")))
        .when(mail_local.isNotNull() & mail_offset.isNull(),
              info(mail_local, clock_precision(mail_local), none, F.lit("unknown")))
        .when(mail_local.isNotNull(),
              info(shift(mail_local, mail_offset), clock_precision(mail_local),
                   F.when(mail(7) == "GMT", "GMT").otherwise(_zone_label(mail_offset)), F.lit("explicit")))
        .otherwise(info(F.lit(None).cast("timestamp_ntz"), F.lit("unknown"), none, F.lit("unknown")))
    )


def parse_epoch(seconds: Column) -> Column:
    """Epoch seconds are exact and explicitly UTC."""
    utc = F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("bigint"),
                          F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.struct(utc.alias("utc"), F.lit("exact").alias("precision"), F.lit("UTC").alias("timezone"),
                    F.lit("explicit").alias("tz_status"), seconds.cast("string").alias("raw"))


def to_exchange_time(ts_utc: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc)


def exchange_date(ts_utc: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.to_date(to_exchange_time(ts_utc, zone))


def _session_instant(day: Column, clock: str, zone: str) -> Column:
    local = F.concat(day.cast("string"), F.lit(" " + clock)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def session_open(day: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return _session_instant(day, OPEN_TIME, zone)


def session_close(day: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return _session_instant(day, CLOSE_TIME, zone)
