"""Trading calendars, as-of lookups and forecast horizons.

A calendar holds one entry per trading day (a century is about 25,000), so it is kept as a small local
relation. Every as-of lookup (sessions, cut-offs) becomes a plain equi-join of the data with a per-day spine:
no inequality join, no sort of the data, no shuffle of the big side.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import session_close, session_open
from tidemark.session import local_frame

#: Upper bound on calendar entries (days); anything longer is not a calendar.
MAX_ENTRIES = 100_000
_DAY = dt.timedelta(days=1)


def _days(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def _bounded_rows(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"{what} has more than {MAX_ENTRIES} entries")
    return rows


@dataclass(frozen=True)
class Calendar:
    """Ordered trading sessions. ``reliable_until`` separates published sessions from projected ones (None: all projected)."""

    spark: SparkSession
    sessions: tuple
    source: str = "price-data"
    reliable_until: dt.date | None = None

    @classmethod
    def observed(cls, bars: DataFrame, date_col: str = "date") -> Calendar:
        """Sessions on which any instrument traded (distinct dates; aggregated before they reach the driver)."""
        rows = _bounded_rows(bars.select(F.col(date_col).alias("d")).where("d is not null").distinct(), "calendar")
        sessions = tuple(sorted(r["d"] for r in rows))
        return cls(bars.sparkSession, sessions, "price-data", sessions[-1] if sessions else None)

    @classmethod
    def weekdays(cls, spark: SparkSession, start: dt.date, end: dt.date, reliable_until: dt.date | None = None) -> Calendar:
        return cls(spark, tuple(d for d in _days(start, end) if d.weekday() < 5), "weekdays-only", reliable_until)

    @property
    def first(self) -> dt.date:
        return self.sessions[0]

    @property
    def last(self) -> dt.date:
        return self.sessions[-1]

    def frame(self) -> DataFrame:
        """session, idx, open_utc, close_utc, projected"""
        limit = self.reliable_until
        rows = [(d, i, limit is None or d > limit) for i, d in enumerate(self.sessions)]
        df = local_frame(self.spark, rows, "session date, idx int, projected boolean")
        return df.select("session", "idx", session_open(F.col("session")).alias("open_utc"),
                         session_close(F.col("session")).alias("close_utc"), "projected")

    def spine(self) -> DataFrame:
        """One row per calendar day: neighbouring sessions and the number of sessions up to the day."""
        s = self.sessions
        rows = []
        for d in _days(self.first, self.last):
            i, j = bisect_right(s, d), bisect_left(s, d)
            rows.append((d, i, s[i - 1], s[j], s[j - 1] if j else None))
        return local_frame(
            self.spark, rows, "day date, sessions_to_date int, on_or_before date, on_or_after date, previous_session date")

    def lookup(self, df: DataFrame, date: Column, *columns: str, prefix: str = "") -> DataFrame:
        """Attach spine columns for a date; dates outside the calendar resolve as the bounds allow."""
        key = F.least(F.greatest(date, F.lit(self.first)), F.lit(self.last))
        spine = self.spine().select(F.col("day").alias("_spine_day"), *[F.col(c).alias("_spine_" + c) for c in columns])
        out = df.withColumn("_day", key).withColumn("_date", date)
        out = out.join(F.broadcast(spine), F.col("_day") == F.col("_spine_day"), "left")
        before, after = F.col("_date") < F.lit(self.first), F.col("_date") > F.lit(self.last)
        values = {
            "on_or_before": F.when(~before, F.col("_spine_on_or_before")),
            "on_or_after": F.when(~after, F.col("_spine_on_or_after")),
            "previous_session": F.when(after, F.lit(self.last)).when(~before, F.col("_spine_previous_session")),
            "sessions_to_date": F.when(before, 0).otherwise(F.col("_spine_sessions_to_date")),
        }
        return out.select(*df.columns, *[values[c].alias(prefix + c) for c in columns])

    def grid(self) -> CutoffGrid:
        """One cut-off per session that has a predecessor: its open, with the previous open as window start."""
        frame = self.frame().orderBy("session").collect()
        rows = [(b["session"], b["open_utc"], a["open_utc"]) for a, b in zip(frame, frame[1:])]
        return CutoffGrid(self.spark, tuple(rows))

    def next_session(self, df: DataFrame, ts: Column, out: str = "session") -> DataFrame:
        """First session whose open is at or after ``ts`` (equality counts); null when the calendar ends."""
        opens = self.frame().orderBy("session").collect()
        table = CutoffGrid(self.spark, tuple((r["session"], r["open_utc"], r["open_utc"]) for r in opens))
        return table.attach_session(df, ts, out)


@dataclass(frozen=True)
class CutoffGrid:
    """Ordered information cut-offs: (session, as_of, window_start), addressed by dense position."""

    spark: SparkSession
    rows: tuple

    @classmethod
    def single(cls, spark: SparkSession, session: dt.date, as_of: dt.datetime, window_start: dt.datetime) -> CutoffGrid:
        return cls(spark, ((session, as_of, window_start),))

    def where(self, sessions) -> CutoffGrid:
        wanted = set(sessions)
        return CutoffGrid(self.spark, tuple(r for r in self.rows if r[0] in wanted))

    def between(self, start: dt.date, end: dt.date, step: int = 1) -> CutoffGrid:
        """Evaluation dates: sessions in [start, end], every ``step``-th."""
        inside = [r for r in self.rows if start <= r[0] <= end]
        return CutoffGrid(self.spark, tuple(inside[:: max(1, step)]))

    def __len__(self) -> int:
        return len(self.rows)

    def frame(self) -> DataFrame:
        rows = [(i, s, a, w) for i, (s, a, w) in enumerate(self.rows)]
        return local_frame(
            self.spark, rows, "pos int, session date, as_of timestamp_ntz, window_start timestamp_ntz")

    def _stops(self, by: str) -> list[dt.datetime]:
        return [r[1] if by == "as_of" else r[2] for r in self.rows]

    def position(self, df: DataFrame, ts: Column, out: str, by: str = "as_of", strict: bool = False) -> DataFrame:
        """Add ``out``: the first position whose ``by`` instant is >= ts (> ts when strict), ``len`` when none."""
        stops = self._stops(by)
        if stops != sorted(stops):
            raise ValueError("cut-offs must be ordered")
        by_day: dict[dt.date, list] = {}
        for s in stops:
            by_day.setdefault(s.date(), []).append(s)
        rows, seen = [], 0
        for d in _days(stops[0].date(), stops[-1].date()):
            rows.append((d, seen, by_day.get(d, [])))
            seen += len(by_day.get(d, []))
        spine = local_frame(self.spark, rows, "_d date, _seen int, _stops array<timestamp_ntz>")
        first, last = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in (stops[0], stops[-1]))
        passed = (lambda c: c <= F.col("_ts")) if strict else (lambda c: c < F.col("_ts"))
        position = (
            F.when(F.col("_ts").isNull(), F.lit(None).cast("int"))
            .when(F.col("_ts") < first, 0)
            .when(F.col("_ts") > last, len(stops))
            .otherwise(F.col("_seen") + F.size(F.filter("_stops", passed)))
        )
        return (
            df.withColumn("_ts", ts)
            .join(F.broadcast(spine), F.to_date("_ts") == F.col("_d"), "left")
            .select(*df.columns, position.alias(out))
        )

    def attach_session(self, df: DataFrame, ts: Column, out: str) -> DataFrame:
        located = self.position(df, ts, "_pos")
        names = self.frame().select(F.col("pos").alias("_p"), F.col("session").alias(out))
        return located.join(F.broadcast(names), F.col("_pos") == F.col("_p"), "left").select(*df.columns, out)


def quarter_label(day: Column, convention: str = "indian_fy") -> Column:
    """Q3 FY27 (April-March year, named by its end) or Q3 2026 (calendar year) of a quarter-end date."""
    month, year = F.month(day), F.year(day)
    if convention == "calendar":
        return F.concat(F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string"), F.lit(" "), year.cast("string"))
    quarter = F.when(month <= 3, 4).otherwise(F.floor(month / 3).cast("int") - 1)
    fiscal = year + F.when(month >= 4, 1).otherwise(0)
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" FY"), F.lpad((fiscal % 100).cast("string"), 2, "0"))


def horizons(dates: DataFrame, calendar: Calendar, convention: str = "indian_fy", n_months: int = 3,
             n_quarters: int = 6, day: str = "day", calendar_today: str | None = None) -> DataFrame:
    """Forecast targets per date: the session itself, the next month-ends and the next quarter-ends.

    Target = last session on or before the nominal date and after the current session. A calendar that ends
    early yields fewer horizons.
    """
    base = calendar.lookup(dates, F.col(day), "on_or_after", prefix="_t_")
    base = base.withColumnRenamed("_t_on_or_after", "session")
    base = calendar.lookup(base, F.col("session"), "previous_session", "sessions_to_date", prefix="_b_")
    base = base.withColumn("_base_idx", F.col("_b_sessions_to_date") - 1)
    shown = F.col(calendar_today) if calendar_today else F.col(day)
    keys = [c for c in dates.columns]

    today = base.select(
        *keys, "session", F.lit("today").alias("horizon_type"),
        F.when(F.col("session") == shown, "Today").otherwise(F.concat(F.lit("Next session "), F.col("session").cast("string")))
        .alias("horizon_label"), F.col("session").alias("calendar_date"), F.col("session").alias("target_date"),
        F.lit(1).alias("trading_days_ahead"), F.lit(0).alias("_k"))

    steps = max(n_months + 2, 3 * n_quarters + 3)
    months = base.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "nominal", F.last_day(F.add_months(F.trunc(F.col(day), "month"), F.col("_k"))))
    months = calendar.lookup(months, F.col("nominal"), "on_or_before", "sessions_to_date", prefix="_n_")
    months = months.where(F.col("_n_on_or_before") > F.col("session"))

    def pick(df, kind, label, limit):
        # The k-th next period end is found by counting, per input date, the at most `steps` candidates.
        ranked = df.groupBy(*keys, "session").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("_k", "nominal", "_n_on_or_before", "_n_sessions_to_date", "_base_idx"))),
                    1, limit).alias("_ends"))
        ends = ranked.select(*keys, "session", F.explode("_ends").alias("_e"))
        return ends.select(
            *keys, "session", F.lit(kind).alias("horizon_type"), label(F.col("_e.nominal")).alias("horizon_label"),
            F.col("_e.nominal").alias("calendar_date"), F.col("_e._n_on_or_before").alias("target_date"),
            F.greatest(F.lit(1), F.col("_e._n_sessions_to_date") - F.col("_e._base_idx")).alias("trading_days_ahead"),
            F.col("_e._k").alias("_k"))

    month_end = pick(months.where(F.col("_k") < n_months + 2), "month_end",
                     lambda d: F.concat(F.date_format(d, "MMM yyyy"), F.lit(" month-end")), n_months)
    quarter_end = pick(months.where((F.month("nominal") % 3 == 0) & (F.col("_k") < 3 * n_quarters + 3)), "quarter_end",
                       lambda d: F.concat(quarter_label(d, convention), F.lit(" end")), n_quarters)
    limit = calendar.reliable_until
    projected = F.lit(True) if limit is None else F.col("target_date") > F.lit(limit)
    return today.unionByName(month_end).unionByName(quarter_end).drop("_k").withColumn("projected_calendar", projected)
