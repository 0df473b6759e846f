"""Stored articles: availability annotation, audits, point-in-time eligibility, lookups and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import availability as av
from tidemark.functions.timestamps import session_close, session_open, stored_precision, to_exchange_time
from tidemark.operators.calendar import Calendar, CutoffGrid
from tidemark.session import spread

NONE_ENTITY = "NONE"


def complete_provenance(news: DataFrame) -> DataFrame:
    """Derive precision and zone status of rows stored without them (or with the legacy precision ``coarse``)."""
    legacy = F.col("timestamp_precision").isNull() | (F.col("timestamp_precision") == "coarse")
    return news.withColumn(
        "timestamp_precision", F.when(legacy, stored_precision(F.col("published_at"), F.col("provider"))).otherwise(F.col("timestamp_precision"))
    ).withColumn("timezone_status", F.coalesce("timezone_status", F.when(F.col("provider") == "google_news_rss", "explicit").otherwise("unknown")))


def annotate(news: DataFrame, calendar: Calendar) -> DataFrame:
    """Add available_at, first_usable_session, availability_status and exchange-time display columns."""
    base = complete_provenance(news)
    base = base.withColumn("available_at", av.available_at(
        F.col("published_at"), F.col("timestamp_precision"), F.col("fetched_at"), F.col("timezone_status")))
    located = calendar.next_session(base, F.col("available_at"), "first_usable_session")
    s = F.col("first_usable_session")
    return located.withColumn("availability_status", av.article_status(
        F.col("fetched_at"), session_open(s), session_close(s), F.col("timestamp_precision"), F.col("timezone_status"))).withColumns({
            "published_at_local": to_exchange_time(F.col("published_at")), "fetched_at_local": to_exchange_time(F.col("fetched_at"))})


def needs_annotation(news: DataFrame) -> DataFrame:
    """Rows an incremental audit has to (re)derive."""
    return news.where(F.col("availability_status").isNull() | F.col("first_usable_session").isNull() | (F.col("timestamp_precision") == "coarse"))


def reannotate(news: DataFrame, calendar: Calendar, everything: bool = False) -> DataFrame:
    derived = ["available_at", "first_usable_session", "availability_status", "published_at_local", "fetched_at_local"]
    present = [c for c in derived if c in news.columns]
    if everything:
        return annotate(news.drop(*present), calendar)
    todo = needs_annotation(news)
    done = news.join(todo.select("news_id"), "news_id", "left_anti")
    return done.unionByName(annotate(todo.drop(*present), calendar), allowMissingColumns=True)


def eligibility_at(items: DataFrame, grid: CutoffGrid) -> DataFrame:
    """(session, eligibility, n): how many items fall in each class at each cut-off.

    Over time an item is post_cutoff, then timestamp_before / uncertain, then verified. Each stretch is counted as +1 where
    it starts and -1 where it ends; running sums over the calendar give every cut-off, so no item meets a cut-off.
    """
    published, precision, zone, fetched = (F.col(c) for c in ("provider_published_at", "timestamp_precision", "timezone_status", "fetched_at"))
    base = spread(items).select("provider_published_at", "timestamp_precision", "timezone_status", "fetched_at")
    base = base.withColumn("_a1", av.provider_available_at(published, precision, zone)).withColumn(
        "_middle", F.when(av.is_precise(precision, zone), "timestamp_before").otherwise("uncertain"))
    base = grid.position(grid.position(base, fetched, "_pf"), F.col("_a1"), "_pa")
    n = F.lit(len(grid))
    held, first = F.coalesce("_pf", n), F.least(F.coalesce("_pf", n), F.col("_pa"))
    stretch = lambda name, lo, hi: F.struct(name.alias("eligibility"), lo.alias("lo"), hi.alias("hi"))
    stretches = F.array(stretch(F.lit("post_cutoff"), F.lit(0), first), stretch(F.col("_middle"), first, held), stretch(F.lit("verified"), held, n))
    grains = base.withColumn("_s", F.explode(stretches)).groupBy("_s.eligibility", "_s.lo", "_s.hi").agg(F.count("*").alias("n")).where("lo < hi")
    edges = grains.select("eligibility", F.col("lo").alias("pos"), "n").unionByName(grains.select("eligibility", F.col("hi").alias("pos"), (-F.col("n")).alias("n")))
    steps = edges.groupBy("eligibility", "pos").agg(F.sum("n").alias("n"))
    classes = grid.frame().select("pos", "session", F.explode(F.array(*[F.lit(e) for e in av.ELIGIBILITY])).alias("eligibility"))
    running = Window.partitionBy("eligibility").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = classes.join(steps, ["eligibility", "pos"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(running))
    return filled.where("n > 0").select("session", "eligibility", "n")


def apply_policy(items: DataFrame, cutoff, policy: str) -> DataFrame:
    """Items usable at one cut-off under a policy."""
    cls = av.eligibility(F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), cutoff)
    return items.where(F.col("available_at") <= cutoff).withColumn("eligibility", cls).where(F.col("eligibility").isin(*av.POLICIES[policy]))


def _quality(*keys: str) -> list:
    n = F.count("*")
    share = lambda c: F.round(F.try_divide(c, n), 4)
    duplicate, zone = F.count_if(F.col("duplicate_of").isNotNull()), F.count_if(F.col("timezone_status") == "unknown")
    cols = [n.alias("articles"), duplicate.alias("duplicates"), share(duplicate).alias("duplicate_rate"), zone.alias("timezone_unknown")]
    for p in av.PRECISIONS:
        hits = F.count_if(F.coalesce("timestamp_precision", F.lit("unknown")) == p)
        cols += [hits.alias(f"precision_{p}"), share(hits).alias(f"precision_{p}_share")]
    for s in av.STATUSES:
        cols.append(F.count_if(F.coalesce("availability_status", F.lit("unknown")) == s).alias(f"status_{s}"))
    for s, name in (("verified_pre_market", "verified_share"), ("unknown", "unknown_share"), ("collected_after_event", "post_event_share")):
        cols.append(share(F.count_if(F.coalesce("availability_status", F.lit("unknown")) == s)).alias(name))
    return cols


def audit_by_provider(news: DataFrame) -> DataFrame:
    """Overall and per-provider quality blocks from a single pass (provider ALL = overall)."""
    grouped = news.groupingSets([[], [F.col("provider")]], F.col("provider")).agg(*_quality(), F.grouping("provider").alias("_g"))
    return grouped.withColumn("provider", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("provider"))).drop("_g")


def audit_with_rejects(audit: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Add collection rejects; providers seen on only one side stay."""
    rejects = fetch_log.groupBy("provider").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in (
        "rejected_future", "rejected_missing_timestamp", "rejected_invalid", "duplicates_at_collection", "fetched")])
    return audit.join(rejects, "provider", "full_outer")


def audit_by_company(news: DataFrame, analysis: DataFrame, engine: str) -> DataFrame:
    current = analysis.where((F.col("engine") == engine) & (F.col("entity") != NONE_ENTITY)).select("news_id", "entity")
    joined = current.join(news.select("news_id", F.coalesce("availability_status", F.lit("unknown")).alias("s")), "news_id")
    return joined.groupBy("entity").agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == s).alias(s) for s in av.STATUSES])


def audit_by_date(news: DataFrame, live_sessions: DataFrame | None = None) -> DataFrame:
    """Per first usable session; flags sessions for which a live prediction exists."""
    rows = news.where(F.col("first_usable_session").isNotNull()).groupBy(F.col("first_usable_session").alias("session")).agg(
        *[F.count_if(F.coalesce("availability_status", F.lit("unknown")) == s).alias(s) for s in av.STATUSES])
    if live_sessions is None:
        return rows
    live = live_sessions.select("session").distinct().withColumn("live_prediction", F.lit(True))
    return rows.join(live, "session", "left").withColumn("live_prediction", F.coalesce("live_prediction", F.lit(False)))


def article_stats(news: DataFrame, analysis: DataFrame) -> DataFrame:
    """(kind, name, n): counts by entity, availability status and precision."""
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(analysis, "entity", "entity").unionByName(by(news, "status", "availability_status")).unionByName(by(news, "precision", "timestamp_precision"))


def window_quality(news: DataFrame, start, end) -> DataFrame:
    """Data-quality summary of [start, end] by published_at. Coarse counts date-only and hour stamps."""
    rows = news.where(F.col("published_at").between(start, end))
    n = F.count("*")
    return rows.agg(
        n.alias("articles"), *[F.count_if(F.coalesce("availability_status", F.lit("unknown")) == s).alias(s) for s in av.STATUSES],
        F.count_if(F.col("timestamp_precision").isin("date_only", "hour")).alias("coarse_timestamps"),
        F.round(F.try_divide(F.count_if(F.col("duplicate_of").isNotNull()), n), 4).alias("duplicate_rate"), F.min("fetched_at").alias("first_fetched_at"))


def item_quality(items: DataFrame, start, end) -> DataFrame:
    rows = items.where(F.col("available_at").between(start, end))
    return rows.agg(F.count("*").alias("relevant_analyses"), F.count_if("price_report").alias("price_reports"))


def replay_input_summary(news: DataFrame, items: DataFrame) -> DataFrame:
    """#articles, #clusters, backfilled share of the articles behind the items."""
    used = news.join(items.select("news_id").distinct(), "news_id", "left_semi")
    return used.agg(F.count("*").alias("articles"), F.countDistinct(F.coalesce("duplicate_of", "news_id")).alias("clusters"),
                    F.round(F.avg(F.col("backfilled").cast("double")), 6).alias("backfilled_share"))


def build_items(news: DataFrame, analysis: DataFrame, engine: str, since=None, until=None) -> DataFrame:
    """Scored facts of one engine with their availability. The stamp filter prunes partitions; the exact filter follows."""
    stored = complete_provenance(news)
    if until is not None:
        stored = stored.where(F.col("published_at") <= until)
    if since is not None:
        stored = stored.where(F.col("published_at") >= F.timestamp_add("DAY", F.lit(-1), since))
    stored = stored.withColumn("available_at", av.available_at(
        F.col("published_at"), F.col("timestamp_precision"), F.col("fetched_at"), F.col("timezone_status")))
    if until is not None:
        stored = stored.where(F.col("available_at") <= until)
    if since is not None:
        stored = stored.where(F.col("available_at") >= since)
    facts = analysis.where((F.col("engine") == engine) & (F.col("entity") != NONE_ENTITY))
    return facts.join(stored.withColumnRenamed("published_at", "provider_published_at"), "news_id").withColumn(
        "cluster_id", F.coalesce("duplicate_of", "news_id"))


def find_articles(news: DataFrame, analysis: DataFrame, engine: str, ticker: str | None = None, start=None, end=None,
                  include_irrelevant: bool = False, limit: int = 100) -> DataFrame:
    """Newest articles with their analyses nested; only the selected page is joined."""
    rows = news
    if start is not None:
        rows = rows.where(F.col("published_at") >= start)
    if end is not None:
        rows = rows.where(F.col("published_at") <= end)
    current = analysis.where(F.col("engine") == engine)
    if ticker is not None:
        rows = rows.join(current.where(F.col("entity") == ticker).select("news_id"), "news_id", "left_semi")
    elif not include_irrelevant:
        rows = rows.join(current.where(F.col("entity") != NONE_ENTITY).select("news_id"), "news_id", "left_semi")
    page = rows.orderBy(F.desc("published_at"), "news_id").limit(limit)
    # At most `limit` articles are nested, so broadcasting the page keeps the analysis table in place.
    nested = current.join(F.broadcast(page.select("news_id")), "news_id").groupBy("news_id").agg(
        F.sort_array(F.collect_list(F.struct("entity", "category", "relevance", "sentiment"))).alias("analyses"))
    return page.join(nested, "news_id", "left").orderBy(F.desc("published_at"), "news_id")


def leakage_violations(evidence: DataFrame) -> DataFrame:
    """Evidence rows that could not have been known: available after the cut-off, or verified but fetched too late."""
    late = F.col("available_at") > F.col("cutoff")
    unheld = (F.col("eligibility") == "verified") & (F.col("fetched_at").isNull() | (F.col("fetched_at") > F.least("as_of", "cutoff")))
    return evidence.withColumn("violation", F.when(late, "available_after_cutoff").when(unheld, "verified_but_not_held")).where(F.col("violation").isNotNull())


# Outcome columns that must never reach an evidence payload.
OUTCOME_COLUMNS = frozenset(
    "actual actual_close actual_close_date actual_movement actual_movement_percent actual_return actual_direction error abs_error squared_error "
    "direction_correct".split())


def outcome_columns(df: DataFrame) -> list[str]:
    """Outcome fields in a schema, at any depth; an evidence table must have none."""
    found: list[str] = []

    def walk(dtype):
        for f in getattr(dtype, "fields", []):
            if f.name in OUTCOME_COLUMNS:
                found.append(f.name)
            walk(f.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(dtype, inner):
                walk(getattr(dtype, inner))

    walk(df.schema)
    return found


def run_summaries(items: DataFrame, grid: CutoffGrid) -> DataFrame:
    """(pos, session, as_of, loaded, used_<policy>, excluded_<policy>): what a run at every cut-off loads, and what each policy lets it use.

    An item is loaded from its available_at on and used from the first cut-off at which it is visible as well, so both are running sums over
    counts per position; only those counts, bounded by the calendar, are laid over the cut-offs.
    """
    kinds = ["loaded", *av.POLICIES]
    out = grid.position(items, F.col("available_at"), "p_loaded")
    for policy in av.POLICIES:
        seen = av.visible_at(F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), policy)
        out = grid.position(out, seen, f"p_{policy}").withColumn(f"p_{policy}", F.when(F.col(f"p_{policy}").isNotNull(), F.greatest(f"p_{policy}", "p_loaded")))
    first = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p_{k}").alias("pos")) for k in kinds]))
    counts = out.select(first.alias("f")).where("f.pos IS NOT NULL").groupBy("f.kind", "f.pos").agg(F.count("*").alias("n"))
    spine = grid.frame().select("pos", "session", "as_of", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    upto = Window.partitionBy("kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = spine.join(counts, ["kind", "pos"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    wide = running.groupBy("pos", "session", "as_of").pivot("kind", kinds).agg(F.first("n"))
    return wide.select("pos", "session", "as_of", "loaded", *[F.col(k).alias(f"used_{k}") for k in av.POLICIES], *[(F.col("loaded") - F.col(k)).alias(f"excluded_{k}") for k in av.POLICIES])
