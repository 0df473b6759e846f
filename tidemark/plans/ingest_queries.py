"""Registered queries: feed parsing, storage and maintenance over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import articles as art
from tidemark.operators import entities, market, patterns, report, snapshots
from tidemark.operators import universe as uni
from tidemark.params import default_params
from tidemark.plans import article_queries as aq
from tidemark.session import ensure_checkpoint_dir, local_frame
from tidemark.sources import bars, feeds
from tidemark.sources import bench_views as v

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_LO, _HI = "2024-01-05 00:00:00", "2024-01-20 03:45:00"
_MACRO = ["repo rate decision", "monsoon outlook"]


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the text of a feed item, parsed by the XML functions."""
    e = F.col("event_id")
    stamp = F.when(e % 13 == 0, F.lit("soon")).when(e % 9 == 0, F.date_format("ts", "EEE, dd MMM yyyy '07:00:00 GMT'")).otherwise(
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    source = F.when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Wire "), (F.col("user_id") % 6).cast("string")))
    title = F.concat("event_type", F.lit(" &amp; co "), e.cast("string"), F.when(e % 2 == 0, F.concat(F.lit(" - "), source)).otherwise(F.lit("")))
    text = F.concat(F.lit("<item>"), tag("title", title), tag("link", F.concat(F.lit(" http://x.example/"), e.cast("string"))), tag("pubDate", stamp),
                    tag("guid", F.when(e % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("g"), e.cast("string")))),
                    tag("description", F.concat(F.lit("&lt;p&gt;Up &amp;amp; "), "event_type", F.lit(" &lt;/p&gt;"))), tag("source", source), F.lit("</item>"))
    parsed = F.from_xml(text, schemas.FEED_ITEM)
    # the generator keeps a condition on one field from parsing the text once more
    return v.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id").select(F.explode(F.array(parsed)).alias("i")).select("i.*")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source", "title", "url", F.date_format("published_at", _STAMP).alias("published_at"), "summary", "provider_article_id", "published_raw",
                     "published_timezone", "timezone_status", "timestamp_precision")


def search_feed_items(spark, sf_dir):
    """Search-feed items of a window, publisher suffix removed."""
    return _shown(feeds.search_feed(_items(spark, sf_dir), _ntz(_LO), _ntz(_HI)))


def publisher_feed_items(spark, sf_dir):
    """Publisher-feed items, HTML cleaned, guid or link as the id."""
    return _shown(feeds.publisher_feed(_items(spark, sf_dir), "Daily"))


def json_feed_items(spark, sf_dir):
    """The three JSON shapes, one article a payload."""
    e = F.col("event_id")
    n, iso = e.cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(e % 3 == 2, F.to_json(F.struct(F.array(F.struct(
        F.lit("").alias("source"), F.concat("event_type", n).alias("title"), F.concat(F.lit("http://m/"), n).alias("url"), iso.alias("published_at"),
        F.lit("").alias("description"), F.col("event_type").alias("snippet"), F.concat(F.lit("u"), n).alias("uuid"))).alias("data")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(
            F.struct(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("name")).alias("source"), F.concat("event_type", n).alias("title"),
            F.concat(F.lit("http://n/"), n).alias("url"), iso.alias("publishedAt"), F.col("event_type").alias("description"),
            F.when(e % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("i"), n)).alias("id"))).alias("articles"))))
    payloads = v.table(spark, sf_dir, "events").select((e % 3).alias("k"), F.from_json(text, schemas.JSON_PAYLOAD).alias("p")).select("k", "p.*")
    parts = [feeds.json_articles(payloads.where(F.col("k") == k), p) for k, p in enumerate(("newsapi", "gnews", "marketaux"))]
    return feeds.union_sources(*parts).select("provider", "source", "title", "url", F.date_format("published_at", _STAMP).alias("published_at"), "summary",
                                              "provider_article_id", "timezone_status")


def query_list(spark, sf_dir):
    """I8: one query per supplier (as companies) and the market-wide ones."""
    n = v.table(spark, sf_dir, "supplier")
    catalog = n.select(F.col("s_name").alias("name"), F.when(n.s_suppkey % 2 == 0, F.array(F.lower("s_name"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return feeds.query_list(catalog, _MACRO)


def first_seen_urls(spark, sf_dir):
    """First page of every address in page order."""
    p = v.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.regexp_replace("url", r"\d+", "0")).alias("url"))
    return feeds.first_seen(p, "page_id")


def bars_ingest(spark, sf_dir):
    """Bars delivered as CSV files, read with their schema; those without a positive close are dropped."""
    o = v.table(spark, sf_dir, "orders")
    prices = o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        F.min("o_orderkey").cast("double").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("close"),
        F.count("*").cast("double").alias("volume"))
    folder = f"{ensure_checkpoint_dir(spark)}/bars-{uuid.uuid4().hex}"
    prices.withColumn("close", F.when(F.dayofmonth("date") % 7 == 0, 0.0).otherwise(F.col("close"))).write.option("header", "true").csv(folder)
    return market.validate_bars(bars.read_bars(spark, folder, "csv")).groupBy("ticker").agg(
        F.count("*").alias("bars"), F.sum("volume").cast("bigint").alias("volume"), F.min("date").alias("first_date"), F.max("high").alias("high"))


def bars_stored(spark, sf_dir):
    """Two deliveries stored by year, the later one replacing what it brings anew."""
    base = v.order_bars(spark, sf_dir).select("ticker", "date", F.round("close", 4).alias("close"))
    folder = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    bars.store_bars(base.withColumn("fetched_at", _ntz("2024-01-01 00:00:00")), folder)
    bars.store_bars(base.where("year(date) = 1997 AND day(date) < 10").withColumn("close", F.lit(1.5)).withColumn("fetched_at", _ntz("2024-02-01 00:00:00")), folder)
    return bars.stored_bars(spark, folder).groupBy("ticker", F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("bars"), F.count_if(F.col("close") == 1.5).alias("replaced"))


def closes_range(spark, sf_dir):
    """I15."""
    return market.closes(v.order_bars(spark, sf_dir), ["1-URGENT", "3-MEDIUM"], "1996-02-01", "1997-01-31").select("ticker", "date", F.round("close", 6).alias("close"))


def replay_price_window(spark, sf_dir):
    """Bars held for a replay of one quarter, per ticker."""
    w = market.price_window(v.order_bars(spark, sf_dir), F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date"))
    return w.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"))


def new_bars(spark, sf_dir):
    """Bars of a delivery that are not stored yet."""
    held = v.order_bars(spark, sf_dir)
    return market.new_bar_count(held.where("day(date) % 3 = 0"), held.where("day(date) % 2 = 0"))


def reannotated(spark, sf_dir):
    """Rows with gaps are derived again, the others stay as stored."""
    full = art.annotate(v.news(spark, sf_dir), aq.stream_calendar(spark, sf_dir))
    stored = full.withColumn("availability_status", F.when(F.col("news_id") % 3 == 0, F.lit(None)).when(F.col("news_id") % 3 == 1, "stored").otherwise(F.col("availability_status")))
    stored = stored.withColumn("first_usable_session", F.when(F.col("news_id") % 5 == 0, F.lit(None)).otherwise(F.col("first_usable_session")))
    return art.reannotate(stored, aq.stream_calendar(spark, sf_dir)).select("news_id", "availability_status", "first_usable_session")


def provider_audit(spark, sf_dir):
    """A10: quality per provider next to what collection rejected; providers known to one side only stay."""
    audit = art.audit_by_provider(aq._annotated(spark, sf_dir)).where("provider <> 'gnews'").select("provider", "articles", "duplicates", "verified_share")
    return art.audit_with_rejects(audit, aq.fetch_log(spark, sf_dir).where("provider <> 'newsapi'")).select(
        "provider", "articles", "duplicates", "verified_share", "rejected_future", "rejected_missing_timestamp", "rejected_invalid", "fetched")


def window_quality_items(spark, sf_dir):
    """Analyses and price reports behind a window, sessions, missing bars and the coverage ratio."""
    q = art.item_quality(v.items(spark, sf_dir), _ntz(_LO), _ntz(_HI))
    cal = aq.stream_calendar(spark, sf_dir)
    held = market.sessions_held(v.stream_bars(spark, sf_dir), cal, "2024-01-05", "2024-01-20")
    return q.join(F.broadcast(held))


def pending_analysis(spark, sf_dir):
    """Articles that the current engine has not analysed, per provider."""
    done = v.analysis(spark, sf_dir).withColumn("engine", F.when(F.col("news_id") % 4 == 0, "lexicon-v2").otherwise(F.col("engine")))
    return entities.pending_articles(v.news(spark, sf_dir), done, "lexicon-v3").groupBy("provider").agg(F.count("*").alias("pending"), F.min("news_id").alias("first_id"))


def event_strengths(spark, sf_dir):
    """E9."""
    ev = v.table(spark, sf_dir, "events")
    return ev.select("event_id", entities.event_strength(F.expr(v.STRENGTH), F.col("value") * 0.031731).alias("strength"))


def engine_scores(spark, sf_dir):
    """Another engine behind the same interface, its rows kept under its own name."""
    score = entities.model_scorer(lambda pdf: (pdf["summary"].str.count("e") - pdf["summary"].str.count("a")) / (pdf["summary"].str.len() + 1.0), "vowels-v1")
    docs = v.articles(spark, sf_dir).select("news_id", "title", "summary")
    return score(docs).select("news_id", F.round("raw", 9).alias("raw"), "engine")


def article_analysis(spark, sf_dir):
    """Full analysis of given articles (entities, sentiment, label, strength, reliability)."""
    from tidemark.functions.sentiment import lexicon_score

    rows = v.articles(spark, sf_dir).select("news_id", "title", "summary", "source")
    out = entities.analyse(rows, aq.COMPANIES, aq.CATEGORIES, {"default": 0.6, "src1": 0.9}, lambda d: lexicon_score(d, "title", "summary", aq.LEXICON))
    return out.select("news_id", "entity", "sentiment_label", F.round("reliability", 3).alias("reliability"), "engine", (F.col("sentiment") == 0).alias("no_sentiment"))


def _versions(spark, sf_dir):
    """Membership versions from the orders: one per eight order numbers, its members the customers by their largest order; every second one is confirmed."""
    o = v.table(spark, sf_dir, "orders").withColumn("_v", F.floor(F.col("o_orderkey") / 8))
    since = o.groupBy("_v").agg(F.to_date(F.min("o_orderdate")).alias("effective_from"))
    return o.groupBy("_v", "o_custkey").agg(F.max("o_totalprice").alias("weight")).join(since, "_v").select(
        F.concat(F.lit("v"), F.col("_v").cast("string")).alias("version"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ticker"), "weight", "effective_from",
        F.lit(None).cast("date").alias("effective_to"), F.when(F.col("_v") % 2 == 0, "confirmed").otherwise("requires_confirmation").alias("status"))


def confirmed_members(spark, sf_dir):
    """C11."""
    return uni.ever_confirmed(_versions(spark, sf_dir))


def universe_history(spark, sf_dir):
    """Versions in order with their members by weight."""
    return uni.history(_versions(spark, sf_dir)).select(
        "version", "effective_from", "status", F.array_join(F.transform("members", lambda m: m["ticker"]), ",").alias("tickers"))


def seeded_versions(spark, sf_dir):
    """C14: only versions that are not stored are added; a confirmation log then changes their status."""
    rows = _versions(spark, sf_dir)
    fresh = uni.seed_versions(rows.where("version LIKE '%0'"), rows, rows.select("ticker").distinct())
    log = v.table(spark, sf_dir, "orders").where("o_orderkey % 24 = 8").select(F.concat(F.lit("v"), F.floor(F.col("o_orderkey") / 8).cast("string")).alias("version"), F.to_date("o_orderdate").alias("confirmed_at"))
    return uni.confirm(fresh, log).groupBy("version", "status").agg(F.count("*").alias("members"))


def catalog_upsert(spark, sf_dir):
    """A delivery of customers changes a catalog of them; a new row must be complete."""
    n = v.table(spark, sf_dir, "customer")
    held = n.where("c_custkey % 5 <> 0").select(n.c_name.alias("ticker"), F.concat(F.lit("N "), "c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.lit(1.0).alias("weight"))
    changes = n.where("c_custkey % 3 = 0").select(n.c_name.alias("ticker"), F.when(n.c_custkey % 2 == 0, F.lower("c_name")).alias("name"), F.lit("new").alias("sector"),
                                                  F.when(n.c_custkey % 7 != 0, n.c_acctbal).alias("weight"))
    return uni.upsert_catalog(held, changes)


def mirrored_weights(spark, sf_dir):
    """Weights, version, source and source date effective on a day, on the catalog of customers."""
    rows = _versions(spark, sf_dir).withColumn("source", F.concat(F.lit("review "), "version")).withColumn("source_date", F.date_sub("effective_from", 9))
    day = local_frame(spark, [("1996-08-15",)], "day string").select(F.col("day").cast("date").alias("day"))
    return uni.mirror_weights(v.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker")), rows, day)


def _many_aliases(spark, sf_dir):
    """A catalog as large as the corpus: neighbouring words of every document, every third alias in its own case."""
    pair = lambda w, i: F.struct(F.element_at(w, i).alias("x"), F.element_at(w, i + 1).alias("y"))
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.least(F.lit(100), F.size(w) - 1)), lambda i: pair(w, i)))
    # 101 words are enough for 100 pairs; the array of one keeps the words from being cut anew for every use
    words = F.array(F.regexp_extract_all(F.regexp_extract("text", r"\A(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){1,101}+", 0), F.lit(r"([A-Za-z0-9]+)"), F.lit(1)))
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.transform(words, pairs).getItem(0)).alias("p"))
    # "a a" would overlap itself in "a a a", where a regular expression counts once
    return d.where(F.lower("p.x") != F.lower("p.y")).select(
        F.concat(F.lit("c"), (F.col("doc_id") % 500).cast("string")).alias("owner"), F.concat("p.x", F.lit(" "), "p.y").alias("pattern"), (F.length("p.x") % 3 == 0).alias("case_sensitive"))


def entity_mentions_many(spark, sf_dir):
    """E1 with about 100 aliases a document, which hundreds of owners share."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("news_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("summary"))
    return patterns.mentions(docs, _many_aliases(spark, sf_dir))


def newest_runs(spark, sf_dir):
    """The newest changes of a log (a top-k report)."""
    log = v.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("ts").alias("at"))
    return report.newest_first(log, "at", 25).select("event_id")


def failure_titles(spark, sf_dir):
    """The titles behind the worst forecasts, in evidence order."""
    ev = v.table(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = ev.groupBy(day.alias("session"), F.col("event_type").alias("ticker")).agg(F.min("value").alias("predicted"), F.max("value").alias("actual"))
    rows = rows.select("session", "ticker", F.lit("today").alias("horizon_type"), F.col("session").alias("target_date"), "predicted", "actual")
    evidence = ev.select(day.alias("session"), F.col("event_type").alias("ticker"), F.lit("today").alias("horizon_type"), day.alias("target_date"), F.col("event_id").alias("news_id"),
                         F.row_number().over(Window.partitionBy(day, "event_type").orderBy("event_id")).alias("rank"))
    titles = ev.select(F.col("event_id").alias("news_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"))
    return report.failure_evidence(report.failure_cases(rows), evidence, titles).select("session", "ticker", F.array_join("evidence", ",").alias("evidence"))


def parameter_fingerprint(spark, sf_dir):
    """Parameter sets estimated per event type, told apart by a fingerprint of their sorted rows."""
    base = snapshots.parameter_rows(spark, "v", default_params())
    estimated = v.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).cast("string").alias("band"))
    sets = estimated.join(F.broadcast(base)).select(F.col("event_type").alias("version"), "name", F.when(F.col("name") == "news.neutral_band", F.col("band")).otherwise(F.col("value")).alias("value"))
    return snapshots.fingerprints(sets.where("name LIKE 'news.%band'")).select("version", "fingerprint")


QUERIES = {f.__name__: f for f in (
    bars_ingest, bars_stored, search_feed_items, publisher_feed_items, json_feed_items, query_list, first_seen_urls, closes_range, replay_price_window, new_bars, reannotated, provider_audit,
    window_quality_items, pending_analysis, event_strengths, engine_scores, article_analysis, confirmed_members, universe_history, seeded_versions, catalog_upsert,
    mirrored_weights, entity_mentions_many, newest_runs, failure_titles, parameter_fingerprint)}

# ---- SQL checks -----------------------------------------------------------------------------------
_ITEM = """i AS (SELECT event_id, event_type || ' & co ' || event_id AS t, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Wire ' || (user_id % 6) END AS s,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 9 = 0 THEN date_trunc('day', ts) + INTERVAL 7 HOUR ELSE date_trunc('second', ts) END AS u,
  CASE WHEN event_id % 13 = 0 THEN 'soon' WHEN event_id % 9 = 0 THEN strftime(ts, '%a, %d %b %Y 07:00:00 GMT') ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') END AS raw,
  CASE WHEN event_id % 4 <> 0 THEN 'g' || event_id END AS g, event_type FROM events)"""
_CLOCK = "CASE WHEN u IS NULL THEN 'unknown' WHEN second(u) > 0 THEN 'exact' WHEN minute(u) > 0 THEN 'minute' ELSE 'hour' END"
_MARKED = "CASE WHEN strftime(u, '%H:%M:%S') = '07:00:00' THEN 'date_only' ELSE " + _CLOCK + " END"
_ZONE = "CASE WHEN u IS NOT NULL THEN 'GMT' END AS published_timezone, CASE WHEN u IS NOT NULL THEN 'explicit' ELSE 'unknown' END AS timezone_status"
_VERSIONS = """vo AS (SELECT o_orderkey // 8 AS k, * FROM orders), vd AS (SELECT k, CAST(min(o_orderdate) AS DATE) AS effective_from FROM vo GROUP BY 1),
ver AS (SELECT 'v' || k AS version, 'c' || o_custkey AS ticker, max(o_totalprice) AS weight, any_value(effective_from) AS effective_from, CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE 'requires_confirmation' END AS status
  FROM vo JOIN vd USING (k) GROUP BY k, o_custkey)"""

ORACLES = {
    "bars_ingest": """WITH b AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT ticker, count(*) AS bars, CAST(sum(n) AS BIGINT) AS volume, min(date) AS first_date, max(high) AS high FROM b WHERE day(date) % 7 <> 0 GROUP BY 1""",
    "bars_stored": f"""WITH {v.SQL_ORDER_BARS} SELECT ticker, year(date) AS year, count(*) AS bars, count(*) FILTER (year(date) = 1997 AND day(date) < 10) AS replaced FROM bars GROUP BY 1, 2""",
    "search_feed_items": f"""WITH {_ITEM} SELECT CASE WHEN s = '' THEN 'unknown' ELSE s END AS source, CASE WHEN s = '' AND event_id % 2 = 0 THEN t || ' -' ELSE t END AS title,
  'http://x.example/' || event_id AS url, strftime(u, '%Y-%m-%d %H:%M:%S.%f') AS published_at, CAST(NULL AS VARCHAR) AS summary, coalesce(g, '') AS provider_article_id, raw AS published_raw, {_ZONE}, {_MARKED} AS timestamp_precision
FROM i WHERE u IS NULL OR u BETWEEN TIMESTAMP '{_LO}' AND TIMESTAMP '{_HI}'""",
    "publisher_feed_items": f"""WITH {_ITEM} SELECT 'Daily' AS source, trim(t || CASE WHEN event_id % 2 = 0 THEN ' - ' || s ELSE '' END) AS title, 'http://x.example/' || event_id AS url,
  strftime(u, '%Y-%m-%d %H:%M:%S.%f') AS published_at, 'Up & ' || event_type AS summary, coalesce(g, 'http://x.example/' || event_id) AS provider_article_id, raw AS published_raw, {_ZONE}, {_CLOCK} AS timestamp_precision FROM i""",
    "json_feed_items": """SELECT ['newsapi', 'gnews', 'marketaux'][event_id % 3 + 1] AS provider, CASE WHEN event_id % 3 = 2 THEN 'unknown' ELSE 'S' || (user_id % 4) END AS source, event_type || event_id AS title,
  CASE WHEN event_id % 3 = 2 THEN 'http://m/' ELSE 'http://n/' END || event_id AS url, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS published_at, event_type AS summary,
  CASE event_id % 3 WHEN 2 THEN 'u' || event_id WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'http://n/' || event_id ELSE 'i' || event_id END ELSE 'http://n/' || event_id END AS provider_article_id,
  'explicit' AS timezone_status FROM events""",
    "query_list": f"""SELECT '"' || CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE s_name END || '"' AS query FROM supplier UNION ALL SELECT unnest({_MACRO})""",
    "first_seen_urls": r"SELECT regexp_replace(url, '\d+', '0', 'g') AS url, min(page_id) AS page_id FROM pages WHERE page_id % 10 <> 0 GROUP BY 1",
    "closes_range": f"WITH {v.SQL_ORDER_BARS} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE ticker IN ('1-URGENT', '3-MEDIUM') AND date BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'",
    "replay_price_window": f"""WITH {v.SQL_ORDER_BARS} SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS bars FROM bars
WHERE date >= DATE '1997-01-01' - 400 AND date <= DATE '1997-03-31' + 200 GROUP BY 1""",
    "new_bars": f"WITH {v.SQL_ORDER_BARS} SELECT ticker, count(*) AS new_bars FROM bars WHERE day(date) % 2 = 0 AND day(date) % 3 <> 0 GROUP BY 1",
    "reannotated": f"""WITH {aq.SQL_ANNOTATED} SELECT news_id, CASE WHEN news_id % 3 = 1 AND NOT (news_id % 5 = 0 OR first_usable_session IS NULL) THEN 'stored' ELSE availability_status END AS availability_status,
  first_usable_session FROM ann""",
    "provider_audit": f"""WITH {aq.SQL_ANNOTATED}, q AS (SELECT provider, count(*) AS articles, count(duplicate_of) AS duplicates,
  round(count(*) FILTER (availability_status = 'verified_pre_market') / count(*), 4) AS verified_share FROM ann WHERE provider <> 'gnews' GROUP BY 1
  UNION ALL SELECT 'ALL', count(*), count(duplicate_of), round(count(*) FILTER (availability_status = 'verified_pre_market') / count(*), 4) FROM ann),
f AS (SELECT {v.PROVIDER} AS provider, CASE WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN 'i' WHEN event_id % 19 = 0 THEN 'm' WHEN event_id % 31 = 0 THEN 'f' END AS why FROM events),
r AS (SELECT provider, count(*) FILTER (why = 'f') AS rejected_future, count(*) FILTER (why = 'm') AS rejected_missing_timestamp, count(*) FILTER (why = 'i') AS rejected_invalid, count(*) AS fetched FROM f WHERE provider <> 'newsapi' GROUP BY 1)
SELECT provider, articles, duplicates, verified_share, rejected_future, rejected_missing_timestamp, rejected_invalid, fetched FROM q FULL JOIN r USING (provider)""",
    "window_quality_items": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, s AS (SELECT session FROM calendar WHERE session BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), k AS (SELECT DISTINCT ticker FROM bars),
x AS (SELECT count(*) AS expected, count(b.date) AS held FROM k CROSS JOIN s LEFT JOIN bars b ON b.ticker = k.ticker AND b.date = s.session)
SELECT (SELECT count(*) FROM items WHERE available_at BETWEEN TIMESTAMP '{_LO}' AND TIMESTAMP '{_HI}') AS relevant_analyses,
  (SELECT count(*) FROM items WHERE price_report AND available_at BETWEEN TIMESTAMP '{_LO}' AND TIMESTAMP '{_HI}') AS price_reports,
  (SELECT count(*) FROM s) AS sessions, expected - held AS missing_sessions, round(held / expected, 4) AS coverage_ratio FROM x""",
    "pending_analysis": f"SELECT {v.PROVIDER} AS provider, count(*) AS pending, min(event_id) AS first_id FROM events WHERE event_id % 4 = 0 GROUP BY 1",
    "event_strengths": f"SELECT event_id, round_even({v.STRENGTH} * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, value * 0.031731::DOUBLE / 3.0::DOUBLE)), 4) AS strength FROM events",
    "engine_scores": """SELECT doc_id AS news_id, round((length(text) - length(replace(text, 'e', '')) - length(text) + length(replace(text, 'a', ''))) / (length(text) + 1.0::DOUBLE), 9) AS raw, 'vowels-v1' AS engine FROM documents""",
    "confirmed_members": f"WITH {_VERSIONS} SELECT DISTINCT ticker FROM ver WHERE status = 'confirmed'",
    "universe_history": f"WITH {_VERSIONS} SELECT version, effective_from, status, string_agg(ticker, ',' ORDER BY weight DESC, ticker) AS tickers FROM ver GROUP BY 1, 2, 3",
    "seeded_versions": f"""WITH {_VERSIONS} SELECT version, CASE WHEN CAST(substr(version, 2) AS BIGINT) % 3 = 1 THEN 'confirmed' ELSE status END AS status, count(*) AS members FROM ver
WHERE version NOT LIKE '%0' GROUP BY 1, 2""",
    "catalog_upsert": """WITH c AS (SELECT *, c_custkey % 5 <> 0 AS held, c_custkey % 3 = 0 AS changed FROM customer)
SELECT c_name AS ticker, coalesce(CASE WHEN changed AND c_custkey % 2 = 0 THEN lower(c_name) END, CASE WHEN held THEN 'N ' || c_name END) AS name,
  CASE WHEN changed THEN 'new' ELSE c_mktsegment END AS sector, coalesce(CASE WHEN changed AND c_custkey % 7 <> 0 THEN c_acctbal END, CASE WHEN held THEN 1.0::DOUBLE END) AS weight,
  NOT held AND (c_custkey % 2 <> 0 OR c_custkey % 7 = 0) AS rejected FROM c WHERE held OR changed""",
    "mirrored_weights": f"""WITH {_VERSIONS}, a AS (SELECT version FROM ver WHERE status = 'confirmed' AND effective_from <= DATE '1996-08-15' ORDER BY effective_from DESC, version DESC LIMIT 1)
SELECT 'c' || c_custkey AS ticker, w.weight AS index_weight, w.version AS weight_version, 'review ' || w.version AS weight_source, CAST(w.effective_from - 9 AS DATE) AS weight_source_date
FROM customer LEFT JOIN (SELECT ver.* FROM ver JOIN a USING (version)) w ON w.ticker = 'c' || c_custkey""",
    "entity_mentions_many": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(1, least(101, len(w)))) AS i FROM d WHERE len(w) > 1),
a AS (SELECT DISTINCT 'c' || (doc_id % 500) AS owner, w[i] AS x, w[i + 1] AS y, length(w[i]) % 3 = 0 AS cs FROM k WHERE lower(w[i]) <> lower(w[i + 1])),
t AS (SELECT doc_id, 0 AS part, regexp_extract_all(substr(text, 1, 80), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') FROM documents),
o AS (SELECT doc_id, part, unnest(p) AS x, unnest(list_slice(p, 2, len(p))) AS sep, unnest(list_slice(p, 3, len(p))) AS y FROM t),
h AS (SELECT o.doc_id, o.part, a.owner FROM o JOIN a ON lower(a.x) = lower(o.x) AND lower(a.y) = lower(o.y) AND (NOT a.cs OR (a.x = o.x AND a.y = o.y)) WHERE o.sep = ' ')
SELECT doc_id AS news_id, owner, CAST(count(*) FILTER (part = 0) AS INTEGER) AS in_title, CAST(count(*) FILTER (part = 1) AS INTEGER) AS in_body FROM h GROUP BY 1, 2""",
    "newest_runs": "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 25",
    "failure_titles": """WITH g AS (SELECT CAST(ts AS DATE) AS session, event_type AS ticker, round(min(value) - max(value), 4) AS e FROM events GROUP BY 1, 2),
w AS (SELECT session, ticker FROM g ORDER BY abs(e) DESC, session, ticker LIMIT 10),
x AS (SELECT CAST(ts AS DATE) AS session, event_type AS ticker, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS k FROM events)
SELECT session, ticker, string_agg('t' || event_id, ',' ORDER BY k) AS evidence FROM w JOIN x USING (session, ticker) WHERE k <= 3 GROUP BY 1, 2""",
    "parameter_fingerprint": """SELECT event_type AS version, substr(sha256('news.neutral_band=' || CAST(round(avg(value), 4) AS VARCHAR)), 1, 10) AS fingerprint FROM events GROUP BY 1""",
}
ORACLES["article_analysis"] = f"""WITH de AS ({aq.ORACLES["detected_entities"].replace(">= 0.3", ">= 0.1")}), ls AS ({aq.ORACLES["lexicon_score"]})
SELECT de.news_id, entity, CASE WHEN entity = 'NONE' THEN 'NEUTRAL' ELSE label END AS sentiment_label,
  CASE WHEN entity = 'NONE' THEN 0.0 WHEN contains(source, 'src1') THEN 0.9 ELSE 0.6 END::DOUBLE AS reliability, '{aq.LEXICON.name}' AS engine, entity = 'NONE' OR score = 0 AS no_sentiment
FROM de JOIN ls USING (news_id) JOIN documents d ON d.doc_id = de.news_id"""
