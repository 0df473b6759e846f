"""Registered queries: ingestion, availability audits, duplicates and text over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import availability as av
from tidemark.functions import timestamps as tsf
from tidemark.functions.headlines import price_report
from tidemark.functions.lexicon import PHRASE_STOP_WORDS, Lexicon
from tidemark.functions.sentiment import lexicon_score as score_lexicon
from tidemark.functions.sentiment import label
from tidemark.functions.titles import title_fingerprint, title_tokens
from tidemark.functions.urls import canonical_url
from tidemark.operators import articles as art
from tidemark.operators import dedup, entities, keywords
from tidemark.operators.entities import Category, Company
from tidemark.plans.news_queries import stream_calendar
from tidemark.session import spread
from tidemark.sources import bench_views as v
from tidemark.sources import feeds, validation

# Vocabulary of the synthetic documents, used as catalog, taxonomy and lexicon.
COMPANIES = [
    Company("AAA", "Aaa", "X", ("th", "orre"), (), ("rewh",)), Company("BBB", "Bbb", "X", ("thth", "Ther"), ("Ther",)),
    Company("CCC", "Ccc", "Y", ("nd",)), Company("DDD", "Ddd", "Y", ("thor", "er"), (), ("thin",)),
]
CATEGORIES = [
    Category("one", "company", 1.0, 10.0, ("tion", "ble")), Category("two", "company", 0.7, 20.0, ("ing", "ed")),
    Category("rates", "macro", 1.0, 45.0, ("ou", "sh")), Category("growth", "macro", 0.8, 20.0, ("ly", "wh")),
    Category("market_wrap", "macro", 0.3, 2.0, ("st",)),
]
MOVES, NOUNS = ["the", "of"], ["nd", "th", "in"]
LEVEL, SIZE = r"(?:^| )(?:er|ti|on) (?:th|nd|the)(?: |$)", r"[a-z]{9,}"
LEXICON = Lexicon(
    name="synthetic", positive={"rewh": 0.8, "tion": 0.5, "ble": 0.4, "thatin": 0.7, "of the": 0.9}, negative={"ononst": 1.1, "ed": 0.6, "ing": 0.3},
    inverted_objects=("nd", "ou"), direction_terms=("orre", "ti", "ed"), up_terms=("orre",), negations=("the",), intensifiers={"hehely": 1.5, "is": 0.6},
    phrases=(("one", r"er (?:[a-z]+ ){0,2}th", -0.8),), contrast=("was", "for"), concession=("that", "with"))
QUERY_TEXTS = ['"nd th"', "orre rewh thatin the", '"er"', "an of"]


# ---- timestamps and ingestion ---------------------------------------------------------------------
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3 over seven textual shapes."""
    ev = v.table(spark, sf_dir, "events").select("event_id", "ts")
    fmt = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'"))
        .when(k == 2, fmt("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 3, fmt("dd MMM yyyy HH:mm '-0230'"))
        .when(k == 4, fmt("yyyy-MM-dd HH:mm:ss")).when(k == 5, fmt("yyyy-MM-dd")).otherwise(F.lit("n/a")))
    zone = F.when(F.col("event_id") % 2 == 0, "UTC")
    p = ev.withColumn("p", tsf.parse_timestamp(raw, zone))
    return p.select("event_id", F.date_format("p.utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("utc"), "p.precision", "p.timezone", "p.tz_status")


def stored_precision(spark, sf_dir):
    """T4: precision inferred from stored stamps (every ninth stamp moved to 07:00:00)."""
    ev = v.table(spark, sf_dir, "events")
    day = F.to_date("ts")
    at = F.when(F.col("event_id") % 9 == 0, F.timestamp_add("HOUR", F.lit(7), day.cast("timestamp_ntz"))).when(
        F.col("event_id") % 9 == 1, F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return ev.select(F.expr(v.PROVIDER).alias("provider"), tsf.stored_precision(at, F.expr(v.PROVIDER)).alias("precision")).groupBy(
        "provider", "precision").agg(F.count("*").alias("n"))


def exchange_time(spark, sf_dir):
    """T5: exchange-local display time, session open and close of every stamp's local date."""
    ev = v.table(spark, sf_dir, "events")
    d = tsf.exchange_date(F.col("ts"))
    s = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return ev.select("event_id", s(tsf.to_exchange_time(F.col("ts"))).alias("local"), s(tsf.session_open(d)).alias("open_utc"), s(tsf.session_close(d)).alias("close_utc"))


def _raw(spark, sf_dir):
    ev = v.table(spark, sf_dir, "events")
    e = F.col("event_id")
    return ev.select(
        e.alias("news_id"), F.expr(v.PROVIDER).alias("provider"), F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("query"),
        F.when(e % 23 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("title"), F.lit("s").alias("source"),
        F.when(e % 29 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("http://x.com/"), F.floor(e / 2).cast("string"))).alias("url"),
        F.when(e % 19 == 0, F.lit(None)).when(e % 31 == 0, F.lit("2099-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("published_at"),
        F.when(e % 3 == 1, e - 1).alias("duplicate_of"))


def reject_counts(spark, sf_dir):
    """T6-T7."""
    return validation.reject_counts(validation.validate(_raw(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")))


def fetch_log(spark, sf_dir):
    """Per provider and query, with exact duplicates by canonical URL."""
    raw = validation.validate(_raw(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    ok = raw.where("reject_reason IS NULL")
    first = dedup.exact_duplicates(ok).select("news_id", (F.col("news_id") != F.col("first_seq")).alias("is_exact_duplicate"))
    rows = raw.join(first, "news_id", "left").withColumn("is_exact_duplicate", F.coalesce("is_exact_duplicate", F.lit(False)))
    return validation.fetch_log(rows, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).drop("started_at", "status")


def canonical_urls(spark, sf_dir):
    """D1-D2."""
    p = v.table(spark, sf_dir, "pages")
    return p.select("page_id", canonical_url(F.col("url")).alias("canonical"), F.sha2(canonical_url(F.col("url")), 256).alias("url_hash"))


def exact_dedup(spark, sf_dir):
    """D3 over the page URLs: path digits folded so that canonical URLs repeat."""
    p = v.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"\d+", "0").alias("url"))
    return dedup.url_groups(p, seq="page_id")


def page_titles(spark, sf_dir):
    """HTML-cleaned titles."""
    p = v.table(spark, sf_dir, "pages")
    return p.select("page_id", feeds.clean_html(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


def query_matches(spark, sf_dir):
    """Phrase and bag-of-words queries over whole articles."""
    return feeds.match_queries(v.articles(spark, sf_dir).select("news_id", "title", "summary"), QUERY_TEXTS).select("news_id", "query")


def query_limit(spark, sf_dir):
    """First items per query in feed order (a top-k operator)."""
    m = feeds.match_queries(v.articles(spark, sf_dir).select("news_id", "title", "summary"), QUERY_TEXTS).select("news_id", "query")
    return feeds.limit_per_query(m, ["news_id"], 25)


# ---- duplicates -----------------------------------------------------------------------------------
def fingerprints(spark, sf_dir):
    """D4."""
    a = v.articles(spark, sf_dir)
    return a.select("news_id", title_fingerprint(F.col("title")).alias("fingerprint"), F.size(title_tokens(F.col("title"))).cast("bigint").alias("n_tokens"))


def near_dup_leaders(spark, sf_dir):
    """Links in arrival order and cluster ids."""
    return dedup.near_duplicates(v.articles(spark, sf_dir)).select(
        "news_id", "duplicate_of", dedup.cluster_id(F.col("duplicate_of"), F.col("news_id")).alias("cluster_id"))


def duplicate_rate(spark, sf_dir):
    """D9."""
    return dedup.duplicate_rate(v.news(spark, sf_dir), "provider")


# ---- availability ---------------------------------------------------------------------------------
def effective_availability(spark, sf_dir):
    """A1-A3 per item."""
    i = v.items(spark, sf_dir)
    return i.select("news_id", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("available_at"),
                    av.is_precise(F.col("timestamp_precision"), F.col("timezone_status")).alias("is_precise"))


def eligibility_by_cutoff(spark, sf_dir):
    """A4: class counts of every item at every session open."""
    return art.eligibility_at(v.items(spark, sf_dir), stream_calendar(spark, sf_dir).grid())


def policy_filter(spark, sf_dir):
    """A5, M9: loaded, used and excluded items of each policy at one cut-off."""
    items, cut = v.items(spark, sf_dir), F.lit("2024-01-20 03:45:00").cast("timestamp_ntz")
    loaded = items.where(F.col("available_at") <= cut)
    cls = av.eligibility(F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), cut)
    flags = [F.count_if(cls.isin(*c)).alias(f"used_{p}") for p, c in av.POLICIES.items()]
    return loaded.agg(F.count("*").alias("loaded"), *flags, *[F.count_if(cls == e).alias(e) for e in av.ELIGIBILITY])


def run_summaries(spark, sf_dir):
    """M9: loaded, used and excluded items of a run at every cut-off, per policy."""
    return art.run_summaries(v.items(spark, sf_dir), stream_calendar(spark, sf_dir).grid()).drop("pos", "as_of")


def _annotated(spark, sf_dir):
    return art.annotate(v.news(spark, sf_dir), stream_calendar(spark, sf_dir))


def first_usable_session(spark, sf_dir):
    """A6-A7 per article."""
    return _annotated(spark, sf_dir).select("news_id", "first_usable_session", "availability_status")


def availability_audit(spark, sf_dir):
    """Overall and per-provider quality blocks in one pass."""
    return art.audit_by_provider(_annotated(spark, sf_dir))


def audit_by_company(spark, sf_dir):
    return art.audit_by_company(_annotated(spark, sf_dir), v.analysis(spark, sf_dir), "lexicon-v3")


def audit_by_date(spark, sf_dir):
    live = v.stream_bars(spark, sf_dir).where("ticker = 'signup'").select(F.col("date").alias("session"))
    return art.audit_by_date(_annotated(spark, sf_dir), live)


def article_stats(spark, sf_dir):
    """A11."""
    return art.article_stats(_annotated(spark, sf_dir), v.analysis(spark, sf_dir))


def window_quality(spark, sf_dir):
    """A12."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-20 03:45:00"))
    return art.window_quality(_annotated(spark, sf_dir), lo, hi).withColumn("first_fetched_at", F.date_format("first_fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def replay_input_summary(spark, sf_dir):
    """B9."""
    return art.replay_input_summary(v.news(spark, sf_dir), v.items(spark, sf_dir))


def analysis_items(spark, sf_dir):
    """Analysis joined to articles for one engine with an availability range."""
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08 00:00:00", "2024-01-15 03:45:00"))
    out = art.build_items(v.news(spark, sf_dir), v.analysis(spark, sf_dir), "lexicon-v3", since, until)
    return out.groupBy("entity").agg(F.count("*").alias("n"), F.sum("news_id").alias("id_sum"), F.sum("cluster_id").alias("cluster_sum"),
                                     F.round(F.sum("relevance"), 4).alias("relevance_sum"))


def news_lookup(spark, sf_dir):
    """Newest articles of one company (a top-k report)."""
    return art.find_articles(v.news(spark, sf_dir), v.analysis(spark, sf_dir), "lexicon-v3", ticker="click", limit=50).select(
        "news_id", "provider", F.size("analyses").cast("bigint").alias("n_analyses"))


# ---- text -----------------------------------------------------------------------------------------
def entity_mentions(spark, sf_dir):
    """Alias counts per article and company, title and whole text."""
    a = spread(v.articles(spark, sf_dir))
    counts = F.explode(F.array(*[F.struct(F.lit(c.ticker).alias("ticker"), entities.mention_count(F.col("title"), c).alias("t"),
                                          entities.mention_count(F.col("summary"), c).alias("b")) for c in COMPANIES]))
    return a.select("news_id", counts.alias("m")).where("m.t + m.b > 0").select(
        "news_id", "m.ticker", F.col("m.t").cast("bigint").alias("in_title"), F.col("m.b").cast("bigint").alias("in_body"))


def category_match(spark, sf_dir):
    """Keyword hits per category over title + text."""
    a = spread(v.articles(spark, sf_dir))
    hits = entities.category_hits(F.concat("title", F.lit(". "), "summary"), CATEGORIES)
    return a.select("news_id", F.explode_outer(hits).alias("h")).where("h IS NOT NULL").select("news_id", "h.category", F.array_join("h.keywords", ",").alias("keywords"))


def price_reports(spark, sf_dir):
    """E3 with a vocabulary taken from the corpus."""
    a = v.articles(spark, sf_dir)
    return a.select("news_id", price_report(F.col("title"), MOVES, NOUNS, LEVEL, SIZE).alias("price_report"))


def detected_entities(spark, sf_dir):
    """Relevance, category and markers of every article."""
    flag = price_report(F.col("title"), MOVES, NOUNS, LEVEL, SIZE)
    a = v.articles(spark, sf_dir).select("news_id", "title", "summary")
    hits = entities.detect_entities(a, COMPANIES, CATEGORIES, 0.3, report_flag=flag, mark_irrelevant=True)
    return hits.select("news_id", "entity", "relevance", "category", "strength", "half_life_days", "price_report")


def lexicon_score(spark, sf_dir):
    """The whole scorer on whole texts with a corpus lexicon."""
    a = v.articles(spark, sf_dir).select("news_id", "title", "summary")
    out = score_lexicon(a, "title", "summary", LEXICON)
    return out.select("news_id", "score", label(F.col("score")).alias("label"))


def rake_keywords(spark, sf_dir):
    """Top phrases per document, whole texts."""
    return keywords.rake(v.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "rank", "phrase", "score")


def corpus_phrases(spark, sf_dir):
    """X7, corpus level (a top-k report)."""
    return keywords.corpus_rake(v.table(spark, sf_dir, "documents").select("text"), "text", top_n=100)


def article_keywords(spark, sf_dir):
    """Taxonomy hits merged with key phrases."""
    out = keywords.article_keywords(v.articles(spark, sf_dir).select("news_id", "title", "summary"), "news_id", "title", "summary", CATEGORIES)
    return out.select("news_id", F.array_join("keywords", "|").alias("keywords"))


def source_reliability(spark, sf_dir):
    """Longest configured name contained in the source."""
    table = {"default": 0.6, "src1": 0.8, "src1x": 0.9, "src12": 0.95, "c3": 0.7, "src19": 0.5}
    d = v.table(spark, sf_dir, "documents")
    return d.select("source", entities.source_reliability(F.col("source"), table).alias("reliability")).groupBy("source", "reliability").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    timestamp_parse, stored_precision, exchange_time, reject_counts, fetch_log, canonical_urls, exact_dedup, page_titles, query_matches, query_limit,
    fingerprints, near_dup_leaders, duplicate_rate, effective_availability, eligibility_by_cutoff, policy_filter, run_summaries, first_usable_session, availability_audit,
    audit_by_company, audit_by_date, article_stats, window_quality, replay_input_summary, analysis_items, news_lookup, entity_mentions, category_match,
    price_reports, detected_entities, lexicon_score, rake_keywords, corpus_phrases, article_keywords, source_reliability)}


# ---- SQL checks -----------------------------------------------------------------------------------
def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


SQL_ANNOTATED = f"""{v.SQL_NEWS}, {v.SQL_STREAM_BARS},
av AS (SELECT *, CASE WHEN fetched_at < a1 THEN fetched_at ELSE a1 END AS available_at FROM (
  SELECT *, CASE WHEN timestamp_precision = 'date_only' OR timezone_status = 'unknown' THEN CAST(CAST(published_at AS DATE) + 1 AS TIMESTAMP)
                 WHEN timestamp_precision = 'hour' THEN published_at + INTERVAL 1 HOUR ELSE published_at END AS a1 FROM news)),
ann AS (
  SELECT a.*, c.session AS first_usable_session,
         CASE WHEN a.fetched_at IS NULL OR c.session IS NULL THEN 'unknown' WHEN a.fetched_at <= c.open_utc THEN 'verified_pre_market'
              WHEN a.timestamp_precision = 'date_only' OR a.timezone_status = 'unknown' THEN 'unknown'
              WHEN a.fetched_at <= c.close_utc THEN 'published_before_cutoff' ELSE 'collected_after_event' END AS availability_status
  FROM av a ASOF LEFT JOIN calendar c ON a.available_at <= c.open_utc)"""
_ST = "".join(f", count(*) FILTER (availability_status = '{s}') AS {s}" for s in av.STATUSES)
_QUALITY = ("count(*) AS articles, count(duplicate_of) AS duplicates, round(count(duplicate_of) / count(*), 4) AS duplicate_rate, "
            "count(*) FILTER (timezone_status = 'unknown') AS timezone_unknown"
            + "".join(f", count(*) FILTER (timestamp_precision = '{p}') AS precision_{p}, round(count(*) FILTER (timestamp_precision = '{p}') / count(*), 4) AS precision_{p}_share"
                      for p in av.PRECISIONS)
            + "".join(f", count(*) FILTER (availability_status = '{s}') AS status_{s}" for s in av.STATUSES)
            + "".join(f", round(count(*) FILTER (availability_status = '{s}') / count(*), 4) AS {n}" for s, n in (
                ("verified_pre_market", "verified_share"), ("unknown", "unknown_share"), ("collected_after_event", "post_event_share"))))
_CLASS = ("CASE WHEN i.fetched_at <= {c} THEN 'verified' WHEN i.provider_available_at > {c} THEN 'post_cutoff' "
          "WHEN i.timestamp_precision <> 'date_only' AND i.timezone_status <> 'unknown' THEN 'timestamp_before' ELSE 'uncertain' END")
_RAW = f"""
raw AS (
  SELECT event_id AS news_id, {v.PROVIDER} AS provider, 'q' || CAST(user_id % 3 AS VARCHAR) AS query, event_id % 23 = 0 AS no_title, event_id % 29 = 0 AS bad_url,
         event_id % 19 = 0 AS no_stamp, event_id % 31 = 0 AS future, event_id // 2 AS u, event_id % 3 = 1 AS near FROM events),
judged AS (SELECT *, CASE WHEN no_title OR bad_url THEN 'invalid' WHEN no_stamp THEN 'missing_timestamp' WHEN future THEN 'future_timestamp' END AS reason FROM raw)"""


def _doubled(text: str) -> str:
    return f"regexp_replace({text}, '([^A-Za-z0-9])', '\\1\\1', 'g')"


def _rx(word: str, cs: bool = False) -> str:
    return ("" if cs else "(?i)") + "(^|[^A-Za-z0-9])" + word.replace(" ", "  ") + "([^A-Za-z0-9]|$)"


def _mention_sql(text: str, c: Company) -> str:
    clean = text
    for p in c.exclude_patterns:
        clean = f"regexp_replace({clean}, '(?i){p}', ' ', 'g')"
    return " + ".join(f"len(regexp_extract_all({_doubled(clean)}, '{_rx(a, a in c.case_sensitive_aliases)}'))" for a in c.aliases)


_MENTIONS = "mentions AS (" + " UNION ALL ".join(
    f"SELECT news_id, '{c.ticker}' AS ticker, CAST({_mention_sql('title', c)} AS BIGINT) AS in_title, CAST({_mention_sql('summary', c)} AS BIGINT) AS in_body FROM articles"
    for c in COMPANIES) + ")"
_FULL = "full_text AS (SELECT news_id, " + _doubled("title") + " AS t, " + _doubled("title || '. ' || summary") + " AS f FROM articles)"
_KW = "kw AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c.category}', '{c.scope}', {c.base_strength}::DOUBLE, {c.half_life_days}::DOUBLE, {j}, '{k}', '{_rx(k)}')"
    for i, c in enumerate(CATEGORIES) for j, k in enumerate(c.keywords)) + ") k(pos, category, scope, strength, half_life, j, word, rx))"
_HITS = f"""{_FULL}, {_KW},
hits AS (SELECT x.news_id, k.pos, k.category, k.scope, k.strength, k.half_life, string_agg(word, ',' ORDER BY j) AS keywords, count(*) AS n,
                count(*) FILTER (regexp_matches(x.t, k.rx)) AS nt
         FROM full_text x JOIN kw k ON regexp_matches(x.f, k.rx) GROUP BY ALL)"""
_PR = f"""
tk AS (SELECT news_id, title, regexp_extract_all(lower(title), '[a-z0-9][a-z0-9\\-''&]*') AS w,
              len(regexp_extract_all(lower(regexp_extract(title, '(?is)^(.*?)(?:{LEVEL})', 1)), '[a-z0-9][a-z0-9\\-''&]*')) AS lp FROM articles),
pr AS (SELECT news_id, (regexp_matches(title, '(?i)(?:{LEVEL})') AND NOT list_has_any(w[greatest(1, lp - 3):lp], {_list(NOUNS)}))
              OR (regexp_matches(title, '{SIZE}') AND len(list_filter(range(1, len(w) + 1), lambda i: list_contains({_list(MOVES)}, w[i])
                  AND NOT list_has_any(w[greatest(1, i - 4):i - 1], {_list(NOUNS)}))) > 0) AS price_report FROM tk)"""


def _case(table: dict, column: str, default: str = "0.0") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in table.items()) + f" ELSE {default} END"


_single = {k: x for k, x in LEXICON.weights().items() if " " not in k}
_LEX = f"""
texts AS (SELECT news_id, 2.0 AS factor, title AS x FROM articles UNION ALL SELECT news_id, 1.0, summary FROM articles),
norm AS (SELECT news_id, factor, replace(replace(regexp_replace(regexp_replace(replace(lower(x), '’', ''''), '([a-z])-(than\\b)', '\\1 \\2', 'g'),
                '(\\bthan)-([a-z])', '\\1 \\2', 'g'), 'show-cause', 'show cause'), 'even as', 'though') AS x FROM texts),
tl AS (SELECT news_id, factor, flatten(list_transform(string_split_regex(x, '{LEXICON.phrases[0][1]}'), lambda p, i: CASE WHEN i > 1 THEN list_prepend('', regexp_extract_all(p, '[a-z][a-z\\-'']*'))
  ELSE regexp_extract_all(p, '[a-z][a-z\\-'']*') END)) AS w FROM norm),
tok AS (SELECT news_id, factor, i, w[i] AS t FROM (SELECT news_id, factor, w, unnest(range(1, len(w) + 1)) AS i FROM tl)),
nb AS (SELECT *, lag(t) OVER s AS p1, lag(t, 2) OVER s AS p2, lag(t, 3) OVER s AS p3, lag(t, 4) OVER s AS p4, lag(t, 5) OVER s AS p5, lead(t) OVER s AS n1, lead(t, 2) OVER s AS n2,
       min(CASE WHEN t IN ('was', 'for') THEN i END) OVER (PARTITION BY news_id, factor) AS fc,
       coalesce(sum(CASE WHEN t IN ('that', 'with') THEN 1 ELSE 0 END) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb
       FROM tok WINDOW s AS (PARTITION BY news_id, factor ORDER BY i)),
oc AS (SELECT *, cb - coalesce(max(CASE WHEN t IN ('was', 'for') THEN cb END) OVER (PARTITION BY news_id, factor ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS open_c FROM nb),
wt AS (SELECT *, CASE WHEN t = '' THEN {LEXICON.phrases[0][2]} WHEN p1 || ' ' || t = 'of the' THEN 0.0 WHEN t || ' ' || n1 = 'of the' THEN 0.9
       WHEN t IN ('orre', 'ti', 'ed') AND list_has_any([p1, p2, p3, p4, p5, n1, n2], ['nd', 'ou']) THEN CASE WHEN t = 'orre' THEN -1.4 ELSE 1.4 END
       ELSE {_case(_single, 't')} END AS b FROM oc),
sc AS (SELECT news_id, sum(factor * b
       * CASE WHEN p1 = 'the' THEN -1 ELSE 1 END * CASE WHEN p2 = 'the' THEN -1 ELSE 1 END * CASE WHEN p3 = 'the' THEN -1 ELSE 1 END
       * {_case(LEXICON.intensifiers, 'p1', '1.0')} * {_case(LEXICON.intensifiers, 'p2', '1.0')} * {_case(LEXICON.intensifiers, 'p3', '1.0')} * {_case(LEXICON.intensifiers, 'n1', '1.0')}
       * CASE WHEN fc IS NULL OR i = fc THEN 1.0 WHEN i < fc THEN 0.5 ELSE 1.5 END * pow(0.5, open_c)) AS raw FROM wt GROUP BY 1)"""


def _rake_sql(source: str) -> str:
    return f"""
rt AS (SELECT k, regexp_extract_all(regexp_replace(lower(text), '[^a-zA-Z0-9&\\-\\s]|\\s-\\s', '|', 'g'), '[a-zA-Z][a-zA-Z0-9&\\-]*|\\|') AS w FROM {source}),
rw AS (SELECT k, i, w[i] AS t, w[i] = '|' OR len(w[i]) < 2 OR list_contains({_list(PHRASE_STOP_WORDS)}, w[i]) AS brk FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM rt)),
rr AS (SELECT *, sum(brk::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM rw),
rp AS (SELECT k, run, i, t, (row_number() OVER (PARTITION BY k, run ORDER BY i) - 1) // 3 AS win FROM rr WHERE NOT brk),
rl AS (SELECT *, count(*) OVER (PARTITION BY k, run, win) - 1 AS deg FROM rp),"""


_RAKE_DOC = """
rs AS (SELECT *, (sum(deg) OVER (PARTITION BY k, t) + count(*) OVER (PARTITION BY k, t)) / count(*) OVER (PARTITION BY k, t) AS sc FROM rl),
rf AS (SELECT k, run, win, string_agg(t, ' ' ORDER BY i) AS phrase, sum(sc) AS score FROM rs GROUP BY 1, 2, 3),
rg AS (SELECT k, phrase, round(max(score), 6) AS score FROM rf GROUP BY 1, 2),
rtop AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, phrase) AS INTEGER) AS rank, phrase, score FROM rg)"""

ORACLES = {
    "timestamp_parse": """
WITH k AS (SELECT event_id, ts, event_id % 7 AS k, CASE WHEN event_id % 2 = 0 THEN 'UTC' END AS zone FROM events),
u AS (SELECT *, CASE k WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts - INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('minute', ts) + INTERVAL 150 MINUTE
                     WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('day', ts) END AS utc,
             CASE WHEN k = 1 THEN ts WHEN k = 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS shown FROM k)
SELECT event_id, strftime(utc, '%Y-%m-%d %H:%M:%S.%f') AS utc,
       CASE WHEN k = 5 THEN 'date_only' WHEN k = 6 THEN 'unknown' WHEN epoch_us(shown) % 60000000 <> 0 THEN 'exact' WHEN minute(shown) <> 0 THEN 'minute' ELSE 'hour' END AS precision,
       CASE k WHEN 0 THEN 'UTC' WHEN 1 THEN '+05:30' WHEN 2 THEN 'GMT' WHEN 3 THEN '-02:30' WHEN 4 THEN zone WHEN 5 THEN zone END AS timezone,
       CASE WHEN k <= 3 THEN 'explicit' WHEN k <= 5 AND zone IS NOT NULL THEN 'provider_documented' ELSE 'unknown' END AS tz_status FROM u""",
    "stored_precision": f"""
WITH x AS (SELECT {v.PROVIDER} AS provider, CASE event_id % 9 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 7 HOUR WHEN 1 THEN date_trunc('minute', ts) ELSE ts END AS stamp FROM events)
SELECT provider, CASE WHEN provider = 'google_news_rss' AND CAST(stamp AS TIME) = TIME '07:00:00' THEN 'date_only' WHEN epoch_us(stamp) % 60000000 <> 0 THEN 'exact'
       WHEN minute(stamp) <> 0 THEN 'minute' ELSE 'hour' END AS precision, count(*) AS n FROM x GROUP BY 1, 2""",
    "exchange_time": """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local, strftime(date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 225 MINUTE, '%Y-%m-%d %H:%M:%S') AS open_utc,
       strftime(date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 600 MINUTE, '%Y-%m-%d %H:%M:%S') AS close_utc FROM events""",
    "reject_counts": f"""WITH {_RAW} SELECT provider, count(*) AS fetched, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'invalid') AS rejected_invalid,
       count(*) FILTER (reason = 'missing_timestamp') AS rejected_missing_timestamp, count(*) FILTER (reason = 'future_timestamp') AS rejected_future_timestamp FROM judged GROUP BY 1""",
    "fetch_log": f"""WITH {_RAW}, d AS (SELECT *, reason IS NULL AND news_id <> min(news_id) FILTER (reason IS NULL) OVER (PARTITION BY u) AS dup FROM judged)
SELECT provider, query, count(*) AS fetched, count(*) FILTER (reason IS NULL AND NOT dup) AS new_items, count(*) FILTER (reason IS NULL AND (dup OR near)) AS duplicates_at_collection,
       count(*) FILTER (reason = 'future_timestamp') AS rejected_future, count(*) FILTER (reason = 'missing_timestamp') AS rejected_missing_timestamp,
       count(*) FILTER (reason = 'invalid') AS rejected_invalid FROM d GROUP BY 1, 2""",
    "canonical_urls": """
WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, lower(regexp_extract(u, '^([a-z]+://[^/?]*)', 1)) AS head, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_filter(str_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid|gclid|mc_|ref|cmpid|ocid)')) AS q FROM a),
c AS (SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM b)
SELECT page_id, canonical, sha256(canonical) AS url_hash FROM c""",
    "exact_dedup": """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '[0-9]+', '0', 'g'), '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, lower(regexp_extract(u, '^([a-z]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+$', '')
      || CASE WHEN regexp_matches(u, '\\?page') THEN '?page=0' ELSE '' END AS c FROM a)
SELECT sha256(c) AS url_hash, min(page_id) AS first_seq, count(*) AS copies FROM b GROUP BY 1""",
    "page_titles": """
WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS x FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t)
SELECT page_id, nullif(trim(regexp_replace(x, '\\s+', ' ', 'g')), '') AS title FROM u""",
    "query_matches": f"""WITH {v.SQL_ARTICLES}, x AS (SELECT news_id, lower(title || ' ' || summary) AS t, {_doubled("lower(title || ' ' || summary)")} AS d FROM articles),
w AS (SELECT *, regexp_extract_all(t, '[a-z0-9&]+') AS toks FROM x)
SELECT news_id, '"nd th"' AS query FROM w WHERE regexp_matches(d, '(^|[^a-z0-9])nd  th([^a-z0-9]|$)') UNION ALL
SELECT news_id, 'orre rewh thatin the' FROM w WHERE list_contains(toks, 'orre')::INT + list_contains(toks, 'rewh')::INT + list_contains(toks, 'thatin')::INT + list_contains(toks, 'the')::INT >= 2 UNION ALL
SELECT news_id, '"er"' FROM w WHERE regexp_matches(d, '(^|[^a-z0-9])er([^a-z0-9]|$)')""",
    "fingerprints": f"""WITH {v.SQL_ARTICLES}, t AS (SELECT news_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9&]+'),
       lambda w: len(w) > 1 AND NOT list_contains({_list("a an the of to in on for and or is are at by with as from its it be this that after over".split())}, w)))) AS w FROM articles)
SELECT news_id, array_to_string(w, ' ') AS fingerprint, CAST(len(w) AS BIGINT) AS n_tokens FROM t""",
    "near_dup_leaders": f"""WITH RECURSIVE {v.SQL_ARTICLES}, t AS MATERIALIZED (SELECT news_id, published_at, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9&]+'),
       lambda w: len(w) > 1 AND NOT list_contains({_list("a an the of to in on for and or is are at by with as from its it be this that after over".split())}, w))) AS w FROM articles),
e AS MATERIALIZED (SELECT a.news_id AS early, b.news_id AS late, a.published_at AS early_at FROM t a JOIN t b ON a.news_id < b.news_id
       AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 172800000000 AND len(a.w) > 0 AND len(b.w) > 0
       AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
nb AS MATERIALIZED (SELECT late, list(early) AS ns FROM e GROUP BY 1),
o AS MATERIALIZED (SELECT t.news_id, coalesce(ns, []) AS ns, row_number() OVER (ORDER BY t.news_id) AS k FROM t LEFT JOIN nb ON nb.late = t.news_id),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders UNION ALL
         SELECT o.k, CASE WHEN list_has_any(o.ns, walk.leaders) THEN walk.leaders ELSE list_append(walk.leaders, o.news_id) END FROM walk JOIN o ON o.k = walk.k + 1),
lead AS (SELECT unnest(leaders) AS id FROM walk WHERE k = (SELECT max(k) FROM o)),
best AS (SELECT e.late, first(e.early ORDER BY early_at, early) AS d FROM e JOIN lead ON lead.id = e.early WHERE e.late NOT IN (SELECT id FROM lead) GROUP BY 1)
SELECT t.news_id, d AS duplicate_of, coalesce(d, t.news_id) AS cluster_id FROM t LEFT JOIN best ON best.late = t.news_id""",
    "duplicate_rate": f"WITH {v.SQL_NEWS} SELECT provider, round(count(duplicate_of) / count(*), 4) AS duplicate_rate, count(*) AS articles FROM news GROUP BY 1",
    "effective_availability": f"WITH {v.SQL_ITEMS} SELECT news_id, strftime(available_at, '%Y-%m-%d %H:%M:%S.%f') AS available_at, timestamp_precision <> 'date_only' AND timezone_status <> 'unknown' AS is_precise FROM items",
    "eligibility_by_cutoff": f"WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS} SELECT c.session, {_CLASS.format(c='c.as_of')} AS eligibility, count(*) AS n FROM items i CROSS JOIN cutoffs c GROUP BY 1, 2",
    "policy_filter": f"""WITH {v.SQL_ITEMS}, l AS (SELECT {_CLASS.format(c="TIMESTAMP '2024-01-20 03:45:00'")} AS e FROM items i WHERE available_at <= TIMESTAMP '2024-01-20 03:45:00')
SELECT count(*) AS loaded, count(*) FILTER (e = 'verified') AS used_verified, count(*) FILTER (e IN ('verified', 'timestamp_before')) AS used_exact_timestamp,
       count(*) FILTER (e <> 'post_cutoff') AS used_provider_timestamp, count(*) FILTER (e = 'verified') AS verified, count(*) FILTER (e = 'timestamp_before') AS timestamp_before,
       count(*) FILTER (e = 'post_cutoff') AS post_cutoff, count(*) FILTER (e = 'uncertain') AS uncertain FROM l""",
    "run_summaries": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, l AS (SELECT c.session, {_CLASS.format(c="c.as_of")} AS e FROM items i JOIN cutoffs c ON i.available_at <= c.as_of),
a AS (SELECT session, count(*) AS n, count(*) FILTER (e = 'verified') AS x, count(*) FILTER (e IN ('verified', 'timestamp_before')) AS y, count(*) FILTER (e <> 'post_cutoff') AS z FROM l GROUP BY 1)
SELECT c.session, coalesce(n, 0) AS loaded, coalesce(x, 0) AS used_verified, coalesce(y, 0) AS used_exact_timestamp, coalesce(z, 0) AS used_provider_timestamp,
  coalesce(n - x, 0) AS excluded_verified, coalesce(n - y, 0) AS excluded_exact_timestamp, coalesce(n - z, 0) AS excluded_provider_timestamp FROM cutoffs c LEFT JOIN a USING (session)""",
    "first_usable_session": f"WITH {SQL_ANNOTATED} SELECT news_id, first_usable_session, availability_status FROM ann",
    "availability_audit": f"WITH {SQL_ANNOTATED} SELECT CASE WHEN grouping(provider) = 1 THEN 'ALL' ELSE provider END AS provider, {_QUALITY} FROM ann GROUP BY GROUPING SETS ((), (provider))",
    "audit_by_company": f"WITH {SQL_ANNOTATED} SELECT entity, count(*) AS total{_ST} FROM ann JOIN analysis a USING (news_id) WHERE a.entity <> 'NONE' GROUP BY 1",
    "audit_by_date": f"""WITH {SQL_ANNOTATED} SELECT first_usable_session AS session{_ST}, first_usable_session IN (SELECT date FROM bars WHERE ticker = 'signup') AS live_prediction
FROM ann WHERE first_usable_session IS NOT NULL GROUP BY 1""",
    "article_stats": f"""WITH {SQL_ANNOTATED} SELECT 'entity' AS kind, entity AS name, count(*) AS n FROM analysis GROUP BY 2 UNION ALL
SELECT 'status', availability_status, count(*) FROM ann GROUP BY 2 UNION ALL SELECT 'precision', timestamp_precision, count(*) FROM ann GROUP BY 2""",
    "window_quality": f"""WITH {SQL_ANNOTATED} SELECT count(*) AS articles{_ST}, count(*) FILTER (timestamp_precision IN ('date_only', 'hour')) AS coarse_timestamps,
       round(count(duplicate_of) / count(*), 4) AS duplicate_rate, strftime(min(fetched_at), '%Y-%m-%d %H:%M:%S.%f') AS first_fetched_at
FROM ann WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 03:45:00'""",
    "replay_input_summary": f"WITH {v.SQL_NEWS} SELECT count(*) AS articles, count(DISTINCT coalesce(duplicate_of, news_id)) AS clusters, round(avg(backfilled::INT), 6) AS backfilled_share FROM news",
    "analysis_items": f"""WITH {SQL_ANNOTATED} SELECT a.entity, count(*) AS n, CAST(sum(news_id) AS BIGINT) AS id_sum, CAST(sum(coalesce(duplicate_of, news_id)) AS BIGINT) AS cluster_sum,
       round(sum(a.relevance), 4) AS relevance_sum FROM ann JOIN analysis a USING (news_id) WHERE a.entity <> 'NONE' AND available_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15 03:45:00' GROUP BY 1""",
    "news_lookup": f"""WITH {v.SQL_NEWS} SELECT n.news_id, provider, CAST(1 AS BIGINT) AS n_analyses FROM news n JOIN analysis a ON a.news_id = n.news_id AND a.entity = 'click'
ORDER BY published_at DESC, n.news_id LIMIT 50""",
    "entity_mentions": f"WITH {v.SQL_ARTICLES}, {_MENTIONS} SELECT * FROM mentions WHERE in_title + in_body > 0",
    "category_match": f"WITH {v.SQL_ARTICLES}, {_HITS} SELECT news_id, category, keywords FROM hits",
    "price_reports": f"WITH {v.SQL_ARTICLES}, {_PR} SELECT news_id, price_report FROM pr",
    "detected_entities": f"""WITH {v.SQL_ARTICLES}, {_MENTIONS}, {_HITS}, {_PR},
ment AS (SELECT *, count(*) OVER (PARTITION BY news_id) AS nc FROM mentions WHERE in_title + in_body > 0),
crow AS (SELECT news_id, ticker, round_even(least(1.0::DOUBLE, (CASE WHEN in_title > 0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END + least(0.3::DOUBLE, 0.1::DOUBLE * (in_title + in_body - 1)))
                / CASE WHEN nc > 2 THEN sqrt(nc - 1) ELSE 1 END), 3) AS relevance FROM ment),
cpick AS (SELECT h.news_id, first(struct_pack(c := category, s := strength, h := half_life) ORDER BY (nt > 0)::INT DESC, strength DESC, CASE WHEN p.price_report THEN nt ELSE n END DESC, pos) AS k
          FROM hits h JOIN pr p USING (news_id) WHERE scope = 'company' AND (NOT p.price_report OR nt > 0) GROUP BY 1),
mpick AS (SELECT news_id, first(struct_pack(c := category, s := strength, h := half_life) ORDER BY (nt > 0)::INT DESC, strength DESC, n DESC, pos) AS k, sum(nt) AS nt, sum(n) AS na,
                 bool_or(nt > 0 AND category <> 'market_wrap') AS ev FROM hits WHERE scope = 'macro' GROUP BY 1),
mrow AS (SELECT m.*, round_even(least(1.0::DOUBLE, CASE WHEN nt > 0 THEN 0.5::DOUBLE + 0.15::DOUBLE * least(nt, 3) ELSE 0.25::DOUBLE + 0.05::DOUBLE * least(na, 3) END
                * CASE WHEN EXISTS (SELECT 1 FROM ment x WHERE x.news_id = m.news_id) THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 3) AS relevance FROM mpick m),
found AS (
  SELECT c.news_id, c.ticker AS entity, c.relevance, coalesce(k.k.c, CASE WHEN p.price_report THEN 'price_action' ELSE 'other' END) AS category,
         coalesce(k.k.s, CASE WHEN p.price_report THEN 0.3 ELSE 0.5 END) AS strength, coalesce(k.k.h, CASE WHEN p.price_report THEN 2.0 ELSE 5.0 END) AS half_life_days, p.price_report
  FROM crow c JOIN pr p USING (news_id) LEFT JOIN cpick k USING (news_id) WHERE c.relevance >= 0.3 UNION ALL
  SELECT m.news_id, 'MACRO', m.relevance, m.k.c, m.k.s, m.k.h, p.price_report AND NOT m.ev FROM mrow m JOIN pr p USING (news_id) WHERE m.relevance >= 0.3)
SELECT news_id, entity, relevance, category, CAST(strength AS DOUBLE) AS strength, CAST(half_life_days AS DOUBLE) AS half_life_days, price_report FROM found UNION ALL
SELECT news_id, 'NONE', 0.0, 'unrelated', 0.0, 0.0, FALSE FROM articles WHERE news_id NOT IN (SELECT news_id FROM found)""",
    "lexicon_score": f"""WITH {v.SQL_ARTICLES}, {_LEX}
SELECT a.news_id, round(100 * tanh(coalesce(raw, 0) / 3), 2) AS score, CASE WHEN round(100 * tanh(coalesce(raw, 0) / 3), 2) > 15 THEN 'POSITIVE'
       WHEN round(100 * tanh(coalesce(raw, 0) / 3), 2) < -15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
FROM articles a LEFT JOIN sc USING (news_id)""",
    "rake_keywords": f"WITH docs AS (SELECT doc_id AS k, text FROM documents), {_rake_sql('docs')} {_RAKE_DOC} SELECT k AS doc_id, rank, phrase, score FROM rtop WHERE rank <= 8",
    "corpus_phrases": f"""WITH docs AS (SELECT doc_id AS k, text FROM documents), {_rake_sql('docs')}
rs AS (SELECT *, (sum(deg) OVER (PARTITION BY t) + count(*) OVER (PARTITION BY t)) / count(*) OVER (PARTITION BY t) AS sc FROM rl),
rf AS (SELECT k, run, win, string_agg(t, ' ' ORDER BY i) AS phrase, sum(sc) AS score FROM rs GROUP BY 1, 2, 3)
SELECT phrase, count(*) AS copies, round(max(score), 6) AS score FROM rf GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100""",
    "article_keywords": f"""WITH {v.SQL_ARTICLES}, {_HITS}, docs AS (SELECT news_id AS k, title || '. ' || coalesce(summary, '') AS text FROM articles), {_rake_sql('docs')} {_RAKE_DOC},
known AS (SELECT news_id AS k, flatten(list(string_split(keywords, ',') ORDER BY pos)) AS ws FROM hits GROUP BY 1), best AS (SELECT k, list(phrase ORDER BY rank) AS ps FROM rtop WHERE rank <= 10 GROUP BY 1),
terms AS (SELECT d.k, list_transform(list_concat(coalesce(ws, []), coalesce(ps, [])), lambda x: [x]) AS ts FROM docs d LEFT JOIN known USING (k) LEFT JOIN best USING (k))
SELECT k AS news_id, CASE WHEN len(ts) = 0 THEN '' ELSE array_to_string(list_reduce(ts, lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: contains(s, x[1]))) > 0 THEN acc ELSE list_concat(acc, x) END)[:10], '|') END AS keywords FROM terms""",
    "source_reliability": """
SELECT source, CAST(CASE WHEN contains(source, 'src12') THEN 0.95 WHEN contains(source, 'src19') THEN 0.5 WHEN contains(source, 'src1') THEN 0.8 WHEN contains(source, 'c3') THEN 0.7 ELSE 0.6 END AS DOUBLE) AS reliability,
       count(*) AS n FROM documents GROUP BY 1, 2""",
}
ORACLES["query_limit"] = f"SELECT news_id, query FROM ({ORACLES['query_matches']}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY news_id) <= 25"
