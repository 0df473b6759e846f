"""Readers that bring feed, JSON and custom sources to one raw-article schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.timestamps import parse_timestamp

# Character references that occur in feed text.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“",
            "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Named references above and every decimal or hexadecimal one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(&#[xX]?[0-9a-fA-F]+;|(?:(?!&#[xX]?[0-9a-fA-F]+;)[\s\S])+)"), F.lit(1))

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        # chr() covers one byte only; wider code points are decoded from UTF-16.
        unit = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        pair = F.decode(F.unhex(F.concat(
            F.lpad(F.hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), 4, "0"),
            F.lpad(F.hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)), 4, "0"))), "UTF-16BE")
        return F.when(piece.rlike("^&#[xX]?[0-9a-fA-F]+;$") & code.isNotNull(), F.when(code > 0xFFFF, pair).otherwise(unit)).otherwise(piece)

    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def clean_html(text: Column) -> Column:
    """Tags to spaces, references decoded, whitespace collapsed, empty -> null."""
    t = unescape(F.regexp_replace(text, "<[^>]+>", " "))
    return F.nullif(F.trim(F.regexp_replace(t, r"[\s ]+", " ")), F.lit(""))


def strip_publisher(title: Column, source: Column) -> Column:
    suffix = F.concat(F.lit(" - "), source)
    return F.when((source != "unknown") & F.endswith(title, suffix),
                  F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))).otherwise(title)


def _article(provider: str, source: Column, title: Column, url: Column, stamp: Column, summary: Column, article_id: Column, query: Column | None = None,
             precision: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.lit(provider).alias("provider"), source.alias("source"), title.alias("title"), url.alias("url"), stamp["utc"].alias("published_at"),
        summary.alias("summary"), (query if query is not None else none).alias("query"), none.alias("article_text"), article_id.alias("provider_article_id"),
        stamp["raw"].alias("published_raw"), stamp["timezone"].alias("published_timezone"), stamp["tz_status"].alias("timezone_status"),
        F.when(stamp["utc"].isNull(), "unknown").otherwise(precision if precision is not None else stamp["precision"]).alias("timestamp_precision")]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``<item>`` elements of RSS files, split across tasks by the built-in XML reader."""
    schema = "title string, link string, pubDate string, guid struct<_VALUE: string, _isPermaLink: string>, description string, source struct<_VALUE: string, _url: string>"
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return raw.select("title", "link", "pubDate", F.col("guid._VALUE").alias("guid"), "description", F.col("source._VALUE").alias("source"))


def _stamped(df: DataFrame, stamp: Column) -> DataFrame:
    """``df`` with the parsed stamp as ``_s``; the generator keeps every use of a field, conditions included, from parsing it once more."""
    return df.select("*", F.explode(F.array(stamp)).alias("_s"))


def search_feed(items: DataFrame, start=None, end=None, provider: str = "google_news_rss", query: Column | None = None) -> DataFrame:
    """Search-feed items: publisher suffix removed; items outside [start, end] dropped, items without a stamp kept.

    A stamp at exactly 07:00:00 is a date without a time.
    """
    base = _stamped(items, parse_timestamp(F.col("pubDate"))).withColumn("_src", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")))
    utc = F.col("_s.utc")
    if start is not None:
        base = base.where(utc.isNull() | (utc >= start))
    if end is not None:
        base = base.where(utc.isNull() | (utc <= end))
    marker = F.date_format(utc, "HH:mm:ss.SSSSSS") == "07:00:00.000000"
    precision = F.when(marker, "date_only").otherwise(F.col("_s.precision"))
    return base.select(*_article(
        provider, F.col("_src"), strip_publisher(F.trim(F.coalesce("title", F.lit(""))), F.col("_src")), F.trim(F.coalesce("link", F.lit(""))),
        F.col("_s"), F.lit(None).cast("string"), F.col("guid"), query, precision))


def publisher_feed(items: DataFrame, publisher: str, provider: str = "publisher_rss") -> DataFrame:
    """Publisher-feed items: HTML cleaned, guid falls back to the link."""
    base = _stamped(items, parse_timestamp(F.col("pubDate")))
    link = F.trim(F.coalesce("link", F.lit("")))
    guid = F.nullif(F.trim(F.coalesce(F.nullif("guid", F.lit("")), link)), F.lit(""))
    return base.select(*_article(provider, F.lit(publisher), F.coalesce(clean_html(F.col("title")), F.lit("")), link, F.col("_s"),
                                 clean_html(F.col("description")), guid))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JSON_PAYLOAD).option("multiLine", "true").json(path)


def json_articles(payloads: DataFrame, provider: str, query: Column | None = None) -> DataFrame:
    """The three JSON shapes: ``articles[]`` (id = url or id) and ``data[]`` (description, else snippet)."""
    zone = F.lit("UTC")
    if provider == "marketaux":
        a = _stamped(payloads.select(F.explode("data").alias("a")).select("a.*"), parse_timestamp(F.col("published_at"), zone))
        return a.select(*_article(provider, F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")),
                                  F.col("_s"), F.coalesce(F.nullif("description", F.lit("")), F.col("snippet")), F.col("uuid"), query))
    a = _stamped(payloads.select(F.explode("articles").alias("a")).select("a.*"), parse_timestamp(F.col("publishedAt"), zone))
    ident = F.coalesce(F.nullif("id", F.lit("")), F.col("url")) if provider == "gnews" else F.col("url")
    return a.select(*_article(provider, F.coalesce(F.nullif(F.col("source.name"), F.lit("")), F.lit("unknown")), F.coalesce("title", F.lit("")),
                              F.coalesce("url", F.lit("")), F.col("_s"), F.col("description"), ident, query))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- queries --------------------------------------------------------------------------------------
def query_list(catalog: DataFrame, macro_queries: list[str]) -> DataFrame:
    """One quoted primary alias per company, then the market-wide queries."""
    spark = catalog.sparkSession
    own = catalog.select(F.concat(F.lit('"'), F.coalesce(F.get("aliases", F.lit(0)), F.col("name")), F.lit('"')).alias("query"))
    macro = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in macro_queries])).alias("query")) if macro_queries else None
    return own.unionByName(macro) if macro is not None else own


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([a-z0-9&]+)"), F.lit(1))


def query_match(query: str, title: Column, summary: Column) -> Column:
    """Quoted query: phrase between non-alphanumerics. Otherwise at least half of its words of three letters or more."""
    import re

    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(summary, F.lit(""))))
    q = query.strip()
    if len(q) >= 2 and q.startswith('"') and q.endswith('"'):
        phrase = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", q.strip('"').lower())
        return text.rlike(f"(?<![a-z0-9]){phrase}(?![a-z0-9])")
    words = [w for w in re.findall(r"[a-z0-9&]+", q.lower()) if len(w) >= 3]
    if not words:
        return F.lit(False)
    tokens = _words(text)
    hits = sum((F.array_contains(tokens, w).cast("int") for w in words), F.lit(0))
    return hits >= max(1, (len(words) + 1) // 2)


def match_queries(articles: DataFrame, queries: list[str]) -> DataFrame:
    """Articles x matching queries (a handful of configured queries, evaluated inside one scan)."""
    found = F.array_compact(F.array(*[F.when(query_match(q, F.col("title"), F.col("summary")), F.lit(q)) for q in queries]))
    return articles.drop("query").withColumn("query", F.explode_outer(found)).where(F.col("query").isNotNull())


def first_seen(articles: DataFrame, order: str, url: str = "url") -> DataFrame:
    """First item per URL within one fetch, by feed order (map-side combined)."""
    rest = [c for c in articles.columns if c not in (order, url)]
    return articles.groupBy(url).agg(F.min(F.struct(order, *rest)).alias("_r")).select(url, "_r.*").where(F.col(url) != "")


def limit_per_query(articles: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """First ``limit`` items per query in feed order (limited map-side before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(*order)
    return articles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def backfill_windows(spark: SparkSession, start: str, end: str, chunk_days: int) -> DataFrame:
    """(chunk, from_ts, to_ts): consecutive windows; all but the last end one second before the next starts."""
    s, e = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    edges = spark.range(1).select(F.explode(F.sequence(s, e, F.expr(f"interval {int(chunk_days)} days"))).alias("from_ts"), e.alias("_e"))
    nxt = F.timestamp_add("DAY", F.lit(int(chunk_days)), F.col("from_ts"))
    return edges.where(F.col("from_ts") < F.col("_e")).select("from_ts", F.least(F.timestamp_add("SECOND", F.lit(-1), nxt), F.col("_e")).alias("to_ts"))
