"""Table schemas (naive-UTC timestamps, doubles for money, dates for sessions)."""

RAW_ARTICLE = (
    "provider string, source string, title string, url string, published_at timestamp_ntz, summary string, query string, article_text string, "
    "provider_article_id string, published_raw string, published_timezone string, timezone_status string, timestamp_precision string"
)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double"
FETCH_LOG = (
    "provider string, query string, started_at timestamp_ntz, status string, error string, fetched bigint, new_items bigint, "
    "duplicates_at_collection bigint, rejected_future bigint, rejected_missing_timestamp bigint, rejected_invalid bigint"
)
UNIVERSE = (
    "version string, ticker string, company string, weight double, effective_from date, effective_to date, source string, source_date date, status string"
)
CATALOG = (
    "ticker string, name string, sector string, aliases array<string>, case_sensitive_aliases array<string>, exclude_patterns array<string>"
)
FEED_ITEM = "title string, link string, pubDate string, guid string, description string, source string"
JSON_PAYLOAD = (
    "articles array<struct<source: struct<name: string>, title: string, url: string, publishedAt: string, description: string, id: string>>, "
    "data array<struct<source: string, title: string, url: string, published_at: string, description: string, snippet: string, uuid: string>>"
)
