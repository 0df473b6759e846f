import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars as bar_store
from tidemark.sources import feeds, plugin, validation
from tidemark.sources.commits import CommitLog, exactly_once
from tidemark.streaming import jobs

FEED = """<rss><channel>
<item><title>HDFC Bank gains - Reuters</title><link>https://a.com/1</link><pubDate>Tue, 29 Sep 2026 08:25:49 +0530</pubDate><guid>g1</guid>
<description>&lt;p&gt;Rises &amp;amp; shines&amp;nbsp;&amp;#8217;s&lt;/p&gt;</description><source url="https://r.com">Reuters</source></item>
<item><title>RBI keeps repo rate</title><link>https://a.com/2</link><pubDate>Tue, 29 Sep 2026 07:00:00 GMT</pubDate><source url="x">Mint</source></item>
<item><title>No date</title><link>https://a.com/3</link></item>
</channel></rss>"""


def test_xml_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    items = feeds.read_items(spark, str(tmp_path / "f.xml"))
    rows = {r["url"]: r for r in feeds.search_feed(items).collect()}
    assert rows["https://a.com/1"]["title"] == "HDFC Bank gains" and rows["https://a.com/1"]["timestamp_precision"] == "exact"
    assert str(rows["https://a.com/1"]["published_at"]) == "2026-09-29 02:55:49" and rows["https://a.com/1"]["published_timezone"] == "+05:30"
    assert rows["https://a.com/2"]["timestamp_precision"] == "date_only"
    assert rows["https://a.com/3"]["published_at"] is None and rows["https://a.com/3"]["source"] == "unknown"
    late = feeds.search_feed(items, start=F.lit("2026-09-29 05:00:00").cast("timestamp_ntz"))
    assert {r["url"] for r in late.collect()} == {"https://a.com/2", "https://a.com/3"}
    pub = {r["url"]: r for r in feeds.publisher_feed(items, "Mint").collect()}
    assert pub["https://a.com/1"]["summary"] == "Rises & shines ’s" and pub["https://a.com/3"]["provider_article_id"] == "https://a.com/3"
    both = feeds.union_sources(feeds.search_feed(items), feeds.publisher_feed(items, "Mint"))
    hit = {(r["provider"], r["query"], r["url"]) for r in feeds.match_queries(both, ['"HDFC Bank"', "RBI repo rate"]).collect()}
    assert ("publisher_rss", '"HDFC Bank"', "https://a.com/1") in hit and ("publisher_rss", "RBI repo rate", "https://a.com/2") in hit and len(hit) == 4
    checked = validation.validate(both, F.lit("2026-09-29 06:00:00").cast("timestamp_ntz"))
    n = {r["provider"]: r for r in validation.reject_counts(checked).collect()}["publisher_rss"]
    assert (n["accepted"], n["rejected_missing_timestamp"], n["rejected_future_timestamp"]) == (1, 1, 1)
    firsts = feeds.first_seen(both.withColumn("n", F.monotonically_increasing_id()), "n")
    assert firsts.count() == 3


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"articles": [{"source": {"name": "X"}, "title": "t", "url": "http://u", "publishedAt": "2026-01-02T03:04:05Z", "description": "d"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"source": "s", "title": "t", "url": "http://v", "published_at": "2026-01-02T03:04:05.5Z", "snippet": "sn", "uuid": "u1"}]}))
    a = feeds.json_articles(feeds.read_json(spark, str(tmp_path / "a.json")), "newsapi").first()
    b = feeds.json_articles(feeds.read_json(spark, str(tmp_path / "b.json")), "marketaux").first()
    assert (a["source"], a["summary"], a["timezone_status"]) == ("X", "d", "explicit")
    assert (b["summary"], b["provider_article_id"], b["timestamp_precision"]) == ("sn", "u1", "exact")


def test_plugin_source(spark):
    def partitions(options):
        return range(int(options["slices"]))

    def fetch(i):
        yield {"provider": "mine", "title": f"t{i}", "url": f"http://x/{i}"}

    source = plugin.article_source("mine", partitions, fetch)
    plugin.register(spark, source)
    assert {r["title"] for r in spark.read.format("mine").option("slices", 3).load().collect()} == {"t0", "t1", "t2"}
    assert plugin.enabled(["mine", "other"], {"mine": source}) == ([source], ["other"])


def test_bar_store_upserts(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = lambda close, at: spark.createDataFrame(
        [("A", dt.date(2025, 12, 31), close, at), ("A", dt.date(2026, 1, 1), close, at), ("A", dt.date(2026, 1, 2), 0.0, at)],
        "ticker string, date date, close double, fetched_at timestamp_ntz")
    bar_store.store_bars(rows(1.0, dt.datetime(2026, 1, 3)), path)
    bar_store.store_bars(rows(2.0, dt.datetime(2026, 1, 4)).where("date > '2025-12-31'"), path)
    table = lambda: sorted((str(r["date"]), r["close"]) for r in bar_store.stored_bars(spark, path).collect())
    assert table() == [("2025-12-31", 1.0), ("2026-01-01", 2.0)]
    for _ in range(2):  # the same delivery twice
        bar_store.store_bars(rows(3.0, dt.datetime(2026, 1, 5)).where("date < '2026-01-01'"), path, delivery=9)
    assert table() == [("2025-12-31", 3.0), ("2026-01-01", 2.0)]
    bar_store.store_bars(rows(4.0, dt.datetime(2026, 1, 1)), path)  # fetched earlier: nothing is newer
    assert table() == [("2025-12-31", 3.0), ("2026-01-01", 2.0)]


def test_a_bar_writer_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    rows = lambda close, at: spark.createDataFrame([("A", dt.date(2026, 1, 1), close, at)], "ticker string, date date, close double, fetched_at timestamp_ntz")
    bar_store.store_bars(rows(1.0, dt.datetime(2026, 1, 3)), path)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            bar_store.store_bars(rows(2.0, dt.datetime(2026, 1, 4)), path)
    assert [r.close for r in bar_store.stored_bars(spark, path).collect()] == [1.0]
    log = CommitLog(spark, path)
    assert log.clean() == 0 and log.clean(older_than_s=-5) == 1
    bar_store.store_bars(rows(2.0, dt.datetime(2026, 1, 4)), path)
    assert [r.close for r in bar_store.stored_bars(spark, path).collect()] == [2.0]


def test_commits_find_the_next_free_version(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "t"))
    assert log.entries() == [] and log.read("x long").collect() == []
    log.write(spark.range(2).withColumnRenamed("id", "x"), "a", 0)
    with monkeypatch.context() as m:  # a writer that has not seen the first commit
        m.setattr(CommitLog, "entries", lambda self: [])
        assert log.publish("b", 0, "commit=none", notes={"k": "v"}) == 1
    assert [(e.version, e.owner, e.batch, e.notes) for e in log.entries()] == [(0, "a", 0, {}), (1, "b", 0, {"k": "v"})]
    assert [e.owner for e in log.before("a", 0)] == ["b"] and [e.owner for e in log.before("b", 1)] == ["a", "b"]


@pytest.mark.parametrize("kind", ["urls", "titles", "outcomes"])
def test_a_batch_that_is_delivered_again_leaves_the_table_as_it_is(spark, tmp_path, kind, monkeypatch):
    """Twice the same batch id, before and after the commit, and once more after later batches."""
    at = dt.datetime(2026, 1, 1)
    if kind == "urls":
        frame = lambda rows: spark.createDataFrame(rows, "news_id long, url_hash string").withColumn("prefix", F.substring("url_hash", 1, 2))
        batches = [frame([(2, "aa2"), (1, "ab1"), (3, "aa2")]), frame([(4, "aa2"), (5, "ba9"), (6, "ab1")])]
        write = exactly_once(str(tmp_path / "t"), jobs.first_deliveries(), partition_by=("prefix",))
        schema, want = "news_id long, url_hash string", [(1, "ab1"), (2, "aa2"), (5, "ba9")]
    elif kind == "titles":
        t = "Monsoon reaches Kerala coast two days early"
        frame = lambda rows: spark.createDataFrame(rows, "news_id long, title string, published_at timestamp_ntz")
        batches = [frame([(1, t, at), (2, "Other words about nothing", at)]), frame([(3, t, at + dt.timedelta(hours=5)), (4, "Other words about nothing", at + dt.timedelta(hours=60))])]
        write = exactly_once(str(tmp_path / "t"), jobs.near_duplicates_in())
        schema, want = "news_id long, duplicate_of long", [(1, None), (2, None), (3, 1), (4, None)]
    else:
        p = spark.createDataFrame([(k, "A", dt.date(2026, 1, k), "OK", False, 1.0, 100.0, 1.0, "up", "v1") for k in (1, 2, 3)],
                                  "prediction_id long, ticker string, target_date date, status string, is_backtest boolean, predicted_movement double, previous_close double,"
                                  " uncertainty_1sigma_pct double, predicted_direction string, param_version string")
        frame = lambda rows: spark.createDataFrame(rows, "ticker string, date date, close double")
        batches = [frame([("A", dt.date(2026, 1, 1), 101.0)]), frame([("A", dt.date(2026, 1, 1), 105.0), ("A", dt.date(2026, 1, 2), 99.0)])]
        thresholds = spark.createDataFrame([("v1", 0.1)], "param_version string, neutral_threshold_sigma double")
        write = exactly_once(str(tmp_path / "t"), jobs.outcome_step(lambda: p, lambda: p.limit(0), lambda: thresholds, F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")))
        schema, want = "prediction_id long, actual_close double", [(1, 101.0), (2, 99.0)]
    log = CommitLog(spark, str(tmp_path / "t"))
    table = lambda: sorted(map(tuple, log.read(schema).collect()))
    with monkeypatch.context() as m:  # the writer dies between its files and its commit
        m.setattr(CommitLog, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            write(batches[0], 0)
    assert table() == []
    write(batches[0], 0)
    first = table()
    write(batches[0], 0)
    assert table() == first and first == want[: len(first)]
    write(batches[1], 1)
    assert table() == want
    write(batches[0], 0)
    write(batches[1], 1)
    assert table() == want


def test_windows_and_queries(spark):
    w = feeds.backfill_windows(spark, "2026-01-01 00:00:00", "2026-01-10 00:00:00", 4).orderBy("from_ts").collect()
    assert [(str(r[0]), str(r[1])) for r in w][-1] == ("2026-01-09 00:00:00", "2026-01-10 00:00:00") and len(w) == 3
    cat = spark.createDataFrame([("A", "A Ltd", ["Aaa"]), ("B", "B Ltd", [])], "ticker string, name string, aliases array<string>")
    assert {r["query"] for r in feeds.query_list(cat, ["rates"]).collect()} == {'"Aaa"', '"B Ltd"', "rates"}


def test_micro_batches_resolve_like_one_batch(spark):
    from tidemark.operators.dedup import near_duplicates

    t = "Monsoon reaches Kerala coast two days early"
    at = dt.datetime(2026, 1, 1)
    rows = [(1, t, at), (2, t + " report", at + dt.timedelta(hours=30)), (3, t, at + dt.timedelta(hours=60)), (4, t, at + dt.timedelta(hours=70))]
    schema = "news_id long, title string, published_at timestamp_ntz"
    whole = {r["news_id"]: r["duplicate_of"] for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    first, second = spark.createDataFrame(rows[:2], schema), spark.createDataFrame(rows[2:], schema)
    a = {r["news_id"]: r["duplicate_of"] for r in jobs.near_duplicates_in()(first, lambda s: spark.createDataFrame([], s)).collect()}
    held = spark.createDataFrame([(*r, a[r[0]]) for r in rows[:2]], schema + ", duplicate_of long")
    b = {r["news_id"]: r["duplicate_of"] for r in jobs.near_duplicates_in()(second, lambda s: held).collect()}
    assert {**a, **b} == whole == {1: None, 2: 1, 3: None, 4: 3}


def test_late_rows_are_labelled_and_counted(spark, tmp_path):
    """Three deliveries through a stream: the totals hold every row, the label tells the late ones."""
    at = lambda d, h=0: dt.datetime(2026, 1, d, h)
    schema = "entity string, available_at timestamp_ntz, sentiment double"
    deliveries = [[("A", at(1), 1.0), ("A", at(10), 2.0)], [("A", at(1, 5), 4.0), ("A", at(9), 8.0), ("B", at(12), 1.0)], [("B", at(11), 3.0), ("A", at(2), 5.0)]]
    out = f"{tmp_path}/out"
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/source")
        jobs.start(stream, jobs.labelled(out, "available_at", 48, jobs.daily_statistics), f"{tmp_path}/offsets").awaitTermination()
    got = {(r["entity"], r["day"].day): (r["n"], r["n_late"], r["s"]) for r in jobs.totals(CommitLog(spark, out).read("entity string, day date, n long, n_late long, s double, ss double"), "entity", "day").collect()}
    assert got == {("A", 1): (2, 1, 5.0), ("A", 10): (1, 0, 2.0), ("A", 9): (1, 0, 8.0), ("B", 12): (1, 0, 1.0), ("B", 11): (1, 0, 3.0), ("A", 2): (1, 1, 5.0)}


def test_one_url_over_several_batches(spark):
    raw = spark.createDataFrame([(2, "h2"), (1, "h1"), (3, "h2"), (4, "h9")], "news_id long, url_hash string").withColumn("prefix", F.substring("url_hash", 1, 2))
    known = spark.createDataFrame([("h9", "h9")], "url_hash string, prefix string")
    assert {(r["url_hash"], r["news_id"]) for r in jobs.first_deliveries()(raw, lambda s: known).collect()} == {("h1", 1), ("h2", 2)}


def test_a_condition_on_the_stamp_does_not_parse_it_again(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import feeds

    items = spark.createDataFrame([("t", "l", "2024-01-05 10:00:00", "g", "d", "s")], "title string, link string, pubDate string, guid string, description string, source string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    plan = feeds.search_feed(items, at, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract" in line]
