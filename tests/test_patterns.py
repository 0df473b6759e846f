"""Pattern tables against the literal operators that they stand in for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import patterns, tallies
from tidemark.operators.entities import Category, Company, category_hits, mention_count

COMPANIES = [
    Company("AA", "Alpha Steel", "s", ("Alpha", "Alpha Steel", "A&B"), (), ()),
    Company("IT", "It Ltd", "s", ("IT", "Info Tech"), ("IT",), ()),
    Company("BB", "Beta", "s", ("Beta", "Dr. Beta's", "beta-max"), (), ("beta version", "alpha beta")),
    Company("CC", "Gamma", "s", ("never seen words",), (), ()),
]


def table(spark, companies):
    rows = [(c.ticker, a, a in c.case_sensitive_aliases) for c in companies for a in c.aliases]
    return spark.createDataFrame(rows, "owner string, pattern string, case_sensitive boolean"), spark.createDataFrame(
        [(c.ticker, list(c.exclude_patterns)) for c in companies if c.exclude_patterns], "owner string, phrases array<string>")


def texts(seed, n=120):
    rng = random.Random(seed)
    parts = ["Alpha", "alpha steel", "ALPHA", "A&B", "a&bc", "IT", "it", "Info Tech", "info-tech", "Beta", "dr. beta's", "beta-max", "beta version", "Alpha Beta", "xBeta", "Beta9", "İT", "étabeta",
             "and", "the", ".", ",", "K"]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), None if i % 17 == 0 else rng.choice([" ", "-", ""]).join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_equal_the_literal_catalog(spark, seed):
    news = spark.createDataFrame(texts(seed), "news_id long, title string, summary string").repartition(3)
    aliases, excluded = table(spark, COMPANIES)
    got = {(r.news_id, r.owner): (r.in_title, r.in_body) for r in patterns.mentions(news, aliases, excluded).collect()}
    body = F.coalesce("summary", F.lit(""))
    rows = news.select("news_id", *[F.struct(mention_count(F.col("title"), c), mention_count(body, c)).alias(c.ticker) for c in COMPANIES]).collect()
    want = {(r.news_id, c.ticker): tuple(r[c.ticker]) for r in rows for c in COMPANIES if sum(r[c.ticker])}
    assert got == want and {t for _, t in want} == {"AA", "IT", "BB"}


def test_keywords_equal_the_literal_taxonomy(spark):
    categories = [Category("x", "macro", 1.0, 1.0, ("alpha", "info tech")), Category("y", "company", 1.0, 1.0, ("beta", "dr. beta's", "k"))]
    news = spark.createDataFrame(texts(3), "news_id long, title string, summary string").withColumn("summary", F.coalesce("summary", F.lit("")))
    taxonomy = spark.createDataFrame([(c.category, k, False) for c in categories for k in c.keywords], "owner string, pattern string, case_sensitive boolean")
    got = {(r.news_id, r.owner): (r.title_keywords, r.keywords) for r in patterns.keywords(news, taxonomy).collect()}
    both = F.concat("title", F.lit(" . "), "summary")
    want = {}
    for r in news.select("news_id", category_hits(F.col("title"), categories).alias("t"), category_hits(both, categories).alias("a")).collect():
        titles = {h.category: len(h.keywords) for h in r.t}
        want |= {(r.news_id, h.category): (titles.get(h.category, 0), len(h.keywords)) for h in r.a}
    assert got == want and want


def test_edges(spark):
    news = spark.createDataFrame([(1, "Alpha", None), (2, None, "alpha"), (3, "", "")], "news_id long, title string, summary string")
    aliases, _ = table(spark, COMPANIES[:1])
    assert {(r.news_id, r.in_title, r.in_body) for r in patterns.mentions(news, aliases.union(aliases)).collect()} == {(1, 1, 0), (2, 0, 1)}
    assert patterns.mentions(news, aliases.limit(0)).collect() == [] and patterns.mentions(news.limit(0), aliases).collect() == []
    with pytest.raises(ValueError, match="letter or digit"):
        patterns.mentions(news, spark.createDataFrame([("X", "&", False)], aliases.schema))


def shuffled_bytes(spark):
    store, no = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, no, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_common_tokens_do_not_multiply(spark):
    """3,540 pairs of 60 words that every article has: only those that stand together may meet an article."""
    rng, words = random.Random(3), [f"w{i}" for i in range(60)]
    bodies = [(i, "", " ".join(rng.sample(words, 60))) for i in range(200)]
    news = spark.createDataFrame(bodies, "news_id long, title string, summary string")
    aliases = spark.createDataFrame([(f"c{i % 7}", f"{a} {b}", False) for i, (a, b) in enumerate((a, b) for a in words for b in words if a != b)], "owner string, pattern string, case_sensitive boolean")
    before = shuffled_bytes(spark)
    got = patterns.mentions(news, aliases).agg(F.sum("in_body"), F.sum("in_title")).first()
    assert tuple(got) == (200 * 59, 0) and shuffled_bytes(spark) - before < 3_000_000


def counted(news, aliases):
    """The definition, an expression per alias and article."""
    out = {}
    for owner, pattern, own_case in set(aliases):
        found = re.compile(rf"(?<![A-Za-z0-9]){re.escape(pattern)}(?![A-Za-z0-9])", re.ASCII | (0 if own_case else re.IGNORECASE))
        for i, title, body in news:
            n = out.setdefault((i, owner), [0, 0])
            n[0] += len(found.findall(title or ""))
            n[1] += len(found.findall(body or ""))
    return {k: tuple(n) for k, n in out.items() if sum(n)}


@pytest.mark.parametrize("owners, bitmaps, filters", [(2048, 32 << 20, 24 << 20), (3, 1 << 14, 1 << 10), (2048, 0, 0)])
def test_mentions_equal_an_expression_per_alias(spark, monkeypatch, owners, bitmaps, filters):
    """Whether owners are broadcast or met in the exchange; aliases in several cases count as often as an owner has them, tokens over the edge of a text don't."""
    for name, value in (("OWNERS", owners), ("BITMAP_BYTES", bitmaps), ("FILTER_BYTES", filters)):
        monkeypatch.setattr(tallies, name, value)
    rng = random.Random(5)
    words = ["The", "the", "THE", "cat", "Cat", "of", "Of", "x1", "été", "K", "ſat", "日本", "n0"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", "  ", ", "]) for _ in range(n)).strip()
    news = [(i, text(4), None if i % 9 == 0 else text(rng.choice([0, 5, 40, 900]))) for i in range(60)]
    aliases = [(f"c{rng.randrange(12)}", p, rng.random() < 0.4) for p in (text(rng.randint(1, 4)) for _ in range(700)) if re.search("[A-Za-z0-9]", p)]
    table = spark.createDataFrame(aliases, "owner string, pattern string, case_sensitive boolean").repartition(3)
    got = patterns.mentions(spark.createDataFrame(news, "news_id long, title string, summary string").repartition(3), table).collect()
    want = counted(news, aliases)
    assert len(got) == len(want) > 500 and {(r.news_id, r.owner): (r.in_title, r.in_body) for r in got} == want


def test_owners_do_not_travel_with_places(spark):
    """400 owners of each of 4,000 patterns: what is shuffled follows the catalog and the texts, not their product."""
    pair = lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(" b"), i.cast("string"))
    aliases = spark.range(400 * 4000, numPartitions=4).select(F.concat(F.lit("c"), (F.col("id") % 400).cast("string")).alias("owner"), pair(F.floor(F.col("id") / 400)).alias("pattern"), F.lit(False).alias("case_sensitive"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: pair((F.col("id") * 37 + k * 19) % 4000)), ", ")
    news = spark.range(100, numPartitions=4).select(F.col("id").alias("news_id"), F.lit("").alias("title"), body.alias("summary"))
    before = shuffled_bytes(spark)
    got = patterns.mentions(news, aliases).agg(F.count("*"), F.sum("in_body"), F.sum("in_title")).first()
    assert tuple(got) == (100 * 400, 100 * 200 * 400, 0) and shuffled_bytes(spark) - before < 8_000_000
