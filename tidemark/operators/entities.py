"""Company and macro detection over articles.

The catalog and the taxonomy are configuration (a few hundred patterns at most). They become literal,
pre-compiled regular expressions inside one projection, so detection is a map-side scan of the articles:
no join, no shuffle, and every pattern is guarded by one alternation so most rows run few regexes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.headlines import price_report
from tidemark.params import DEFAULT_COMPANY_CATEGORY, PRICE_ACTION_CATEGORY
from tidemark.session import spread

#: More patterns than this must be split over several detection passes (the projection grows with them).
MAX_PATTERNS = 5_000
#: Relevance below which a match is not stored at all.
STORAGE_FLOOR = 0.10
NONE_ENTITY = "NONE"


@dataclass(frozen=True)
class Company:
    ticker: str
    name: str
    sector: str
    aliases: tuple = ()
    case_sensitive_aliases: tuple = ()
    exclude_patterns: tuple = ()


@dataclass(frozen=True)
class Category:
    category: str
    scope: str
    base_strength: float
    half_life_days: float
    keywords: tuple = field(default_factory=tuple)


def categories_from(rows: list[dict]) -> list[Category]:
    return [Category(r["category"], r["scope"], r["base_strength"], r["half_life_days"], tuple(r["keywords"]))
            for r in rows]


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def _bounded(text: str, case_sensitive: bool = False) -> str:
    """The text between edges. It leads the pattern, so that its left edge is looked at only where it stands."""
    flag = "" if case_sensitive else "(?i)"
    return rf"{flag}{_quote(text)}(?<![A-Za-z0-9]{_quote(text)})(?![A-Za-z0-9])"


def _plain(text: str) -> bool:
    return re.fullmatch("[A-Za-z0-9]+", text) is not None


def mention_count(text: Column, company: Company) -> Column:
    """Alias hits outside the excluded phrases; overlapping aliases each count."""
    def count(clean: Column) -> Column:
        total = F.lit(0)
        for alias in company.aliases:
            total = total + F.regexp_count(clean, F.lit(_bounded(alias, alias in company.case_sensitive_aliases)))
        return total

    clean = text
    for p in company.exclude_patterns:
        clean = F.regexp_replace(clean, "(?i)" + _quote(p), " ")
    guard = "(?i)" + "|".join(_quote(a) for a in company.aliases)
    return F.when(text.rlike(guard), F.transform(F.array(clean), count).getItem(0)).otherwise(0)


def category_hits(text: Column, categories: list[Category]) -> Column:
    """array<struct(position, category, keywords)> of the categories with at least one keyword in the text.

    One scan cuts the text into runs of letters and digits, and keywords that are such a run are looked up among those that any category
    has; the others are searched for one by one.
    """
    plain = sorted({k.lower() for c in categories for k in c.keywords if _plain(k)})

    def slot(position: int, c: Category, words: Column) -> Column:
        has = lambda k: F.array_contains(words, k.lower()) if _plain(k) else text.rlike(_bounded(k))
        found = F.array_compact(F.array(*[F.when(has(k), F.lit(k)) for k in c.keywords]))
        return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.struct(
            F.lit(position).alias("position"), F.lit(c.category).alias("category"), F.lit(c.scope).alias("scope"),
            F.lit(float(c.base_strength)).alias("base_strength"),
            F.lit(float(c.half_life_days)).alias("half_life_days"), f.alias("keywords")))).getItem(0)

    runs = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))
    words = F.array_distinct(F.filter(runs, lambda w: w.isin(plain))) if plain else F.array().cast("array<string>")
    return F.transform(F.array(words), lambda w: F.array_compact(F.array(*[slot(i, c, w) for i, c in enumerate(categories)]))).getItem(0)


def pick_category(hits: Column, title_hits: Column, scope: str) -> Column:
    """Strongest category of a scope: title match, then strength, then keyword count, then taxonomy order."""
    titles = F.transform(title_hits, lambda h: h["position"])
    ranked = F.transform(
        F.filter(hits, lambda h: h["scope"] == scope),
        lambda h: F.struct(
            F.array_contains(titles, h["position"]).cast("int").alias("in_title"), h["base_strength"].alias("strength"),
            F.size(h["keywords"]).alias("n"), (-h["position"]).alias("order"), h["category"].alias("category"),
            h["half_life_days"].alias("half_life_days"), h["keywords"].alias("keywords")))
    return F.array_max(ranked)


def detect_entities(news: DataFrame, companies: list[Company], categories: list[Category],
                    min_relevance: float = 0.3, title: str = "title", summary: str = "summary",
                    report_flag: Column | None = None, mark_irrelevant: bool = False) -> DataFrame:
    """One row per (article, entity): relevance, category, strength, half-life, matched terms, price_report.

    With ``mark_irrelevant`` an article without any entity keeps one ``NONE`` row, so it is not analysed again; the
    marker is produced in the same scan.
    """
    if sum(len(c.aliases) for c in companies) + sum(len(c.keywords) for c in categories) > MAX_PATTERNS:
        raise ValueError("too many patterns for one pass; split the catalog and union the passes")
    t, body = F.col(title), F.coalesce(F.col(summary), F.lit(""))
    full = F.concat(t, F.lit(". "), body)
    mentions = F.filter(
        F.array(*[F.struct(F.lit(c.ticker).alias("ticker"), mention_count(t, c).alias("in_title"),
                           mention_count(body, c).alias("in_body")) for c in companies]),
        lambda m: (m["in_title"] + m["in_body"]) > 0)
    base = (
        spread(news).withColumn("_companies", mentions)
        .withColumn("_title_hits", category_hits(t, categories))
        .withColumn("_hits", category_hits(full, categories))
        .withColumn("price_report", price_report(t) if report_flag is None else report_flag)
    )

    # macro entity
    macro = F.filter(F.col("_hits"), lambda h: h["scope"] == "macro")
    macro_title = F.filter(F.col("_title_hits"), lambda h: h["scope"] == "macro")
    words = lambda hits: F.aggregate(hits, F.lit(0), lambda a, h: a + F.size(h["keywords"]))
    n_title, n_all = words(macro_title), words(macro)
    rel = F.when(n_title > 0, 0.5 + 0.15 * F.least(n_title, F.lit(3))).otherwise(0.25 + 0.05 * F.least(n_all, F.lit(3)))
    rel = F.bround(F.least(F.lit(1.0), F.when(F.size("_companies") > 0, rel * 0.6).otherwise(rel)), 3)
    title_event = F.exists(macro_title, lambda h: h["category"] != "market_wrap")
    chosen = pick_category(F.col("_hits"), F.col("_title_hits"), "macro")
    macro_row = F.when(F.size(macro) > 0, F.struct(
        F.lit("MACRO").alias("entity"), F.lit(True).alias("is_macro"), rel.alias("relevance"),
        chosen["category"].alias("category"), chosen["strength"].alias("strength"),
        chosen["half_life_days"].alias("half_life_days"), chosen["keywords"].alias("matched"),
        (F.col("price_report") & ~title_event).alias("price_report")))

    # company entities
    source = F.when(F.col("price_report"), F.col("_title_hits")).otherwise(F.col("_hits"))
    company_pick = pick_category(source, F.col("_title_hits"), "company")
    name, strength, half_life = (
        F.when(F.col("price_report"), F.lit(p)).otherwise(F.lit(d))
        for p, d in zip(PRICE_ACTION_CATEGORY, DEFAULT_COMPANY_CATEGORY))
    category = F.coalesce(F.col("_pick.category"), name)
    matched = F.coalesce(F.get(F.filter(F.col("_hits"), lambda h: h["category"] == category), F.lit(0))["keywords"],
                         F.array().cast("array<string>"))

    def company_row(m: Column) -> Column:
        n = F.size("_companies")
        r = F.when(m["in_title"] > 0, 0.7).otherwise(0.4) + F.least(F.lit(0.3), 0.1 * (m["in_title"] + m["in_body"] - 1))
        r = F.when(n > 2, r / F.sqrt(n - 1)).otherwise(r)
        return F.struct(
            m["ticker"].alias("entity"), F.lit(False).alias("is_macro"),
            F.bround(F.least(F.lit(1.0), r), 3).alias("relevance"), F.col("_category").alias("category"),
            F.coalesce(F.col("_pick.strength"), strength).alias("strength"),
            F.coalesce(F.col("_pick.half_life_days"), half_life).alias("half_life_days"),
            F.col("_matched").alias("matched"), F.col("price_report").alias("price_report"))

    rows = (
        base.withColumn("_pick", company_pick)
        .withColumn("_category", category)
        .withColumn("_matched", matched)
        .withColumn("_rows", F.concat(F.transform("_companies", company_row), F.array_compact(F.array(macro_row))))
        .withColumn("_rows", F.filter("_rows", lambda r: r["relevance"] >= min_relevance))
    )
    keep = [c for c in news.columns]
    if mark_irrelevant:
        marker = F.struct(F.lit(NONE_ENTITY).alias("entity"), F.lit(False).alias("is_macro"), F.lit(0.0).alias("relevance"),
                          F.lit("unrelated").alias("category"), F.lit(0.0).alias("strength"), F.lit(0.0).alias("half_life_days"),
                          F.array().cast("array<string>").alias("matched"), F.lit(False).alias("price_report"))
        rows = rows.withColumn("_rows", F.when(F.size("_rows") == 0, F.array(marker)).otherwise(F.col("_rows")))
    # explode_outer + filter: a plain explode would push "size(_rows) > 0" down to the scan and evaluate it all twice.
    return rows.select(*keep, F.explode_outer("_rows").alias("_e")).where(F.col("_e").isNotNull()).select(*keep, "_e.*")


def source_reliability(source: Column, table: dict[str, float]) -> Column:
    """Value of the longest configured name contained in the source; the default otherwise."""
    names = sorted((k for k in table if k != "default"), key=len)
    out = F.lit(float(table.get("default", 0.6)))
    for name in names:
        out = F.when(F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit(name)), float(table[name])).otherwise(out)
    return out


def event_strength(base_strength: Column, intensity: Column) -> Column:
    return F.bround(base_strength * (0.5 + 0.5 * F.least(F.lit(1.0), intensity / 3.0)), 4)


def pending_articles(news: DataFrame, analysis: DataFrame, engine: str) -> DataFrame:
    """Articles without an analysis row of this engine version."""
    return news.join(analysis.where(F.col("engine") == engine).select("news_id"), "news_id", "left_anti")


def analyse(news: DataFrame, companies: list[Company], categories: list[Category], reliability: dict[str, float],
            scorer, neutral_band: float = 15) -> DataFrame:
    """Full article analysis. ``scorer`` maps a DataFrame to itself plus score, raw, intensity, engine.

    The scorer is any DataFrame -> DataFrame function: the lexicon expressions, or a ``mapInPandas`` model.
    """
    from tidemark.functions.sentiment import label

    hits = detect_entities(scorer(news), companies, categories, STORAGE_FLOOR, mark_irrelevant=True)
    found = F.col("entity") != NONE_ENTITY
    return hits.select(
        "news_id", "entity", "is_macro", "category", "relevance", F.when(found, F.col("score")).otherwise(0.0).alias("sentiment"),
        F.when(found, label(F.col("score"), neutral_band)).otherwise("NEUTRAL").alias("sentiment_label"),
        F.when(found, event_strength(F.col("strength"), F.col("intensity"))).otherwise(0.0).alias("strength"),
        F.when(found, source_reliability(F.col("source"), reliability)).otherwise(0.0).alias("reliability"), "half_life_days", "price_report", "engine")


def model_scorer(predict, engine: str):
    """Wrap ``predict(pandas.DataFrame[title, summary]) -> probabilities difference`` as a batch scorer."""
    def run(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [
            T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType()),
            T.StructField("intensity", T.DoubleType()), T.StructField("engine", T.StringType())])

        def score(batches):
            for pdf in batches:
                raw = predict(pdf)
                yield pdf.assign(raw=raw, score=(100 * raw).round(2), intensity=raw.abs() * 3, engine=engine)

        return df.mapInPandas(score, schema)

    return run
