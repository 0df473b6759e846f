"""Key phrases (degree / frequency scoring) and the keyword merge."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexicon import PHRASE_STOP_WORDS
from tidemark.session import spread


def phrase_windows(text: Column, stop_words: list[str], max_words: int) -> Column:
    """array<string>: runs of non-stop words, cut into windows of at most ``max_words``, words joined by a space."""
    # words, and what breaks a phrase: any sign but digits, "&", "-" and white space, each alone, and a hyphen between spaces
    # (the signs as ranges: a negated class with \s in it takes twice the time)
    signs = r"[\x00-\x08\x0E-\x1F!-%'-,./:-@\[-`{-~\x7F-\x{10FFFF}]"
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-zA-Z][a-zA-Z0-9&\-]*|{signs}|-(?<=\s-)(?=\s)"), F.lit(0))
    marked = F.transform(words, lambda w: F.when(w.isin(stop_words) | (F.length(w) < 2), "|").otherwise(w))
    return F.regexp_extract_all(F.array_join(marked, " "), F.lit(r"[^ |]+(?: [^ |]+){0,%d}" % (max_words - 1)), F.lit(0))


def best_phrases(phrases: list[list[str]], top_n: int) -> list[tuple[str, float]]:
    """Best scored phrases of one document: a word weighs (degree + frequency) / frequency, a phrase the sum of its words."""
    frequency, degree = Counter(), Counter()
    for words in phrases:
        for w in words:
            frequency[w] += 1
            degree[w] += len(words) - 1
    scores = {" ".join(words): round(sum((degree[w] + frequency[w]) / frequency[w] for w in words), 6) for words in map(tuple, phrases)}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top_n]


def rake(df: DataFrame, key: str, text: str, max_words: int = 3, top_n: int = 8,
         stop_words: list[str] | None = None) -> DataFrame:
    """(key, phrase, score, rank): top phrases per document.

    Everything is within one document, so nothing is shuffled: phrases are split in the JVM and scored in Python, which holds a hundred documents at a time.
    """
    stops = stop_words or PHRASE_STOP_WORDS
    joined = F.array_join(phrase_windows(F.col(text), stops, max_words), "\n")
    phrases = spread(df.select(key, text)).select(key, joined.alias("p"))

    # a row at a time: an Arrow batch would hold the phrases of 10,000 documents as Python objects at once
    @F.udf("array<struct<phrase: string, score: double>>", useArrow=False)
    def best(p: str | None) -> list:
        return best_phrases([w.split(" ") for w in p.split("\n")], top_n) if p else []

    found = phrases.select(key, F.posexplode(best("p")).alias("at", "b"))
    return found.select(key, "b.phrase", "b.score", (F.col("at") + 1).alias("rank"))


def corpus_rake(df: DataFrame, text: str, max_words: int = 3, top_n: int = 100,
                stop_words: list[str] | None = None) -> DataFrame:
    """Corpus-level phrases: word statistics over all documents, one row per distinct phrase.

    Neither phrases nor words are bounded, so both are joined by shuffle; the words' side is hashed (a partition holds its share of the
    vocabulary), which leaves the many more places of words unsorted.
    """
    stops = stop_words or PHRASE_STOP_WORDS
    phrases = (
        spread(df.select(text)).select(F.explode_outer(phrase_windows(F.col(text), stops, max_words)).alias("phrase")).where(F.col("phrase").isNotNull())
        .groupBy("phrase").agg(F.count("*").alias("copies"))
    )
    words = phrases.select("phrase", "copies", F.explode(F.split("phrase", " ")).alias("word"))
    n_words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    stats = (
        phrases.select("copies", (n_words - 1).alias("others"), F.explode(F.split("phrase", " ")).alias("word"))
        .groupBy("word").agg(F.sum("copies").alias("freq"), F.sum(F.col("copies") * F.col("others")).alias("degree"))
        .select("word", ((F.col("degree") + F.col("freq")) / F.col("freq")).alias("weight"))
    )
    scored = words.join(stats.hint("shuffle_hash"), "word").groupBy("phrase", "copies").agg(F.round(F.sum("weight"), 6).alias("score"))
    return scored.select("phrase", "copies", "score").orderBy(F.desc("score"), "phrase").limit(top_n)


def merge_keywords(known: Column, phrases: Column, top_n: int = 10) -> Column:
    """Known terms first, then phrases; a term contained in an earlier one is skipped."""
    folded = F.aggregate(
        F.concat(known, phrases), F.array().cast("array<string>"),
        lambda acc, k: F.when(F.exists(acc, lambda s: F.contains(s, k)), acc).otherwise(F.array_append(acc, k)))
    return F.slice(folded, 1, top_n)


def article_keywords(news: DataFrame, key: str, title: str, summary: str, categories, top_n: int = 10) -> DataFrame:
    """(key, keywords) per article: taxonomy hits merged with the best phrases."""
    from tidemark.operators.entities import category_hits

    text = F.concat(F.col(title), F.lit(". "), F.coalesce(F.col(summary), F.lit("")))
    base = news.select(key, text.alias("_text"))
    best = (
        rake(base, key, "_text", top_n=top_n)
        .groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda r: r["phrase"]).alias("phrases"))
    )
    known = F.flatten(F.transform(category_hits(F.col("_text"), categories), lambda h: h["keywords"]))
    empty = F.array().cast("array<string>")
    return (
        base.select(key, known.alias("known")).join(best, key, "left")
        .select(key, merge_keywords(F.coalesce("known", empty), F.coalesce("phrases", empty), top_n).alias("keywords"))
    )
