"""Aliases and keywords of any number, looked up by the characters of their places.

A pattern counts where it stands between characters that are no ASCII letters or digits, so every token of a pattern is a whole token of
the text it occurs in. A plain pattern - a token at either end, a few tokens, no way to overlap itself, no excluded phrases - is a run of tokens of the text with what stands
between them, and a lookup of such runs counts it. The others wait at one token only - of their tokens the one that the fewest articles have - and are verified in
place in the articles with that token. There is no regular expression per pattern and article, and no bound on the catalog: it is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tallies import LONGEST, tallied
from tidemark.session import cut_lineage, dimension, spread

#: Owners of patterns that are broadcast in all.
ENTRIES = 1_500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """The different runs of ASCII letters and digits, lower-cased; the case of other characters is left alone."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def _bounded(pattern: Column, case_sensitive: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([^A-Za-z0-9 ])", r"\\$1")
    return F.concat(F.when(case_sensitive, "").otherwise("(?i)"), F.lit(r"(?<![A-Za-z0-9])"), quoted, F.lit(r"(?![A-Za-z0-9])"))


def _without(text: Column, phrases: Column) -> Column:
    """The text with each of the phrases replaced by a blank, whatever their case."""
    return F.aggregate(phrases, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?i)"), F.regexp_replace(p, r"([^A-Za-z0-9 ])", r"\\$1")), F.lit(" ")))


def anchored(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``token``: of each pattern's tokens the one that the fewest articles of ``words`` (id, token) have; those that none has are left out."""
    if not patterns.where(F.size(tokens(F.col("pattern"))) == 0).isEmpty():
        raise ValueError("a pattern needs an ASCII letter or digit")
    own = patterns.select("pattern", F.explode(tokens(F.col("pattern"))).alias("token")).distinct()
    counts = words.groupBy("token").agg(F.count("*").alias("df"))
    rarest = own.join(counts, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r"))
    return patterns.join(rarest.where("r.df > 0").select("pattern", F.col("r.token").alias("token")), "pattern")


def _searched(articles: DataFrame, wanted: DataFrame, seq: str, title: str, body: str) -> DataFrame:
    """(seq, owner, pattern, in_title, in_body) of the patterns that need an expression of their own; ``wanted`` has phrases."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (title, body)}
    wanted = cut_lineage(wanted)
    unit = ["pattern", "case_sensitive", "phrases"]  # what owners share is looked for once
    known = dimension(cut_lineage(wanted.select(F.explode(tokens(F.col("pattern"))).alias("token")).distinct()))
    words = articles.select(F.col(seq).alias("id"), F.explode(F.array_union(tokens(text[title]), tokens(text[body]))).alias("token"))
    words = cut_lineage(words.join(known, "token", "left_semi"))
    waiting = anchored(words, wanted.select(*unit).distinct())
    waiting = waiting.select("token", F.struct(*unit, F.translate("pattern", _UPPER, _LOWER).alias("plain"), _bounded(F.col("pattern"), F.col("case_sensitive")).alias("regex")).alias("c"))
    found = words.join(dimension(cut_lineage(waiting)), "token").groupBy("id").agg(F.collect_list("c").alias("c"))

    def count(c: Column) -> Column:
        n = lambda t: F.regexp_count(F.when(F.size(c["phrases"]) > 0, _without(t, c["phrases"])).otherwise(t), c["regex"])
        return F.struct(*[c[u].alias(u) for u in unit], n(F.col("_t")).alias("in_title"), n(F.col("_b")).alias("in_body"))

    rows = articles.select(F.col(seq).alias("id"), text[title].alias("_t"), text[body].alias("_b")).join(found, "id")
    # a plain search for the pattern's characters spares most candidates the expression; blanking phrases removes places but makes none
    seen = F.translate(F.concat("_t", F.lit("\n"), "_b"), _UPPER, _LOWER)
    rows = rows.withColumn("c", F.transform(F.array(seen), lambda s: F.filter("c", lambda c: F.contains(s, c["plain"]))).getItem(0)).where(F.size("c") > 0)
    counted = rows.select("id", F.explode(F.filter(F.transform("c", count), lambda h: h["in_title"] + h["in_body"] > 0)).alias("h"))
    return counted.select(F.col("id").alias(seq), "h.*").join(wanted, unit).select(seq, "owner", "pattern", "case_sensitive", "in_title", "in_body")


def _length(pattern: Column) -> Column:
    return F.size(F.regexp_extract_all(pattern, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)))


def _plain(pattern: Column) -> Column:
    """Begins and ends with a token, has at most LONGEST of them, and its last token stands nowhere else in it: its places can't overlap."""
    words = F.regexp_extract_all(F.translate(pattern, _UPPER, _LOWER), F.lit(r"([a-z0-9]+)"), F.lit(1))
    last_once = F.array_position(words, F.get(words, F.size(words) - 1)) == F.size(words)
    return F.coalesce(pattern.rlike(r"\A[A-Za-z0-9](?s:.*[A-Za-z0-9])?\z") & (F.size(words) <= LONGEST) & last_once, F.lit(False))


def _places(text: Column, lengths: list[int], in_title: bool) -> Column:
    """array<struct(gram, in_title)>: every run of so many tokens with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))

    def of_length(p: Column, first: Column, n: int) -> Column:
        gram = lambda i: F.struct(F.array_join(F.slice(p, i, 2 * n - 1), "").alias("gram"), F.lit(in_title).alias("in_title"))
        last = F.size(p) - (2 * n - 2)
        return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(2)), gram)).otherwise(F.array().cast("array<struct<gram: string, in_title: boolean>>"))

    def runs(p: Column) -> Column:
        first = F.when(F.get(p, F.lit(0)).rlike("^[A-Za-z0-9]"), 1).otherwise(2)
        return F.concat(F.array().cast("array<struct<gram: string, in_title: boolean>>"), *[of_length(p, first, n) for n in lengths])

    return F.transform(F.array(pieces), runs).getItem(0)


def _looked_up(articles: DataFrame, known: DataFrame, sizes: list, seq: str, title: str, body: str) -> DataFrame:
    """(seq, owner, pattern, in_title, in_body), a row per place and owner, of plain patterns: places are looked up by their characters.

    A pattern is found at its own places only, never at those of one of its tokens. The patterns with most owners, up to ENTRIES owners in all, are broadcast and
    looked up where the article is; places of the others meet them in a shuffle and go back to their article before they are laid out over owners. Rows of
    an article stay together, so sums per article need no further shuffle. ``sizes``: how many keys (patterns in lower case) have how many rows and tokens.
    """
    # a plain explode would push "size(...) > 0" down and cut the texts twice, hence explode_outer below
    lower = lambda c: F.translate(c, _UPPER, _LOWER)
    lengths = sorted({r["tokens"] for r in sizes})
    room, least = ENTRIES, None
    for n in sorted({r["n"] for r in sizes}, reverse=True):
        room -= n * sum(r["keys"] for r in sizes if r["n"] == n)
        if room < 0:
            break
        least = n
    units = lambda df: df.groupBy("key", "pattern", "case_sensitive").agg(F.collect_set("owner").alias("owners"))
    unit = F.struct("pattern", "case_sensitive", "owners")
    empty = known.limit(0)
    crowded = F.broadcast(known.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")) if least else empty.select("key")
    near = cut_lineage(units(known.join(crowded, "key", "left_semi")).groupBy("key").agg(F.collect_list(unit).alias("near")))
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (title, body)}
    rows = articles.select(F.col(seq).alias("id"), text[title].alias("_t"), text[body].alias("_b"))
    places = lambda: F.concat(_places(F.col("_t"), lengths, True), _places(F.col("_b"), lengths, False))
    far = units(known.join(F.broadcast(near.select("key")), "key", "left_anti").repartition("key")).select("key", unit.alias("unit"))
    fits = lambda u: ~u["case_sensitive"] | (u["pattern"] == F.col("p.gram"))
    far_places = spread(rows).select("id", F.explode_outer(places()).alias("p")).withColumn("key", lower("p.gram")).join(F.broadcast(near.select("key")), "key", "left_anti")
    # the key is the place's own text in lower case: it need not travel beside it
    met = far_places.select("id", "p").join(far, lower(F.col("p.gram")) == F.col("key")).where(fits(F.col("unit"))).select("id", F.col("p.in_title").alias("at"), "unit")
    both = rows.withColumn("at", F.lit(None).cast("boolean")).withColumn("unit", F.lit(None).cast(met.schema["unit"].dataType)).unionByName(met, allowMissingColumns=True).repartition("id")
    direct = F.array(F.struct(F.lit(None).cast("string").alias("gram"), F.col("at").alias("in_title")))
    own = both.withColumn("p", F.explode_outer(F.when(F.col("unit").isNull(), places()).otherwise(direct)))
    found = own.join(F.broadcast(near), lower(F.col("p.gram")) == F.col("key"), "left").select(
        "id", "p", F.col("unit").isNotNull().alias("met"), F.explode(F.when(F.col("unit").isNull(), F.col("near")).otherwise(F.array("unit"))).alias("u"))
    laid = found.where(F.col("met") | fits(F.col("u"))).select("id", F.col("p.in_title").alias("in_title"), F.col("u.pattern").alias("pattern"), F.col("u.case_sensitive").alias("case_sensitive"), F.explode("u.owners").alias("owner"))
    return laid.select(F.col("id").alias(seq), "owner", "pattern", "case_sensitive", F.col("in_title").cast("int").alias("in_title"), (~F.col("in_title")).cast("int").alias("in_body"))


def _wanted(patterns: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """owner, pattern, case_sensitive, phrases (an empty array where there are none)."""
    wanted = patterns.select("owner", "pattern", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")).where("owner IS NOT NULL AND pattern IS NOT NULL")
    none = F.array().cast("array<string>")
    return wanted.join(excluded, "owner", "left").withColumn("phrases", F.coalesce("phrases", none)) if excluded is not None else wanted.withColumn("phrases", none)


def _found(articles: DataFrame, patterns: DataFrame, excluded: DataFrame | None, seq: str, title: str, body: str, *by: str) -> DataFrame:
    wanted = _wanted(patterns, excluded).withColumn("plain", (F.size("phrases") == 0) & _plain(F.col("pattern"))).withColumn("key", F.translate("pattern", _UPPER, _LOWER))
    sizes = wanted.groupBy("plain", "key").agg(F.count("*").alias("n")).groupBy("plain", "n", _length(F.col("key")).alias("tokens")).agg(F.count("*").alias("keys")).collect()
    total = lambda df: df.groupBy(seq, *by).agg(F.sum("in_title").cast("int").alias("in_title"), F.sum("in_body").cast("int").alias("in_body"))
    out = total(_looked_up(articles, wanted.where("plain").drop("plain", "phrases"), [r for r in sizes if r["plain"]], seq, title, body))
    if all(r["plain"] for r in sizes):
        return out
    others = wanted.where("NOT plain").drop("plain", "key").distinct()
    return total(out.unionByName(total(_searched(articles, others, seq, title, body))))


def hits(articles: DataFrame, patterns: DataFrame, excluded: DataFrame | None = None, seq: str = "news_id", title: str = "title", body: str = "summary") -> DataFrame:
    """(seq, owner, pattern, in_title, in_body): how often each pattern stands in an article; pairs without a hit are left out.

    ``patterns``: owner (a ticker, a category), pattern, case_sensitive; repeated ones count once. ``excluded``: owner, phrases (array) - an owner's
    phrases are blanked before its patterns are counted; they should begin and end at the edge of a word. Null texts are empty.
    """
    return _found(articles, patterns, excluded, seq, title, body, "owner", "pattern", "case_sensitive").drop("case_sensitive")


def mentions(articles: DataFrame, aliases: DataFrame, excluded: DataFrame | None = None, seq: str = "news_id", title: str = "title", body: str = "summary") -> DataFrame:
    """(seq, owner, in_title, in_body): alias hits per company; overlapping aliases each count."""
    wanted = _wanted(aliases, excluded)
    phrased = wanted.withColumn("phrased", F.size("phrases") > 0)
    return tallied(articles, phrased, seq, title, body, lambda others: _searched(articles, _wanted(others, excluded), seq, title, body))


def keywords(articles: DataFrame, taxonomy: DataFrame, seq: str = "news_id", title: str = "title", body: str = "summary") -> DataFrame:
    """(seq, owner, title_keywords, keywords): how many different keywords of a category the title and the whole article hold."""
    found = hits(articles, taxonomy, None, seq, title, body)
    return found.groupBy(seq, "owner").agg(F.count_if(F.col("in_title") > 0).alias("title_keywords"), F.count("*").alias("keywords"))
