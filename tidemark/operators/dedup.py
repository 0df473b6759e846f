"""Exact and near-duplicate resolution.

Near duplicates follow arrival order: an article that resembles (Jaccard >= threshold, |time gap| <= window) an earlier
article which is itself no duplicate becomes its duplicate, otherwise it leads. That greedy order is reproduced exactly
without comparing all pairs and without collecting a group:

* identical token sets published at one instant act as one row; identical token sets inside one window-long bucket form
  a *cell*, whose rows all resemble each other, so a cell has at most one leader;
* cells meet through signatures (pairs of rare tokens from an extended prefix, plus the whole set), which no similar
  pair can miss; pairs are verified on the token sets. Where a signature is crowded (a flood of near copies), its cells are
  tied to one hub instead of being compared pairwise;
* the components of that graph are independent of each other. Each is resolved in one pass in arrival order, in which a row meets the
  leaders so far through their signatures. The number of Spark rounds follows the logarithm of the longest chain of conflicts (contraction), not
  the calendar. Components with very many rows go through in slices of the arrival order that carry their leaders over;
* a token set that meets no other one is its own component and needs no contraction.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.titles import jaccard, title_tokens
from tidemark.functions.urls import url_hash
from tidemark.operators.graph import components
from tidemark.session import cut_lineage

#: Cells behind one signature (in a bucket and the two next to it) above which they are tied to a hub instead of being compared.
PAIR_BUDGET = 64
#: Rows of one component that a pass takes, and the parts by which a larger component's arrival order is cut.
SLICE_ROWS, CUTS = 500_000, 1024


def exact_duplicates(articles: DataFrame, url: str = "url", seq: str = "news_id", stored: DataFrame | None = None) -> DataFrame:
    """(seq, url_hash, first_seq, already_stored): the first arrival of every canonical URL.

    The first arrivals are combined before the shuffle; the way back to the rows is an equi-join whose crowded URLs are split at
    run time. Where a row per URL is enough, use ``url_groups`` (no join).
    """
    hashed = articles.select(seq, url_hash(F.col(url)).alias("url_hash"))
    first = hashed.groupBy("url_hash").agg(F.min(seq).alias("first_seq"))
    if stored is not None:
        known = stored.select("url_hash").distinct().withColumn("already_stored", F.lit(True))
        first = first.join(known, "url_hash", "left").withColumn("already_stored", F.coalesce("already_stored", F.lit(False)))
    else:
        first = first.withColumn("already_stored", F.lit(False))
    return hashed.join(first, "url_hash")


def url_groups(articles: DataFrame, url: str = "url", seq: str = "news_id") -> DataFrame:
    """(url_hash, first_seq, copies): one aggregate, combined before the shuffle."""
    hashed = articles.select(seq, url_hash(F.col(url)).alias("url_hash"))
    return hashed.groupBy("url_hash").agg(F.min(seq).alias("first_seq"), F.count("*").alias("copies"))


def keep_first(articles: DataFrame, url: str = "url", seq: str = "news_id", stored: DataFrame | None = None) -> DataFrame:
    """One row per canonical URL (first arrival), minus URLs already stored. Payload columns travel with the minimum."""
    rest = [c for c in articles.columns if c != seq]
    firsts = articles.withColumn("url_hash", url_hash(F.col(url))).groupBy("url_hash").agg(F.min(F.struct(seq, *rest)).alias("_r"))
    if stored is not None:
        firsts = firsts.join(stored.select("url_hash"), "url_hash", "left_anti")
    return firsts.select("_r.*", "url_hash")


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(fp, key): two sets with Jaccard >= threshold share a key.

    Both share at least ceil(threshold * n) tokens, hence at least two tokens within their first n - ceil(t n) + 2
    tokens under one global order (rarest first). Sets too small to resemble a different set only emit themselves.
    """
    words = sets.select("fp", F.explode(F.split("fp", " ")).alias("token"))
    # every token's exact frequency; a frequent token's rows are split by run-time skew handling
    ordered = words.join(words.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("fp").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("t"))
    n = F.size("t")
    need = F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")
    smallest = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1_000_000
    prefix = F.slice("t", 1, n - need + 2)
    pairs = F.transform(F.array(prefix), lambda p: F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
        lambda i: F.transform(F.slice(p, i + 1, F.size(p)), lambda b: F.xxhash64(F.element_at(p, i), b))))).getItem(0)
    own = F.array(F.xxhash64("fp"))
    keys = F.when(n >= max(2, smallest), F.concat(own, pairs)).otherwise(own)
    return ordered.select("fp", F.explode(F.array_distinct(keys)).alias("key"))


def _near_buckets(bucket: Column) -> Column:
    return F.explode(F.array(bucket - 1, bucket, bucket + 1))


def _similar(a: str, b: str, threshold: float) -> Column:
    return (F.col(a) == F.col(b)) | (jaccard(F.split(a, " "), F.split(b, " ")) >= threshold)


def _meet(left: DataFrame, right: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Verified (left cell, right cell) pairs; right columns are prefixed ``o_``."""
    lk = left.select("fp", "bucket").join(sigs, "fp").withColumn("_at", _near_buckets(F.col("bucket")))
    rk = right.select("fp", "bucket").join(sigs, "fp").select(F.col("fp").alias("o_fp"), F.col("bucket").alias("o_bucket"), "key")
    met = lk.join(rk, (lk["key"] == rk["key"]) & (lk["_at"] == rk["o_bucket"])).select("fp", "bucket", "o_fp", "o_bucket").distinct()
    return met.where(_similar("fp", "o_fp", threshold))


def _linked(cells: DataFrame, sigs: DataFrame, threshold: float, pair_budget: float) -> DataFrame:
    """Edges (fp, bucket, o_fp, o_bucket, u, v) that connect all cells whose rows may depend on each other.

    Verified pairs where a signature has few cells. The cells of a crowded one are tied to its hub unverified: that joins more than
    has to be, which costs parallelism only.
    """
    entries = cut_lineage(cells.join(sigs, "fp"))
    around = entries.select("key", _near_buckets(F.col("bucket")).alias("bucket")).groupBy("key", "bucket").agg(F.count("*").alias("n"))
    crowded = cut_lineage(around.where(F.col("n") > pair_budget).select("key", "bucket"))
    quiet = entries.join(crowded, ["key", "bucket"], "left_anti")
    left = quiet.select("fp", "bucket", "key", _near_buckets(F.col("bucket")).alias("_at"))
    right = quiet.select(F.col("fp").alias("o_fp"), F.col("bucket").alias("o_bucket"), "key")
    met = left.join(right, (left["key"] == right["key"]) & (left["_at"] == right["o_bucket"])).select("fp", "bucket", "o_fp", "o_bucket").distinct()
    pairs = met.where(_similar("fp", "o_fp", threshold)).withColumns({"u": F.xxhash64("fp", "bucket"), "v": F.xxhash64("o_fp", "o_bucket")})
    reach = entries.select("fp", "bucket", "key", _near_buckets(F.col("bucket")).alias("_at"))
    hubs = reach.join(crowded.withColumnRenamed("bucket", "_at"), ["key", "_at"]).select(
        "fp", "bucket", F.lit(None).cast("string").alias("o_fp"), F.col("_at").alias("o_bucket"), F.xxhash64("fp", "bucket").alias("u"), F.xxhash64(F.lit("hub"), "key", "_at").alias("v"))
    return pairs.unionByName(hubs)


def _resolve(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """Leaders (root, fp, bucket, seq, published_at) of rows (root, fp, bucket, seq, published_at, keys, led): one pass per root in arrival order.

    Rows with ``led`` are leaders of earlier slices and are not returned again. A task keeps the leaders of the root it is at, by signature and time.
    """
    names = ["root", "fp", "bucket", "seq", "published_at"]
    schema = rows.select(*names).schema

    def scan(batches):
        root, index, sets = None, {}, {}
        for batch in batches:
            keep = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 5, 6, 7)]
            for key, fp, at, keys, led in zip(*columns):
                if key != root:
                    root, index, sets = key, {}, {}
                words = sets.get(fp) or frozenset(fp.split(" "))
                blocked = False
                if not led:
                    seen = {fp}
                    for k in keys:
                        times = index.get(k, ())
                        i = bisect_left(times, (at - window,))
                        while not blocked and i < len(times) and times[i][0] <= at + window:
                            other = times[i][1]
                            if other == fp:
                                blocked = True
                            elif other not in seen:
                                seen.add(other)
                                common = len(words & sets[other])
                                blocked = common / (len(words) + len(sets[other]) - common) >= threshold
                            i += 1
                        if blocked:
                            break
                if not blocked:
                    sets[fp] = words
                    for k in keys:
                        insort(index.setdefault(k, []), (at, fp))
                keep.append(not blocked and not led)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    timed = rows.select(*names, F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), "keys", "led")
    return timed.repartition("root").sortWithinPartitions("root", F.desc("led"), "seq").mapInArrow(scan, schema)


def _sliced(rows: DataFrame, window: int, threshold: float, slice_rows: int) -> DataFrame:
    """``_resolve`` for rows (root, fp, bucket, seq, published_at, keys), the roots with more than ``slice_rows`` rows in slices of their arrival order."""
    fresh = rows.withColumn("led", F.lit(False))
    sizes = cut_lineage(rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows))
    if sizes.isEmpty():
        return _resolve(fresh, window, threshold)
    out = [_resolve(fresh.join(sizes, "root", "left_anti"), window, threshold)]
    # cut at 1/CUTS steps of each root's arrival order, as many of them together as make up a slice
    large = fresh.join(sizes, "root")
    steps = [i / CUTS for i in range(1, CUTS)]
    cuts = large.groupBy("root").agg(F.percentile_approx("seq", steps).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c < F.col("seq")))
    large = cut_lineage(large.join(cuts, "root").withColumn("slice", F.floor(place * F.ceil(F.col("n") / slice_rows) / CUTS).cast("int")).drop("cuts", "n"))
    carried: DataFrame | None = None
    for k in range(large.agg(F.max("slice")).first()[0] + 1):
        part = large.where(F.col("slice") == k).drop("slice")
        if carried is not None:
            span = part.groupBy("root").agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
            near = carried.join(span, "root").where((_apart("published_at", "lo") <= window) | (_apart("published_at", "hi") <= window) | F.col("published_at").between(F.col("lo"), F.col("hi")))
            part = part.unionByName(near.select(*part.columns))
        found = cut_lineage(_resolve(part, window, threshold))
        out.append(found)
        led = found.join(part.select("root", "seq", "keys"), ["root", "seq"]).withColumn("led", F.lit(True))
        carried = cut_lineage(led if carried is None else carried.unionByName(led.select(*carried.columns)))
    lead = out[0]
    for more in out[1:]:
        lead = lead.unionByName(more)
    return lead


def _apart(a: str, b: str) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)))


def near_duplicates(articles: DataFrame, threshold: float = 0.8, hours: int = 48, seq: str = "news_id", title: str = "title",
                    pair_budget: float = PAIR_BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(seq, duplicate_of): ``duplicate_of`` is the matching leader with the earliest published_at, null for leaders.

    ``seq`` is the arrival order.
    """
    window = hours * 3_600_000_000
    tokens = F.array_sort(title_tokens(F.col(title)))
    rows = articles.select(F.col(seq).alias("seq"), "published_at", F.array_join(tokens, " ").alias("fp")).withColumn(
        "bucket", F.floor(F.unix_micros(F.col("published_at").cast("timestamp")) / F.lit(window)))
    rows = cut_lineage(rows)
    worded = rows.where("fp <> ''")
    units = cut_lineage(worded.groupBy("fp", "bucket", "published_at").agg(F.min("seq").alias("seq")))
    sigs = cut_lineage(signatures(units.select("fp").distinct(), threshold))
    links = cut_lineage(_linked(units.select("fp", "bucket").distinct(), sigs, threshold, pair_budget))
    contested = cut_lineage(links.where("o_fp IS NULL OR fp <> o_fp").select("fp").distinct())
    roots = components(links.join(contested, "fp", "left_semi").select("u", "v"))
    met = units.join(contested, "fp", "left_semi").withColumn("node", F.xxhash64("fp", "bucket")).join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")).drop("node")
    # a set that meets no other one is looked up by its own signature only
    alone = units.join(contested, "fp", "left_anti").withColumn("root", F.xxhash64("fp")).withColumn("keys", F.array("root"))
    keys = sigs.groupBy("fp").agg(F.collect_list("key").alias("keys"))
    lead = cut_lineage(_sliced(met.join(keys, "fp").unionByName(alone), window, threshold, slice_rows).select("fp", "bucket", "seq", "published_at"))
    followers = worded.join(lead.select("seq"), "seq", "left_anti")
    links = _meet(followers.select("fp", "bucket").distinct(), lead, sigs, threshold).join(
        lead.select(F.col("fp").alias("o_fp"), F.col("bucket").alias("o_bucket"), F.col("seq").alias("l_seq"), F.col("published_at").alias("l_at")),
        ["o_fp", "o_bucket"])
    chosen = (
        followers.join(links, ["fp", "bucket"]).where((_apart("published_at", "l_at") <= window) & (F.col("l_seq") < F.col("seq")))
        .groupBy("seq").agg(F.min(F.struct("l_at", "l_seq")).alias("b"))
        .select("seq", F.col("b.l_seq").alias("duplicate_of"))
    )
    return rows.select("seq").join(chosen, "seq", "left").withColumnRenamed("seq", seq)


def cluster_id(duplicate_of: Column, news_id: Column) -> Column:
    return F.coalesce(duplicate_of, news_id)


def duplicate_rate(news: DataFrame, *keys: str) -> DataFrame:
    return news.groupBy(*keys).agg(F.round(F.avg(F.col("duplicate_of").isNotNull().cast("double")), 4).alias("duplicate_rate"), F.count("*").alias("articles"))
