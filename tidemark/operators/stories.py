"""Story states: what each near-duplicate cluster looks like at every cut-off, without replaying cut-offs.

An item is visible over one contiguous range of cut-off positions [p_from, p_to). The visible membership of a
cluster therefore changes only where one of its members appears or expires, and the cluster is constant in
between. ``story_states`` returns those constant stretches, so the cost follows the number of items, not
items x cut-offs, and everything downstream aggregates stretches before any cut-off is enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.availability import visible_at
from tidemark.functions.timestamps import plus_days
from tidemark.operators.calendar import CutoffGrid
from tidemark.session import cut_lineage, dimension, spread

#: Items of the largest story that is resolved in one row.
MEMBERS = 64


def with_visibility(items: DataFrame, policy: str = "provider_timestamp") -> DataFrame:
    """Add ``visible_at`` (first instant an item may be used under a policy)."""
    if {"provider_published_at", "fetched_at", "timestamp_precision", "timezone_status"} <= set(items.columns):
        at = visible_at(F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"),
                        F.col("fetched_at"), policy)
    else:
        at = F.col("available_at")
    return spread(items.withColumn("visible_at", at))


def score_range(items: DataFrame, grid: CutoffGrid, p: dict) -> DataFrame:
    """Positions at which an item counts for the decayed score: visible and not older than the lookback."""
    kept = items.where((F.col("relevance") >= p["min_relevance"]) & F.col("visible_at").isNotNull())
    out = grid.position(kept, F.col("visible_at"), "p_from")
    out = grid.position(out, plus_days(F.col("available_at"), p["max_lookback_days"]), "p_to", strict=True)
    return out.where(F.col("p_from") < F.col("p_to"))


def flow_range(items: DataFrame, grid: CutoffGrid, p: dict) -> DataFrame:
    """Positions at which an item lies in the news-flow window (window_start - baseline_days, as_of].

    ``new_until`` is the first position whose window starts at or after the item: before it the item is new.
    """
    kept = items.where((F.col("relevance") >= p["min_relevance"]) & F.col("visible_at").isNotNull())
    slice_days = max(p["max_lookback_days"], p["baseline_days"] + 7)
    out = grid.position(kept, F.col("visible_at"), "p_from")
    out = grid.position(out, F.col("available_at"), "new_until", by="window_start")
    out = grid.position(out, plus_days(F.col("available_at"), p["baseline_days"]), "_base_end", by="window_start")
    out = grid.position(out, plus_days(F.col("available_at"), slice_days), "_slice_end", strict=True)
    out = out.withColumn("p_to", F.least("_base_end", "_slice_end")).drop("_base_end", "_slice_end")
    return out.where(F.col("p_from") < F.col("p_to"))


def _earliest(*payload: str) -> Column:
    return F.min(F.struct("available_at", "news_id", *payload))


def crowded_stories(items: DataFrame) -> DataFrame | None:
    """(entity, cluster_id) of the stories with more than MEMBERS items; None if there are none."""
    found = cut_lineage(items.groupBy("entity", "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("entity", "cluster_id"))
    return None if found.isEmpty() else dimension(found)


def story_states(ranged: DataFrame, extra: tuple[str, ...] = (), scope: tuple[str, ...] = (), crowded: DataFrame | None | bool = False) -> DataFrame:
    """(entity, cluster_id, p, q) stretches with representative, relevance, reliability, sentiment and sizes.

    * representative = earliest (available_at, news_id); relevance and reliability come from the member with the
      largest product (ties: earliest); sentiment is the reliability x relevance weighted mean; the size counts
      distinct sources.
    * a story of up to MEMBERS items is brought together once and resolved in its row; ``crowded`` names the others
      (found in ``ranged`` if it is left out), which are combined before they are shuffled and laid out by joins.

    ``scope`` columns extend the cluster key, so several memberships can be resolved in the same pass.
    """
    key = (*scope, "entity", "cluster_id")
    payload = ("strength", "half_life_days", "category", "price_report", *extra)
    crowded = crowded_stories(ranged) if crowded is False else crowded
    if crowded is None:
        return _small_stories(ranged, key, payload)
    ids = ["entity", "cluster_id"]
    return _small_stories(ranged.join(crowded, ids, "left_anti"), key, payload).unionByName(_crowded_states(ranged.join(crowded, ids, "left_semi"), key, payload))


def _weights() -> tuple[Column, Column]:
    product = F.col("reliability") * F.col("relevance")
    return product, F.greatest(F.lit(1e-9), product)


def _small_stories(ranged: DataFrame, key: tuple[str, ...], payload: tuple[str, ...]) -> DataFrame:
    """One shuffle: the members of a story in an array, from which its stretches are read off."""
    product, weight = _weights()
    member = F.struct("available_at", "news_id", *payload, "p_from", "p_to", "source", F.struct(
        product.alias("product"), (-F.unix_micros(F.col("available_at").cast("timestamp"))).alias("early"), (-F.col("news_id")).alias("low_id"), "relevance", "reliability").alias("best"),
        weight.alias("w"), (weight * F.col("sentiment")).alias("ws"))
    keyed = ranged.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    stories = keyed.groupBy(*key).agg(F.array_sort(F.collect_list(member)).alias("_m"))
    edges = lambda m: F.array_sort(F.array_union(F.transform(m, lambda x: x["p_from"]), F.transform(m, lambda x: x["p_to"])))
    # the arrays of one keep members and edges from being worked out anew for every use
    spans = F.transform(F.array(F.col("_m")), lambda m: F.transform(F.array(edges(m)), lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct(
        F.element_at(e, i).alias("p"), F.element_at(e, i + 1).alias("q"),
        F.filter(m, lambda x: (x["p_from"] <= F.element_at(e, i)) & (x["p_to"] > F.element_at(e, i))).alias("c")))).getItem(0)).getItem(0)
    # explode_outer: a plain explode would push "size(...) > 0" down and work the spans out twice
    rows = stories.select(*key, F.explode_outer(spans).alias("_s")).where(F.size("_s.c") > 0).select(*key, "_s.p", "_s.q", F.col("_s.c").alias("_c"))
    plus = lambda a, x: F.coalesce(a + x, a, x)
    total = lambda name: F.aggregate("_c", F.lit(None).cast("double"), lambda a, x: plus(a, x[name]))
    return rows.withColumns({"_rep": F.get("_c", F.lit(0)), "_best": F.array_max(F.transform("_c", lambda x: x["best"]))}).select(
        *key, "p", "q", "_rep.available_at", "_rep.news_id", *[f"_rep.{c}" for c in payload],
        "_best.relevance", "_best.reliability", (total("ws") / total("w")).alias("sentiment"),
        F.size(F.array_distinct(F.transform("_c", lambda x: x["source"]))).cast("bigint").alias("cluster_size"), F.size("_c").cast("bigint").alias("articles"))


def _crowded_states(ranged: DataFrame, key: tuple[str, ...], payload: tuple[str, ...]) -> DataFrame:
    """Members with the same visible range and source are combined map-side first, so a story that holds a large share of all rows
    shrinks to at most (ranges x sources) rows before it is shuffled."""
    product, weight = _weights()
    parts = ranged.groupBy(*key, "p_from", "p_to", "source").agg(
        _earliest(*payload).alias("rep"),
        F.max(F.struct(product.alias("product"), (-F.unix_micros(F.col("available_at").cast("timestamp"))).alias("early"),
                       (-F.col("news_id")).alias("low_id"), "relevance", "reliability")).alias("best"),
        F.sum(weight).alias("w"), F.sum(weight * F.col("sentiment")).alias("ws"), F.count("*").alias("articles"))
    # edges are cut-off positions, so a story has no more of them than the calendar; the way back to its parts is an equi-join,
    # which run-time skew handling splits when one story is hot
    edges = parts.select(*key, F.explode(F.array("p_from", "p_to")).alias("_e")).groupBy(*key).agg(F.array_sort(F.collect_set("_e")).alias("_edges"))
    stretches = (
        parts.join(edges, list(key))
        .withColumn("_cover", F.filter("_edges", lambda e: (e >= F.col("p_from")) & (e <= F.col("p_to"))))
        .withColumn("_span", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("_cover") - 1),
            lambda i: F.struct(F.element_at("_cover", i).alias("p"), F.element_at("_cover", i + 1).alias("q")))))
    )
    merged = (
        stretches.groupBy(*key, "_span.p", "_span.q", "source")
        .agg(F.min("rep").alias("rep"), F.max("best").alias("best"), F.sum("w").alias("w"), F.sum("ws").alias("ws"),
             F.sum("articles").alias("articles"))
        .groupBy(*key, "p", "q")
        .agg(F.min("rep").alias("rep"), F.max("best").alias("best"), F.sum("w").alias("w"), F.sum("ws").alias("ws"),
             F.sum("articles").alias("articles"), F.count("*").alias("sources"))
    )
    return merged.select(
        *key, "p", "q", "rep.available_at", "rep.news_id", *[f"rep.{c}" for c in payload],
        "best.relevance", "best.reliability", (F.col("ws") / F.col("w")).alias("sentiment"),
        F.col("sources").alias("cluster_size"), "articles")


def enumerate_positions(df: DataFrame, p: str = "p", q: str = "q", out: str = "pos") -> DataFrame:
    """Expand [p, q) into positions. Apply to aggregated stretches only."""
    return df.where(F.col(p) < F.col(q)).withColumn(out, F.explode(F.sequence(F.col(p), F.col(q) - 1))).drop(p, q)
