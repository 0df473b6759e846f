"""Time-decayed sentiment scores for every (cut-off, horizon, entity), and index scores.

The decay 0.5 ** (age / h) factors into a part known when a story stretch begins and a part that depends only
on (stretch start, target, h). Stories are therefore summed per (entity, category, h, stretch) first; only
those sums - their number is bounded by the calendar, not by the data - are expanded over cut-offs and targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import days_between
from tidemark.operators.calendar import CutoffGrid
from tidemark.operators.stories import crowded_stories, enumerate_positions, score_range, story_states, with_visibility

MACRO = "MACRO"


def number(value) -> Column:
    """A parameter as a column: a literal, or the column that a table of trials has it in."""
    return value if isinstance(value, Column) else F.lit(float(value))


def _half_life(p: dict) -> Column:
    return F.greatest(F.lit(1e-6), F.col("half_life_days") * number(p["recency_half_life_scale"]))


def weighted_states(items: DataFrame, grid: CutoffGrid, p: dict, policy: str = "provider_timestamp") -> DataFrame:
    """Story stretches with ``x``: the story's weight as of the first cut-off of its stretch."""
    states = story_states(score_range(with_visibility(items, policy), grid, p), crowded=crowded_stories(items))
    starts = grid.frame().select(F.col("pos").alias("p"), F.col("as_of").alias("start_at"))
    decay = F.pow(F.lit(0.5), days_between(F.col("available_at"), F.col("start_at")) / _half_life(p))
    weight = (
        F.col("reliability") * F.col("relevance") * F.col("strength") * decay
        * (1 + F.lit(float(p["corroboration_bonus"])) * F.log(F.greatest(F.lit(1), F.col("cluster_size"))))
        * F.when(F.col("price_report"), F.lit(float(p["price_report_weight"]))).otherwise(1.0)
    )
    return states.join(F.broadcast(starts), "p").withColumn("x", weight)


def _fade(start: str, target: str, p: dict) -> Column:
    return F.pow(F.lit(0.5), days_between(F.col(start), F.col(target)) / _half_life(p))


def targets_of(horizon_rows: DataFrame, grid: CutoffGrid, close_utc: Column) -> DataFrame:
    """Attach ``pos``, ``as_of`` and ``target_at`` = max(as_of, close of the target session) to horizon rows."""
    cut = grid.frame().select("pos", "session", "as_of")
    return horizon_rows.join(F.broadcast(cut), "session").withColumn("target_at", F.greatest("as_of", close_utc))


def category_sums(states: DataFrame, targets: DataFrame, grid: CutoffGrid, p: dict) -> DataFrame:
    """Weight, weighted sentiment and counts per (pos, horizon, entity, category)."""
    grains = states.groupBy("entity", "category", "half_life_days", "p", "q").agg(
        F.sum("x").alias("x"), F.sum(F.col("x") * F.col("sentiment")).alias("xs"), F.count("*").alias("stories"),
        F.count_if(F.col("x") > 0).alias("weighted_stories"), F.sum("articles").alias("articles"))
    return faded_sums(grains, targets, grid, p)


def trial_grains(items: DataFrame, grid: CutoffGrid, p: dict, trials: DataFrame, scales: list[float], policy: str = "provider_timestamp") -> DataFrame:
    """Story grains of all trials from one pass over the stories.

    ``trials`` holds trial, scale_no (place in ``scales``, the different half-life scales), t_scale and t_price_report. A story's weight depends on a trial through
    its decay only, so stories are summed once a scale (price reports apart), and the trials are laid over those sums.
    """
    states = story_states(score_range(with_visibility(items, policy), grid, p), crowded=crowded_stories(items))
    starts = grid.frame().select(F.col("pos").alias("p"), F.col("as_of").alias("start_at"))
    base = (F.col("reliability") * F.col("relevance") * F.col("strength")
            * (1 + F.lit(float(p["corroboration_bonus"])) * F.log(F.greatest(F.lit(1), F.col("cluster_size")))))
    age = days_between(F.col("available_at"), F.col("start_at"))
    weights = [F.col("_base") * F.pow(F.lit(0.5), F.col("_age") / _half_life({"recency_half_life_scale": s})) for s in scales]
    sums = states.join(F.broadcast(starts), "p").withColumns({"_base": base, "_age": age}).groupBy("entity", "category", "half_life_days", "p", "q", "price_report").agg(
        F.array(*[F.struct(F.sum(w).alias("x"), F.sum(w * F.col("sentiment")).alias("xs")) for w in weights]).alias("v"), F.count("*").alias("n"), F.sum("articles").alias("a"))
    factor = F.when(F.col("price_report"), F.col("t_price_report")).otherwise(1.0)
    own = F.element_at("v", F.col("scale_no") + 1)
    return sums.join(F.broadcast(trials)).groupBy("trial", "t_scale", "entity", "category", "half_life_days", "p", "q").agg(
        F.sum(own["x"] * factor).alias("x"), F.sum(own["xs"] * factor).alias("xs"), F.sum("n").alias("stories"), F.sum(F.when(own["x"] * factor > 0, F.col("n")).otherwise(0)).alias("weighted_stories"),
        F.sum("a").alias("articles"))


def faded_sums(grains: DataFrame, targets: DataFrame, grid: CutoffGrid, p: dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """The grains' sums per (extra, pos, horizon, entity, category); ``extra`` are trial columns."""
    # Fade in two steps: stretch start -> cut-off (summed per cut-off), then cut-off -> each horizon target.
    cut = grid.frame().select("pos", "as_of")
    starts = cut.select(F.col("pos").alias("p"), F.col("as_of").alias("start_at"))
    spread = enumerate_positions(grains.join(F.broadcast(starts), "p")).join(F.broadcast(cut), "pos").withColumn("fade", _fade("start_at", "as_of", p))
    at_cut = spread.groupBy(*extra, "pos", "as_of", "entity", "category", "half_life_days").agg(
        F.sum(F.col("x") * F.col("fade")).alias("x"), F.sum(F.col("xs") * F.col("fade")).alias("xs"), F.sum("stories").alias("stories"),
        F.sum("weighted_stories").alias("weighted_stories"), F.sum("articles").alias("articles"))
    wanted = targets.select("pos", "horizon_type", "target_date", "target_at")
    joined = at_cut.join(wanted, "pos").withColumn("fade", _fade("as_of", "target_at", p))
    return joined.groupBy(*extra, "pos", "horizon_type", "target_date", "entity", "category").agg(
        F.sum(F.col("x") * F.col("fade")).alias("w"), F.sum(F.col("xs") * F.col("fade")).alias("ws"),
        F.sum("stories").alias("stories"), F.sum("weighted_stories").alias("weighted_stories"),
        F.sum("articles").alias("articles"))


def entity_scores(sums: DataFrame, expected: DataFrame, p: dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """Shrunk scores. ``expected`` lists every (extra, pos, horizon, entity) that must appear, evidence or not."""
    keys = [*extra, "pos", "horizon_type", "target_date", "entity"]
    totals = sums.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("ws").alias("ws"), F.sum("stories").alias("stories"),
                                     F.sum("articles").alias("articles"))
    has = F.col("w") > 0
    mean = F.try_divide("ws", "w")
    k = number(p["shrinkage_k"])
    score = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), mean * F.col("w") / (F.col("w") + k)))
    return expected.join(totals, keys, "left").select(
        *expected.columns,
        F.when(has, F.bround(score, 2)).otherwise(0.0).alias("score"),
        F.when(has, F.bround(mean, 2)).alias("raw_mean"),
        F.when(has, F.bround("w", 5)).otherwise(0.0).alias("evidence_weight"),
        F.coalesce("stories", F.lit(0)).alias("news_count"),
        F.coalesce("articles", F.lit(0)).alias("article_count"))


def category_breakdown(sums: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return sums.where((F.col("weighted_stories") > 0) & (F.col("w") > 0)).select(
        *extra, "pos", "horizon_type", "target_date", "entity", "category",
        F.bround(F.col("ws") / F.col("w"), 2).alias("mean"), F.bround("w", 5).alias("weight"))


def top_contributors(states: DataFrame, targets: DataFrame, grid: CutoffGrid, p: dict, top_n: int = 5) -> DataFrame:
    """Largest story weights per (pos, horizon, entity).

    Stories with equal half-life keep their order for ever, so the best ``top_n`` of each (entity, half-life,
    stretch) suffice; they are limited map-side before the shuffle and only then expanded over cut-offs.
    """
    first = Window.partitionBy("entity", "half_life_days", "p", "q").orderBy(F.desc("x"), "available_at", "news_id")
    best = (
        states.where(F.col("x") > 0)
        .select("entity", "half_life_days", "p", "q", "x", "available_at", "news_id", "category", "sentiment", "cluster_size")
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top_n).drop("_r")
    )
    starts = grid.frame().select(F.col("pos").alias("p"), F.col("as_of").alias("start_at"))
    joined = enumerate_positions(best.join(F.broadcast(starts), "p")).join(targets, "pos").withColumn(
        "weight", F.col("x") * _fade("start_at", "target_at", p))
    order = Window.partitionBy("pos", "horizon_type", "target_date", "entity").orderBy(F.desc("weight"), "available_at", "news_id")
    return (
        joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
        .select("pos", "horizon_type", "target_date", "entity", "rank", "news_id", "available_at", "category",
                F.bround("sentiment", 4).alias("sentiment"), F.bround("weight", 5).alias("weight"), "cluster_size")
    )


def index_scores(scores: DataFrame, p: dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """company_weighted, macro, overall and weight coverage per (pos, horizon). Needs a ``weight`` column."""
    company = F.col("entity") != MACRO
    total = F.sum(F.when(company, F.col("weight")))
    weighted = F.sum(F.when(company, F.col("weight") * F.col("score")))
    covered = F.sum(F.when(company & (F.col("news_count") > 0), F.col("weight")).otherwise(0.0))
    macro = F.max(F.when(~company, F.col("score")))
    share = number(p["macro_weight_in_index"])
    cw = F.when(total > 0, weighted / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return scores.groupBy(*extra, "pos", "session", "horizon_type", "target_date").agg(
        F.bround(cw, 2).alias("company_weighted"), macro.alias("macro"),
        F.bround((1 - share) * cw + share * F.coalesce(macro, F.lit(0.0)), 2).alias("overall"),
        F.when(total > 0, F.bround(covered / F.nullif(total, F.lit(0.0)), 4)).otherwise(0.0).alias("weight_coverage"))
