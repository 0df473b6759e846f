"""Relative sentiment: what is new since the previous cut-off compared with an entity's own baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import hours_between, plus_days
from tidemark.operators.calendar import CutoffGrid
from tidemark.operators.scores import MACRO
from tidemark.operators.stories import crowded_stories, enumerate_positions, flow_range, story_states, with_visibility
from tidemark.session import cut_lineage

Z_CLIP = 5.0


def flow_states(items: DataFrame, grid: CutoffGrid, p: dict, policy: str = "provider_timestamp") -> DataFrame:
    ranged = flow_range(with_visibility(items, policy), grid, p)
    extra = ("new_until", "fetched_at") if "fetched_at" in ranged.columns else ("new_until",)
    return story_states(ranged, extra=extra, crowded=crowded_stories(items))


def new_stories(states: DataFrame) -> DataFrame:
    """Stretches of a story during which it is new (its representative is after the window start)."""
    return states.withColumn("q", F.least("q", "new_until")).where(F.col("p") < F.col("q"))


def baseline_stories(states: DataFrame) -> DataFrame:
    return states.withColumn("p", F.greatest("p", "new_until")).where(F.col("p") < F.col("q"))


def flow_grains(items: DataFrame, grid: CutoffGrid, p: dict, policy: str = "provider_timestamp") -> DataFrame:
    """(pos, entity) sums of the new stories, of the own baseline and of the baseline offered to the pool.

    One scan and one cluster shuffle serve all three: an item enters the cluster resolution once as seen at the cut-off
    and once as seen up to the window start only (the pool ignores later members). Stories are summed per stretch
    before any stretch is expanded over cut-offs.
    """
    pr_w = float(p["price_report_weight"])
    ranged = flow_range(with_visibility(items, policy), grid, p)
    views = F.array(
        F.struct(F.lit("own").alias("view"), F.col("p_from").alias("p_from")),
        F.struct(F.lit("pool").alias("view"), F.when(F.col("entity") != MACRO, F.greatest("p_from", "new_until")).alias("p_from")))
    members = ranged.withColumn("_v", F.explode(views)).withColumns({"view": F.col("_v.view"), "p_from": F.col("_v.p_from")}).drop("_v").where(
        F.col("p_from") < F.col("p_to"))
    states = story_states(members, extra=("new_until",), scope=("view",), crowded=crowded_stories(items))
    own = F.col("view") == "own"
    parts = F.array(
        F.when(own, F.struct(F.lit("new").alias("kind"), F.col("p").alias("p"), F.least("q", "new_until").alias("q"))),
        F.when(own, F.struct(F.lit("base").alias("kind"), F.greatest("p", "new_until").alias("p"), F.col("q").alias("q"))),
        F.when(~own, F.struct(F.lit("pool").alias("kind"), F.col("p").alias("p"), F.col("q").alias("q"))))
    phases = states.withColumn("_k", F.explode(parts)).where(F.col("_k.p") < F.col("_k.q")).select(
        "entity", "_k.kind", "_k.p", "_k.q", "available_at", "relevance", "sentiment", "price_report",
        F.greatest(F.lit(1e-9), F.col("reliability") * F.col("relevance") * F.col("strength")
                   * F.when(F.col("price_report"), F.lit(pr_w)).otherwise(1.0)).alias("weight"))
    used = ~(F.col("price_report") & F.lit(pr_w <= 0))
    keep = lambda c: F.when(used, c)
    grains = phases.groupBy("entity", "kind", "p", "q").agg(
        F.count_if(used).alias("n"), F.count_if(~used).alias("excluded"), F.sum(keep(F.col("sentiment"))).alias("s"),
        F.sum(keep(F.col("sentiment") * F.col("sentiment"))).alias("ss"), F.min(keep(F.col("sentiment"))).alias("lo"),
        F.max(keep(F.col("sentiment"))).alias("hi"), F.sum(keep(F.col("weight"))).alias("w"),
        F.sum(keep(F.col("weight") * F.col("sentiment"))).alias("ws"), F.sum(keep(F.col("relevance"))).alias("rel"),
        F.max(keep(F.col("available_at"))).alias("newest"))
    spread = enumerate_positions(grains)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    moments = [f(of(kind, c)).alias(prefix + c) for kind, prefix in (("base", ""), ("pool", "p_"))
               for c, f in (("n", F.sum), ("s", F.sum), ("ss", F.sum), ("lo", F.min), ("hi", F.max))]
    return spread.groupBy("pos", "entity").agg(
        F.sum(of("new", "n")).alias("news_count"), F.sum(of("new", "excluded")).alias("excluded"), F.sum(of("new", "w")).alias("w"),
        F.sum(of("new", "ws")).alias("ws"), F.sum(of("new", "rel")).alias("rel"), F.max(of("new", "newest")).alias("newest"), *moments)


def trial_flow_grains(items: DataFrame, grid: CutoffGrid, p: dict, trials: DataFrame, baselines: list[float], policy: str = "provider_timestamp") -> DataFrame:
    """The sums of ``flow_grains`` per (trial, pos, entity) from one pass over the items.

    ``trials`` holds trial, baseline_no (place in ``baselines``, the different lengths in days) and t_price_report. Items are read, dated and
    clustered together for all lengths; price reports are summed apart, so their weight is laid over the sums like everything else of a trial.
    """
    seen = with_visibility(items, policy)
    kept = seen.where((F.col("relevance") >= p["min_relevance"]) & F.col("visible_at").isNotNull())
    out = grid.position(kept, F.col("visible_at"), "p_from")
    out = grid.position(out, F.col("available_at"), "new_until", by="window_start")
    for k, days in enumerate(baselines):
        out = grid.position(out, plus_days(F.col("available_at"), days), "_base_end", by="window_start")
        out = grid.position(out, plus_days(F.col("available_at"), max(p["max_lookback_days"], days + 7)), "_slice_end", strict=True)
        out = out.withColumn(f"_to{k}", F.least("_base_end", "_slice_end")).drop("_base_end", "_slice_end")
    views = F.array(*[F.struct(F.lit(k).alias("baseline_no"), F.lit(view).alias("view"), start.alias("p_from"), F.col(f"_to{k}").alias("p_to"))
                      for k in range(len(baselines))
                      for view, start in (("own", F.col("p_from")), ("pool", F.when(F.col("entity") != MACRO, F.greatest("p_from", "new_until"))))])
    members = out.withColumn("_v", F.explode(views)).withColumns({c: F.col(f"_v.{c}") for c in ("baseline_no", "view", "p_from", "p_to")}).drop(
        "_v", *[f"_to{k}" for k in range(len(baselines))]).where(F.col("p_from") < F.col("p_to"))
    states = story_states(members, extra=("new_until",), scope=("baseline_no", "view"), crowded=crowded_stories(items))
    own = F.col("view") == "own"
    parts = F.array(
        F.when(own, F.struct(F.lit("new").alias("kind"), F.col("p").alias("p"), F.least("q", "new_until").alias("q"))),
        F.when(own, F.struct(F.lit("base").alias("kind"), F.greatest("p", "new_until").alias("p"), F.col("q").alias("q"))),
        F.when(~own, F.struct(F.lit("pool").alias("kind"), F.col("p").alias("p"), F.col("q").alias("q"))))
    weight = F.greatest(F.lit(1e-9), F.col("reliability") * F.col("relevance") * F.col("strength"))
    phases = states.withColumn("_k", F.explode(parts)).where(F.col("_k.p") < F.col("_k.q")).select(
        "baseline_no", "entity", "_k.kind", "_k.p", "_k.q", "available_at", "relevance", "sentiment", "price_report", weight.alias("weight"))
    sums = [F.count("*").alias("n"), F.sum("sentiment").alias("s"), F.sum(F.col("sentiment") * F.col("sentiment")).alias("ss"), F.min("sentiment").alias("lo"), F.max("sentiment").alias("hi"),
            F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("sentiment")).alias("ws"), F.sum("relevance").alias("rel"), F.max("available_at").alias("newest")]
    grains = phases.groupBy("baseline_no", "entity", "kind", "p", "q", "price_report").agg(*sums)
    total = {"n": F.sum, "s": F.sum, "ss": F.sum, "lo": F.min, "hi": F.max, "w": F.sum, "ws": F.sum, "rel": F.sum, "newest": F.max}
    at = cut_lineage(enumerate_positions(grains).groupBy("baseline_no", "pos", "entity", "kind", "price_report").agg(*[f(c).alias(c) for c, f in total.items()]))
    laid = at.join(F.broadcast(trials), "baseline_no")
    used = ~F.col("price_report") | (F.col("t_price_report") > 0)
    factor = F.when(F.col("price_report"), F.col("t_price_report")).otherwise(1.0)
    of = lambda kind, c: F.when((F.col("kind") == kind) & used, c)
    moments = [total[c](of(kind, F.col(c))).alias(prefix + c) for kind, prefix in (("base", ""), ("pool", "p_")) for c in ("n", "s", "ss", "lo", "hi")]
    return laid.groupBy("trial", "pos", "entity").agg(
        F.sum(of("new", F.col("n"))).alias("news_count"), F.sum(F.when((F.col("kind") == "new") & ~used, F.col("n"))).alias("excluded"), F.sum(of("new", F.col("w") * factor)).alias("w"),
        F.sum(of("new", F.col("ws") * factor)).alias("ws"), F.sum(of("new", F.col("rel"))).alias("rel"), F.max(of("new", F.col("newest"))).alias("newest"), *moments)


def pooled_moments(grains: DataFrame, companies: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Baseline moments of all companies in the universe at each cut-off."""
    pool = grains.where(F.col("p_n") > 0).join(companies, ["pos", "entity"])
    return pool.groupBy(*extra, "pos").agg(F.sum("p_n").alias("pool_n"), F.sum("p_s").alias("pool_s"), F.sum("p_ss").alias("pool_ss"),
                                   F.min("p_lo").alias("pool_lo"), F.max("p_hi").alias("pool_hi"))


def news_flow(items: DataFrame, grid: CutoffGrid, members: DataFrame, p: dict, policy: str = "provider_timestamp") -> DataFrame:
    """Flow per (pos, entity) for every universe member and MACRO.

    ``members``: (pos, entity) of the companies in the universe at each cut-off. A thin own baseline falls back
    to the pooled baseline of those companies; MACRO never does.
    """
    return flow_of(flow_grains(items, grid, p, policy), grid, members, p)


def flow_of(grains: DataFrame, grid: CutoffGrid, members: DataFrame, p: dict, trials: DataFrame | None = None) -> DataFrame:
    """Flow rows from the sums of ``flow_grains``; with ``trials`` (trial) from those of ``trial_flow_grains``, a row for every trial."""
    extra = () if trials is None else ("trial",)
    # (cut-offs x entities) rows: the checkpoint lets the pool and the per-entity rows share one computation.
    grains = cut_lineage(grains)
    cut = grid.frame().select("pos", "session", "as_of")
    companies = members.select("pos", "entity").distinct()
    expected = companies.unionByName(grid.frame().select("pos", F.lit(MACRO).alias("entity")))
    if trials is not None:
        expected = expected.join(F.broadcast(trials.select("trial")))
    rows = expected.join(F.broadcast(cut), "pos").join(grains, [*extra, "pos", "entity"], "left").join(pooled_moments(grains, companies, extra), [*extra, "pos"], "left")
    min_n = int(p["min_baseline_n"])
    own_n, pool_n = F.coalesce("n", F.lit(0)), F.coalesce("pool_n", F.lit(0))
    use_pool = (F.col("entity") != MACRO) & (own_n < min_n) & (pool_n >= min_n)
    pick = lambda c: F.when(use_pool, F.col("pool_" + c)).otherwise(F.col(c))
    rows = (
        rows.withColumn("pooled", use_pool)
        .withColumn("baseline_n", F.when(use_pool, pool_n).otherwise(own_n))
        .withColumn("_mean", F.try_divide(pick("s"), pick("n")))
        .withColumn("_same", pick("lo") == pick("hi"))
        .withColumn("_var", F.try_divide(pick("ss") - pick("s") * F.col("_mean"), pick("n") - 1))
        .withColumn("_std", F.when(F.col("baseline_n") > 1,
                                   F.when(F.col("_same"), 0.0).otherwise(F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))))))
        .withColumn("news_count", F.coalesce("news_count", F.lit(0)))
        .withColumn("price_reports_excluded", F.coalesce("excluded", F.lit(0)))
        .withColumn("_cur", F.try_divide("ws", "w"))
    )
    enough = F.col("baseline_n") >= min_n
    quiet = F.col("news_count") == 0
    z_ok = enough & (F.coalesce("_std", F.lit(0.0)) > 0)
    relative = F.col("_cur") - F.col("_mean")
    z = F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), F.try_divide(relative, F.col("_std"))))
    return rows.select(
        *extra, "pos", "session", "entity",
        F.when(quiet, F.when(enough, "no_new_news").otherwise("insufficient_history"))
        .when(~enough, "insufficient_history").when(F.col("pooled"), "ok_pooled_baseline").otherwise("ok").alias("status"),
        F.when(~quiet, F.bround("_cur", 3)).alias("current_sentiment"),
        F.when(~enough, F.lit(None)).when(quiet, 0.0).otherwise(F.bround(relative, 3)).alias("relative_sentiment"),
        F.when(~z_ok, F.lit(None)).when(quiet, 0.0).otherwise(F.bround(z, 4)).alias("sentiment_zscore"),
        F.bround("_mean", 3).alias("baseline_mean"), F.bround("_std", 3).alias("baseline_std"), "baseline_n", "news_count",
        F.when(~quiet, F.bround(F.round(F.try_divide("rel", "news_count"), 9), 3)).alias("news_relevance"),
        F.when(~quiet, F.bround(hours_between(F.col("newest"), F.col("as_of")), 2)).alias("news_recency_hours"),
        "price_reports_excluded")


def new_news_ids(states: DataFrame, p: dict, limit: int | None = None) -> DataFrame:
    """(pos, entity, news_id, available_at[, rank]): representatives of the new stories, oldest first."""
    pr_w = float(p["price_report_weight"])
    kept = new_stories(states).where(~(F.col("price_report") & F.lit(pr_w <= 0)))
    held = ["fetched_at"] if "fetched_at" in kept.columns else []
    rows = enumerate_positions(kept.select("entity", "p", "q", "news_id", "available_at", *held))
    if limit is None:
        return rows
    order = Window.partitionBy("pos", "entity").orderBy("available_at", "news_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def index_relative(flows: DataFrame, weights: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Index-weighted mean relative sentiment per cut-off over companies whose value is known."""
    known = flows.where((F.col("entity") != MACRO) & F.col("relative_sentiment").isNotNull()).join(weights, ["pos", "entity"])
    total = F.sum("weight")
    return known.groupBy(*extra, "pos").agg(
        F.when(total > 0, F.bround(F.sum(F.col("weight") * F.col("relative_sentiment")) / F.nullif(total, F.lit(0.0)), 3))
        .alias("index_relative"))
