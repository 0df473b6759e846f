"""Linear models by distributed sufficient statistics.

One scan of the records gives pairwise raw moments per key; every penalty, feature subset and expanding window
is then a k x k solve. Only those matrices (never rows) reach the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import normal_p
from tidemark.operators import metrics as metric_ops
from tidemark.operators.predict import FEATURES, linear_value
from tidemark.session import cut_lineage, local_frame

ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)
_NEWS = ["relative_sentiment", "sentiment_zscore", "news_count", "news_relevance", "news_recency", "macro_relative", "index_relative"]
_MARKET = ["historical_volatility", "beta", "previous_return", "rolling_return_5d", "rolling_return_20d"]
FEATURE_SETS: dict[str, list[str]] = {
    "intercept only (training mean)": [],
    "+ raw sentiment": ["raw_sentiment"],
    "+ relative sentiment": ["relative_sentiment", "sentiment_zscore"],
    "+ news features": _NEWS,
    "recommended initial set": ["relative_sentiment", "news_count", "news_recency", "macro_relative", "historical_volatility", "beta"],
    "market features only": _MARKET,
    "news + market features": _NEWS + _MARKET,
    "full": list(FEATURES),
}
TRIVIAL_SET = "intercept only (training mean)"


def moments(records: DataFrame, features: list[str], *keys: str, target: str = "actual") -> DataFrame:
    """(keys, stat, i, j, value): sums over rows, using pairwise presence for missing values.

    stat pp = both present, px = x_i where j is present, xx = x_i x_j, xy = x_i y, py = y where i is present,
    plus n, y and yy. Each Arrow batch is reduced to matrices before anything is shuffled.
    """
    cols = list(features)
    key_fields = [records.schema[k] for k in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] + ["stat string, i int, j int, value double"])

    def reduce(batches):
        for pdf in batches:
            groups = pdf.groupby(list(keys), sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = part[cols].to_numpy(dtype="float64") if cols else np.zeros((len(part), 0))
                y = part[target].to_numpy(dtype="float64")
                seen = (~np.isnan(x)).astype("float64")
                x = np.nan_to_num(x, nan=0.0)
                rows = [("n", -1, -1, float(len(y))), ("y", -1, -1, float(y.sum())), ("yy", -1, -1, float(y @ y))]
                for name, m in (("pp", seen.T @ seen), ("px", x.T @ seen), ("xx", x.T @ x)):
                    rows += [(name, i, j, float(m[i, j])) for i in range(len(cols)) for j in range(len(cols))]
                for name, vec in (("xy", x.T @ y), ("py", seen.T @ y)):
                    rows += [(name, i, -1, float(vec[i])) for i in range(len(cols))]
                out = pd.DataFrame(rows, columns=["stat", "i", "j", "value"])
                for k, value in zip(keys, key):
                    out.insert(0, k, [value] * len(out))
                yield out[[*keys, "stat", "i", "j", "value"]]

    partial = records.select(*keys, target, *cols).mapInPandas(reduce, schema)
    return partial.groupBy(*keys, "stat", "i", "j").agg(F.sum("value").alias("value"))


@dataclass
class Moments:
    """Additive raw moments of one group of rows."""

    features: list
    n: float
    y: float
    pp: np.ndarray
    px: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    py: np.ndarray

    @classmethod
    def from_rows(cls, features: list[str], rows) -> Moments:
        k = len(features)
        m = cls(list(features), 0.0, 0.0, *(np.zeros((k, k)) for _ in range(3)), *(np.zeros(k) for _ in range(2)))
        for r in rows:
            stat, i, j, v = r["stat"], r["i"], r["j"], r["value"]
            if stat in ("n", "y"):
                setattr(m, stat, v)
            elif stat in ("pp", "px", "xx"):
                getattr(m, stat)[i, j] = v
            elif stat in ("xy", "py"):
                getattr(m, stat)[i] = v
        return m

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.features, self.n + o.n, self.y + o.y, self.pp + o.pp, self.px + o.px, self.xx + o.xx,
                       self.xy + o.xy, self.py + o.py)

    def subset(self, features: list[str]) -> Moments:
        ix = [self.features.index(f) for f in features]
        grid = np.ix_(ix, ix)
        return Moments(list(features), self.n, self.y, self.pp[grid], self.px[grid], self.xx[grid], self.xy[ix], self.py[ix])

    def standardisation(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population std over present values; all missing -> 0 / 1, constant -> 1."""
        seen = np.diag(self.pp)
        safe = np.where(seen > 0, seen, 1.0)
        mean = np.where(seen > 0, np.diag(self.px) / safe, 0.0)
        var = np.maximum(np.where(seen > 0, np.diag(self.xx) / safe - mean**2, 0.0), 0.0)
        std = np.sqrt(var)
        return mean, np.where((seen == 0) | (std < 1e-12) | (var < 1e-13 * (1 + mean**2)), 1.0, std)

    def standardised(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gram matrix and target products of the standardised design in which a missing value is zero."""
        mean, std = self.standardisation()
        gram = self.xx - mean[None, :] * self.px - mean[:, None] * self.px.T + np.outer(mean, mean) * self.pp
        target = self.xy - mean * self.py
        column = np.diag(self.px) - mean * np.diag(self.pp)
        y_mean = self.y / self.n
        return gram / np.outer(std, std), (target - y_mean * column) / std, mean, std


def ridge(m: Moments, alpha: float) -> dict:
    """Minimise squared error + alpha n |b|^2 on standardised features; the intercept is the unpenalised target mean."""
    base = {"kind": "ridge", "features": list(m.features), "intercept": m.y / m.n, "alpha": alpha, "n_train": int(m.n)}
    if not m.features:
        return {**base, "coef": [], "mean": [], "std": []}
    gram, target, mean, std = m.standardised()
    coef = np.linalg.solve(gram + alpha * m.n * np.eye(len(mean)), target)
    return {**base, "coef": coef.round(8).tolist(), "mean": mean.tolist(), "std": std.tolist()}


def fit_ridge(records: DataFrame, features: list[str], alphas=ALPHAS, target: str = "actual") -> list[dict]:
    m = Moments.from_rows(features, moments(records, features, target=target).collect())
    return [ridge(m, a) for a in alphas]


def fit_logistics(records: DataFrame, models: list[tuple[list[str], float]], target: str, iterations: int = 50) -> list[dict]:
    """L2-penalised logistic models of several feature lists and penalties, ``models`` being (features, alpha), fitted together.

    Every Newton step is one pass over the rows: a task adds up the gradients and Hessians of all models that have not settled, Spark
    sums them, and the driver solves one small system a model. Missing values are zero after standardisation; the intercept is not penalised.
    """
    names = sorted({f for features, _ in models for f in features})
    rows = cut_lineage(records.select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names]))
    m = Moments.from_rows(names, moments(rows, names, target="_y").collect())
    mean, std = m.standardisation()
    places = [[0] + [1 + names.index(f) for f in features] for features, _ in models]
    share = min(max(m.y / m.n, 1e-6), 1 - 1e-6) if m.n else 0.5
    weights = [np.zeros(len(p)) for p in places]
    penalties = [np.diag([0.0] + [alpha * m.n] * (len(p) - 1)) for p, (_, alpha) in zip(places, models)]
    left = [i for i, p in enumerate(places) if len(p) > 1 and m.n]
    for i, p in enumerate(places):
        if len(p) == 1:
            weights[i][0] = np.log(share / (1 - share))

    def step_sums(active: list[int]) -> dict[int, np.ndarray]:
        current = [(i, places[i], weights[i]) for i in active]

        def reduce(batches):
            sums = {i: np.zeros(len(w) * (len(w) + 1)) for i, _, w in current}
            for pdf in batches:
                z = np.nan_to_num((pdf[names].to_numpy(dtype="float64") - mean) / std, nan=0.0)
                z, y = np.hstack([np.ones((len(z), 1)), z]), pdf["_y"].to_numpy()
                for i, p, w in current:
                    x = z[:, p]
                    prob = 1 / (1 + np.exp(-(x @ w)))
                    sums[i][: len(w)] += x.T @ (prob - y)
                    sums[i][len(w):] += (x.T @ (x * (prob * (1 - prob))[:, None])).ravel()
            yield pd.DataFrame({"model": np.repeat(list(sums), [len(v) for v in sums.values()]), "pos": np.concatenate([np.arange(len(v)) for v in sums.values()]),
                                "value": np.concatenate(list(sums.values()))})

        out = {i: np.zeros(len(w) * (len(w) + 1)) for i, _, w in current}
        for r in rows.mapInPandas(reduce, "model int, pos int, value double").groupBy("model", "pos").agg(F.sum("value").alias("value")).collect():
            out[r["model"]][r["pos"]] = r["value"]
        return out

    for _ in range(iterations):
        if not left:
            break
        sums, still = step_sums(left), []
        for i in left:
            k = len(weights[i])
            grad, hess = sums[i][:k], sums[i][k:].reshape(k, k)
            step = np.linalg.solve(hess + penalties[i] + 1e-9 * np.eye(k), grad + penalties[i] @ weights[i])
            weights[i] = weights[i] - step
            if np.max(np.abs(step)) >= 1e-8:
                still.append(i)
        left = still
    out = []
    for (features, alpha), p, w in zip(models, places, weights):
        at = [k - 1 for k in p[1:]]
        out.append({"kind": "logistic", "features": list(features), "alpha": alpha, "n_train": int(m.n), "coef": w[1:].round(8).tolist(), "intercept": float(w[0]),
                    "mean": mean[at].tolist(), "std": std[at].tolist()})
    return out


def fit_logistic(records: DataFrame, features: list[str], alpha: float, target: str, iterations: int = 50) -> dict:
    """One L2-penalised logistic model."""
    return fit_logistics(records, [(features, alpha)], target, iterations)[0]


def directions(rows: DataFrame, feature_sets: dict[str, list[str]], actual: str = "actual") -> DataFrame:
    """(feature_set, part, alpha, ...): a model of the sign of the return for every feature set, on rows with ``part``.

    All sets and penalties are fitted together on the training rows; each set's penalty is the one with the least log loss on validation. The scores stand
    next to always telling the training majority and to the training share of rising rows.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows.withColumn("_up", (F.col(actual) > 0).cast("int")))
    tagged = [(name, features, a) for name, features in feature_sets.items() for a in (ALPHAS if features else (0.0,))]
    fitted = fit_logistics(rows.where("part = 'train'"), [(features, a) for _, features, a in tagged], "_up")
    rate = rows.where("part = 'train'").agg(F.avg("_up")).first()[0]
    scored = _scored(rows.where("part <> 'train'"), fitted)
    scores = metric_ops.classifier_scores(scored, "value", "_up", rate, "candidate", "part")
    hits = scored.groupBy("candidate", "part").agg(F.count_if((F.col("value") >= 0.5) == (F.col("_up") == 1)).alias("hits"),
                                                  (-F.avg(F.log(F.when(F.col("_up") == 1, _inside("value")).otherwise(1 - _inside("value"))))).alias("_loss"))
    table = cut_lineage(scores.join(hits, ["candidate", "part"]))
    loss = {r["candidate"]: r["_loss"] for r in table.where("part = 'validation'").collect()}  # one number a set and penalty
    chosen = [min((loss.get(i, float("inf")), i) for i, t in enumerate(tagged) if t[0] == name)[1] for name in feature_sets]
    picked = local_frame(spark, [(i, tagged[i][0], float(tagged[i][2])) for i in chosen], "candidate int, feature_set string, alpha double")
    return table.join(F.broadcast(picked), "candidate").select(
        "feature_set", "part", "alpha", "n", "accuracy", metric_ops.half_up(normal_p(metric_ops.coin_flip_z(F.col("hits"), F.col("n")))).alias("p_value"), "majority_accuracy",
        "log_loss", "brier", "brier_base_rate", "share_predicted_up", metric_ops.half_up(F.lit(rate)).alias("train_up_rate"))


def _inside(p: str) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))


def model_table(spark, models: dict[str, dict]) -> DataFrame:
    """(model, alpha, term, coef, mean, std) with the intercept as a term."""
    rows = []
    for name, m in models.items():
        rows.append((name, float(m["alpha"]), "intercept", float(m["intercept"]), None, None))
        rows += [(name, float(m["alpha"]), f, c, mu, sd) for f, c, mu, sd in zip(m["features"], m["coef"], m["mean"], m["std"])]
    return local_frame(spark, rows, "model string, alpha double, term string, coef double, mean double, std double")


def chronological_split(records: DataFrame, train_end: dt.date | None = None, valid_end: dt.date | None = None,
                        fractions: tuple[float, float] = (0.6, 0.2), date: str = "as_of_date") -> DataFrame:
    """Add ``part`` (train < validation < test): explicit ends, or fractions of the distinct dates."""
    if train_end and valid_end:
        if train_end >= valid_end:
            raise ValueError(f"no validation dates between {train_end} and {valid_end}")
        d = F.col(date)
        return records.withColumn("part", F.when(d <= F.lit(train_end), "train").when(d <= F.lit(valid_end), "validation").otherwise("test"))
    from pyspark.sql import Window

    days = records.select(date).distinct()
    order = Window.orderBy(date)  # calendar-sized
    n = F.count("*").over(Window.partitionBy())
    a = F.floor(n * fractions[0])
    b = F.floor(n * (fractions[0] + fractions[1]))
    rank = F.row_number().over(order) - 1
    parts = days.select(date, F.when(rank < a, "train").when(rank < b, "validation").otherwise("test").alias("part"))
    return records.join(F.broadcast(parts), date)


def _scored(records: DataFrame, models: list[dict], column: str = "candidate") -> DataFrame:
    """Records x models: the forecasts of all models in one pass, long form."""
    values = F.array(*[F.struct(F.lit(i).alias(column), linear_value(m).alias("value")) for i, m in enumerate(models)])
    return records.withColumn("_v", F.explode(values)).withColumn(column, F.col(f"_v.{column}")).withColumn("value", F.col("_v.value")).drop("_v")


def alpha_errors(validation: DataFrame, models: list[dict]) -> DataFrame:
    """(candidate, mae) of each model on the validation rows - all penalties in one job."""
    return _scored(validation, models).groupBy("candidate").agg(F.round(F.avg(F.abs(F.col("value") - F.col("actual"))), 5).alias("mae"))


def select_alpha(train: Moments, validation: DataFrame, features: list[str], alphas=ALPHAS) -> tuple[dict, dict]:
    """Model with the smallest validation MAE (first on ties) and the MAE per penalty."""
    grid = alphas if features else (0.0,)
    models = [ridge(train.subset(features), a) for a in grid]
    mae = {r["candidate"]: r["mae_"] for r in _scored(validation, models).groupBy("candidate").agg(
        F.avg(F.abs(F.col("value") - F.col("actual"))).alias("mae_")).collect()}
    best = min(range(len(models)), key=lambda i: (mae[i], i))
    return models[best], {grid[i]: round(mae[i], 5) for i in range(len(models))}


def select_all(train: Moments, validation: DataFrame, feature_sets: dict[str, list[str]]) -> dict[str, tuple[dict, dict]]:
    """The same for every feature set, with a single pass over the validation rows."""
    tagged = [(name, a, ridge(train.subset(f), a)) for name, f in feature_sets.items() for a in (ALPHAS if f else (0.0,))]
    mae = {r["candidate"]: r["mae_"] for r in _scored(validation, [m for _, _, m in tagged]).groupBy("candidate").agg(
        F.avg(F.abs(F.col("value") - F.col("actual"))).alias("mae_")).collect()}
    out = {}
    for name in feature_sets:
        mine = [(mae[i], i) for i, (s, _, _) in enumerate(tagged) if s == name]
        best = min(mine)[1]
        out[name] = (tagged[best][2], {tagged[i][1]: round(e, 5) for e, i in mine})
    return out


def walk_forward(records: DataFrame, features: list[str], month: str = "month") -> DataFrame:
    """Expanding monthly evaluation. One scan yields raw moments per month; cumulative sums give every window.

    The penalty for month i is chosen on month i-1 with a model of the months before it; the refitted model of all
    earlier months is then scored on month i.
    """
    spark = records.sparkSession
    by_month: dict[str, list] = {}
    for r in moments(records, features, month).collect():
        by_month.setdefault(r[month], []).append(r)
    names = sorted(by_month)
    parts = [Moments.from_rows(features, by_month[m]) for m in names]
    upto = [parts[0]]
    for p in parts[1:]:
        upto.append(upto[-1] + p)
    grid = ALPHAS if features else (0.0,)

    def table(pairs):
        rows = []
        for label, extra, m in pairs:
            rows.append((label, extra, float(m["intercept"]), [float(c) for c in m["coef"]], [float(c) for c in m["mean"]], [float(c) for c in m["std"]]))
        return local_frame(spark, rows, "month string, alpha double, b0 double, coef array<double>, mu array<double>, sd array<double>")

    def forecast(models: DataFrame) -> DataFrame:
        x = F.array(*[F.col(f).cast("double") for f in features]) if features else F.array().cast("array<double>")
        z = F.zip_with(F.zip_with(x, "mu", lambda a, b: a - b), "sd", lambda a, b: F.coalesce(a / b, F.lit(0.0)))
        value = F.aggregate(F.zip_with(z, "coef", lambda a, b: a * b), F.col("b0"), lambda s, t: s + t)
        joined = records.drop("month").withColumnRenamed(month, "month") if month != "month" else records
        return joined.join(F.broadcast(models), "month").withColumn("value", value)

    if len(names) < 3:
        raise ValueError("walk-forward needs at least three months")
    inner = [(names[i - 1], a, ridge(upto[i - 2], a)) for i in range(2, len(names)) for a in grid]
    errors = forecast(table(inner)).groupBy("month", "alpha").agg(F.avg(F.abs(F.col("value") - F.col("actual"))).alias("mae")).collect()
    best: dict[str, tuple] = {}
    for r in sorted(errors, key=lambda r: (r["month"], round(r["mae"], 5), r["alpha"])):
        best.setdefault(r["month"], (r["alpha"],))
    outer = [(names[i], best[names[i - 1]][0], ridge(upto[i - 1], best[names[i - 1]][0])) for i in range(2, len(names))]
    return metric_ops.error_stats(forecast(table(outer)), "value", "month", "alpha")


def study_rows(records: DataFrame, baselines: list[str], train_end=None, valid_end=None) -> DataFrame:
    """Next-session rows that no baseline lacks, with their ``part``."""
    rows = metric_ops.with_all_baselines(records.where(F.col("horizon_type") == "today"), baselines)
    return cut_lineage(chronological_split(rows, train_end, valid_end))


def experiment(records: DataFrame, baselines: list[str], train_end=None, valid_end=None, references: dict[str, DataFrame] | None = None,
               feature_sets: dict[str, list[str]] | None = None, period: str | None = None, with_directions: bool = False) -> dict[str, DataFrame]:
    """Out-of-sample study of the next-session horizon: split, fit, select on validation, test once.

    ``period``: column by which the full and the selected feature set also walk forward. ``with_directions``: models of the sign as well.
    """
    sets = feature_sets or FEATURE_SETS
    spark = records.sparkSession
    rows = study_rows(records, baselines, train_end, valid_end)
    names = sorted({f for fs in sets.values() for f in fs})
    train = Moments.from_rows(names, moments(rows.where("part = 'train'"), names).collect())
    valid = rows.where("part = 'validation'")
    chosen = select_all(train, valid, sets)
    order = list(sets)
    models = {n: chosen[n][0] for n in order}
    scored = _scored(rows, [models[n] for n in order]).withColumn("feature_set", F.element_at(F.array(*[F.lit(n) for n in order]), F.col("candidate") + 1))
    scores = metric_ops.error_stats(scored, "value", "feature_set", "part")
    usable_sets = [r for r in scores.where("part = 'validation'").collect() if r["feature_set"] != TRIVIAL_SET]
    selected = min(usable_sets, key=lambda r: (r["mae"], order.index(r["feature_set"])))["feature_set"]
    best = rows.withColumn("selected", linear_value(models[selected]))
    tests = None
    for b in baselines:
        t = metric_ops.paired_test(best.where("part <> 'train'"), "selected", b, "part").withColumn("baseline", F.lit(b))
        tests = t if tests is None else tests.unionByName(t)
    tests = tests.withColumn("feature_set", F.lit(selected))
    out = {
        "models": model_table(spark, models), "scores": scores, "paired_tests": tests,
        "periods": rows.groupBy("part").agg(F.min("as_of_date").alias("start"), F.max("as_of_date").alias("end"), F.count("*").alias("rows"),
                                            F.countDistinct("as_of_date").alias("sessions")),
        "feature_analysis": metric_ops.feature_analysis(rows.where("part = 'train'"), list(FEATURES)),
        "feature_analysis_all": metric_ops.feature_analysis(rows, list(FEATURES)),
        "directions_per_part": metric_ops.direction_counts(scored, "value", "feature_set", "part"),
    }
    if with_directions:
        out["directions"] = directions(rows, sets)
    if period:
        walks = [walk_forward(rows, features, period).withColumn("feature_set", F.lit(name)) for name, features in (("full", list(FEATURES)), ("selected", sets[selected]))]
        out["walk_forward"] = walks[0].unionByName(walks[1])
        out["walk_forward_baselines"] = _stacked([metric_ops.error_stats(rows, b, period).withColumn("baseline", F.lit(b)) for b in baselines])
    for b in baselines:
        part = metric_ops.error_stats(rows, b, "part").withColumn("baseline", F.lit(b))
        out["baselines"] = part if "baselines" not in out else out["baselines"].unionByName(part)
    for name, ref in (references or {}).items():
        matched = rows.select("as_of_date", "ticker", "part", "actual", "neutral_threshold_pct").join(
            ref.where(F.col("horizon_type") == "today").select("as_of_date", "ticker", "predicted"), ["as_of_date", "ticker"])
        part = metric_ops.error_stats(matched, "predicted", "part").withColumn("reference", F.lit(name))
        out["references"] = part if "references" not in out else out["references"].unionByName(part)
    return out


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def recommended(tests: DataFrame) -> DataFrame:
    """True when the model beats every baseline significantly on validation and on test."""
    return tests.groupBy("feature_set").agg(
        (F.bool_and("significant") & (F.countDistinct("part") == 2)).alias("recommended"))
