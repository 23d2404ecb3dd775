"""Binary classifiers by MLlib over feature columns, and the tables that judge them. Labels are 0 or 1 in `y`; rows carry
`features` as a vector, as `clusters.feature_matrix` makes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.operators.places import running

KINDS = {"forest": RandomForestClassifier, "logistic": LogisticRegression, "boosted": GBTClassifier}


def split_part(key: str, validation: float = 0.15, test: float = 0.2) -> Column:
    """The part of a coin by the hash of its name: all samples of a coin are in one part, and stay there as coins are
    added. `test` is a share of what validation leaves."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    cut = round(1000 * validation)
    return F.when(at < cut, "validation").when(at < cut + round((1000 - cut) * test), "test").otherwise("train")


def split_by_coin(df: DataFrame, key: str = "coin_id", validation: float = 0.15, test: float = 0.2) -> DataFrame:
    return df.withColumn("part", split_part(key, validation, test))


def chance() -> Column:
    """The probability of 1; 0 by a model that has seen no label but 0."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def fit_classifier(df: DataFrame, kind: str = "forest", seed: int = 42, **params) -> Model:
    """A model of `y` from `features`; kinds are forest, logistic and boosted."""
    made = KINDS[kind](featuresCol="features", labelCol="y", **params)
    return (made.setSeed(seed) if kind != "logistic" else made).fit(df)


def score(df: DataFrame, model: Model, threshold: float = 0.5, sure: float = 0.7) -> DataFrame:
    """Add score (the probability of 1), predicted, confidence (of the likelier label) and whether it is over `sure`."""
    kept = model.transform(df).withColumn("score", chance()).drop("rawPrediction", "probability", "prediction")
    confidence = F.greatest(F.col("score"), 1 - F.col("score"))
    return kept.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "confidence": confidence, "is_sure": confidence > sure})


def score_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, share predicted 1, mean score and confidence, and share of sure ones."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("predicted").alias("positive_share"), F.avg("score").alias("mean_score"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("is_sure").cast("int")).alias("sure_share"))


def vote(df: DataFrame, models: Sequence[Model], soft: bool = True) -> DataFrame:
    """Add score and predicted by the mean probability of the models, or by the share of models that say 1 (half says 1)."""
    rows, names = df, []
    for i, model in enumerate(models):
        names.append(f"__p{i}")
        rows = model.transform(rows).withColumn(names[-1], chance()).drop("rawPrediction", "probability", "prediction")
    parts = [F.col(n) if soft else (F.col(n) >= 0.5).cast("double") for n in names]
    rows = rows.withColumn("score", sum(parts[1:], parts[0]) / len(parts)).drop(*names)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def cross_validate(df: DataFrame, kind: str, folds: int, fold_col: str, seed: int = 42, **params) -> list[float]:
    """AUC by folds that a column numbers from 0, so that a coin can be in one fold whole; the mean over folds comes last."""
    made = KINDS[kind](featuresCol="features", labelCol="y", **params)
    runner = CrossValidator(estimator=made, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=folds, foldCol=fold_col, seed=seed, collectSubModels=False)
    return list(runner.fit(df).avgMetrics)


def time_folds(df: DataFrame, time: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) for each fold: all before a time, and what comes up to the next. Times part the span evenly; two
    values come to the driver."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return []
    cuts = [low + (high - low + 1) * i // (folds + 1) for i in range(1, folds + 2)]
    return [(df.where(F.col(time) < a), df.where((F.col(time) >= a) & (F.col(time) < b))) for a, b in zip(cuts, cuts[1:])]


def importance(models: dict[str, Model], names: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """The features of greatest mean share of importance over the models: a tree model's own, a linear one's absolute
    weights. A value a feature."""
    sums = dict.fromkeys(names, 0.0)
    for model in models.values():
        raw = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
        whole = raw.sum() or 1.0
        for name, value in zip(names, raw):
            sums[name] += float(value) / whole / len(models)
    return sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:top]


def category_importance(ranked: Sequence[tuple[str, float]], categories: dict[str, Sequence[str]], other: str = "other") -> list[tuple[str, int, float, float]]:
    """(category, features, sum, mean) of importances by category, the greatest sum first: a feature is in the first category one of
    whose words its name holds, or in `other`. A value a feature."""
    sums: dict[str, list[float]] = {}
    for name, value in ranked:
        sums.setdefault(next((c for c, words in categories.items() if any(w in name for w in words)), other), []).append(value)
    return sorted(((c, len(v), sum(v), sum(v) / len(v)) for c, v in sums.items()), key=lambda x: (-x[2], x[0]))


def compare_by_regime(df: DataFrame, kinds: Sequence[str] = ("forest", "logistic"), regime: str = "regime", least: int = 1000, train: Column | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """(regime, model, n, auc, accuracy, f1, baseline_auc, gain, is_best): models of each kind fitted to each regime's training
    rows, judged on its other rows, beside the AUC that a model of the first kind fitted to all regimes' training rows has on
    the same rows. is_best marks each regime's best AUC, the first named of equals. Regimes with fewer than `least` training
    rows, or one label, have none.

    A model a regime and kind is a loop of fits; the judging is one aggregation over all of them."""
    params = params or {}
    train = F.col("part") == "train" if train is None else train
    learn, judged = df.where(train), df.where(~train)
    one = lambda model, rows, name: score(rows, model).select(F.col(regime).alias("regime"), F.lit(name).alias("model"), "y", "score")
    base = fit_classifier(learn, kinds[0], **params.get(kinds[0], {}))
    out = one(base, judged, "baseline")
    for kind in kinds:
        for key, model in fit_by_regime(learn, kind, regime, least, **params.get(kind, {})).items():
            out = out.unionByName(one(model, judged.where(F.col(regime) == key), kind))
    stats = metrics_by(out, ["regime", "model"])
    baseline = stats.where("model = 'baseline'").select("regime", F.col("auc").alias("baseline_auc"))
    rows = stats.where("model <> 'baseline'").join(baseline, "regime", "left").withColumn("gain", F.col("auc") - F.col("baseline_auc"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("model"))
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.col("auc").desc_nulls_last(), order))
    return rows.select("regime", "model", "n", "auc", "accuracy", "f1", "baseline_auc", "gain", (place == 1).alias("is_best"))


def metrics_by(scored: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(by..., n, auc, accuracy, f1) of score against y: AUC from mean ranks, ties at half, null where a label is missing. Rows are
    counted by group and score before any are ordered."""
    by = list(by)
    counted = scored.groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.col("score") >= threshold
    count = lambda on, c: F.sum(F.when(on, F.col(c)).otherwise(0))
    tp, fp, fn, tn = count(hit, "p"), count(hit, "q"), count(~hit, "p"), count(~hit, "q")
    rows = counted.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return rows.groupBy(*by).agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def fit_by_regime(df: DataFrame, kind: str = "forest", regime: str = "regime", least: int = 1000, **params) -> dict:
    """A model for each regime with `least` rows or more and both labels. The regimes and their counts come to the driver."""
    counts = df.groupBy(regime).agg(F.count("*").alias("n"), F.countDistinct("y").alias("labels")).where((F.col("n") >= least) & (F.col("labels") > 1))
    return {row[regime]: fit_classifier(df.where(F.col(regime) == row[regime]), kind, **params) for row in counts.orderBy(regime).collect()}


def score_routed(df: DataFrame, models: dict, regime: str = "regime") -> DataFrame:
    """Add score by the model of the row's regime; 0.5 where there is none. Each model reads its own regime's rows."""
    known = list(models)
    out = df.where(~F.col(regime).isin(known) | F.col(regime).isNull()).withColumn("score", F.lit(0.5)) if known else df.withColumn("score", F.lit(0.5))
    for key, model in models.items():
        part = model.transform(df.where(F.col(regime) == key)).withColumn("score", chance())
        out = out.unionByName(part.drop("rawPrediction", "probability", "prediction"))
    return out


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, AUC (ties at half) and average precision. Rows are counted by
    score before any are ordered, and the order is dealt by ranges."""
    y = F.col("y")
    by_score = scored.groupBy("score").agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    rows = running(by_score, [], [-F.col("score")], {"p": "tp", "q": "fp"}, {"p": "all_p", "q": "all_q"})
    rows = rows.withColumns({"tp": F.col("tp") + F.col("p"), "fp": F.col("fp") + F.col("q")})
    hit = F.col("score") >= threshold
    zero = lambda c: F.coalesce(F.sum(F.when(c[0], F.col(c[1]))), F.lit(0))
    out = rows.agg(
        zero((hit, "p")).alias("tp"), zero((hit, "q")).alias("fp"), zero((~hit, "p")).alias("fn"), zero((~hit, "q")).alias("tn"),
        F.try_divide(F.sum(F.col("p") * (F.col("all_q") - F.col("fp") + F.col("q") / 2)), F.max("all_p") * F.max("all_q")).alias("auc"),
        F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_p")).alias("average_precision"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})


def anova_select(df: DataFrame, features: Sequence[str], y: str = "y", k: int | None = None) -> DataFrame:
    """(feature, f, place): one-way analysis of variance of each feature by label, from one pass of sums; the first `k`."""
    long = df.select(F.col(y).alias("__y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select("__y", "f.feature", "f.x").where("x is not null")
    groups = long.groupBy("feature", "__y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = groups.groupBy("feature").agg(F.sum("n").alias("rows"), F.count("*").alias("labels"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("whole"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = groups.join(whole, "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("whole")) * (F.col("m") - F.col("whole"))).alias("between"))
    rows = whole.join(between, "feature").select("feature", F.when(F.col("labels") > 1, F.try_divide(F.col("between") / (F.col("labels") - 1), F.col("within") / (F.col("rows") - F.col("labels")))).alias("f"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("f").desc_nulls_last(), "feature")))
    return rows if k is None else rows.where(F.col("place") <= k)
