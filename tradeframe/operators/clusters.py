"""Clusters of rows by feature columns: fits by MLlib, and their quality, choice, profiles and assignment as DataFrame work.

Tables of centroids, metrics and profiles have a row a cluster or a number of clusters: they are small whatever the input."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of the trader segments.
SEGMENTS = {
    0: "Specialized/Niche Traders - Focused on specific strategies or tokens",
    1: "Active Retail Traders - Regular trading activity with moderate volumes",
    2: "Casual/Small Traders - Occasional trading with small volumes",
    3: "Serious/Semi-Pro Traders - High activity with significant volumes",
    4: "Elite/Whale Traders - Very high volume professional trading",
}


def constant_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, constant) for each feature, nulls as 0. By least and greatest value: the deviation of equal values, put
    together from parts, can be above 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ends = df.agg(*[F.struct(F.min(value(c)).alias("least"), F.max(value(c)).alias("greatest")).alias(c) for c in features])
    same = lambda c: F.coalesce((F.col(c)["least"] == F.col(c)["greatest"]) & ~F.isnan(F.col(c)["least"]), F.lit(True))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), same(c).alias("constant")) for c in features])
    return ends.select(F.inline(rows))


def feature_matrix(df: DataFrame, drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All columns; the numeric ones that aren't dropped have 0 for null, and those that vary make the vector `features`.
    One row, a value a feature, comes to the driver."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    names = [c for c, kind in df.dtypes if c not in drop and kind in kinds]
    varied = {row.feature for row in constant_columns(df, names).where("not constant").collect()}
    names = [c for c in names if c in varied]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.fillna(0, names)), names


def scale(df: DataFrame, method: str = "standard") -> tuple[DataFrame, Model]:
    """Add `scaled` to rows with `features`: standard (mean and deviation) or robust (median and quartiles, to Spark's relative error)."""
    makers = {"standard": StandardScaler(inputCol="features", outputCol="scaled", withMean=True), "robust": RobustScaler(inputCol="features", outputCol="scaled", withCentering=True)}
    model = makers[method].fit(df)
    return model.transform(df), model


def fit_kmeans(df: DataFrame, k: int, seed: int = 42) -> Model:
    return KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(df)


def fit_gmm(df: DataFrame, k: int, seed: int = 42, starts: int = 1) -> tuple[Model, float, float]:
    """The mixture with its AIC and BIC: full covariances. MLlib starts at random rows and can end in a poor optimum: of
    several starts the likeliest is kept."""
    made = [GaussianMixture(k=k, seed=seed + i, featuresCol="scaled", predictionCol="cluster", probabilityCol="cluster_probability").fit(df) for i in range(starts)]
    model = max(made, key=lambda m: m.summary.logLikelihood)
    d, likelihood = len(model.gaussians[0].mean), model.summary.logLikelihood
    free, n = k * (d + d * (d + 1) / 2) + k - 1, df.count()
    return model, 2 * free - 2 * likelihood, free * math.log(max(n, 1)) - 2 * likelihood


def bisecting_labels(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Add cluster by a hierarchy from the top down: merging upwards needs all distances. MLlib parts a cluster by moving
    its centre in proportion to the centre's length, which is none in centred rows: they are moved by one first, which
    leaves all distances as they are."""
    moved = df.withColumn("__moved", array_to_vector(F.transform(vector_to_array("scaled"), lambda x: x + 1)))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="__moved", predictionCol="cluster").fit(moved)
    return model.transform(moved).drop("__moved")


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette by squared Euclidean distances, from sums a cluster."""
    return ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(labelled)


def distance2(features: Sequence[str], prefix: str) -> Column:
    out = F.lit(0.0)
    for c in features:
        out = out + (F.col(c) - F.col(prefix + c)) * (F.col(c) - F.col(prefix + c))
    return out


def cluster_quality(labelled: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each `by`: n, k, the sum of squares within clusters, Calinski-Harabasz and Davies-Bouldin. Two passes over the
    rows; pairs are those of centroids."""
    by = list(by)
    labelled = labelled.withColumn("__all", F.lit(1))
    keys = ["__all", *by]
    centres = labelled.groupBy(*keys, "cluster").agg(F.count("*").alias("__n"), *[F.avg(c).alias("c_" + c) for c in features])
    means = labelled.groupBy(*keys).agg(*[F.avg(c).alias("m_" + c) for c in features])
    near = labelled.join(centres, [*keys, "cluster"]).withColumn("__d2", distance2(features, "c_"))
    spread = near.groupBy(*keys, "cluster").agg(F.sum("__d2").alias("__within"), F.avg(F.sqrt("__d2")).alias("__s"))
    rows = centres.join(spread, [*keys, "cluster"]).join(means, keys)
    between = sum(((F.col("c_" + c) - F.col("m_" + c)) * (F.col("c_" + c) - F.col("m_" + c)) for c in features), F.lit(0.0))
    other = rows.select(*keys, F.col("cluster").alias("__other"), F.col("__s").alias("__s2"), *[F.col("c_" + c).alias("o_" + c) for c in features])
    apart = F.sqrt(sum(((F.col("c_" + c) - F.col("o_" + c)) * (F.col("c_" + c) - F.col("o_" + c)) for c in features), F.lit(0.0)))
    worst = rows.join(other, keys).where(F.col("cluster") != F.col("__other")).groupBy(*keys, "cluster").agg(F.max(F.try_divide(F.col("__s") + F.col("__s2"), apart)).alias("__r"))
    sums = rows.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count("*").alias("k"), F.sum("__within").alias("wcss"), F.sum(F.col("__n") * between).alias("__between"))
    out = sums.join(worst.groupBy(*keys).agg(F.avg("__r").alias("davies_bouldin")), keys, "left")
    calinski = F.try_divide(F.col("__between") / (F.col("k") - 1), F.col("wcss") / (F.col("n") - F.col("k")))
    return out.select(*by, "n", "k", "wcss", F.when(F.col("k") > 1, calinski).alias("calinski_harabasz"), "davies_bouldin")


def silhouettes(labelled: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., silhouette) of squared Euclidean distances: the mean over rows of (b - a) / max(a, b), a the mean distance to
    the others of the row's cluster and b the least mean distance to another cluster; 0 for a row that is alone in its
    cluster, null where there is one cluster. Mean distances come from each cluster's count and sums, so rows meet clusters
    and not each other."""
    by, x = list(by), [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    square = lambda vs: sum((v * v for v in vs), F.lit(0.0))
    # about the mean, so that sums of squares stay exact
    means = labelled.groupBy(*by).agg(*(F.avg(v).alias(f"__m{i}") for i, v in enumerate(x)))
    rows = (labelled.join(F.broadcast(means), by) if by else labelled.crossJoin(means)).select(*by, "cluster", *((v - F.col(f"__m{i}")).alias(f"__x{i}") for i, v in enumerate(x)))
    x = [F.col(f"__x{i}") for i in range(len(x))]
    each = rows.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("sums"), F.sum(square(x)).alias("squares"))
    table = each.groupBy(*by).agg(F.collect_list(F.struct("cluster", "n", "sums", "squares")).alias("__all"))
    rows = rows.join(F.broadcast(table), by) if by else rows.crossJoin(table)

    def mean(c: Column) -> Column:
        """Mean squared distance to a cluster's rows, without the row itself in its own."""
        total = c["n"] * square(x) + c["squares"] - 2 * sum((v * F.get(c["sums"], F.lit(i)) for i, v in enumerate(x)), F.lit(0.0))
        return F.greatest(total, F.lit(0.0)) / (c["n"] - F.when(c["cluster"] == F.col("cluster"), 1).otherwise(0))

    own = lambda c: c["cluster"] == F.col("cluster")
    rows = rows.withColumn("__alone", F.exists("__all", lambda c: own(c) & (c["n"] == 1)))
    a = F.array_min(F.transform(F.filter("__all", lambda c: own(c) & (c["n"] > 1)), mean))
    b = F.array_min(F.transform(F.filter("__all", lambda c: ~own(c)), mean))
    rows = rows.withColumns({"__a": a, "__b": b})
    value = F.when(F.col("__b").isNotNull(), F.when(F.col("__alone"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b")), F.lit(0.0))))
    return rows.groupBy(*by).agg(F.avg(value).alias("silhouette"))


def choose_k(metrics: DataFrame, of: str = "k") -> DataFrame:
    """(elbow, by_calinski, by_davies, [by_silhouette,] k): the number of clusters, named by the column `of`, that is farthest
    from the chord of the sums of squares, those of the best scores, and the one that most of these name; of equals the first
    named. `metrics` has a row a number of clusters asked for. A row without a score, as of a fit that found one cluster, is
    not among those that the score chooses from."""
    ends = metrics.agg(F.min(of).alias("k0"), F.max(of).alias("k1"), F.min_by("wcss", of).alias("w0"), F.max_by("wcss", of).alias("w1")).withColumn("__one", F.lit(1))
    rows = metrics.withColumn("__one", F.lit(1)).join(ends, "__one")
    at = F.col(of)
    # the chord's length is the same for all
    off = F.abs((F.col("k1") - F.col("k0")) * (F.col("wcss") - F.col("w0")) - (F.col("w1") - F.col("w0")) * (at - F.col("k0")))
    scores = {"elbow": off, "by_calinski": F.col("calinski_harabasz"), "by_davies": -F.col("davies_bouldin")}
    if "silhouette" in metrics.columns:
        scores["by_silhouette"] = F.col("silhouette")
    picked = rows.agg(*[F.max_by(of, F.when(v.isNotNull(), F.struct(v, -at))).alias(n) for n, v in scores.items()])
    names = list(scores)
    votes = F.array(*names)
    count = lambda c: F.size(F.filter(votes, lambda v: v == F.col(c)))
    best = F.greatest(*[count(c) for c in names])
    return picked.withColumn("k", F.coalesce(*[F.when(count(c) == best, F.col(c)) for c in names]))


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = range(2, 11), seed: int = 42) -> DataFrame:
    """(of, n, k, wcss, calinski_harabasz, davies_bouldin, silhouette) of a fit for each number of clusters `of`, over rows
    with `scaled`; k is how many have rows. All fits are scored in one pass each of quality and silhouette."""
    labelled = None
    for k in ks:
        model = fit_kmeans(df, k, seed)
        names = [f"s{i}" for i in range(len(model.clusterCenters()[0]))]
        vector = vector_to_array("scaled")
        part = model.transform(df).select(*(F.get(vector, F.lit(i)).alias(c) for i, c in enumerate(names)), "cluster", F.lit(k).alias("of"))
        labelled = part if labelled is None else labelled.unionByName(part)
    return cluster_quality(labelled, names, ["of"]).join(silhouettes(labelled, names, ["of"]), "of")


def target_separation(labelled: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Deviation of the clusters' mean targets; 0 of one cluster."""
    means = labelled.groupBy(*by, "cluster").agg(F.avg(target).alias("__m"))
    return means.groupBy(*by).agg(F.stddev_pop("__m").alias("target_separation"))


def composite_score(metrics: DataFrame, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """Add composite: target separation times ten, silhouette and Calinski-Harabasz to 0..1, Davies-Bouldin turned round."""
    a, b, c, d = weights
    parts = a * F.col("target_separation") * 10 + b * (F.col("silhouette") + 1) / 2 + c * F.least(F.col("calinski_harabasz") / 10000, F.lit(1.0)) + d * (2 - F.col("davies_bouldin")) / 2
    return metrics.withColumn("composite", parts)


def cluster_profiles(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cluster, feature, n, mean, std, overall, log_ratio, cv, place): a row a cluster and feature with the log of its
    mean against that of all, its place in the cluster by that, and the variation of the feature's mean over clusters."""
    long = labelled.select("cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x")).select("cluster", "x.feature", "x.value")
    rows = long.groupBy("cluster", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum("value").alias("__sum"))
    over = rows.groupBy("feature").agg((F.sum("__sum") / F.sum("n")).alias("overall"), F.try_divide(F.stddev_samp("mean"), F.avg("mean")).alias("cv"))
    rows = rows.join(over, "feature").withColumn("log_ratio", F.when((F.col("mean") > 0) & (F.col("overall") > 0), F.log(F.col("mean") / F.col("overall"))))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.abs("log_ratio").desc_nulls_last(), "feature"))
    return rows.withColumn("place", place).select("cluster", "feature", "n", "mean", "std", "overall", "log_ratio", "cv", "place")


def assign_centroids(df: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]], temperature: float = 1.0, inverse: bool = False) -> DataFrame:
    """Add cluster (the nearest centroid, the first of equals), distance, and confidence: of probabilities by softmax of
    the distances over the temperature the first less the second; with `inverse` the nearest's share of 1 / (1 + distance).
    Centroids are literals of the plan: nothing is shuffled."""
    far = [F.sqrt(sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - v) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - v) for c, v in zip(features, at)), F.lit(0.0))) for at in centroids]
    rows = df.withColumn("__d", F.array(*far))
    least = F.array_min("__d")
    if inverse:
        share = F.transform("__d", lambda d: 1 / (1 + d))
    else:  # the least distance is taken off, so that no exponent is large
        share = F.transform("__d", lambda d: F.exp((least - d) / temperature))
    rows = rows.withColumns({"cluster": (F.array_position("__d", least) - 1).cast("int"), "distance": least, "__p": F.sort_array(share, asc=False), "__sum": F.aggregate(share, F.lit(0.0), lambda a, x: a + x)})
    top = F.col("__p")[0] / F.col("__sum")
    return rows.withColumn("confidence", top if inverse else top - F.col("__p")[1] / F.col("__sum")).drop("__d", "__p", "__sum")


def centroid_probabilities(df: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]], temperature: float = 1.0) -> DataFrame:
    """A row for each row and centroid: the columns of df with centroid, distance, probability (softmax of the distances over the
    temperature) and place, the nearest first. Centroids are literals: nothing is shuffled."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    far = [F.sqrt(sum(((zero(c) - v) * (zero(c) - v) for c, v in zip(features, at)), F.lit(0.0))) for at in centroids]
    rows = df.withColumn("__d", F.array(*far))
    least = F.array_min("__d")
    rows = rows.withColumn("__e", F.transform("__d", lambda d: F.exp((least - d) / temperature)))
    rows = rows.withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    each = F.transform("__d", lambda d, i: F.struct(d.alias("distance"), i.alias("centroid"), (F.get("__e", i) / F.col("__sum")).alias("probability")))
    rows = rows.select(*df.columns, F.posexplode(F.array_sort(each)).alias("place", "x"))
    return rows.select(*df.columns, "x.centroid", "x.distance", "x.probability", (F.col("place") + 1).alias("place"))


def regime_kind(volume: Column, whale: Column, profitable: Column, overall: Column) -> Column:
    """The first kind that holds, by a regime's activity against all rows' and its share of profitable rows, in points."""
    kinds = {
        "HIGH WHALE ACTIVITY": (volume > 1.5) & (whale > 1.5), "HIGH VOLUME TRADING": volume > 1.3, "LOW ACTIVITY / QUIET": volume < 0.7,
        "HIGH PROFIT POTENTIAL": profitable > overall + 5, "LOW PROFIT / RISKY": profitable < overall - 5,
    }
    return F.coalesce(*(F.when(on, F.lit(name)) for name, on in kinds.items()), F.lit("MODERATE ACTIVITY"))


def regime_summary(labelled: DataFrame, y: str, volume: Sequence[str], txns: Sequence[str], whale: Sequence[str]) -> DataFrame:
    """(cluster, n, share, profitable_pct, volume_ratio, txn_ratio, whale_ratio, regime_type): a row a cluster; ratios are the mean of
    some features' means against that of all rows. One pass; all rows' figures come from the clusters' sums."""
    groups = {"volume": volume, "txn": txns, "whale": whale}
    level = lambda names: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names), F.lit(0.0)) / len(names)
    rows = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(y).alias("__y"), *(F.sum(level(names)).alias(f"__{g}") for g, names in groups.items()))
    every = rows.agg(F.sum("n").alias("__n"), F.sum("__y").alias("__all_y"), *(F.sum(f"__{g}").alias(f"__all_{g}") for g in groups)).withColumn("__one", F.lit(1))
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one")
    ratio_of = lambda g: F.try_divide(F.col(f"__{g}") / F.col("n"), F.col(f"__all_{g}") / F.col("__n"))
    rows = rows.select("cluster", "n", (F.col("n") / F.col("__n")).alias("share"), (F.col("__y") * 100.0 / F.col("n")).alias("profitable_pct"), *(ratio_of(g).alias(f"{g}_ratio") for g in groups), (F.col("__all_y") * 100.0 / F.col("__n")).alias("__overall"))
    return rows.withColumn("regime_type", regime_kind(F.col("volume_ratio"), F.col("whale_ratio"), F.col("profitable_pct"), F.col("__overall"))).drop("__overall")


def distinctive_features(profiles: DataFrame, most: int = 10) -> DataFrame:
    """(cluster, feature, mean, overall, ratio, description, place) of the profiles' features farthest from all rows' mean, and of those
    the ones well over it (HIGH) or under (LOW)."""
    rows = profiles.where(F.col("place") <= most).withColumn("ratio", F.try_divide(F.col("mean"), F.col("overall")))
    kind = F.when(F.col("ratio") > 1.5, "HIGH").when(F.col("ratio") < 0.67, "LOW")
    return rows.withColumn("description", kind).where("description is not null").select("cluster", "feature", "mean", "overall", "ratio", "description", "place")


def hour_mix(labelled: DataFrame, us: str = "sample_us") -> DataFrame:
    """(cluster, hour, n, share, is_marked): a cluster's rows by hour of the day, and whether one has over a tenth of them."""
    rows = labelled.groupBy("cluster", (F.floor(F.col(us) / 3_600_000_000) % 24).alias("hour")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return rows.withColumns({"share": share, "is_marked": share > 0.1})


def score_traders(profiles: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]], names: dict[int, str] = SEGMENTS) -> DataFrame:
    """Traders with their segment, its confidence by inverse distances and its name."""
    rows = assign_centroids(profiles, features, centroids, inverse=True)
    name = F.coalesce(*[F.when(F.col("cluster") == k, F.lit(v)) for k, v in names.items()], F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return rows.withColumn("segment", name)


def strong_regimes(auc: DataFrame, baseline: float = 0.5, gain: float = 0.05, least: int = 100) -> DataFrame:
    """Keys whose AUC is over the baseline's by more than `gain`, of more than `least` samples."""
    rows = auc.withColumns({"n": F.col("positives") + F.col("negatives"), "auc_gain": F.col("auc") - baseline})
    return rows.where((F.col("auc_gain") > gain) & (F.col("n") > least))
