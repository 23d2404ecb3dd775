"""Fits by MLlib over rows whose clusters and labels are known, and places in groups against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeframe import catalog
from tradeframe.operators import clusters, hierarchy, models, places


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id") % 3
    df = spark.range(600).select("id", (x * x * 10 + F.rand(1)).alias("a"), (x * -5 + F.rand(2)).alias("b"), F.lit(3).alias("same"), x.cast("int").alias("true"), (x == 2).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("fold"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("regime"))
    made, names = clusters.feature_matrix(df, ["id", "true", "y", "fold"])
    assert names == ["a", "b"]
    return clusters.scale(made)[0].cache()


def purity(labelled):
    table = labelled.groupBy("cluster", "true").count().groupBy("cluster").agg(F.max("count").alias("m"))
    return table.agg(F.sum("m")).first()[0] / labelled.count()


def test_clusters_are_found(rows):
    best = clusters.fit_kmeans(rows, 3).transform(rows)
    assert purity(best) == 1 and clusters.silhouette(best) > 0.9
    assert purity(clusters.bisecting_labels(rows, 3)) > 0.6
    model, aic, bic = clusters.fit_gmm(rows, 3, starts=3)
    assert purity(model.transform(rows)) > 0.6 and bic > aic and aic <= clusters.fit_gmm(rows, 3)[1]
    stable = hierarchy.cluster_stability(rows, lambda df, seed: clusters.fit_kmeans(df, 3, seed), 2).collect()
    assert len(stable) == 6 and all(r.agreement == 1 and r.n == 200 for r in stable)
    sweep = clusters.kmeans_sweep(rows, range(2, 6))
    assert clusters.choose_k(sweep, "of").first().k == 3
    found = {r.of: r for r in sweep.collect()}
    assert sorted(found) == [2, 3, 4, 5] and found[3].silhouette == pytest.approx(clusters.silhouette(best), abs=1e-9)


def test_robust_scale(rows):
    scaled, _ = clusters.scale(rows.drop("scaled"), "robust")
    assert scaled.count() == 600


def test_classifiers_votes_and_routes(rows):
    fits = {k: models.fit_classifier(rows, k, **({"maxIter": 5} if k != "forest" else {"numTrees": 5})) for k in models.KINDS}
    for model in fits.values():
        scored = models.score(rows, model)
        assert scored.where("predicted = y").count() == 600
    assert models.score_summary(scored).first().n == 600
    for soft in (True, False):
        assert models.vote(rows, list(fits.values()), soft).where("predicted = y").count() == 600
    assert {n for n, _ in models.importance(fits, ["a", "b"])} == {"a", "b"}
    assert models.cross_validate(rows, "logistic", 4, "fold", maxIter=5)[0] > 0.99
    routed = models.fit_by_regime(rows.where("regime = 'even'"), least=100, numTrees=5)
    assert list(routed) == ["even"]
    out = models.score_routed(rows, routed)
    assert out.count() == 600 and out.where("regime = 'odd' and score <> 0.5").count() == 0 and out.where("regime = 'even' and (score >= 0.5) <> (y = 1)").count() == 0
    assert models.score_routed(rows, {}).where("score = 0.5").count() == 600
    folds = models.time_folds(rows, "id", 2)
    assert [(a.count(), b.count()) for a, b in folds] == [(200, 200), (400, 200)]


def test_fits_of_the_catalogue(spark):
    kinds = catalog.QUERIES["kmeans_traders"](spark, "/root/testdata/sf0.001")
    assert kinds.select("cluster").distinct().count() == 5
    scores = catalog.QUERIES["forest_scores"](spark, "/root/testdata/sf0.001")
    assert scores.where("score < 0 or score > 1").count() == 0


def test_places_in_small_pieces(spark):
    df = spark.range(101).select(F.lit("k").alias("g"), (F.col("id") * 7 % 101 * 10_000_000_000).alias("us"), "id").union(spark.sql("select 'z', 5L, 1L"))
    rows = places.numbered(df, "g", "us", ["us", "id"])
    got = [r.us for r in rows.where("g = 'k'").orderBy("place").collect()]
    assert got == sorted(got)
    pieces = places.overlapped(rows, 3, 2, size=5)
    w = places.piece("g").rowsBetween(-3, 2)
    out = places.own(pieces.withColumns({"n": F.count("*").over(w), "s": F.sum("us").over(w)})).where("g = 'k'").orderBy("place").collect()
    assert len(out) == 101
    for i, r in enumerate(out):
        frame = got[max(i - 3, 0) : i + 3]
        assert (r.n, r.s) == (len(frame), sum(frame))


def test_quantiles_equal_numpy(spark):
    values = [5.0, 1.0, 1.0, 9.0, 2.5, None, 7.0, 7.0, 3.0, 4.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "g string, v double")
    got = {r.g: r for r in places.quantiles(df, ["g"], "v", {"q33": 0.33, "q50": 0.5, "q80": 0.8}).collect()}
    want = np.quantile([v for v in values if v is not None], [0.33, 0.5, 0.8])
    assert np.allclose([got["a"].q33, got["a"].q50, got["a"].q80], want)
    assert got["b"].q33 == got["b"].q80 == 2.0


def test_strong_regimes(spark):
    auc = spark.createDataFrame([("a", 80, 40, 0.6), ("b", 80, 40, 0.54), ("c", 50, 50, 0.9), ("d", 200, 0, None)], "k string, positives long, negatives long, auc double")
    assert [r.k for r in clusters.strong_regimes(auc).collect()] == ["a"]


def test_models_of_regimes_against_one_for_all(spark):
    """In one regime a high x is a yes, in the other a low one: one model for all can't tell."""
    df = spark.range(2000).select("id", F.rand(3).alias("x"), (F.col("id") % 2).cast("string").alias("regime"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"))
    df = df.withColumn("y", F.when(F.col("regime") == "0", F.col("x") > 0.5).otherwise(F.col("x") <= 0.5).cast("int"))
    rows, _ = clusters.feature_matrix(df, ["id", "y", "part"])
    found = {(r.regime, r.model): r for r in models.compare_by_regime(rows, least=100, params={"forest": {"numTrees": 5}}).collect()}
    assert set(found) == {(k, m) for k in ("0", "1") for m in ("forest", "logistic")}
    for key in ("0", "1"):
        assert found[key, "logistic"].auc > 0.99 and found[key, "forest"].gain > 0.3 and found[key, "forest"].baseline_auc < 0.6
        assert sum(found[key, m].is_best for m in ("forest", "logistic")) == 1 and found[key, "forest"].n == 200
    assert models.compare_by_regime(rows, least=5000).count() == 0


def test_importance_by_category():
    ranked = [("volume_30s", 0.4), ("traders_30s", 0.3), ("volume_60s", 0.2), ("odd", 0.1)]
    got = models.category_importance(ranked, {"volume": ["volume"], "trader": ["trader", "volume"]})
    assert [(c, n) for c, n, *_ in got] == [("volume", 2), ("trader", 1), ("other", 1)] and got[0][2:] == (pytest.approx(0.6), pytest.approx(0.3))
