"""Queries of clusters and classifiers. Those with fixed centroids have SQL; fits have none and are tested by what they must reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.operators import clusters, hierarchy, models, trades
from tradeframe.sources.tables import TRADES_SQL
from tradeframe.sources.tables import trades as trades_of

FEATURES = ("x1", "x2", "x3")
#: Of ln(1 + trades), ln(1 + base spent), ln(1 + base received); the first k are taken for k clusters.
CENTROIDS = ((4.1, 7.2, 7.0), (4.3, 7.6, 7.4), (4.2, 7.6, 7.0), (4.25, 7.2, 7.4), (4.2, 7.4, 7.2))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.trader_volume(trades.normalise_trades(trades_of(spark, sf_dir)))
    ln = lambda c: F.round(F.log1p(F.col(c).cast("double")), 9)
    return rows.select("swapper", ln("trades").alias("x1"), ln("sol_spent").alias("x2"), ln("sol_received").alias("x3"), (F.col("net_sol") > 0).cast("int").alias("y"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traders with labels for each k."""
    base, out = points(spark, sf_dir), None
    for k in range(2, len(CENTROIDS) + 1):
        part = clusters.assign_centroids(base, FEATURES, CENTROIDS[:k]).withColumn("of", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.assign_centroids(points(spark, sf_dir), FEATURES, CENTROIDS)


def square(a: str, b: str) -> str:
    return " + ".join(f"({a}{c} - {b}{c}) ** 2" for c in FEATURES)


POINTS = """, pts AS (SELECT swapper, round(ln(1 + count(*)), 9) AS x1, round(ln(1 + coalesce(sum(CASE WHEN swap_from_mint = 'SOL' THEN swap_from_amount END), 0)), 9) AS x2,
    round(ln(1 + coalesce(sum(CASE WHEN swap_to_mint = 'SOL' THEN swap_to_amount END), 0)), 9) AS x3,
    CAST(coalesce(sum(CASE WHEN swap_to_mint = 'SOL' THEN swap_to_amount END), 0) - coalesce(sum(CASE WHEN swap_from_mint = 'SOL' THEN swap_from_amount END), 0) > 0 AS INTEGER) AS y FROM norm GROUP BY swapper)
"""
CENTRES = ", cts(cluster, a1, a2, a3) AS (VALUES " + ", ".join(str((i, *c)) for i, c in enumerate(CENTROIDS)) + ")\n"
LABELLED = POINTS + CENTRES + f""", dist AS (SELECT p.*, k AS of, cluster, sqrt((x1 - a1) ** 2 + (x2 - a2) ** 2 + (x3 - a3) ** 2) AS d FROM pts p, cts, (SELECT unnest(range(2, {len(CENTROIDS) + 1})) AS k) WHERE cluster < k)
, lab AS (SELECT swapper, of, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3, any_value(y) AS y, CAST(arg_min(cluster, (d, cluster)) AS INTEGER) AS cluster, min(d) AS distance, list_reverse_sort(list(d)) AS ds FROM dist GROUP BY swapper, of)
"""
QUALITY = LABELLED + f""", c AS (SELECT of, cluster, count(*) AS n, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM lab GROUP BY of, cluster)
, g AS (SELECT of, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM lab GROUP BY of)
, w AS (SELECT of, cluster, sum({square("l.", "c.")}) AS within, avg(sqrt({square("l.", "c.")})) AS s FROM lab l JOIN c USING (of, cluster) GROUP BY of, cluster)
, r AS (SELECT a.of, a.cluster, max((wa.s + wb.s) / sqrt({square("a.", "b.")})) AS r FROM c a JOIN c b ON a.of = b.of AND a.cluster <> b.cluster JOIN w wa ON wa.of = a.of AND wa.cluster = a.cluster JOIN w wb ON wb.of = b.of AND wb.cluster = b.cluster GROUP BY a.of, a.cluster)
, q0 AS (SELECT c.of, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(within) AS wcss, sum(n * ({square("c.", "g.")})) AS between FROM c JOIN g USING (of) JOIN w USING (of, cluster) GROUP BY c.of)
, q AS (SELECT of, n, k, wcss, CASE WHEN k > 1 THEN (between / (k - 1)) / (wcss / (n - k)) END AS calinski_harabasz, db AS davies_bouldin FROM q0 LEFT JOIN (SELECT of, avg(r) AS db FROM r GROUP BY of) USING (of))
"""


def register(add, r, by_scored, queries) -> None:
    add("assign_centroids", lambda spark, d: labelled(spark, d).select("swapper", "of", "cluster", "distance", "confidence"), TRADES_SQL + LABELLED + f"""SELECT swapper, CAST(of AS INTEGER) AS of, cluster, {r("distance", "distance")},
  {r("(1 - exp(ds[len(ds)] - ds[len(ds) - 1])) / list_sum([exp(ds[len(ds)] - x) FOR x IN ds])", "confidence")} FROM lab""")  # fmt: skip
    name = " ".join(f"WHEN {k} THEN '{v}'" for k, v in clusters.SEGMENTS.items())
    add("score_traders", lambda spark, d: clusters.score_traders(points(spark, d), FEATURES, CENTROIDS).select("swapper", "cluster", "confidence", "segment"),
        TRADES_SQL + LABELLED + f"SELECT swapper, cluster, {r('1 / (1 + distance) / list_sum([1 / (1 + x) FOR x IN ds])', 'confidence')}, CASE cluster {name} END AS segment FROM lab WHERE of = {len(CENTROIDS)}")
    doubles = ", ".join(r(c, c) for c in ("wcss", "calinski_harabasz", "davies_bouldin"))
    quality = lambda spark, d: clusters.cluster_quality(labelled(spark, d), FEATURES, ["of"])
    add("cluster_quality", quality, TRADES_SQL + QUALITY + f"SELECT CAST(of AS INTEGER) AS of, n, k, {doubles} FROM q")
    silhouette = lambda spark, d: clusters.silhouettes(labelled(spark, d), FEATURES, ["of"])
    measured = lambda spark, d: quality(spark, d).join(silhouette(spark, d), "of")
    # all rows against all, as the definition has it
    SILHOUETTE = QUALITY + f""", apart AS (SELECT a.of, a.swapper, a.cluster, b.cluster AS other, sum({square("a.", "b.")}) AS d, count(*) FILTER (b.swapper <> a.swapper) AS m FROM lab a JOIN lab b USING (of) GROUP BY ALL)
, near AS (SELECT of, swapper, min(d / nullif(m, 0)) FILTER (other = cluster) AS a, min(d / m) FILTER (other <> cluster) AS b FROM apart GROUP BY ALL)
, sil AS (SELECT of, avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0e0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0e0) END) AS silhouette FROM near GROUP BY of)
"""
    add("silhouettes", silhouette, TRADES_SQL + SILHOUETTE + f"SELECT CAST(of AS INTEGER) AS of, {r('silhouette', 'silhouette')} FROM sil")
    best = lambda c: f"CAST(arg_max(of, ({c}, -of)) FILTER ({c} IS NOT NULL) AS INTEGER)"
    add("choose_k", lambda spark, d: clusters.choose_k(measured(spark, d), "of"), TRADES_SQL + SILHOUETTE + f""", e AS (SELECT min(of) AS k0, max(of) AS k1, arg_min(wcss, of) AS w0, arg_max(wcss, of) AS w1 FROM q)
, s AS (SELECT *, abs((k1 - k0) * (wcss - w0) - (w1 - w0) * (of - k0)) AS off, -davies_bouldin AS davies FROM q JOIN sil USING (of), e)
, v AS (SELECT {best("off")} AS elbow, {best("calinski_harabasz")} AS by_calinski, {best("davies")} AS by_davies, {best("silhouette")} AS by_silhouette FROM s)
, votes AS (SELECT u.i, u.k, count(*) OVER (PARTITION BY u.k) AS n FROM (SELECT unnest([{{'i': 1, 'k': elbow}}, {{'i': 2, 'k': by_calinski}}, {{'i': 3, 'k': by_davies}}, {{'i': 4, 'k': by_silhouette}}]) AS u FROM v) WHERE u.k IS NOT NULL)
SELECT v.*, (SELECT arg_max(k, (n, -i)) FROM votes) AS k FROM v""")  # fmt: skip

    def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
        metrics = measured(spark, sf_dir).join(clusters.target_separation(labelled(spark, sf_dir), "y", ["of"]), "of")
        return clusters.composite_score(metrics).select("of", "target_separation", "composite")

    add("composite_score", composite, TRADES_SQL + SILHOUETTE + f""", t AS (SELECT of, stddev_pop(m) AS target_separation FROM (SELECT of, cluster, avg(y) AS m FROM lab GROUP BY of, cluster) GROUP BY of)
SELECT CAST(of AS INTEGER) AS of, {r("target_separation", "target_separation")}, {r("0.4e0 * target_separation * 10 + 0.15e0 * (silhouette + 1) + 0.2e0 * least(calinski_harabasz / 10000, 1) + 0.1e0 * (2 - davies_bouldin) / 2", "composite")} FROM q JOIN t USING (of) JOIN sil USING (of)""")  # fmt: skip
    add("cluster_profiles", lambda spark, d: clusters.cluster_profiles(five(spark, d), FEATURES), TRADES_SQL + LABELLED + f""", u AS (UNPIVOT (SELECT cluster, x1, x2, x3 FROM lab WHERE of = {len(CENTROIDS)}) ON x1, x2, x3 INTO NAME feature VALUE value)
, p AS (SELECT cluster, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, sum(value) AS s FROM u GROUP BY cluster, feature)
, o AS (SELECT feature, sum(s) / sum(n) AS overall, stddev_samp(mean) / nullif(avg(mean), 0) AS cv FROM p GROUP BY feature)
, z AS (SELECT *, CASE WHEN mean > 0 AND overall > 0 THEN ln(mean / overall) END AS log_ratio FROM p JOIN o USING (feature))
SELECT cluster, feature, n, {", ".join(r(c, c) for c in ("mean", "std", "overall", "log_ratio", "cv"))}, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(log_ratio) DESC NULLS LAST, feature) AS INTEGER) AS place FROM z""")  # fmt: skip
    add("centroid_probabilities", lambda spark, d: clusters.centroid_probabilities(points(spark, d).select("swapper", *FEATURES), FEATURES, CENTROIDS, 0.5).select("swapper", "centroid", "distance", "probability", "place"), TRADES_SQL + LABELLED + f""", five AS (SELECT swapper, cluster, d, exp((min(d) OVER w - d) / 0.5) AS e FROM dist WHERE of = {len(CENTROIDS)} WINDOW w AS (PARTITION BY swapper))
SELECT swapper, CAST(cluster AS INTEGER) AS centroid, {r("d", "distance")}, {r("e / sum(e) OVER (PARTITION BY swapper)", "probability")}, CAST(row_number() OVER (PARTITION BY swapper ORDER BY d, cluster) AS INTEGER) AS place FROM five""")  # fmt: skip
    add("distinctive_features", lambda spark, d: clusters.distinctive_features(clusters.cluster_profiles(five(spark, d).withColumns({"x4": F.col("x1") * F.col("y"), "x5": F.exp(F.col("x2"))}), ["x1", "x4", "x5"])), TRADES_SQL + LABELLED + f""", u AS (UNPIVOT (SELECT cluster, x1, x1 * y AS x4, exp(x2) AS x5 FROM lab WHERE of = {len(CENTROIDS)}) ON x1, x4, x5 INTO NAME feature VALUE value)
, p AS (SELECT cluster, feature, avg(value) AS mean FROM u GROUP BY ALL), o AS (SELECT feature, avg(value) AS overall FROM u GROUP BY feature)
, z AS (SELECT *, mean / nullif(overall, 0) AS ratio, row_number() OVER (PARTITION BY cluster ORDER BY abs(CASE WHEN mean > 0 AND overall > 0 THEN ln(mean / overall) END) DESC NULLS LAST, feature) AS place FROM p JOIN o USING (feature))
SELECT cluster, feature, {r("mean", "mean")}, {r("overall", "overall")}, {r("ratio", "ratio")}, CASE WHEN ratio > 1.5 THEN 'HIGH' ELSE 'LOW' END AS description, CAST(place AS INTEGER) AS place FROM z WHERE place <= 10 AND (ratio > 1.5 OR ratio < 0.67)""")  # fmt: skip
    add("constant_columns", lambda spark, d: clusters.constant_columns(points(spark, d).withColumn("same", F.lit(1)), [*FEATURES, "same"]), TRADES_SQL + POINTS + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(stddev_pop({c}), 0) = 0 AS constant FROM {t}" for c, t in [*((c, "pts") for c in FEATURES), ("same", "(SELECT 1 AS same FROM pts)")]))
    add("anova_f", lambda spark, d: models.anova_select(points(spark, d), FEATURES), TRADES_SQL + POINTS + f""", u AS (UNPIVOT (SELECT y, x1, x2, x3 FROM pts) ON x1, x2, x3 INTO NAME feature VALUE x)
, gr AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY feature, y)
, wh AS (SELECT feature, sum(n) AS nn, count(*) AS g, sum(n * m) / sum(n) AS mm, sum(n * v) AS within FROM gr GROUP BY feature)
, f AS (SELECT feature, CASE WHEN any_value(g) > 1 THEN (sum(n * (m - mm) ** 2) / (any_value(g) - 1)) / (any_value(within) / (any_value(nn) - any_value(g))) END AS f FROM gr JOIN wh USING (feature) GROUP BY feature)
SELECT feature, {r("f", "f")}, CAST(row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS INTEGER) AS place FROM f""")  # fmt: skip
    part = "CAST('0x' || substr(md5(coin_id), 1, 8) AS BIGINT) % 1000"
    by_scored("split_by_coin", lambda s: models.split_by_coin(s).groupBy("coin_id", "part").agg(F.count("*").alias("n")), f"SELECT coin_id, CASE WHEN {part} < 150 THEN 'validation' WHEN {part} < 320 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM scored GROUP BY ALL")
    by_scored("binary_metrics", models.binary_metrics, f""", s AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM scored GROUP BY score)
, c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM s WINDOW w AS (ORDER BY score DESC))
, t AS (SELECT CAST(coalesce(sum(p) FILTER (score >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(q) FILTER (score >= 0.5), 0) AS BIGINT) AS fp, CAST(coalesce(sum(p) FILTER (score < 0.5), 0) AS BIGINT) AS fn, CAST(coalesce(sum(q) FILTER (score < 0.5), 0) AS BIGINT) AS tn,
  sum(p * (qq - fp + q / 2)) / nullif(max(pp) * max(qq), 0) AS auc, sum(p * tp / (tp + fp)) / nullif(max(pp), 0) AS ap FROM c)
SELECT tp, fp, fn, tn, {r("auc", "auc")}, {r("ap", "average_precision")}, {r("(tp + tn) / nullif(tp + tn + fp + fn, 0)", "accuracy")}, {r("tp / nullif(tp + fp, 0)", "precision")}, {r("tp / nullif(tp + fn, 0)", "recall")}, {r("2 * tp / nullif(2 * tp + fp + fn, 0)", "f1")} FROM t""")  # fmt: skip

    def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, names = clusters.feature_matrix(points(spark, sf_dir), ["swapper", "y"])
        scaled, _ = clusters.scale(rows)
        return clusters.fit_kmeans(scaled, 5).transform(scaled).select("swapper", "cluster")

    def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = clusters.feature_matrix(points(spark, sf_dir), ["swapper", "y"])
        rows = models.split_by_coin(rows, "swapper")
        model = models.fit_classifier(rows.where("part = 'train'"), "forest", numTrees=10)
        return models.score(rows, model).select("swapper", "part", "y", "score", "predicted", "confidence", "is_sure")

    def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clusters.scale(clusters.feature_matrix(points(spark, sf_dir), ["swapper", "y"])[0])[0]

    queries["kmeans_traders"], queries["forest_scores"] = kmeans, forest
    queries["trader_k_sweep"] = lambda spark, d: clusters.kmeans_sweep(scaled(spark, d), range(2, 11))
    third = lambda s: s.withColumn("cluster", F.floor(F.col("score") * 3).cast("int"))
    by_scored("regime_summary", lambda s: clusters.regime_summary(third(s), "y", ["forward_buy", "forward_sell"], ["forward_sell"], ["forward_buy"]), f""", c AS (SELECT *, CAST(floor(score * 3) AS INTEGER) AS cluster FROM scored)
, o AS (SELECT avg(y) * 100 AS p, avg((forward_buy + forward_sell) / 2) AS v, avg(forward_sell) AS t, avg(forward_buy) AS w, count(*) AS n FROM c)
, g AS (SELECT cluster, count(*) AS n, count(*) * 1e0 / any_value(o.n) AS share, avg(y) * 100 AS p, avg((forward_buy + forward_sell) / 2) / any_value(v) AS v, avg(forward_sell) / any_value(t) AS t, avg(forward_buy) / any_value(w) AS w, any_value(o.p) AS overall FROM c, o GROUP BY cluster)
SELECT cluster, n, {r("share", "share")}, {r("p", "profitable_pct")}, {r("v", "volume_ratio")}, {r("t", "txn_ratio")}, {r("w", "whale_ratio")},
  CASE WHEN v > 1.5 AND w > 1.5 THEN 'HIGH WHALE ACTIVITY' WHEN v > 1.3 THEN 'HIGH VOLUME TRADING' WHEN v < 0.7 THEN 'LOW ACTIVITY / QUIET' WHEN p > overall + 5 THEN 'HIGH PROFIT POTENTIAL' WHEN p < overall - 5 THEN 'LOW PROFIT / RISKY' ELSE 'MODERATE ACTIVITY' END AS regime_type FROM g""")  # fmt: skip
    by_scored("hour_mix", lambda s: clusters.hour_mix(third(s)), f""", c AS (SELECT CAST(floor(score * 3) AS INTEGER) AS cluster, sample_us // 3600000000 % 24 AS hour, count(*) AS n FROM scored GROUP BY ALL), h AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY cluster) AS s FROM c)
SELECT cluster, hour, n, {r("s", "share")}, s > 0.1 AS is_marked FROM h""")  # fmt: skip
    by_scored("metrics_by_coin", lambda s: models.metrics_by(s, ["coin_id"]), f""", k AS (SELECT *, rank() OVER (PARTITION BY coin_id ORDER BY score) + (count(*) OVER (PARTITION BY coin_id, score) - 1) / 2e0 AS place FROM scored)
, m AS (SELECT coin_id, count(*) AS n, sum(y) AS p, sum(1 - y) AS q, sum(CASE WHEN y = 1 THEN place ELSE 0e0 END) AS s, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM k GROUP BY coin_id)
SELECT coin_id, n, {r("(s - p * (p + 1) / 2e0) / nullif(p * q, 0)", "auc")}, {r("(tp + tn) * 1e0 / n", "accuracy")}, {r("2e0 * tp / nullif(2 * tp + fp + fn, 0)", "f1")} FROM m""")  # fmt: skip

    def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = clusters.feature_matrix(points(spark, sf_dir).withColumn("regime", (F.col("x1") > 4.2).cast("string")), ["swapper", "y"])
        return models.compare_by_regime(models.split_by_coin(rows, "swapper"), least=20, params={"forest": {"numTrees": 10}})

    queries["models_by_regime"] = regimes
    queries["hierarchical_traders"] = lambda spark, d: hierarchy.hierarchical_labels(scaled(spark, d), 4, cells=256).select("swapper", "cluster")
    queries["trader_cluster_stability"] = lambda spark, d: hierarchy.cluster_stability(scaled(spark, d), lambda df, seed: clusters.fit_kmeans(df, 4, seed), 3)
