"""Learned detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.numbers import round_to
from driftmark.operators import anomaly as A, baseline as B, learning as L
from driftmark.plans.detectors import inputs, training
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, with_views
from driftmark.plans.statistics import ORDER, profile_now, with_profile
from driftmark.sources.tables import Tables

KEY = ["product_id", "order_id", "line_no", "supp_id", "ext_price", "qty"]


def feature_rows(t: Tables):
    return training(t).select(*KEY, *L.FEATURES)


@query("e06_iforest_train")
def iforest_train(t: Tables):
    nodes = L.forest_table(feature_rows(t), KEY)
    return nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"), F.max(F.when(F.col("node") == 0, F.col("rows"))).alias("rows"))


@query("e06_iforest_structure", with_profile("""
    , rows_ AS (SELECT count(*) AS n FROM history JOIN profile USING (product_id) WHERE hrank <= 100 AND price > 0 AND observation_count >= 5 AND n > 0)
    SELECT CAST(tree AS INT) AS tree, CAST(least(256, n) AS INT) AS rows, true AS leaves_fit, true AS rows_add_up FROM rows_, generate_series(0, 99) AS g(tree) WHERE n > 0"""))
def iforest_structure(t: Tables):
    """Every tree: its sample, leaves against splits, rows of children against those of their parent."""
    return L.tree_checks(L.forest_table(feature_rows(t), KEY))


def current_features(t: Tables):
    return A.price_features(B.current_baseline(profile_now(t), t.products()), "current_price", "current_original", False)


def isolated(t: Tables):
    """Isolation scores of current prices; none where too few rows are there to learn from."""
    model, d = L.fit_forest(feature_rows(t), KEY), current_features(t)
    if model is None:
        return d.select("product_id", F.lit(None).cast("double").alias("isolation_score"), F.lit(None).cast("boolean").alias("isolation_hit"))
    return model.score(d).select("product_id", "isolation_score", "isolation_hit")


@query("e07_iforest_recomputed", with_profile("SELECT product_id, true AS path_right, true AS score_right, true AS hit_right FROM profile WHERE n > 0"))
def iforest_recomputed(t: Tables):
    """Scores of the forest against the same trees walked in expressions."""
    model, d = L.fit_forest(feature_rows(t), KEY), current_features(t)
    again = L.isolation_by_expression(model.score(d), model.nodes)
    raw = F.col("isolation_again") - model.cut
    right = F.abs(F.col("isolation") - F.col("isolation_again")) < 1e-9
    score = F.abs(F.col("isolation_score") - F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + 0.5))) < 1e-9
    return again.select("product_id", right.alias("path_right"), score.alias("score_right"), (F.col("isolation_hit") == (F.col("isolation") > model.cut)).alias("hit_right"))


@query("e07_iforest_score")
def iforest_score(t: Tables):
    return isolated(t).withColumn("isolation_score", round_to("isolation_score"))


@query("e10_learned_fusion")
def learned_fusion(t: Tables):
    """All methods, statistical and learned, with the vote of the learned ones."""
    methods = A.METHODS + A.LEARNED_METHODS
    d = A.statistical_detectors(inputs(t), L.learned_scores(t.observations(), ORDER, isolated(t)))
    return d.select("product_id", *[c for hit, score, _ in methods for c in (hit, score)], "n_methods", "methods", "anomaly_score", "is_anomaly", "is_significant")


@query("e08_gmm_score")
def gmm_score(t: Tables):
    d = L.mixture_detector(t.observations(), ORDER)
    return d.select("product_id", *[round_to(c).alias(c) for c in ("log_prob", "threshold", "score")], "is_anomaly")


@query("e08_gmm_recomputed", with_views("history", body="""
    , l AS (SELECT product_id, count(*) AS n FROM history WHERE hrank <= 50 GROUP BY product_id)
    SELECT product_id, n AS prices, least(3, n // 5) AS components, true AS weights_right, true AS density_right, true AS threshold_right FROM l WHERE n >= 10"""))
def gmm_recomputed(t: Tables):
    """Densities and thresholds of the mixtures, recomputed from their parameters in expressions."""
    d = L.fitted_mixtures(t.observations(), ORDER)
    mixture, n = F.col("mixture"), F.size("prices")
    place = (n - 1) * 0.1
    d = d.withColumn("past", F.sort_array(F.transform("prices", lambda p: L.mixture_log_density(p, mixture))))
    low = F.get("past", F.floor(place).cast("int"))
    cut = low + (F.get("past", F.ceil(place).cast("int")) - low) * (place - F.floor(place))
    now = L.mixture_log_density(F.col("current_price").cast("double"), mixture)

    def near(a, b):
        return F.abs(a - b) <= 1e-6 * (1 + F.abs(b))

    weights = F.aggregate(mixture["weights"], F.lit(0.0), lambda a, w: a + w)
    return d.select(
        "product_id", n.cast("long").alias("prices"), F.size(mixture["weights"]).cast("long").alias("components"), near(weights, F.lit(1.0)).alias("weights_right"),
        near(mixture["log_prob"], now).alias("density_right"), near(mixture["threshold"], cut).alias("threshold_right"),
    )


@query("e09_reconstruction_score", with_views("history", "current_prices", body=f"""
    , h AS (SELECT *, count(*) OVER w AS n, avg(CAST(price AS DOUBLE)) OVER w AS mu, stddev_pop(CAST(price AS DOUBLE)) OVER w AS sd FROM history WHERE hrank <= 100 WINDOW w AS (PARTITION BY product_id)),
    f AS (SELECT h.product_id, h.hrank, n, mu, sd, (h.price - mu) / greatest(sd, 0.01) AS z, (SELECT count(*) FROM h g WHERE g.product_id = h.product_id AND g.price <= h.price) / n AS q, (h.price - mu) / greatest(mu, 0.01) AS d FROM h WHERE hrank <= 30),
    m AS (SELECT product_id, avg(z) AS mz, avg(q) AS mq, avg(d) AS md FROM f GROUP BY product_id HAVING count(*) >= 10),
    t AS (SELECT product_id, quantile_cont((power(z - mz, 2) + power(q - mq, 2) + power(d - md, 2)) / 28, 0.9) AS threshold FROM f JOIN m USING (product_id) GROUP BY product_id),
    c AS (SELECT c.product_id, max((current_price - mu) / greatest(sd, 0.01)) AS z, count(*) FILTER (price <= current_price) / count(*) AS q, max((current_price - mu) / greatest(mu, 0.01)) AS d FROM current_prices c JOIN h USING (product_id) GROUP BY c.product_id),
    e AS (SELECT product_id, (power(z - mz, 2) + power(q - mq, 2) + power(d - md, 2)) / 28 AS err, threshold FROM c JOIN m USING (product_id) JOIN t USING (product_id))
    SELECT product_id, {r('err', 6)} AS reconstruction_error, {r('threshold', 6)} AS threshold, err > threshold AS is_anomaly, {r('CASE WHEN threshold > 0 THEN least(1.0, err / threshold) ELSE 0.5 END')} AS score FROM e"""))
def reconstruction_score(t: Tables):
    d = L.reconstruction_detector(t.observations(), ORDER)
    return d.select("product_id", round_to("reconstruction_error", 6).alias("reconstruction_error"), round_to("threshold", 6).alias("threshold"), "is_anomaly", round_to("score").alias("score"))
