"""Anomaly detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions import temporal, titles
from driftmark.functions.numbers import round_to
from driftmark.operators import anomaly as A, baseline as B
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, txt, with_views
from driftmark.plans.statistics import (
    ORDER, STATFEAT_SQL, TREND_COLS, TREND_LIST, TREND_SQL, VELOCITY_SQL, profile, with_profile,
)
from driftmark.sources.tables import Tables


def inputs(t: Tables):
    return A.detector_inputs(t.observations(), t.products(), ORDER, t.as_of())


QUARTILES = """, sorted AS (
    SELECT product_id, price, row_number() OVER (PARTITION BY product_id ORDER BY price) - 1 AS i,
           count(*) OVER (PARTITION BY product_id) AS n_priced FROM history WHERE price > 0),
fences AS (
    SELECT product_id, max(n_priced) AS n_priced, max(price) FILTER (i = n_priced // 4) AS q1,
           max(price) FILTER (i = (3 * n_priced) // 4) AS q3 FROM sorted WHERE n_priced >= 4 GROUP BY product_id)
"""
DETECT_SQL = QUARTILES + """, recent5 AS (
    SELECT product_id, avg(CAST(price AS DOUBLE)) FILTER (price > 0) AS recent_mean FROM history WHERE hrank <= 5 GROUP BY product_id),
raw AS (
    SELECT b.*, current_price, current_original, q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, recent_mean,
           CASE WHEN n >= 3 AND std_dev > 0 THEN (current_price - mean) / std_dev END AS z,
           CASE WHEN observation_count >= 2 AND recent_mean > 0 THEN (1 - current_price / recent_mean) * 100 END AS rate
    FROM based b JOIN current_prices USING (product_id) LEFT JOIN fences USING (product_id) LEFT JOIN recent5 USING (product_id)),
det AS (
    SELECT *, coalesce(z < -2.5, false) AS z_hit, coalesce(current_price < lower_bound, false) AS iqr_hit,
           coalesce(rate >= 50, false) AS rate_hit, current_price < min_price AS min_hit,
           (1 - current_price / CAST(min_price AS DOUBLE)) * 100 AS below FROM raw),
fus AS (
    SELECT *, CAST(z_hit AS INT) + CAST(iqr_hit AS INT) + CAST(rate_hit AS INT) + CAST(min_hit AS INT) AS k,
           CASE WHEN z_hit THEN least(1.0, abs(z) / 4) ELSE 0 END + CASE WHEN iqr_hit THEN 0.7::DOUBLE ELSE 0 END
           + CASE WHEN rate_hit THEN least(1.0, rate / 100) ELSE 0 END + CASE WHEN min_hit THEN least(1.0, below / 50) ELSE 0 END AS total
    FROM det),
fused AS (
    SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN total WHEN k = 2 THEN least(1.0, total / 2 * 1.2)
                   ELSE least(1.0, least(1.0, total / k * 1.2) * 1.1) END AS score,
           concat_ws(',', CASE WHEN z_hit THEN 'z_score' END, CASE WHEN iqr_hit THEN 'iqr' END,
                     CASE WHEN rate_hit THEN 'rate_of_change' END, CASE WHEN min_hit THEN 'below_minimum' END) AS methods,
           least(1.0, 0.5 + CASE WHEN observation_count >= 20 THEN 0.2 WHEN observation_count >= 10 THEN 0.1 ELSE 0 END
             + CASE WHEN k >= 3 THEN 0.2 WHEN k >= 2 THEN 0.1 ELSE 0 END + CASE WHEN stability > 0.8 THEN 0.1 ELSE 0 END) AS conf
    FROM fus)
"""


def with_detectors(body: str, *more: str) -> str:
    return with_profile(DETECT_SQL + body, *more)


@query("e01_zscore", with_detectors(f"""
    SELECT product_id, {r('z')} AS z_score, z_hit, {r('CASE WHEN z_hit THEN least(1.0, abs(z) / 4) END')} AS z_points FROM det"""))
def zscore(t: Tables):
    d = A.zscore(B.profile_before_newest(t.observations(), ORDER, t.as_of()))
    return d.select("product_id", round_to("z_score").alias("z_score"), "z_hit", round_to("z_points").alias("z_points"))


@query("e02_iqr", with_views("history", "current_prices", body=QUARTILES + f"""
    SELECT product_id, q1, q3, {r('q1 - 1.5 * (q3 - q1)')} AS lower_bound,
           coalesce(current_price < q1 - 1.5 * (q3 - q1), false) AS iqr_hit
    FROM fences JOIN current_prices USING (product_id)"""))
def iqr(t: Tables):
    d = A.iqr(A.quartile_fences(B.profile_before_newest(t.observations(), ORDER, t.as_of())))
    return d.select("product_id", "q1", "q3", round_to("lower_bound").alias("lower_bound"), "iqr_hit")


@query("e03_rate_of_change", with_detectors(f"""
    SELECT product_id, {r('rate')} AS rate_of_change, rate_hit FROM det"""))
def rate_of_change(t: Tables):
    return A.rate_of_change(B.profile_before_newest(t.observations(), ORDER, t.as_of())).select("product_id", round_to("rate_of_change").alias("rate_of_change"), "rate_hit")


@query("e04_below_minimum", with_detectors(f"""
    SELECT product_id, min_hit, {r('CASE WHEN min_hit THEN below END')} AS below_min_percent,
           {r('CASE WHEN min_hit THEN least(1.0, below / 50) END')} AS min_points FROM det"""))
def below_minimum(t: Tables):
    d = A.below_minimum(B.profile_before_newest(t.observations(), ORDER, t.as_of()))
    return d.select("product_id", "min_hit", round_to("below_min_percent").alias("below_min_percent"), round_to("min_points").alias("min_points"))


FEATURES = ("f_ratio", "f_discount", "f_stability", "f_min_distance", "f_range")


def training(t: Tables):
    base = B.cached_baseline(profile(t))
    return A.training_features(t.observations(), base, ORDER)


@query("e05_iforest_features", with_profile(f"""
    , cached AS (SELECT *, CASE WHEN avg_7d > 0 AND stability > 0.7 THEN avg_7d WHEN avg_30d > 0 THEN avg_30d ELSE median END AS cb
                 FROM profile WHERE n > 0),
    own AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, order_id DESC, line_no DESC, supp_id DESC, ext_price DESC, qty DESC) - 1 AS hrank FROM observations)
    SELECT product_id, order_id, line_no, hrank AS newest_rank, {r('price / cb')} AS f_ratio,
           {r('coalesce((1 - price / CAST(original_price AS DOUBLE)) * 100, 0)')} AS f_discount, {r('stability')} AS f_stability,
           {r('(min_price - price) / CAST(min_price AS DOUBLE)')} AS f_min_distance,
           {r("CASE WHEN max_price > min_price THEN greatest(0.0, least(1.0, (price - min_price) / CAST(max_price - min_price AS DOUBLE))) ELSE 0.5 END")} AS f_range
    FROM own JOIN cached USING (product_id) WHERE hrank BETWEEN 1 AND 100 AND price > 0 AND observation_count >= 5"""))
def iforest_features(t: Tables):
    return training(t).select(
        "product_id", "order_id", "line_no", F.col("newest_rank").cast("long").alias("newest_rank"),
        *[round_to(c).alias(c) for c in FEATURES],
    )


@query("e10_score_fusion", with_detectors(f"""
    SELECT product_id, {r('score')} AS anomaly_score, methods, score > 0.5 OR k > 0 AS is_anomaly,
           (k >= 2 OR (k > 0 AND score >= 0.8)) AS is_significant FROM fused"""))
def score_fusion(t: Tables):
    d = A.statistical_detectors(inputs(t))
    return d.select(
        "product_id", round_to("anomaly_score").alias("anomaly_score"), F.array_join("methods", ",").alias("methods"),
        "is_anomaly", "is_significant",
    )


@query("e11_detector_confidence", with_detectors(f"SELECT product_id, CAST(k AS INT) AS n_methods, {r('conf')} AS confidence FROM fused"))
def detector_confidence(t: Tables):
    d = A.statistical_detectors(inputs(t))
    return d.select("product_id", "n_methods", round_to("confidence_score").alias("confidence"))


@query("d10_baseline_anomaly", with_detectors(f"""
    , why AS (SELECT product_id, n, concat_ws('; ',
        CASE WHEN min_hit THEN 'Below historical minimum ($' || min_price || ') by ' || {txt('below', 1)} || '%' END,
        CASE WHEN z_hit THEN 'Z-score of ' || {txt('z', 2)} || ' (threshold: -2.5)' END,
        CASE WHEN (1 - current_price / current_baseline) * 100 >= 50
             THEN {txt('(1 - current_price / current_baseline) * 100', 1)} || '% below baseline ($' || {txt('current_baseline', 2)} || ')' END) AS reasons
      FROM det)
    SELECT product_id, n >= 3 AND reasons <> '' AS is_anomaly,
           CASE WHEN n >= 3 THEN reasons ELSE 'Insufficient price history' END AS reason FROM why"""))
def baseline_anomaly(t: Tables):
    d = B.current_baseline(B.profile_before_newest(t.observations(), ORDER, t.as_of()), t.products())
    return A.baseline_anomaly(d).select("product_id", "is_anomaly", "reason")


MARKET_SQL = """, market AS (
    SELECT market_key, count(*) AS sample_size, sum(price) AS s, avg(CAST(price AS DOUBLE)) AS avg_p, stddev_samp(CAST(price AS DOUBLE)) AS std_p,
           min(price) AS lo, max(price) AS hi
    FROM history JOIN products USING (product_id), ref_time WHERE fetched_at >= as_of - INTERVAL 30 DAY GROUP BY market_key),
cmp AS (
    SELECT c.product_id, p.market_key, p.store, c.current_price, coalesce(sample_size, 0) AS sample_size,
           CASE WHEN sample_size >= 3 THEN CAST(s AS DOUBLE) / sample_size END AS market_average, std_p,
           CASE WHEN sample_size >= 3 THEN lo END AS market_min, CASE WHEN sample_size >= 3 THEN hi END AS market_max
    FROM current_prices c JOIN products p USING (product_id) LEFT JOIN market m ON m.market_key = p.market_key),
cmpz AS (
    SELECT *, (market_average - current_price) / market_average * 100 AS deviation_percent,
           CASE WHEN sample_size >= 10 THEN CASE WHEN std_p > 0 THEN (current_price - market_average) / std_p ELSE 0 END END AS market_z
    FROM cmp),
compared AS (
    SELECT *, CASE WHEN market_z IS NOT NULL THEN market_z < -3 ELSE coalesce(deviation_percent > 50, false) END AS is_anomalous,
           CASE WHEN market_z < -3 THEN least(1.0, abs(market_z) / 3)
                WHEN market_z IS NULL AND deviation_percent > 50 THEN least(1.0, deviation_percent / 100) ELSE 0 END AS market_confidence
    FROM cmpz)
"""


@query("e13_market_compare", with_views("history", "products", "current_prices", "ref_time", body=MARKET_SQL + f"""
    SELECT product_id, market_key, store, sample_size, {r('market_average')} AS market_average, market_min, market_max,
           {r('deviation_percent')} AS deviation_percent, {r('market_z')} AS market_z, is_anomalous,
           {r('market_confidence')} AS market_confidence FROM compared"""))
def market_compare(t: Tables):
    d = A.market_compare(t.observations(), t.products(), t.current_prices(), t.as_of())
    return d.select(
        "product_id", "market_key", "store", "sample_size", round_to("market_average").alias("market_average"),
        "market_min", "market_max", round_to("deviation_percent").alias("deviation_percent"),
        round_to("market_z").alias("market_z"), "is_anomalous", round_to("market_confidence").alias("market_confidence"),
    )


@query("e12_composite_score", with_detectors(MARKET_SQL + f"""
    , parts AS (SELECT f.product_id, least(1.0, (1 - f.current_price / CAST(current_original AS DOUBLE))) AS c1,
        CASE WHEN z < 0 THEN least(1.0, abs(z) / 4) ELSE 0 END AS c2, least(1.0, 1 - f.current_price / current_baseline) AS c3,
        1 - stability AS c4, CASE WHEN is_anomalous THEN market_confidence ELSE 0 END AS c5,
        CASE WHEN (1 - f.current_price / CAST(msrp AS DOUBLE)) * 100 >= 90 THEN least(1.0, 1 - f.current_price / CAST(msrp AS DOUBLE)) ELSE 0 END AS c6,
        conf, market_confidence FROM fused f JOIN compared USING (product_id)),
    totals AS (SELECT *, least(1.0, c1 * 0.25 + c2 * 0.2 + c3 * 0.15 + c4 * 0.1 + c5 * 0.15 + c6 * 0.15) AS total,
        CAST(c1 > 0.7 AS INT) + CAST(c2 > 0.7 AS INT) + CAST(c3 > 0.7 AS INT) + CAST(c4 > 0.7 AS INT) + CAST(c5 > 0.7 AS INT) + CAST(c6 > 0.7 AS INT) AS high FROM parts)
    SELECT product_id, {r('total')} AS composite_score, total >= 0.6 AS composite_hit,
        {r("least(1.0, conf * 0.5 + CASE WHEN market_confidence > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN high >= 3 THEN 0.2 WHEN high >= 2 THEN 0.1 ELSE 0 END)")} AS composite_confidence
    FROM totals"""))
def composite_score(t: Tables):
    market = A.market_compare(t.observations(), t.products(), t.current_prices(), t.as_of())
    market = market.select("product_id", "is_anomalous", "market_confidence")
    d = A.composite_score(A.statistical_detectors(inputs(t)).join(market, "product_id"))
    return d.select(
        "product_id", round_to("composite_score").alias("composite_score"), "composite_hit",
        round_to("composite_confidence").alias("composite_confidence"),
    )


@query("e14_category_average_outlier", with_views("listings", body=f"""
    , stats AS (SELECT category, avg(CAST(current_price AS DOUBLE)) AS m, stddev_samp(CAST(current_price AS DOUBLE)) AS s FROM listings GROUP BY category)
    SELECT product_id, l.category, {r('m')} AS category_mean, {r('(current_price - m) / s')} AS category_z,
           coalesce((current_price - m) / s < -3, false) AS is_outlier
    FROM listings l JOIN stats USING (category)"""))
def category_outlier(t: Tables):
    d = A.category_outlier(t.listings())
    return d.select("product_id", "category", round_to("category_mean").alias("category_mean"), round_to("category_z").alias("category_z"), "is_outlier")


SHIFT_SQL = """(ratio BETWEEN 0.09 AND 0.11 OR ratio BETWEEN 0.009 AND 0.011
    OR (length(replace(CAST(prev_price AS VARCHAR), '.', '')) > 1 AND replace(CAST(price AS VARCHAR), '.', '')
        = left(replace(CAST(prev_price AS VARCHAR), '.', ''), length(replace(CAST(prev_price AS VARCHAR), '.', '')) - 1)))"""


@query("e15_rapid_drop", with_views("observations", body=f"""
    , seq AS (SELECT *, lag(price) OVER w AS prev_price,
          count(*) OVER (PARTITION BY product_id ORDER BY fetched_at RANGE BETWEEN INTERVAL 1440 HOUR PRECEDING AND CURRENT ROW) AS in_window
        FROM observations WINDOW w AS (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty)),
    drops AS (SELECT *, (prev_price - price) / CAST(prev_price AS DOUBLE) * 100 AS drop_percent, price / CAST(prev_price AS DOUBLE) AS ratio,
          (in_window - 1) / 1440 AS vel FROM seq WHERE in_window >= 3 AND prev_price > 0),
    flagged AS (SELECT *, {SHIFT_SQL} AS is_decimal_error FROM drops WHERE drop_percent >= 50)
    SELECT product_id, order_id, line_no, fetched_at, prev_price, price, {r('drop_percent')} AS drop_percent, is_decimal_error,
       {r('vel')} AS change_velocity,
       {r("least(1.0, 0.5 + CASE WHEN drop_percent >= 90 THEN 0.3 WHEN drop_percent >= 70 THEN 0.2 ELSE 0.1 END + CASE WHEN is_decimal_error THEN 0.2 ELSE 0 END + CASE WHEN vel < 1 THEN 0.1 ELSE 0 END)")} AS drop_confidence
    FROM flagged"""))
def rapid_drop(t: Tables):
    d = A.rapid_drop(t.observations(), tuple(ORDER), hours=1440)
    return d.select(
        "product_id", "order_id", "line_no", "fetched_at", "prev_price", "price", round_to("drop_percent").alias("drop_percent"),
        "is_decimal_error", round_to("change_velocity").alias("change_velocity"), round_to("drop_confidence").alias("drop_confidence"),
    )


@query("e16_decimal_shift", with_views("history", "current_prices", body=f"""
    , q AS (SELECT product_id, price AS prev_price, current_price AS price, current_price / CAST(price AS DOUBLE) AS ratio
            FROM history JOIN current_prices USING (product_id))
    SELECT prev_price, price, count(*) AS pairs, bool_or({SHIFT_SQL}) AS is_decimal_error FROM q GROUP BY prev_price, price"""))
def decimal_shift(t: Tables):
    # prices are counted before they meet the current one, which is then taken out
    counts = t.observations().groupBy("product_id", "price").agg(F.count("*").alias("n")).join(t.current_prices(), "product_id")
    counts = counts.withColumn("n", F.col("n") - F.col("price").eqNullSafe(F.col("current_price")).cast("int")).filter("n > 0")
    pairs = counts.groupBy(F.col("price").alias("prev_price"), F.col("current_price").alias("price")).agg(F.sum("n").alias("pairs"))
    return pairs.withColumn("is_decimal_error", A.decimal_shift(F.col("prev_price"), F.col("price")))


@query("e17_heuristic_flags", with_views("listings", body=f"""
    , stats AS (SELECT category, avg(CAST(current_price AS DOUBLE)) AS m, stddev_samp(CAST(current_price AS DOUBLE)) AS s FROM listings GROUP BY category),
    l AS (SELECT *, CASE product_id % 7 WHEN 3 THEN '$' || current_price || ' CAD' WHEN 5 THEN current_price || ' pesos' ELSE '$' || current_price END AS price_text,
          lower(category) = 'clearance' AS is_clearance, (current_price - m) / s < -3 AS is_outlier, current_price / CAST(msrp AS DOUBLE) AS ratio
          FROM listings JOIN stats USING (category))
    SELECT product_id, concat_ws(',',
        CASE WHEN current_price <= 1 AND msrp >= 50 THEN 'penny_pricing' END,
        CASE WHEN regexp_matches(price_text, '\\$\\d+\\.\\d+\\s*(MXN|CAD|EUR|GBP|JPY)', 'i') OR regexp_matches(price_text, '\\d+\\.\\d+\\s*(pesos|euros|pounds|yen)', 'i')
               OR abs(ratio - 0.01) < 0.001 OR abs(ratio - 0.05) < 0.001 THEN 'currency_error' END,
        CASE WHEN NOT is_clearance AND (1 - ratio) * 100 >= 90 THEN 'msrp_deviation' END,
        CASE WHEN is_outlier THEN 'category_outlier' END) AS issues
    FROM l"""))
def heuristic_flags(t: Tables):
    d = A.category_outlier(t.listings())
    text = F.col("current_price").cast("string")
    k = F.col("product_id") % 7
    d = d.withColumns({
        "price_text": F.when(k == 3, F.concat(F.lit("$"), text, F.lit(" CAD"))).when(k == 5, F.concat(text, F.lit(" pesos"))).otherwise(F.concat(F.lit("$"), text)),
        "is_clearance": F.lower("category") == "clearance",
        "baseline_price": F.col("msrp"),
    })
    return A.heuristic_flags(d).select("product_id", F.array_join("issues", ",").alias("issues"))


@query("e18_price_change_counter", with_views("observations", body="""
    , seq AS (SELECT *, price <> lag(price) OVER (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty) AS ch FROM observations)
    SELECT product_id, order_id, line_no, supp_id, fetched_at,
        CAST(sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER w AS BIGINT) AS change_count_24h,
        max(CASE WHEN ch THEN fetched_at END) OVER w AS last_change_at
    FROM seq WINDOW w AS (PARTITION BY product_id ORDER BY fetched_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)"""))
def price_change_counter(t: Tables):
    d = A.price_changes(t.observations(), tuple(ORDER))
    return d.select("product_id", "order_id", "line_no", "supp_id", "fetched_at", "change_count_24h", "last_change_at")


FLAG_SQL = """CASE WHEN regexp_matches(lower(title), '{words}') THEN 1.0 ELSE 0.0 END::DOUBLE"""


@query("d15_feature_vector", with_views("history", "ref_time", "current_prices", "products",
    body=TREND_SQL.format(days=365) + VELOCITY_SQL.format(hours=24 * 60) + STATFEAT_SQL.format(limit=100) + f"""
    SELECT p.product_id, CASE WHEN t.product_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS has_history, coalesce(price_count, 0) AS price_count,
           {r('coalesce(trend_slope, 0)')} AS trend_slope, {r('coalesce(std_price_t / avg_price, 0)')} AS price_volatility,
           coalesce(price_changes_24h, 0) AS price_changes_24h,
           {r('coalesce((c.current_price - mean_price) / greatest(std_price, 0.01), 0)')} AS z_score, {r('coalesce(percentile, 0.5)')} AS percentile,
           CAST((dayofweek(as_of) + 6) % 7 AS INT) AS day_of_week, CAST(hour(as_of) AS INT) AS hour, CAST(month(as_of) AS INT) AS month,
           {FLAG_SQL.format(words='|'.join(titles.ELECTRONICS_WORDS))} AS is_electronics
    FROM products p JOIN current_prices c USING (product_id)
    LEFT JOIN (SELECT product_id, price_count, trend_slope, std_price AS std_price_t, avg_price FROM trend) t USING (product_id)
    LEFT JOIN velocity v USING (product_id) LEFT JOIN statfeat s USING (product_id), ref_time"""))
def feature_vector(t: Tables):
    o, as_of = t.observations(), t.as_of()
    trend = B.trend_features(o, ORDER, as_of, 365, before_newest=True).select("product_id", "price_count", "trend_slope", "price_volatility", F.lit(1.0).alias("has_history"))
    velocity = B.velocity_features(o, ORDER, as_of, 24 * 60, before_newest=True).select("product_id", "price_changes_24h")
    stats = B.statistical_features(o, ORDER).select("product_id", "z_score", "percentile")
    d = (
        t.products().join(t.current_prices(), "product_id").join(trend, "product_id", "left")
        .join(velocity, "product_id", "left").join(stats, "product_id", "left")
    )
    when = temporal.time_features(as_of)
    zero = F.lit(0)
    return d.select(
        "product_id", F.coalesce("has_history", F.lit(0.0)).alias("has_history"), F.coalesce("price_count", zero).alias("price_count"),
        round_to(F.coalesce("trend_slope", F.lit(0.0))).alias("trend_slope"),
        round_to(F.coalesce("price_volatility", F.lit(0.0))).alias("price_volatility"),
        F.coalesce("price_changes_24h", zero).alias("price_changes_24h"),
        round_to(F.coalesce("z_score", F.lit(0.0))).alias("z_score"), round_to(F.coalesce("percentile", F.lit(0.5))).alias("percentile"),
        when["day_of_week"].alias("day_of_week"), when["hour"].alias("hour"), when["month"].alias("month"),
        titles.title_flags(F.col("title"))["is_electronics"].alias("is_electronics"),
    )


@query("flagship_price_anomalies", with_detectors(f"""
    SELECT product_id, current_price, {r('current_baseline')} AS current_baseline, baseline_source, {r('z')} AS z_score,
           {r('score')} AS anomaly_score, methods, {r('conf')} AS confidence
    FROM fused WHERE k > 0 ORDER BY score DESC, product_id LIMIT 50"""))
def flagship(t: Tables):
    d = A.statistical_detectors(inputs(t)).filter("is_anomaly")
    top = d.orderBy(F.desc("anomaly_score"), "product_id").limit(50)
    return top.select(
        "product_id", "current_price", round_to("current_baseline").alias("current_baseline"), "baseline_source",
        round_to("z_score").alias("z_score"), round_to("anomaly_score").alias("anomaly_score"),
        F.array_join("methods", ",").alias("methods"), round_to("confidence_score").alias("confidence"),
    )
