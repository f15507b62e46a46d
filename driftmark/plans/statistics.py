"""Baseline and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.numbers import round_to
from driftmark.operators import baseline as B
from driftmark import params
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, with_views
from driftmark.sources.tables import Tables

ORDER = Tables.NEWEST


def profile_now(t: Tables):
    """Each product's profile before its newest observation, and that one as ``current_…``."""
    return B.profile_before_newest(t.observations(), ORDER, t.as_of())


def profile(t: Tables):
    return profile_now(t).drop(*B.CURRENT.values(), "recent_mean")


PROFILE_SQL = """, prof AS MATERIALIZED (
    SELECT product_id, count(*) AS observation_count, count(*) FILTER (price > 0) AS n,
           CAST(sum(price) FILTER (price > 0) AS DOUBLE) / nullif(count(*) FILTER (price > 0), 0) AS mean,
           coalesce(stddev_samp(CAST(price AS DOUBLE)) FILTER (price > 0), 0) AS std_dev,
           median(CAST(price AS DOUBLE)) FILTER (price > 0) AS median,
           min(price) FILTER (price > 0) AS min_price, max(price) FILTER (price > 0) AS max_price,
           avg(CAST(price AS DOUBLE)) FILTER (price > 0 AND fetched_at >= as_of - INTERVAL 7 DAY) AS avg_7d,
           avg(CAST(price AS DOUBLE)) FILTER (price > 0 AND fetched_at >= as_of - INTERVAL 30 DAY) AS avg_30d,
           median(CAST(price AS DOUBLE)) FILTER (price > 0 AND fetched_at >= as_of - INTERVAL 30 DAY) AS median_30d,
           median(CAST(price AS DOUBLE)) FILTER (price > 0 AND fetched_at >= as_of - INTERVAL 90 DAY) AS median_90d,
           max(fetched_at) AS last_at, max(price) FILTER (hrank = 1) AS last_price
    FROM history, ref_time GROUP BY product_id),
profile AS (
    SELECT *, std_dev / mean AS cv, greatest(0.0, least(1.0, 1.0 - std_dev / mean)) AS stability FROM prof),
based AS (
    SELECT p.*, msrp,
           CASE WHEN median_90d > 0 THEN median_90d WHEN median_30d > 0 THEN median_30d
                WHEN msrp > 0 THEN CAST(msrp AS DOUBLE) ELSE median END AS current_baseline,
           CASE WHEN median_90d > 0 THEN '90d_median' WHEN median_30d > 0 THEN '30d_median'
                WHEN msrp > 0 THEN 'msrp' ELSE 'median_all' END AS baseline_source
    FROM profile p LEFT JOIN products USING (product_id) WHERE n > 0)
"""


def with_profile(body: str, *more: str) -> str:
    return with_views("history", "ref_time", "products", "current_prices", *more, body=PROFILE_SQL + body)


@query("a01_history_scan", with_views("observations", "ref_time", body="""
    , q AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, order_id DESC,
        line_no DESC, supp_id DESC, ext_price DESC, qty DESC) AS newest_rank
      FROM observations, ref_time WHERE fetched_at >= as_of - INTERVAL 365 DAY)
    SELECT product_id, price, fetched_at, order_id, line_no, newest_rank FROM q WHERE newest_rank <= 5"""))
def history_scan(t: Tables):
    d = B.history_scan(t.observations(), ORDER, t.as_of(), days=365, limit=5)
    return d.select("product_id", "price", "fetched_at", "order_id", "line_no", F.col("newest_rank").cast("long").alias("newest_rank"))


@query("d01_price_statistics", with_profile(f"""
    SELECT product_id, n, {r('mean')} AS mean, {r('median')} AS median, {r('std_dev')} AS std_dev, min_price, max_price,
           max_price - min_price AS price_range, {r('cv', 6)} AS cv, cv < 0.15 AS is_stable
    FROM profile WHERE n >= 3"""))
def price_statistics(t: Tables):
    d = B.price_statistics(profile(t))
    return d.select(
        "product_id", "n", round_to("mean").alias("mean"), round_to("median").alias("median"),
        round_to("std_dev").alias("std_dev"), "min_price", "max_price",
        F.col("price_range").cast("decimal(11,2)").alias("price_range"), round_to("cv", 6).alias("cv"), "is_stable",
    )


@query("d02_windowed_baseline_inputs", with_profile(f"""
    SELECT product_id, observation_count, {r('avg_7d')} AS avg_7d, {r('avg_30d')} AS avg_30d,
           {r('median_30d')} AS median_30d, {r('median_90d')} AS median_90d FROM profile"""))
def windowed_inputs(t: Tables):
    cols = ("avg_7d", "avg_30d", "median_30d", "median_90d")
    return profile(t).select("product_id", "observation_count", *[round_to(c).alias(c) for c in cols])


@query("d03_price_stability", with_profile(f"SELECT product_id, {r('stability', 6)} AS stability FROM profile"))
def price_stability(t: Tables):
    return profile(t).select("product_id", round_to("stability", 6).alias("stability"))


@query("d04_current_baseline", with_profile(
    f"SELECT product_id, {r('current_baseline')} AS current_baseline, baseline_source FROM based"))
def current_baseline(t: Tables):
    d = B.current_baseline(profile(t), t.products())
    return d.select("product_id", round_to("current_baseline").alias("current_baseline"), "baseline_source")


CACHE_SQL = f"""
    SELECT product_id, {r('avg_7d')} AS avg_7d, {r('avg_30d')} AS avg_30d, min_price, max_price,
           {r("CASE WHEN avg_7d > 0 AND stability > 0.7 THEN avg_7d WHEN avg_30d > 0 THEN avg_30d ELSE median END")} AS current_baseline,
           {r('stability', 6)} AS stability, {r('CASE WHEN std_dev > 0 THEN std_dev END')} AS std_deviation,
           observation_count, last_price, last_at AS last_price_at
    FROM profile WHERE n > 0"""


def cache_rows(t: Tables):
    d = B.cached_baseline(profile(t)).withColumnRenamed("last_at", "last_price_at")
    return d.select(
        "product_id", round_to("avg_7d").alias("avg_7d"), round_to("avg_30d").alias("avg_30d"), "min_price", "max_price",
        round_to("current_baseline").alias("current_baseline"), round_to("stability", 6).alias("stability"),
        round_to(F.when(F.col("std_dev") > 0, F.col("std_dev"))).alias("std_deviation"),
        "observation_count", "last_price", "last_price_at",
    )


@query("d05_baseline_cache", with_profile(CACHE_SQL))
def baseline_cache(t: Tables):
    return cache_rows(t)


@query("d06_baseline_refresh", with_profile(f"""
    SELECT p.product_id, sku, store, {r('coalesce(current_baseline, CAST(p.msrp AS DOUBLE))')} AS baseline_price
    FROM products p LEFT JOIN based b ON b.product_id = p.product_id"""))
def baseline_refresh(t: Tables):
    new = B.current_baseline(profile(t), t.products()).select("product_id", "current_baseline")
    d = t.products().join(new, "product_id", "left")
    value = F.coalesce("current_baseline", F.col("msrp").cast("double"))
    return d.select("product_id", "sku", "store", round_to(value).alias("baseline_price"))


@query("d08_baseline_discount", with_profile(f"""
    SELECT b.product_id, {r("CASE WHEN current_baseline > 0 THEN (1 - current_price / current_baseline) * 100 ELSE 0 END")} AS discount_percent,
           current_price < min_price AS below_minimum,
           CAST(floor(epoch(as_of - last_at) / 86400) AS BIGINT) AS data_freshness_days
    FROM based b JOIN current_prices USING (product_id), ref_time"""))
def baseline_discount(t: Tables):
    d = B.current_baseline(profile_now(t), t.products())
    return d.select(
        "product_id",
        round_to(B.baseline_discount(F.col("current_price"), F.col("current_baseline"))).alias("discount_percent"),
        (F.col("current_price") < F.col("min_price")).alias("below_minimum"),
        F.timestamp_diff("DAY", F.col("last_at"), t.as_of()).alias("data_freshness_days"),
    )


@query("d09_percentile_from_z", with_profile(f"""
    , z AS (SELECT product_id, CASE WHEN std_dev > 0 THEN (current_price - mean) / std_dev END AS z
            FROM profile JOIN current_prices USING (product_id) WHERE n >= 3)
    SELECT product_id, {r('z')} AS z_score,
           {r("CASE WHEN z IS NULL THEN 50 WHEN z < -3 THEN 0.1 WHEN z > 3 THEN 99.9 ELSE greatest(0.1, least(99.9, 50 + z * 15)) END")} AS percentile
    FROM z"""))
def percentile_from_z(t: Tables):
    d = profile_now(t).filter(F.col("n") >= params.MIN_OBSERVATIONS)
    z = B.z_score(F.col("current_price"), F.col("mean"), F.col("std_dev"))
    return d.withColumn("z", z).select(
        "product_id", round_to("z").alias("z_score"), round_to(B.percentile_from_z(F.col("z"))).alias("percentile")
    )


@query("d11_adaptive_discount_threshold", with_profile(f"""
    , b AS (SELECT product_id, category, stability, CASE WHEN stability > 0.8 THEN 30.0 WHEN stability < 0.5 THEN 50.0 ELSE 40.0 END AS base,
              month(as_of) AS m FROM profile JOIN products USING (product_id), ref_time),
    c AS (SELECT *, CASE WHEN lower(category) LIKE '%electronics%' OR lower(category) LIKE '%computer%' THEN least(base, 35.0)
              WHEN lower(category) LIKE '%apparel%' OR lower(category) LIKE '%clothing%' THEN greatest(base, 50.0) ELSE base END AS adj FROM b)
    SELECT product_id, category,
      {r("adj * CASE WHEN m IN (11, 12) THEN 0.85 WHEN m = 1 THEN 0.8 WHEN m IN (7, 8) THEN 0.9 ELSE 1.0 END")} AS discount_threshold
    FROM c"""))
def discount_threshold(t: Tables):
    d = profile(t).join(t.products(), "product_id")
    v = B.discount_threshold(F.col("stability"), F.col("category"), t.as_of())
    return d.select("product_id", "category", round_to(v).alias("discount_threshold"))


TREND_SQL = """, recent AS (
    SELECT h.*, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty) AS pos,
           count(*) OVER (PARTITION BY product_id) AS cnt
    FROM history h, ref_time WHERE fetched_at >= as_of - INTERVAL {days} DAY),
trend AS (
    SELECT product_id, count(*) AS price_count, avg(CAST(price AS DOUBLE)) AS avg_price,
           coalesce(stddev_pop(CAST(price AS DOUBLE)), 0) AS std_price,
           coalesce(CASE WHEN count(*) >= 2 THEN regr_slope(CAST(price AS DOUBLE), CAST(pos AS DOUBLE)) END, 0) AS trend_slope,
           CASE WHEN count(*) >= 7 THEN avg(CAST(price AS DOUBLE)) FILTER (cnt - pos < 7) ELSE avg(CAST(price AS DOUBLE)) END AS ma_7,
           CASE WHEN count(*) >= 14 THEN avg(CAST(price AS DOUBLE)) FILTER (cnt - pos < 14) ELSE avg(CAST(price AS DOUBLE)) END AS ma_14,
           min(price) AS min_price, max(price) AS max_price
    FROM recent GROUP BY product_id)
"""
TREND_COLS = ("avg_price", "std_price", "price_volatility", "trend_slope", "ma_7", "ma_14")
TREND_LIST = (
    "price_count, " + ", ".join(f"{r(c if c != 'price_volatility' else 'std_price / avg_price')} AS {c}" for c in TREND_COLS)
)


@query("d12_trend_features", with_views("history", "ref_time", body=TREND_SQL.format(days=365) + f"""
    SELECT product_id, {TREND_LIST}, min_price, max_price, max_price - min_price AS price_range FROM trend"""))
def trend_features(t: Tables):
    d = B.trend_features(t.observations(), ORDER, t.as_of(), 365, before_newest=True)
    return d.select(
        "product_id", "price_count", *[round_to(c).alias(c) for c in TREND_COLS], "min_price", "max_price",
        (F.col("max_price") - F.col("min_price")).alias("price_range"),
    )


VELOCITY_SQL = """, lagged AS (
    SELECT h.product_id, fetched_at, abs(price - lag(price) OVER (PARTITION BY product_id
             ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty)) AS change
    FROM history h, ref_time WHERE fetched_at >= as_of - to_hours({hours})),
velocity AS (
    SELECT product_id, count(*) AS rows_24h, count(*) FILTER (change > 0.01) AS price_changes_24h,
           max(change) AS max_change_24h, avg(CAST(change AS DOUBLE)) AS avg_change_24h,
           epoch(max(fetched_at) - min(fetched_at)) / 3600 AS span
    FROM lagged GROUP BY product_id HAVING count(*) >= 2)
"""


@query("d13_velocity_features", with_views("history", "ref_time", body=VELOCITY_SQL.format(hours=24 * 60) + f"""
    SELECT product_id, rows_24h, price_changes_24h, {r('max_change_24h')} AS max_change_24h, {r('avg_change_24h')} AS avg_change_24h,
           {r('CASE WHEN span > 0 THEN price_changes_24h / greatest(span, 0.1) ELSE 0 END')} AS price_change_rate
    FROM velocity"""))
def velocity_features(t: Tables):
    d = B.velocity_features(t.observations(), ORDER, t.as_of(), 24 * 60, before_newest=True)
    return d.select(
        "product_id", "rows_24h", "price_changes_24h",
        *[round_to(c).alias(c) for c in ("max_change_24h", "avg_change_24h", "price_change_rate")],
    )


STATFEAT_SQL = """, last100 AS (
    SELECT h.product_id, current_price, price FROM history h JOIN current_prices USING (product_id) WHERE hrank <= {limit}),
statfeat AS (
    SELECT product_id, current_price, avg(CAST(price AS DOUBLE)) AS mean_price,
           CASE WHEN count(*) > 1 THEN stddev_pop(CAST(price AS DOUBLE)) ELSE 1 END AS std_price,
           count(*) FILTER (price <= current_price) / count(*) AS percentile
    FROM last100 GROUP BY product_id, current_price)
"""


@query("d14_statistical_features", with_views("history", "current_prices", body=STATFEAT_SQL.format(limit=20) + f"""
    SELECT product_id, {r('mean_price')} AS mean_price, {r('std_price')} AS std_price, {r('percentile')} AS percentile,
           {r('(current_price - mean_price) / greatest(std_price, 0.01)')} AS z_score,
           {r('(current_price - mean_price) / greatest(mean_price, 0.01)')} AS price_deviation
    FROM statfeat"""))
def statistical_features(t: Tables):
    d = B.statistical_features(t.observations(), ORDER, limit=20)
    cols = ("mean_price", "std_price", "percentile", "z_score", "price_deviation")
    return d.select("product_id", *[round_to(c).alias(c) for c in cols])


@query("d16_products_with_history", with_views("products", "observations", body="""
    SELECT product_id, sku, store FROM products p
    WHERE EXISTS (SELECT 1 FROM observations o WHERE o.product_id = p.product_id)"""))
def products_with_history(t: Tables):
    seen = t.raw("lineitem").select(F.col("l_partkey").alias("product_id"))
    return t.products().join(seen, "product_id", "left_semi").select("product_id", "sku", "store")
