"""Deals from a listing alone, without price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftmark import params
from driftmark.functions.numbers import clamp, fixed_text, percent_off
from driftmark.operators.filters import known_name, overlapping_category, threshold_table

# Thresholds of a detector that is given none.
DEFAULTS = {"min_discount_percent": 50.0, "msrp_threshold": 0.5, "min_price": 0.01, "max_price": 10000.0}


def threshold_config(category: Column, store: Column) -> Column:
    """Thresholds by store name, else category name, else first overlap, else default, the least
    discount being scaled per store."""
    cat = F.lower(F.coalesce(F.nullif(category, F.lit("")), F.lit("default")))
    shop = F.lower(store)
    name = F.coalesce(known_name(shop), known_name(cat), overlapping_category(cat), F.lit("default"))
    found = F.element_at(threshold_table(params.CATEGORY_THRESHOLDS["default"]), name)
    factors = F.create_map(*[F.lit(x) for pair in params.STORE_DISCOUNT_MULTIPLIER.items() for x in pair])
    factor = F.coalesce(F.try_element_at(factors, shop), F.lit(1.0))
    return F.struct(
        (found["min_discount_percent"] * factor).alias("min_discount_percent"),
        *[found[c].alias(c) for c in ("msrp_threshold", "min_price", "max_price")],
    )


def deal_confidence(percent: Column, has_original: Column, has_msrp: Column) -> Column:
    """Half, plus the band of the discount, plus the reference prices there are."""
    band = (
        F.when(percent.between(50, 70), 0.2)
        .when((percent > 70) & (percent <= 85), 0.15)
        .when((percent > 85) & (percent <= 95), 0.1)
        .otherwise(-0.1)
    )
    refs = F.when(has_original, 0.15).otherwise(0.0) + F.when(has_msrp, 0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + band + refs, 0.1, 1.0)


def detect(listings: DataFrame, config: Column | None = None) -> DataFrame:
    """Deals among the listings: off the struck-through price, off MSRP, or both.

    ``config`` is a struct of thresholds per row; without it the detector's defaults hold.
    """
    if config is None:
        config = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULTS.items()])
    d = listings.withColumn("cfg", config)
    price, original, msrp = (F.col(c).cast("double") for c in ("current_price", "original_price", "msrp"))
    sane = (price > 0) & price.between(F.col("cfg.min_price"), F.col("cfg.max_price"))
    off_original = F.when(price < original, percent_off(price, original))
    off_msrp = F.when(price < msrp, percent_off(price, msrp))
    struck = F.coalesce(off_original >= F.col("cfg.min_discount_percent"), F.lit(False))
    ratio = price / F.nullif(msrp, F.lit(0.0))
    by_msrp = F.coalesce((price < msrp) & (ratio <= F.col("cfg.msrp_threshold")), F.lit(False))
    d = d.withColumns({"_struck": struck, "_msrp": by_msrp, "_o": off_original, "_m": off_msrp})
    d = d.filter(sane & (F.col("_struck") | F.col("_msrp")))
    msrp_wins = F.col("_msrp") & (~F.col("_struck") | (F.col("_m") > F.col("_o")))
    percent = F.when(msrp_wins, F.col("_m")).otherwise(F.col("_o"))
    both = F.col("_struck") & F.col("_msrp")
    signals = F.array_compact(F.array(F.when(F.col("_struck"), F.lit("strikethrough")), F.when(F.col("_msrp"), F.lit("msrp"))))
    has_original = F.coalesce(original != 0, F.lit(False))
    has_msrp = F.coalesce(msrp != 0, F.lit(False))
    d = d.withColumn("discount_percent", percent).withColumn("signals", signals)
    conf = deal_confidence(F.col("discount_percent"), has_original | ~msrp_wins, has_msrp | msrp_wins)
    conf = F.when(both, F.least(F.lit(1.0), conf + 0.15)).otherwise(conf)
    text = fixed_text("discount_percent", 1)
    reason = (
        F.when(both, F.concat(text, F.lit("% off (verified by "), F.array_join("signals", ", "), F.lit(")")))
        .when(msrp_wins, F.concat(text, F.lit("% off MSRP ($"), fixed_text("msrp", 2), F.lit(")")))
        .otherwise(F.concat(text, F.lit("% off (was $"), fixed_text("original_price", 2), F.lit(")")))
    )
    method = F.when(both, "combined").when(msrp_wins, "msrp").otherwise("strikethrough")
    d = d.withColumns({"confidence": conf, "detection_method": method, "reason": reason})
    return d.drop("_struck", "_msrp", "_o", "_m", "cfg")


def with_flags(deals: DataFrame, score: str = "anomaly_score", n_methods: Column | None = None) -> DataFrame:
    """Adds ``is_significant``, ``is_price_error`` and ``combined_score``."""
    s = F.nullif(F.col(score), F.lit(0.0))
    percent, conf = F.col("discount_percent"), F.col("confidence")
    methods = n_methods if n_methods is not None else F.lit(0)
    significant = F.coalesce(s >= 0.7, F.lit(False)) | ((percent >= 40) & (conf >= 0.6))
    error = (
        ((percent >= 70) & (conf >= 0.8))
        | ((F.size("signals") >= 2) & (percent >= 60))
        | F.coalesce(s >= 0.8, F.lit(False))
        | F.coalesce(methods >= 2, F.lit(False))
    )
    combined = F.when(s.isNotNull(), (conf + s * 1.5) / 2.5).otherwise(conf)
    return deals.withColumns({"is_significant": significant, "is_price_error": error, "combined_score": combined})


def batch(listings: DataFrame, min_confidence: float = 0.5, config: Column | None = None) -> DataFrame:
    """Deals of a batch at or above a confidence; sort by ``discount_percent`` to present them."""
    return detect(listings, config).filter(F.col("confidence") >= min_confidence)


def significant(deals: DataFrame, k: int = 20, key: str = "product_id") -> DataFrame:
    return deals.filter("is_significant").orderBy(F.desc("discount_percent"), key).limit(k)


def price_errors(deals: DataFrame, k: int = 10, key: str = "product_id") -> DataFrame:
    return deals.filter("is_price_error").orderBy(F.desc("confidence"), F.desc("discount_percent"), key).limit(k)


def category_cut(deals: DataFrame, least: Column) -> DataFrame:
    """Keeps deals at or above the category's least discount and the global one."""
    floor = F.greatest(F.coalesce(least, F.lit(50.0)), F.lit(params.GLOBAL_MIN_DISCOUNT))
    return deals.filter(F.col("discount_percent") >= floor)


def enrich(deals: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Adds the anomaly result of the product: signals joined, confidence raised by a tenth.

    ``anomalies`` holds ``product_id, anomaly_score, methods, is_anomaly, anomaly_confidence``; a
    product without one counts as no anomaly with confidence .3.
    """
    d = deals.join(anomalies, "product_id", "left")
    odd = F.coalesce("is_anomaly", F.lit(False))
    none = F.array().cast("array<string>")
    signals = F.when(odd, F.array_union("signals", F.coalesce("methods", none))).otherwise(F.col("signals"))
    sure = odd & (F.coalesce("anomaly_confidence", F.lit(0.3)) > 0.6)
    conf = F.when(sure, F.least(F.lit(1.0), F.col("confidence") * 1.1)).otherwise(F.col("confidence"))
    return d.withColumns(
        {
            "signals": F.array_sort(signals),
            "confidence": conf,
            "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)),
            "n_methods": F.coalesce(F.size(F.coalesce("methods", none)), F.lit(0)),
        }
    )


def enrich_cross_store(deals: DataFrame, matches: DataFrame, attributes: DataFrame) -> DataFrame:
    """Raises confidence by .1 per close match that is at least $10 dearer, .05 for known attributes.

    ``matches`` holds ``product_id, similarity, matched_baseline``; ``attributes`` holds
    ``product_id, brand, model``.
    """
    priced = matches.join(deals.select("product_id", "current_price"), "product_id").filter(
        (F.col("similarity") > 0.9) & (F.col("current_price").cast("double") - F.col("matched_baseline").cast("double") < -10)
    )
    cheaper = priced.groupBy("product_id").agg(F.count("*").alias("cheaper_matches"))
    known = attributes.select("product_id", (F.col("brand").isNotNull() | F.col("model").isNotNull()).alias("has_attributes"))
    d = deals.join(cheaper, "product_id", "left").join(known, "product_id", "left")
    n = F.coalesce("cheaper_matches", F.lit(0))
    raised = F.least(F.lit(1.0), F.col("confidence") + n * 0.1)
    raised = F.when(F.coalesce("has_attributes", F.lit(False)), F.least(F.lit(1.0), raised + 0.05)).otherwise(raised)
    return d.withColumn("cheaper_matches", n).withColumn("confidence", raised)


def candidate_deal(d: DataFrame, *keys: str) -> DataFrame:
    """Deal record of a verified candidate, nested as the alert sink takes it.

    Reads candidate, signal and detection columns of one row: ``product_id, retailer, sku, title, url,
    current_price, msrp, signal_id, signal_type, escalated, detection_discount, detection_confidence,
    detection_reason, baseline_price, baseline_source, scan_pass, evidence, sold_median``.
    """
    percent = F.coalesce(F.nullif(F.col("detection_discount"), F.lit(0.0)), percent_off("current_price", "msrp"), F.lit(0.0))
    signals = F.array_compact(F.array(
        F.when(F.col("signal_id").isNotNull(), F.lit("signal")),
        F.when(F.col("signal_id").isNotNull(), F.nullif(F.col("signal_type"), F.lit(""))),
        F.when(F.col("escalated"), F.lit("two_pass")).otherwise("datacenter_pass"),
    ))
    return d.select(
        *keys,
        F.struct(
            F.col("sku"), F.coalesce("title", "product_id").alias("title"), "url", "current_price",
            F.col("msrp").alias("original_price"), "msrp", F.col("retailer").alias("store"),
        ).alias("product"),
        percent.alias("discount_percent"), F.lit("signal").alias("detection_method"),
        F.col("detection_confidence").alias("confidence"),
        F.coalesce("detection_reason", F.lit("Signal verification")).alias("reason"),
        signals.alias("signals"), "baseline_price", "baseline_source",
        F.struct("scan_pass", F.col("evidence").alias("requirements"), F.col("sold_median").alias("sold_median_price")).alias("verification"),
    )
