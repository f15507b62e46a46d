"""Joined views of products, observations and alerts, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftmark.functions.numbers import MONEY, fixed_text, percent_off
from driftmark.operators import skew


def latest_deals(observations: DataFrame, products: DataFrame) -> DataFrame:
    """Every observation at its product's newest time, with the discount and the total of rows.

    The newest time per product combines before the shuffle and meets the observations as a join, so
    ties are kept.
    """
    latest = observations.groupBy("product_id").agg(F.max("fetched_at").alias("fetched_at"))
    d = observations.join(latest, ["product_id", "fetched_at"]).join(
        products.select("product_id", "store", "sku", "title", "url", "msrp"), "product_id"
    )
    reference = F.coalesce(F.nullif("original_price", F.lit(0).cast(MONEY)), F.col("msrp"))
    price = F.nullif("price", F.lit(0).cast(MONEY))
    return d.withColumn("discount_percent", percent_off(price, reference))


def deals_page(deals: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of ``limit`` rows and the count of all rows beside it."""
    total = deals.agg(F.count("*")).scalar()
    page = deals.orderBy(F.desc("fetched_at"), "product_id", "order_id", "line_no").offset(offset).limit(limit)
    return page.withColumn("total_count", total)


def recent_activity(observations: DataFrame, products: DataFrame, order: Sequence[str], limit: int = 20) -> DataFrame:
    """The newest observations with product facts, "Unknown" where the product is gone."""
    top = observations.orderBy(*[F.desc(c) for c in order]).limit(limit)
    d = top.join(products.select("product_id", "title", "store", "sku"), "product_id", "left")
    return d.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("title", "store", "sku")})


def recent_alerts(alerts: DataFrame, products: DataFrame, limit: int = 50) -> DataFrame:
    """The newest alerts whose product exists."""
    d = alerts.join(products.select("product_id", "title", "store", "sku"), "product_id")
    return d.orderBy(F.desc("sent_at"), F.desc("alert_id")).limit(limit)


def context_bundle(observations: DataFrame, products: DataFrame, order: Sequence[str], limit: int = 5) -> DataFrame:
    """Per product its newest prices, oldest first, and its facts."""
    newest = skew.newest_rows(observations, ["product_id"], order, limit)
    rows = F.sort_array(F.collect_list(F.struct((-F.col("newest_rank")).alias("at"), "price", "fetched_at", "confidence")))
    recent = newest.groupBy("product_id").agg(rows.alias("recent"))
    return recent.join(products.select("product_id", "title", "store", "sku", "msrp"), "product_id")


def review_prompts(d: DataFrame, shown: int = 10) -> DataFrame:
    """A review document per flagged price.

    Reads detector columns and those of ``context_bundle``; no model is called.
    """
    n = F.size("recent")
    lines = F.transform(
        F.slice("recent", 1, shown),
        lambda x, i: F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". $"), fixed_text(x["price"], 2), F.lit(" on "),
            F.date_format(x["fetched_at"], "yyyy-MM-dd HH:mm"),
        ),
    )
    parts = F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.coalesce("title", F.lit("Unknown"))),
        F.concat(F.lit("Store: "), "store"),
        F.concat(F.lit("SKU: "), "sku"),
        F.concat(F.lit("Current Price: $"), fixed_text("current_price", 2)),
        F.concat(F.lit("MSRP: $"), fixed_text("msrp", 2)),
        F.concat(F.lit("Baseline Price: $"), fixed_text("current_baseline", 2)),
        F.lit("\nAnomaly Detection Results:"),
        F.concat(F.lit("- Anomaly Score: "), fixed_text("anomaly_score", 3)),
        F.concat(F.lit("- Confidence: "), fixed_text("confidence_score", 3)),
        F.concat(F.lit("- Detection Methods: "), F.array_join("methods", ", ")),
        F.concat(F.lit("- Z-Score: "), fixed_text("z_score", 2)),
        F.concat(F.lit("\nRecent Price History (last "), n.cast("string"), F.lit(" prices):")),
        F.array_join(lines, "\n"),
        F.lit("\nIs this a genuine pricing error or a false positive?"),
    )
    return d.withColumn("prompt", parts)
