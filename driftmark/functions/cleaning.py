"""Normalising raw price fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftmark.functions.numbers import percent_off

# Texts that mean the price is not shown.
UNAVAILABLE_KEYWORDS = ("see price in cart", "see price at checkout", "contact us", "price unavailable")


def availability(raw: Column, literal: bool = False) -> Column:
    """Free text to in_stock, out_of_stock, preorder or unknown.

    "unavailable" contains "available", so out of stock is tested first; ``literal`` keeps the order
    in which it would count as in stock.
    """
    low = F.lower(raw)
    has_in = low.contains("in_stock") | low.contains("available")
    has_out = low.contains("out_of_stock") | low.contains("unavailable")
    pre = low.contains("preorder") | low.contains("pre-order")
    first, second = (("in_stock", has_in), ("out_of_stock", has_out))
    if not literal:
        (first, second) = (second, first)
    return F.when(first[1], first[0]).when(second[1], second[0]).when(pre, "preorder").otherwise("unknown")


def normalize_price(raw: DataFrame) -> DataFrame:
    """Adds the normalised fields and ``reject_reason`` (NULL for accepted rows).

    Reads ``raw_price, raw_title, raw_availability, raw_confidence, raw_shipping, raw_currency``.
    """
    price = F.col("raw_price")
    reason = (
        F.when(price.isNull(), "no price").when(price == 0, "zero price").when(price < 0, "negative price")
    )
    title = F.lower(F.coalesce("raw_title", F.lit("")))
    hidden = F.lit(False)
    for word in UNAVAILABLE_KEYWORDS:
        hidden = hidden | title.contains(word)
    d = raw.withColumn("reject_reason", reason).withColumn("availability", availability(F.col("raw_availability")))
    conf = F.least(F.col("raw_confidence"), F.when(hidden, 0.3), F.when(F.col("availability") == "out_of_stock", 0.5))
    return d.withColumns(
        {
            "confidence": conf,
            "shipping": F.coalesce("raw_shipping", F.lit("0.00").cast("decimal(10,2)")),
            "currency": F.upper(F.coalesce(F.nullif("raw_currency", F.lit("")), F.lit("USD"))),
        }
    )


def parse_price(text: Column) -> Column:
    """First number of a text once ``$`` and ``,`` are gone."""
    plain = F.translate(text, "$,", "")
    return F.regexp_extract(plain, r"(\d+\.?\d*)", 1).try_cast("decimal(20,4)")


def parse_price_dotted(text: Column) -> Column:
    """The listing pages' variant: the first run of digits and dots, NULL when it is no number."""
    plain = F.translate(text, "$,", "")
    return F.regexp_extract(plain, r"[\d.]+", 0).try_cast("decimal(20,4)")


def discount_percent(price: Column, original: Column, msrp: Column) -> Column:
    """Percent off the original price, else off MSRP, else NULL."""
    priced = F.nullif(price.cast("double"), F.lit(0.0))
    return F.coalesce(percent_off(priced, original), percent_off(priced, msrp))


def msrp_discount(price: Column, msrp: Column) -> Column:
    """Percent off MSRP, never negative; 0 without an MSRP of its own."""
    return F.when(msrp == 0, 0.0).otherwise(F.greatest(F.lit(0.0), percent_off(price, msrp)))


def discount_tier(percent: Column) -> Column:
    return F.when(percent >= 70, "70%+").when(percent >= 60, "60-70%").otherwise("50-60%")


def similarity_tier(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "0.95+").when(score >= 0.9, "0.9-0.95").when(score >= 0.85, "0.85-0.9").otherwise("<0.85")
    )


def direction(old: Column, new: Column) -> Column:
    return F.when(new > old, "up").otherwise("down")
