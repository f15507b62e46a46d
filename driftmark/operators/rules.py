"""Detection rules, store policies and the velocity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftmark import params
from driftmark.functions.numbers import clamp, fixed_text, percent_off
from driftmark.operators import skew

RULE_TYPE = "array<struct<priority:int,id:int,name:string,rule_type:string,threshold:double,enabled:boolean>>"


def rules_table(spark, rows=params.RULES) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "id int, name string, rule_type string, threshold double, enabled boolean, priority int"
    )


def ordered_rules(rules: DataFrame, most: int = 10_000) -> Column:
    """The enabled rules as one array, highest priority first, then by id.

    A rule table is written by hand, so it fits a scalar; attaching it as an array tests every price
    against every rule without a join.  More than ``most`` rules fail the query rather than being cut.
    """
    held = F.collect_list(F.struct("priority", "id", "name", "rule_type", "threshold", "enabled"))
    r = rules.filter("enabled").agg(F.when(F.count("*") <= most, held).otherwise(F.raise_error(F.lit(f"more than {most} rules"))).alias("r"))
    by_rank = F.array_sort(
        "r",
        lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).otherwise(a["id"] - b["id"]),
    )
    return r.select(by_rank.alias("r")).scalar()


def _hit(rule: Column, price: Column, base: Column, msrp: Column) -> Column:
    p, b, m = price.cast("double"), base.cast("double"), msrp.cast("double")
    kind, limit = rule["rule_type"], rule["threshold"]
    expected = F.coalesce(F.nullif(m, F.lit(0.0)), b)
    return F.coalesce(
        F.when(kind == "percent_drop", (b > 0) & (p <= b * limit))
        .when(kind == "absolute", p <= limit)
        .when(kind == "msrp_ratio", (m > 0) & (p <= m * limit))
        .when(kind == "penny_pricing", (p <= 1.0) & (expected >= limit))
        .when(kind == "currency_error", (m > 0) & (p > 0) & (F.abs(p - m / 100) < 0.01))
        .when(kind == "msrp_deviation", (m > 0) & (p / F.nullif(m, F.lit(0.0)) <= limit)),
        F.lit(False),
    )


def _why(kind: Column, limit: Column, price: Column, base: Column, msrp: Column) -> Column:
    def dollars(c: Column) -> Column:
        return F.concat(F.lit("$"), fixed_text(c, 2))

    expected = F.coalesce(F.nullif(msrp.cast("double"), F.lit(0.0)), base.cast("double"))
    off_base, off_msrp = fixed_text(percent_off(price, base), 1), fixed_text(percent_off(price, msrp), 1)
    return (
        F.when(kind == "percent_drop", F.concat(off_base, F.lit("% off baseline ("), dollars(base), F.lit(")")))
        .when(kind == "absolute", F.concat(F.lit("Price "), dollars(price), F.lit(" <= threshold "), dollars(limit)))
        .when(kind == "msrp_ratio", F.concat(off_msrp, F.lit("% off MSRP ("), dollars(msrp), F.lit(")")))
        .when(kind == "penny_pricing", F.concat(F.lit("Penny pricing detected: "), dollars(price), F.lit(" for item expected "), dollars(expected)))
        .when(kind == "currency_error", F.concat(F.lit("Possible currency error: "), dollars(price), F.lit(" vs MSRP "), dollars(msrp)))
        .when(kind == "msrp_deviation", F.concat(off_msrp, F.lit("% off MSRP ("), dollars(msrp), F.lit(") - potential error")))
    )


def rule_predicates(prices: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per price and enabled rule with ``triggered`` and ``reason``."""
    price, base, msrp = F.col("current_price"), F.col("baseline_price"), F.col("msrp")
    d = prices.withColumn("rule", F.explode(ordered_rules(rules)))
    d = d.withColumn("triggered", _hit(F.col("rule"), price, base, msrp))
    why = _why(F.col("rule.rule_type"), F.col("rule.threshold"), price, base, msrp)
    return d.withColumn("reason", F.when(F.col("triggered"), why))


# Cents that mark a clearance price.
CLEARANCE_CENTS = (0, 88, 97)


def store_policy(d: DataFrame) -> DataFrame:
    """Adds ``policy``: allowed, reason, confidence delta and evidence asked for.

    Reads ``store, current_price, availability, seller_type, signal_type, sold_median``.
    """
    store, price = F.lower("store"), F.col("current_price")
    out_of_stock = F.coalesce(F.col("availability") == "out_of_stock", F.lit(False))
    cents = F.floor(price * 100).cast("long") % 100
    odd_cents = F.coalesce(cents.isin(*CLEARANCE_CENTS), F.lit(False))
    clearance = F.coalesce(F.col("signal_type") == "clearance", F.lit(False))
    median = F.nullif(F.col("sold_median").cast("double"), F.lit(0.0))
    cheap = F.coalesce(price.cast("double") < median * 0.8, F.lit(False))
    dear = F.coalesce(price.cast("double") > median * 1.1, F.lit(False))
    nothing = F.array().cast("array<string>")

    def verdict(allowed, reason, delta=0.0, evidence=None) -> Column:
        def col(x, kind):
            return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

        return F.struct(
            col(allowed, "boolean").alias("allowed"), col(reason, "string").alias("reason"),
            col(delta, "double").alias("delta"), (nothing if evidence is None else evidence).alias("evidence"),
        )

    def asked(name: str, when: Column | None = None) -> Column:
        return F.array(F.lit(name)) if when is None else F.when(when, F.array(F.lit(name))).otherwise(nothing)

    by_amazon_seller = F.coalesce(F.col("seller_type").isin("amazon", "fba"), F.lit(False))
    policy = (
        F.when((store == "amazon_us") & out_of_stock, verdict(False, "Amazon item out of stock"))
        .when(store == "amazon_us", verdict(True, "Amazon validation", 0.0, asked("seller_type", (price <= 1) & ~by_amazon_seller)))
        .when((store == "walmart") & out_of_stock, verdict(False, "Walmart item out of stock"))
        .when(store == "walmart", verdict(True, "Walmart validation", F.when(odd_cents, 0.05).otherwise(0.0) + F.when(clearance, 0.05).otherwise(0.0), asked("in_stock")))
        .when((store == "costco") & out_of_stock, verdict(False, "Costco item out of stock"))
        .when((store == "costco") & (odd_cents | clearance), verdict(True, "Costco warehouse markdown", 0.05, asked("in_stock")))
        .when(store == "costco", verdict(True, "Costco validation", 0.0, asked("in_stock")))
        .when((store == "ebay") & dear, verdict(False, "Above sold median comps", 0.0, asked("sold_comps")))
        .when(store == "ebay", verdict(True, "eBay comps check", F.when(cheap, 0.05).otherwise(0.0), asked("sold_comps", median.isNotNull())))
        .otherwise(verdict(True, F.lit(None).cast("string")))
    )
    return d.withColumn("policy", policy)


def detection_confidence(confidence: Column, delta: Column, ml_score: Column) -> Column:
    """Nine tenths of the price's confidence, the policy's change, a bonus when a model agrees."""
    base = confidence * 0.9
    base = F.when(delta != 0, clamp(base + delta, 0.0, 1.0)).otherwise(base)
    return F.when(F.coalesce(ml_score > 0.7, F.lit(False)), F.least(F.lit(1.0), base + 0.1)).otherwise(base)


def detection_discount(price: Column, base: Column, msrp: Column) -> Column:
    return F.coalesce(percent_off(price, base), percent_off(price, msrp))


def first_rule_match(prices: DataFrame, rules: DataFrame) -> DataFrame:
    """The first enabled rule a price triggers and the policy allows; every price keeps its row.

    Reads what ``store_policy`` reads plus ``baseline_price, msrp, confidence, ml_score``.
    """
    d = store_policy(prices).withColumn("_rules", ordered_rules(rules))
    price, base, msrp = F.col("current_price"), F.col("baseline_price"), F.col("msrp")
    gated = (F.col("availability") == "out_of_stock") & (F.col("confidence") < 0.8)
    rule = F.get(F.filter("_rules", lambda r: _hit(r, price, base, msrp)), F.lit(0))
    d = d.withColumn("rule", F.when(~F.coalesce(gated, F.lit(False)) & F.col("policy.allowed"), rule)).drop("_rules")
    hit = F.col("rule").isNotNull()
    why = F.concat_ws(" | ", _why(F.col("rule.rule_type"), F.col("rule.threshold"), price, base, msrp), F.col("policy.reason"))
    return d.withColumns(
        {
            "triggered": hit,
            "detection_reason": F.when(hit, why).when(gated, "Product out of stock").otherwise("No rules triggered"),
            "detection_confidence": F.when(
                hit, detection_confidence(F.col("confidence"), F.col("policy.delta"), F.col("ml_score"))
            ).otherwise(F.col("confidence")),
            "detection_discount": F.when(hit, detection_discount(price, base, msrp)),
        }
    )


def trailing_distinct(df: DataFrame, key: str, ts: str, value: str, seconds: int, name: str = "distinct_values") -> DataFrame:
    """Distinct values of the key within the trailing ``seconds`` of every row, both ends included.

    A value counts from a row until its next occurrence or until the row leaves the window, so the
    distinct count is a running sum of +1 and -1 marks.  Keys are cut into slices of the window's
    length, each with the slice before it as context.
    """
    span = seconds * 1_000_000
    rows = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("_at") / span))
    rows = rows.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    same = W.partitionBy(key, "_slice", value).orderBy("_at")
    until = F.least(F.col("_at") + span + 1, F.lead("_at").over(same))
    rows = rows.withColumn("_until", F.coalesce(until, F.col("_at") + span + 1))
    payload = F.struct(*df.columns)
    marks = rows.select(
        key, "_slice", "_own",
        F.explode(F.array(
            F.struct(F.col("_at").alias("at"), F.lit(1).alias("step"), payload.alias("row")),
            F.struct(F.col("_until").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(df.schema).alias("row")),
        )).alias("m"),
    ).select(key, "_slice", "_own", "m.*")
    upto = W.partitionBy(key, "_slice").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    marks = marks.withColumn("_n", F.sum("step").over(upto))
    own = marks.filter(F.col("row").isNotNull() & (F.col("_slice") == F.col("_own")))
    return own.select("row.*", F.col("_n").alias(name))


def velocity_gate(observations: DataFrame, key: str, ts: str, price: str) -> DataFrame:
    """``velocity_ok`` is false where more than three prices were seen within ten minutes."""
    d = trailing_distinct(observations, key, ts, price, params.VELOCITY_SECONDS, "distinct_prices")
    return d.withColumn("velocity_ok", F.col("distinct_prices") <= params.VELOCITY_MAX_PRICES)
