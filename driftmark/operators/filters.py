"""Listing filters and change detection."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from driftmark import params
from driftmark.functions.numbers import MONEY, fixed_text, percent_off
from driftmark.operators import predicates as P

CONFIG_FIELDS = "keywords array<string>, exclude_keywords array<string>, brands array<string>"


def _any_match(text: Column, patterns: Column, literal: bool = False) -> Column:
    """Does any pattern of the array occur in the text, whatever the case?"""
    def hit(p: Column) -> Column:
        return F.contains(F.lower(text), F.lower(p)) if literal else F.rlike(text, F.concat(F.lit("(?i)"), p))

    return F.coalesce(F.exists(F.filter(patterns, lambda p: F.length(p) > 0), hit), F.lit(False))


def listing_filter(listings: DataFrame, configs: DataFrame, key: str = "category") -> DataFrame:
    """Adds ``dropped_by``: the first filter a listing fails, NULL when it passes all.

    ``configs`` has one row per ``key`` with JSON text lists, price bounds, and arrays of excluded
    SKUs and brands.  Malformed JSON counts as an empty list.
    """
    def listed(c: str) -> Column:
        return F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))

    cfg = configs.select(
        key, *[listed(c).alias(f"_{c}") for c in ("keywords", "exclude_keywords", "brands")],
        F.col("min_price").alias("_min"), F.col("max_price").alias("_max"),
        F.col("excluded_skus").alias("_skus"), F.col("excluded_brands").alias("_xbrands"),
    )
    d = listings.join(cfg, key, "left")
    text, title = F.concat_ws(" ", "title", "sku"), F.col("title")
    price = F.col("current_price")

    def nonempty(c: str) -> Column:
        return F.size(F.filter(F.col(c), lambda p: F.length(p) > 0)) > 0

    low = F.coalesce(F.nullif(F.col("_min"), F.lit(0).cast(MONEY)) > price, F.lit(False))
    high = F.coalesce(F.nullif(F.col("_max"), F.lit(0).cast(MONEY)) < price, F.lit(False))
    why = (
        F.when(F.coalesce(F.array_contains("_skus", F.col("sku")), F.lit(False)), "sku")
        .when(_any_match(text, F.col("_exclude_keywords")), "exclude_keyword")
        .when(_any_match(title, F.col("_xbrands"), literal=True), "excluded_brand")
        .when(nonempty("_keywords") & ~_any_match(text, F.col("_keywords")), "keyword")
        .when(nonempty("_brands") & ~_any_match(title, F.col("_brands"), literal=True), "brand")
        .when(low | high, "price")
    )
    return d.withColumn("dropped_by", why).drop("_keywords", "_exclude_keywords", "_brands", "_min", "_max", "_skus", "_xbrands")


def without_excluded(listings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drops listings on the exclusion list: per store or ``*`` by SKU, keyword pattern, brand.

    SKUs are equi anti joins.  Patterns and brands stay rows, each filed under the rarest gram of a literal that no
    match can do without; the grams of each distinct (store, title, SKU) find the few rules that can match, and only
    those are tested.  A pattern that is no regular expression is left out, as is a null one.
    """
    x = exclusions.filter("enabled")
    star = F.col("store") == "*"
    skus = x.filter(F.col("sku").isNotNull())
    out = listings.join(skus.filter(~star).select("store", "sku").distinct(), ["store", "sku"], "left_anti")
    out = out.join(skus.filter(star).select("sku").distinct(), "sku", "left_anti").select(*listings.columns)

    own = [F.xxhash64("store", "title", "sku").alias("_h1"), F.xxhash64("sku", "title", "store", F.lit(1)).alias("_h2")]
    texts = out.select("store", "title", "sku", *own).distinct()
    whole, title = F.concat_ws(" ", "title", "sku"), F.lower("title")
    folded = F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)

    patterns = x.filter(F.col("keyword").isNotNull()).select("store", "keyword").distinct()
    patterns = patterns.withColumn("needle", F.explode(P.pattern_literals(F.col("keyword"))))
    patterns = patterns.withColumns({"kind": F.lit("pattern"), "keyword": F.concat(F.lit("(?i)"), F.regexp_replace("keyword", r"\(\?P<", "(?<"))})
    brands = x.filter(F.col("brand").isNotNull()).select("store", F.lower("brand").alias("needle")).distinct()
    needles = patterns.unionByName(brands.withColumns({"kind": F.lit("brand"), "keyword": F.lit(None).cast("string")}))
    index = P.filed(needles, "needle", ["store", "kind", "keyword"], P.counted(texts, folded))
    index = index.select(F.col("store").alias("_route"), F.col("kind").alias("_kind"), F.col("gram").alias("_gram"), "keyword", "needle")

    def labelled(kind: str, text: Column) -> Column:
        return F.transform(P.grams(text), lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))

    probes = texts.select("_h1", "_h2", "store", F.explode(F.concat(labelled("pattern", folded), labelled("brand", title))).alias("p"))
    probes = probes.select("_h1", "_h2", "p.*", F.explode(F.array_distinct(F.array(F.lit("*"), "store"))).alias("route"))
    met = (F.col("route") == F.col("_route")) & (F.col("kind") == F.col("_kind")) & (F.col("gram") == F.col("_gram"))
    candidates = probes.join(index, met).select("_h1", "_h2", "kind", "keyword", "needle")
    hit = F.when(F.col("kind") == "brand", F.contains(title, F.col("needle"))).otherwise(F.contains(folded, F.col("needle")) & F.rlike(whole, F.col("keyword")))
    gone = texts.select("_h1", "_h2", "title", "sku").join(candidates, ["_h1", "_h2"]).filter(hit).select("_h1", "_h2").distinct()
    return out.select("*", *own).join(gone, ["_h1", "_h2"], "left_anti").select(*listings.columns)


def low_price_keyword(price: Column, title: Column, sku: Column, store: Column) -> Column:
    """Is this a low-priced item of the word list, or one of the listed SKUs?"""
    words = "(?i)\\b(" + "|".join(params.LOW_PRICE_WORDS) + ")\\b"
    by_word = (price <= params.LOW_PRICE_MAX) & F.concat_ws(" ", title, sku).rlike(words)
    return F.coalesce(by_word, F.lit(False)) | ((store == params.LOW_PRICE_STORE) & sku.isin(*params.LOW_PRICE_SKUS))


def retail_price(original: Column, msrp: Column, current: Column) -> Column:
    return F.coalesce(original, msrp, current)


def min_retail_filter(listings: DataFrame, least: float = params.GLOBAL_MIN_PRICE) -> DataFrame:
    return listings.filter(retail_price(F.col("original_price"), F.col("msrp"), F.col("current_price")) >= least)


def threshold_table(fallback) -> Column:
    """The category thresholds as one literal map; the empty name holds the fallback."""
    names = ("min_discount_percent", "msrp_threshold", "min_price", "max_price")
    rows = {**params.CATEGORY_THRESHOLDS, "": fallback}
    entries = []
    for name, values in rows.items():
        entries += [F.lit(name), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])]
    return F.create_map(*entries)


def overlapping_category(low: Column) -> Column:
    """First name of the table that contains the lower-case text or is contained in it."""
    names = F.array(*[F.lit(n) for n in params.CATEGORY_THRESHOLDS])
    return F.get(F.filter(names, lambda n: F.contains(low, n) | F.contains(n, low)), F.lit(0))


def known_name(low: Column) -> Column:
    return F.when(low.isin(*params.CATEGORY_THRESHOLDS), low)


def category_rules(category: Column, fallback=params.CATEGORY_FILTER_FALLBACK) -> Column:
    """Thresholds of a category: exact name, else the first that contains it or is contained."""
    low = F.lower(category)
    name = F.coalesce(known_name(low), overlapping_category(low), F.lit(""))
    return F.element_at(threshold_table(fallback), name)


def msrp_context_filter(listings: DataFrame, is_clearance: Column) -> DataFrame:
    """Adds ``reject_reason``: 90 % or more off MSRP outside clearance, then the category bounds."""
    off = percent_off(F.nullif(F.col("current_price"), F.lit(0).cast(MONEY)), "msrp")
    rules = category_rules(F.col("category"))
    price = F.col("current_price").cast("double")
    d = listings.withColumn("_r", rules)
    why = (
        F.when(
            (off >= 90.0) & ~is_clearance,
            F.concat(fixed_text(off, 1), F.lit("% off MSRP ($"), F.col("msrp").cast("string"), F.lit(") - potential error")),
        )
        .when(
            price < F.col("_r.min_price"),
            F.concat(F.lit("Price $"), F.col("current_price").cast("string"), F.lit(" below category minimum $"), fixed_text("_r.min_price", 2)),
        )
        .when(
            price > F.col("_r.max_price"),
            F.concat(F.lit("Price $"), F.col("current_price").cast("string"), F.lit(" above category maximum $"), fixed_text("_r.max_price", 2)),
        )
    )
    return d.withColumn("reject_reason", why).drop("_r")


def listing_hash(sku: Column, price: Column, original: Column) -> Column:
    def shown(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit(0).cast(MONEY)).cast("string"), F.lit("0"))

    return F.md5(F.concat(sku, F.lit(":"), shown(price), F.lit(":"), shown(original)))


def changed_listings(now: DataFrame, seen: DataFrame, ttl_seconds: int = params.DELTA_TTL_SECONDS) -> DataFrame:
    """Adds ``changed``: the listing is new, its stored hash has expired, or the hash differs.

    ``seen`` holds ``store, sku, stored_hash, stored_at``.
    """
    d = now.withColumn("listing_hash", listing_hash(F.col("sku"), F.col("current_price"), F.col("original_price")))
    d = d.join(seen.select("store", "sku", "stored_hash", "stored_at"), ["store", "sku"], "left")
    live = F.timestamp_diff("SECOND", F.col("stored_at"), F.col("seen_at")) < ttl_seconds
    same = F.coalesce(live & (F.col("stored_hash") == F.col("listing_hash")), F.lit(False))
    return d.withColumn("changed", ~same)


def change_stats(changed: DataFrame) -> DataFrame:
    return changed.groupBy("store").agg(
        F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("skipped")
    )


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list: a list endpoint's order, offset and limit."""
    return df.orderBy(*order).offset(offset).limit(limit)
