"""Price statistics and baselines, one wide aggregate for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftmark import params
from driftmark.functions.numbers import clamp, mean_of_decimals, percent_off, positive
from driftmark.operators import skew


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def history_scan(history: DataFrame, order, as_of: Column | None = None, days: int | None = None, limit: int | None = None) -> DataFrame:
    """Newest-first slice of every product's history."""
    if days is not None:
        history = history.filter(F.col("fetched_at") >= days_before(as_of, days))
    if limit is not None:
        history = skew.newest_rows(history, ["product_id"], order, limit)
    return history


WINDOWS = (7, 30, 90)


def price_counts(history: DataFrame, as_of: Column) -> DataFrame:
    """Rows per product and positive price, in all and within each window; NULL gathers other prices.

    Equal prices combine on the map side and a product's prices spread over the reducers, so a product
    with very many rows costs its distinct prices, not its rows.
    """
    at = F.col("fetched_at")
    recent = [F.count_if(at >= days_before(as_of, d)).alias(f"n{d}") for d in WINDOWS]
    return history.groupBy("product_id", positive("price").alias("value")).agg(F.count("*").alias("n"), F.max(at).alias("last_at"), *recent)


CURRENT = {
    "price": "current_price", "original_price": "current_original", "availability": "current_availability",
    "confidence": "current_confidence", "fetched_at": "current_at",
}


def newest_and_recent(observations: DataFrame, order, recent: int = 5) -> DataFrame:
    """Each product's newest observation as ``current_…``, the price and time of the one before it, and the mean of
    the positive prices of the ``recent`` ones before it."""
    rows = skew.newest_rows(observations, ["product_id"], order, recent + 1)
    first = F.col("newest_rank") == 1
    picked = [F.max(F.when(first, F.col(c))).alias(name) for c, name in CURRENT.items()]
    second = F.col("newest_rank") == 2
    picked += [F.max(F.when(second, F.col("price"))).alias("last_price"), F.max(F.when(second, F.col("fetched_at"))).alias("last_at")]
    before = F.when(~first & (F.col("price") > 0), F.col("price"))
    return rows.groupBy("product_id").agg(*picked, mean_of_decimals(before).alias("recent_mean"))


def without_current(counts: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Takes each product's newest observation out of its counts and puts it beside them."""
    d = counts.drop("last_at").join(current, "product_id")
    own = F.col("value").eqNullSafe(positive("current_price"))
    less = {"n": F.col("n") - own.cast("int")}
    for days in WINDOWS:
        less[f"n{days}"] = F.col(f"n{days}") - (own & (F.col("current_at") >= days_before(as_of, days))).cast("int")
    return d.withColumns(less).filter(F.col("n") > 0)


def profile_of_counts(counts: DataFrame, beside=()) -> DataFrame:
    """Every statistic of a product from its price counts; unused ones are pruned by Catalyst.

    Medians and quartiles are read off running counts over the distinct prices.  Deviations are taken
    from the lowest price, so a constant price has a deviation of exactly zero.
    """
    whole = W.partitionBy("product_id")
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    priced = F.col("value").isNotNull()
    windows = [d for d in WINDOWS if d != 7]
    d = counts.withColumns({f"p{x}": F.when(priced, F.col(f"n{x}")).otherwise(0) for x in ("", *WINDOWS)})
    d = d.withColumns({
        **{f"c{x}": F.sum(f"p{x}").over(upto) for x in ("", *windows)}, **{f"t{x}": F.sum(f"p{x}").over(whole) for x in ("", *windows)},
        "over_low": F.col("value") - F.min("value").over(whole),
    })

    def at(position: Column, x: str = "") -> Column:
        return F.min(F.when(F.col(f"c{x}") > position, F.col("value")))

    def median(x: str = "") -> Column:
        t = F.col(f"t{x}")
        return (at(F.floor((t - 1) / 2), x).cast("double") + at(F.floor(t / 2), x).cast("double")) / 2

    def mean(x: str) -> Column:
        n = F.sum(f"p{x}")
        return F.sum(F.col("value") * F.col(f"p{x}")).cast("double") / F.nullif(n, F.lit(0))

    n = F.sum("p")
    first = F.sum(F.col("over_low").cast("double") * F.col("p"))
    second = F.sum(F.col("over_low").cast("double") * F.col("over_low").cast("double") * F.col("p"))
    variance = F.greatest(F.lit(0.0), (second - first * first / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)))
    stats = d.groupBy("product_id").agg(
        *[F.first(c).alias(c) for c in beside],
        F.sum("n").alias("observation_count"), n.alias("n"), mean("").alias("mean"), F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("std_dev"),
        median().alias("median"), F.min("value").alias("min_price"), F.max("value").alias("max_price"),
        mean("7").alias("avg_7d"), mean("30").alias("avg_30d"), median("30").alias("median_30d"), median("90").alias("median_90d"),
        at(F.floor(F.col("t") / 4)).alias("q1"), at(F.floor(F.col("t") * 3 / 4)).alias("q3"),
        *([F.max("last_at").alias("last_at")] if "last_at" in counts.columns else []),
    )
    stats = stats.withColumn("cv", F.when(F.col("mean") > 0, F.col("std_dev") / F.col("mean")))
    return stats.withColumn("stability", clamp(F.lit(1.0) - F.col("cv"), 0.0, 1.0))


def product_profile(history: DataFrame, as_of: Column) -> DataFrame:
    """Statistics and baseline inputs of every product in the history."""
    return profile_of_counts(price_counts(history, as_of))


def profile_before_newest(observations: DataFrame, order, as_of: Column) -> DataFrame:
    """Profile of each product's history before its newest observation, with that one as ``current_…``.

    The newest row is taken out of the counts, so the history is not scanned or joined again.  ``last_price`` and
    ``last_at`` are those of the history's newest row.
    """
    current = newest_and_recent(observations, order)
    beside = [*CURRENT.values(), "recent_mean", "last_price"]
    return profile_of_counts(without_current(price_counts(observations, as_of), current, as_of), beside)


def last_price(history: DataFrame, order) -> DataFrame:
    """The newest price of every product."""
    top = F.max(F.struct(*order, "price")).alias("t")
    return history.groupBy("product_id").agg(top).select(
        "product_id", F.col("t.price").alias("last_price"), F.col("t.fetched_at").alias("last_price_at")
    )


def price_statistics(profile: DataFrame) -> DataFrame:
    """Count, mean, median, deviation and spread, from three priced observations on."""
    return profile.filter(F.col("n") >= params.MIN_OBSERVATIONS).select(
        "product_id", "n", "mean", "median", "std_dev", "min_price", "max_price",
        (F.col("max_price") - F.col("min_price")).alias("price_range"), "cv",
        (F.col("cv") < params.STABLE_CV).alias("is_stable"),
    )


def current_baseline(profile: DataFrame, products: DataFrame) -> DataFrame:
    """First positive of 90-day median, 30-day median and MSRP, else the median of all."""
    p = profile.filter(F.col("n") > 0).join(products.select("product_id", "msrp"), "product_id", "left")
    msrp = positive("msrp").cast("double")
    source = (
        F.when(F.col("median_90d") > 0, "90d_median")
        .when(F.col("median_30d") > 0, "30d_median")
        .when(msrp > 0, "msrp")
        .otherwise("median_all")
    )
    value = F.coalesce(positive("median_90d"), positive("median_30d"), msrp, "median")
    return p.withColumn("current_baseline", value).withColumn("baseline_source", source)


def cached_baseline(profile: DataFrame) -> DataFrame:
    """The aggregation job's choice: 7-day mean of a stable product, else 30-day mean, else median."""
    value = (
        F.when((F.col("avg_7d") > 0) & (F.col("stability") > params.BASELINE_STABILITY), F.col("avg_7d"))
        .when(F.col("avg_30d") > 0, F.col("avg_30d"))
        .otherwise(F.col("median"))
    )
    return profile.filter(F.col("n") > 0).withColumn("current_baseline", value)


def season_factor(at) -> Column:
    """Fixed values: .85 in November and December, .80 in January, .90 in July and August."""
    m = F.month(at)
    return F.when(m.isin(11, 12), 0.85).when(m == 1, 0.80).when(m.isin(7, 8), 0.90).otherwise(1.0)


def discount_threshold(stability: Column, category: Column, at) -> Column:
    """Discount that counts as unusual, by stability, category and season."""
    base = F.when(stability > 0.8, 30.0).when(stability < 0.5, 50.0).otherwise(40.0)
    low = F.lower(F.coalesce(category, F.lit("")))
    by_category = (
        F.when(low.contains("electronics") | low.contains("computer"), F.least(base, F.lit(35.0)))
        .when(low.contains("apparel") | low.contains("clothing"), F.greatest(base, F.lit(50.0)))
        .otherwise(base)
    )
    return by_category * season_factor(at)


def baseline_discount(current: Column, baseline: Column) -> Column:
    return F.coalesce(percent_off(current, baseline), F.lit(0.0))


def z_score(current: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (current.cast("double") - mean) / std)


def percentile_from_z(z: Column) -> Column:
    return (
        F.when(z.isNull(), 50.0).when(z < -3, 0.1).when(z > 3, 99.9)
        .otherwise(clamp(F.lit(50.0) + z * 15, 0.1, 99.9))
    )


TAIL = 14


def trend_features(rows: DataFrame, order, as_of: Column, days: int = 30, before_newest: bool = False) -> DataFrame:
    """Thirty-day trend: mean, population deviation, slope over the row index, last 7 and 14 means.

    A product's rows are cut into days.  Each day gives moments of its prices over the index within the day; an index
    shifts by the number of earlier rows, so the moments of all days add up to those of the product and no row is
    joined back.  With ``before_newest`` each product's newest row is taken out of the moments of its last day.  Sums
    of DECIMAL prices are exact.
    """
    recent = skew.with_slice(rows.filter(F.col("fetched_at") >= days_before(as_of, days)), "fetched_at", "DAY")
    day = W.partitionBy("product_id", skew.SLICE)
    p, at, of = F.col("price"), F.col("_at"), F.col("_of")
    numbered = recent.select("product_id", skew.SLICE, "price", F.row_number().over(day.orderBy(*order)).alias("_at"), F.count("*").over(day).alias("_of"))
    sums = numbered.groupBy("product_id", skew.SLICE).agg(
        F.count("*").alias("size"), F.sum(p).alias("s"), F.sum(p * p).alias("ss"), F.sum(p * at).alias("sp"),
        F.max(F.when(at == of, p)).alias("last"), F.min(F.when(at < of, p)).alias("low"), F.max(F.when(at < of, p)).alias("high"),
        F.collect_list(F.when(at >= of - TAIL, F.struct(at.alias("at"), p.alias("p")))).alias("tail"),
    )
    by_day = W.partitionBy("product_id").orderBy(skew.SLICE)
    before = F.coalesce(F.sum("size").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"before": before, "final": F.lead("size").over(by_day).isNull() & F.lit(before_newest)})

    def less(value: str, newest: Column) -> Column:
        return F.when(F.col("final"), F.col(value) - newest).otherwise(F.col(value))

    last = F.col("last")
    d = sums.select(
        "product_id", less("size", F.lit(1)).alias("n"), less("s", last).alias("s"), less("ss", last * last).alias("ss"),
        (less("sp", last * F.col("size")) + F.col("before") * less("s", last)).alias("sp"),
        *[F.when(F.col("final"), F.col(c)).otherwise(f(c, "last")).alias(c) for c, f in (("low", F.least), ("high", F.greatest))],
        F.transform(F.filter("tail", lambda x: ~F.col("final") | (x["at"] < F.col("size"))), lambda x: F.struct((x["at"] + F.col("before")).alias("at"), x["p"].alias("p"))).alias("tail"),
    )
    d = d.groupBy("product_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "ss", "sp")], F.min("low").alias("min_price"), F.max("high").alias("max_price"),
        F.slice(F.reverse(F.sort_array(F.flatten(F.collect_list("tail")))), 1, TAIL).alias("tail"),
    ).filter(F.col("n") > 0)
    n, mean = F.col("n"), F.col("s").cast("double") / F.col("n")
    spread = (n * F.col("ss") - F.col("s") * F.col("s")).cast("double") / (n * n)
    slope = (n * F.col("sp") * 2 - n * (n + 1) * F.col("s")).cast("double") * 6 / (n.cast("double") * n * (n.cast("double") * n - 1))

    def newest(k: int) -> Column:
        total = F.aggregate(F.slice("tail", 1, k), F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x["p"]).cast("decimal(38,6)"))
        return F.when(n >= k, total.cast("double") / k).otherwise(mean)

    std = F.sqrt(F.greatest(spread, F.lit(0.0)))
    return d.select(
        "product_id", n.alias("price_count"), mean.alias("avg_price"), std.alias("std_price"), F.when(n >= 2, slope).otherwise(0.0).alias("trend_slope"),
        newest(7).alias("ma_7"), newest(14).alias("ma_14"), "min_price", "max_price", F.when(mean > 0, std / mean).otherwise(0.0).alias("price_volatility"),
    )


def velocity_features(rows: DataFrame, order, as_of: Column, hours: int = 24, before_newest: bool = False) -> DataFrame:
    """Price changes within the last day; products with fewer than two rows are left out.

    With ``before_newest`` each product's newest row is left out: of a product with rows this recent it is one of them.
    """
    recent = rows.filter(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    lagged = skew.sliced_lag(recent, ["product_id"], order, ["price"], "HOUR")
    if before_newest:
        newest = recent.groupBy("product_id").agg(F.max(F.struct(*order)).alias("_newest"))
        lagged = lagged.join(newest, "product_id").filter(F.struct(*order) < F.col("_newest"))
    change = F.abs(F.col("price") - F.col("prev_price"))
    hours_span = (
        F.unix_micros(F.max("fetched_at").cast("timestamp")) - F.unix_micros(F.min("fetched_at").cast("timestamp"))
    ) / F.lit(3_600_000_000.0)
    changes = F.count_if(change > F.lit("0.01").cast("decimal(10,2)"))
    return (
        lagged.groupBy("product_id")
        .agg(
            F.count("*").alias("rows_24h"),
            changes.alias("price_changes_24h"),
            F.max(change).alias("max_change_24h"),
            mean_of_decimals(change).alias("avg_change_24h"),
            F.when(hours_span > 0, changes / F.greatest(hours_span, F.lit(0.1))).otherwise(0.0).alias("price_change_rate"),
        )
        .filter(F.col("rows_24h") >= 2)
    )


def recent_with_current(observations: DataFrame, order, limit: int) -> DataFrame:
    """The newest ``limit`` rows before each product's newest one, with its price as ``current_price``.

    All come out of one group-limited ranking; the history is not joined.
    """
    rows = skew.newest_rows(observations, ["product_id"], order, limit + 1)
    rank = F.col("newest_rank")
    rows = rows.withColumn("current_price", F.max(F.when(rank == 1, F.col("price"))).over(W.partitionBy("product_id")))
    return rows.filter(rank > 1).withColumn("newest_rank", rank - 1)


def statistical_features(observations: DataFrame, order, limit: int = 100) -> DataFrame:
    """Deviation, empirical percentile and relative deviation of each product's newest price against the 100 before it."""
    p = F.col("price").cast("double")
    cur = F.col("current_price")
    agg = recent_with_current(observations, order, limit).groupBy("product_id", "current_price").agg(
        mean_of_decimals("price").alias("mean_price"),
        F.when(F.count("*") > 1, F.stddev_pop(p)).otherwise(1.0).alias("std_price"),
        (F.count_if(F.col("price") <= cur) / F.count("*")).alias("percentile"),
    )
    off = cur.cast("double") - F.col("mean_price")
    return agg.withColumn("z_score", off / F.greatest("std_price", F.lit(0.01))).withColumn(
        "price_deviation", off / F.greatest("mean_price", F.lit(0.01))
    )
