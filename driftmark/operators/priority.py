"""Which targets to scan when, as queries over the target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Factors on the scan interval.
PRIORITY_FACTORS = {"high": 1.0, "medium": 1.5, "low": 2.0}
NO_DEALS_FACTOR, MANY_DEALS_FACTOR, UNHEALTHY_FACTOR, NEW_FACTOR, VOLATILE_FACTOR = 1.25, 0.8, 1.5, 0.5, 0.7
VOLATILE_WORDS = ("flash", "lightning", "deal", "sale", "clearance")
HIGH_VALUE_WORDS = ("electronics", "computer", "gaming")
# Error text -> seconds without scans, tried in order.
ERROR_COOLDOWNS = {
    "HTTP 403": 8 * 60 * 60, "HTTP 429": 60 * 60, "HTTP 500": 30 * 60, "HTTP 503": 30 * 60, "HTTP 504": 30 * 60,
    "ReadTimeout": 30 * 60, "ReadError": 15 * 60, "ConnectError": 30 * 60, "Blocked or bot challenge detected": 6 * 60 * 60,
}
BLOCK_COOLDOWN_HOURS, TIMEOUT_COOLDOWN_HOURS, MAX_BLOCKS = 24, 1, 3
NEW_PRODUCT_HOURS, FRESHNESS_BOOST, NEW_PRODUCT_INTERVAL = 24, 2.0, 1


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def hours_between(earlier: Column, later: Column) -> Column:
    return (_micros(later) - _micros(earlier)) / F.lit(3_600_000_000.0)


def effective_interval(d: DataFrame) -> DataFrame:
    """Adds ``effective_interval``: base times priority, yield, health and word factors, never below base.

    Reads ``scan_interval, priority, deals_found, last_scanned, healthy, category_name``.
    """
    name = F.lower("category_name")
    found = F.coalesce("deals_found", F.lit(0))
    f = PRIORITY_FACTORS
    m = F.when(F.col("priority") >= 8, f["high"]).when(F.col("priority") >= 5, f["medium"]).otherwise(f["low"])
    m = m * F.when((found == 0) & F.col("last_scanned").isNotNull(), NO_DEALS_FACTOR).when(found >= 5, MANY_DEALS_FACTOR).otherwise(1.0)
    m = m * F.when(~F.coalesce("healthy", F.lit(True)), UNHEALTHY_FACTOR).otherwise(1.0)
    m = m * F.when(name.rlike("new|arrival"), NEW_FACTOR).otherwise(1.0)
    m = m * F.when(name.rlike("|".join(VOLATILE_WORDS)), VOLATILE_FACTOR).otherwise(1.0)
    value = F.greatest((F.col("scan_interval") * m).cast("int"), F.col("scan_interval"), F.lit(1))
    return d.withColumn("effective_interval", value)


def error_cooldown(error: Column) -> Column:
    """Seconds of rest for an error text; NULL when none is set."""
    low = F.lower(error)
    out = F.when(F.lit(False), F.lit(0))
    for word, seconds in ERROR_COOLDOWNS.items():
        out = out.when(low.contains(word.lower()), seconds)
    return out


def target_priority(d: DataFrame, now: Column) -> DataFrame:
    """Adds ``scan_score`` and the focused scanner's ``focus_score``.

    Reads ``priority, deals_found, category_name, category_url, last_error, last_error_at``.
    """
    from driftmark.functions.text import section_flags

    found = F.coalesce("deals_found", F.lit(0))
    yielded = F.when(found >= 5, 2.0).when(found > 0, 1.0).otherwise(0.0)
    since = hours_between(F.col("last_error_at"), now)
    failed = F.length("last_error") > 0
    drop = F.when(failed & (since < 1), 2.0).when(failed & (since < 6), 1.0).otherwise(0.0)
    value = F.when(F.lower("category_name").rlike("|".join(HIGH_VALUE_WORDS)), 1.5).otherwise(0.0)
    flags = section_flags(F.col("category_name"), F.col("category_url"))
    base = F.col("priority").cast("double")
    focus = base + F.when(flags["is_high_value"], 3.0).otherwise(0.0) + F.when(flags["is_deal_section"], 2.0).otherwise(0.0) + yielded
    return d.withColumns({"scan_score": F.greatest(F.lit(0.0), base + yielded + value - drop), "focus_score": focus})


def due_targets(d: DataFrame, now: Column) -> DataFrame:
    """Enabled targets that are due and not resting; order by ``scan_score`` to work through them."""
    d = target_priority(effective_interval(d), now).filter("enabled")
    waited = _micros(now) - _micros(F.col("last_scanned"))
    due = F.col("last_scanned").isNull() | (waited >= F.col("effective_interval").cast("long") * 60_000_000)
    rest = error_cooldown(F.col("last_error"))
    resting = F.coalesce(_micros(now) < _micros(F.col("last_error_at")) + rest.cast("long") * 1_000_000, F.lit(False))
    return d.filter(due & ~resting)


def scan_order() -> list[Column]:
    return [F.desc("scan_score"), F.desc("priority"), F.asc_nulls_first("last_scanned"), F.asc("target_id")]


def is_not_found(error: Column) -> Column:
    low = F.lower(error)
    return low.contains("http 404") | low.contains("http 410") | low.contains("page not found") | (low.contains("404") & low.contains("not found"))


def is_blocked(error: Column) -> Column:
    return F.lower(error).rlike("blocked|403|forbidden|captcha|bot challenge")


def target_state(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Target table after its scan results: enabled, broken, resting until, last error.

    ``results`` holds ``target_id, scanned_at, result_id, error, outcome``.  The run of blocked results at
    the end of a target's log decides on switching it off; it is the count of results after the last
    one that was not blocked, so no window over a whole log is needed.
    """
    at = F.struct("scanned_at", "result_id")
    blocked = F.coalesce((F.col("outcome") == "blocked") | is_blocked(F.col("error")), F.lit(False)) & F.col("error").isNotNull()
    r = results.withColumn("_blocked", blocked)
    ends = r.groupBy("target_id").agg(
        F.max(F.struct("scanned_at", "result_id", "error", "outcome", "_blocked")).alias("last"), F.max(F.when(~F.col("_blocked"), at)).alias("last_clear")
    )
    runs = r.join(ends.select("target_id", "last_clear"), "target_id").filter(F.col("last_clear").isNull() | (at > F.col("last_clear")))
    runs = runs.groupBy("target_id").agg(F.count("*").alias("blocked_run"))
    d = targets.join(ends, "target_id", "left").join(runs, "target_id", "left")
    error, outcome, when = F.col("last.error"), F.col("last.outcome"), F.col("last.scanned_at")
    gone = F.coalesce((outcome == "not_found") | is_not_found(error), F.lit(False)) & error.isNotNull()
    shut = F.col("last._blocked") & ~gone
    off = shut & (F.coalesce("blocked_run", F.lit(0)) >= MAX_BLOCKS)
    wait = outcome.isin("timeout", "retryable_network")

    def later(seconds: Column) -> Column:
        return F.timestamp_add("SECOND", seconds, when)

    rest = (
        F.when(error.isNull() | gone | off, F.lit(None).cast("timestamp_ntz"))
        .when(shut, later(F.lit(BLOCK_COOLDOWN_HOURS * 3600)))
        .when(wait, later(F.lit(TIMEOUT_COOLDOWN_HOURS * 3600)))
        .when(outcome == "parsing_empty", F.lit(None).cast("timestamp_ntz"))
        .otherwise(later(error_cooldown(error)))
    )
    seen = F.col("last").isNotNull()
    return d.withColumns(
        {
            "enabled": F.col("enabled") & ~F.coalesce(gone | off, F.lit(False)),
            "broken_url": F.when(seen, F.coalesce(gone, F.lit(False))).otherwise(False),
            "cooldown_until": F.when(seen, rest),
            "last_error": F.when(seen, error).otherwise(F.col("last_error")),
            "last_scanned": F.coalesce(when, F.col("last_scanned")),
        }
    ).drop("last", "last_clear", "blocked_run")


def freshness(d: DataFrame, now: Column, hours: float = NEW_PRODUCT_HOURS) -> DataFrame:
    """Adds ``age_hours``, ``is_new`` and ``freshness``: 1 in the first hour, then falling to a half, 0 when old."""
    age = hours_between(F.col("created_at"), now)
    d = d.withColumn("age_hours", age)
    score = F.when(F.col("age_hours") < 1, 1.0).when(F.col("age_hours") >= hours, 0.0).otherwise(F.lit(1.0) - F.col("age_hours") / hours * 0.5)
    return d.withColumns({"is_new": F.col("age_hours") < hours, "freshness": score})


def new_product_counts(d: DataFrame) -> DataFrame:
    return d.groupBy("store").agg(F.count_if("is_new").alias("new_products"), F.count("*").alias("products"))


def fresh_boost(d: DataFrame) -> DataFrame:
    """Adds ``boosted_priority`` and ``scan_interval`` of fresh products. Reads ``base_priority, base_interval``."""
    boost = F.lit(1.0) + F.col("freshness") * (FRESHNESS_BOOST - 1.0)
    return d.withColumns(
        {
            "boosted_priority": F.when(F.col("is_new"), F.col("base_priority") * boost).otherwise(F.col("base_priority")),
            "scan_interval": F.when(F.col("is_new"), F.least(F.lit(NEW_PRODUCT_INTERVAL), F.col("base_interval"))).otherwise(F.col("base_interval")),
        }
    )
