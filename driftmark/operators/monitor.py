"""Monitoring aggregates over request, job, alert and feedback logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftmark.operators import skew
from driftmark.operators.priority import hours_between

# Adaptive delay.
BASE_DELAY, MAX_DELAY, ERROR_RATE_LIMIT, HIGH_LATENCY_MS, CAUTION_SECONDS = 2.0, 30.0, 0.3, 5000.0, 300


def store_health(requests: DataFrame, last: int = 100) -> DataFrame:
    """Health of each store over its last 100 requests, its run of failures and last 429 and block.

    The run of failures is the count of requests after the last success.
    """
    at = F.struct("ts", "request_id")
    totals = requests.groupBy("store").agg(
        F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"),
        F.max(F.when(F.col("status_code") == 429, F.col("ts"))).alias("last_429_at"),
        F.max(F.when(F.col("blocked"), F.col("ts"))).alias("last_block_at"), F.max(F.when(F.col("success"), at)).alias("last_ok"),
    )
    recent = skew.newest_rows(requests, ["store"], ["ts", "request_id"], last).groupBy("store").agg(
        (F.lit(1.0) - F.count_if("success") / F.count("*")).alias("error_rate"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("duration_ms"))), F.lit(0.0)).alias("avg_response_ms"),
    )
    tail = requests.join(totals.select("store", "last_ok"), "store").filter(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    tail = tail.groupBy("store").agg(F.count("*").alias("consecutive_failures"))
    d = totals.drop("last_ok").join(recent, "store").join(tail, "store", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    rate, run = F.col("error_rate"), F.col("consecutive_failures")
    status = F.when(rate > 0.5, "critical").when(rate > 0.2, "degraded").when(run > 3, "warning").otherwise("healthy")
    return d.withColumns({"status": status, "healthy": (run < 10) & (rate <= 0.8)})


def recommended_delay(health: DataFrame, now: Column) -> DataFrame:
    """Adds ``recommended_delay``: the base delay times the factors of errors, 429s, blocks, latency and failures."""
    def since(c: str) -> Column:
        return hours_between(F.col(c), now) * 3600

    def backoff(c: str, most: float) -> Column:
        t = since(c)
        return F.when(t < CAUTION_SECONDS, F.lit(1.0) + most * (F.lit(1.0) - t / CAUTION_SECONDS)).otherwise(1.0)

    delay = (
        F.lit(BASE_DELAY)
        * F.when(F.col("error_rate") > ERROR_RATE_LIMIT, F.lit(1.0) + F.col("error_rate") * 2).otherwise(1.0)
        * backoff("last_429_at", 3.0) * backoff("last_block_at", 2.0)
        * F.when(F.col("avg_response_ms") > HIGH_LATENCY_MS, 1.5).otherwise(1.0)
        * F.when(F.col("consecutive_failures") > 0, F.least(F.lit(1.0) + F.col("consecutive_failures") * 0.5, F.lit(5.0))).otherwise(1.0)
    )
    return health.withColumn("recommended_delay", F.least(delay, F.lit(MAX_DELAY)))


def latency_percentiles(requests: DataFrame, key: str, last: int = 100, least: int = 5, slow_ms: float = 2000.0) -> DataFrame:
    """Positional p50, p95 and p99 of the newest 100 latencies per key, from five on.

    Small samples take the maximum for p95 (up to 20) and p99 (up to 50).
    """
    newest = skew.newest_rows(requests, [key], ["ts", "request_id"], last)
    d = newest.groupBy(key).agg(F.sort_array(F.collect_list("duration_ms")).alias("s"), F.avg("duration_ms").alias("avg_ms"))
    n = F.size("s")
    d = d.filter(n >= least)

    def at(position: Column) -> Column:
        return F.get("s", position.cast("int"))

    d = d.select(
        key, n.cast("long").alias("samples"), at(F.floor(n / 2)).alias("p50"), F.when(n > 20, at(F.floor(n * 0.95))).otherwise(at(n - 1)).alias("p95"),
        F.when(n > 50, at(F.floor(n * 0.99))).otherwise(at(n - 1)).alias("p99"), "avg_ms", at(F.lit(0)).alias("min_ms"), at(n - 1).alias("max_ms"),
    )
    return d.withColumn("is_slow", F.col("p95") > slow_ms)


def source_stats(requests: DataFrame, unit: str = "DAY") -> DataFrame:
    """Counts, success rate, smoothed latency and times per source.

    The smoothing ``avg = .9 avg + .1 x`` is a weighted sum: a success k successes before the last one
    weighs ``.1 * .9**k``, the first one ``.9**(n-1)``.
    """
    ok = requests.filter("success").select("source_id", "ts", "request_id", "duration_ms")
    ranked = skew.sliced_rank(ok, ["source_id"], ["ts", "request_id"], unit, "pos")
    sizes = ok.groupBy("source_id").agg(F.count("*").alias("n"))
    back = F.col("n") - F.col("pos")
    weight = F.pow(F.lit(0.9), back.cast("double")) * F.when(F.col("pos") == 1, 1.0).otherwise(0.1)
    smooth = ranked.join(sizes, "source_id").groupBy("source_id").agg(F.sum(weight * F.col("duration_ms")).alias("avg_latency_ms"))
    d = requests.groupBy("source_id").agg(
        F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"), F.count_if(~F.col("success")).alias("failed_requests"),
        F.max("ts").alias("last_used"), F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"),
    )
    d = d.withColumn("success_rate", F.col("successful_requests") / F.col("total_requests"))
    return d.join(smooth, "source_id", "left").withColumn("avg_latency_ms", F.coalesce("avg_latency_ms", F.lit(0.0)))


def traffic_cost(megabytes: Column, cost_per_gb: Column) -> Column:
    return megabytes / 1024 * cost_per_gb


def source_health_score(stats: DataFrame, now: Column) -> DataFrame:
    """Adds ``health_score``: success, latency and recency, less the cost of paid sources."""
    since = hours_between(F.col("last_success"), now)
    latency = F.when(F.col("avg_latency_ms") > 0, F.greatest(F.lit(0.0), F.lit(30.0) - F.col("avg_latency_ms") / 100)).otherwise(15.0)
    recent = F.when(since < 1, 10.0).when(since < 24, 5.0).otherwise(0.0)
    cost = F.when((F.col("source_type") == "residential") & (F.col("cost_per_gb") > 10), 10.0).when(
        (F.col("source_type") == "residential") & (F.col("cost_per_gb") > 5), 5.0).otherwise(0.0)
    return stats.withColumn("health_score", F.greatest(F.lit(0.0), F.col("success_rate") * 50 + latency + recent - cost))


def best_source(scored: DataFrame, pool: str) -> DataFrame:
    """The best source of each pool; the smaller id wins ties."""
    top = F.max(F.struct("health_score", (-F.col("source_id")).alias("neg"))).alias("t")
    return scored.groupBy(pool).agg(top).select(pool, (-F.col("t.neg")).alias("source_id"), F.col("t.health_score").alias("health_score"))


def source_summary(stats: DataFrame, fail_limit: int = 5) -> DataFrame:
    return stats.groupBy("source_type").agg(
        F.count("*").alias("sources"), F.avg("success_rate").alias("avg_success_rate"), F.avg("avg_latency_ms").alias("avg_latency_ms"),
        F.count_if(F.col("success_rate") < 0.5).alias("unhealthy"), F.count_if(F.col("failed_requests") >= fail_limit).alias("to_disable"),
    )


# Fetch strategies, cheapest first.
STRATEGIES = ("static", "static_js_headers", "headless", "headless_stealth")


def strategy_stats(requests: DataFrame) -> DataFrame:
    """Successes and failures per store and strategy, zeros included."""
    counts = requests.groupBy("store", "strategy").agg(F.count_if("success").alias("s"), F.count_if(~F.col("success")).alias("f"))
    grid = counts.select("store").distinct().withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in STRATEGIES])))
    d = grid.join(counts, ["store", "strategy"], "left")
    s, f = F.coalesce("s", F.lit(0)), F.coalesce("f", F.lit(0))
    rate = F.when(s + f > 0, s / F.nullif(s + f, F.lit(0))).otherwise(0.0)
    return d.select("store", "strategy", s.alias("success"), f.alias("failure"), (s + f).alias("total"), rate.alias("rate"))


def scan_stats(jobs: DataFrame, now: Column) -> DataFrame:
    done = F.col("status") == "completed"
    total = F.col("success_count") + F.col("error_count")
    rate = F.when(done & (total > 0), F.col("success_count") / F.nullif(total, F.lit(0)))
    return jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if(F.col("created_at") >= F.date_trunc("DAY", now).cast("timestamp_ntz")).alias("jobs_today"),
        F.coalesce(F.sum("products_found"), F.lit(0)).alias("total_products"), F.coalesce(F.sum("deals_found"), F.lit(0)).alias("total_deals"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("average_success_rate"), F.max(F.when(done, F.col("completed_at"))).alias("last_scan_at"),
    )


def store_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store").agg(F.count("*").alias("total"), F.sum(F.col("enabled").cast("int")).alias("enabled"))


def dashboard_stats(products: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    today = F.date_trunc("DAY", now).cast("timestamp_ntz")
    sent = alerts.filter(F.col("sent_at") >= today).agg(F.count("*")).scalar()
    return products.agg(F.count("*").alias("products"), F.count_distinct("store").alias("stores")).withColumn("alerts_today", sent)


def scan_log(rows: DataFrame, order, limit: int = 100, shown: int = 50) -> DataFrame:
    """Newest entries with the price change in percent; ``shown_title`` has at most ``shown`` characters of the title."""
    change = F.when(F.col("prev_price") > 0, (F.col("price") - F.col("prev_price")).cast("double") / F.col("prev_price").cast("double") * 100)
    title = F.when(F.length("title") > shown, F.concat(F.substring("title", 1, shown), F.lit("..."))).otherwise(F.col("title"))
    return rows.orderBy(*order).limit(limit).withColumns({"price_change": change, "shown_title": title})


def job_rollup(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Progress, products, deals and errors per run. ``runs`` holds ``run_id, total_items``."""
    d = results.groupBy("run_id").agg(
        F.count("*").alias("completed"), F.sum("products_found").alias("products"), F.sum("deals_found").alias("deals"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    d = runs.join(d, "run_id", "left").na.fill(0, ["completed", "products", "deals", "errors"])
    percent = F.when(F.col("total_items") > 0, F.col("completed") / F.nullif("total_items", F.lit(0)) * 100).otherwise(0.0)
    return d.withColumns({"progress_percent": percent, "is_complete": F.col("completed") >= F.col("total_items")})


def metric_increase(events: DataFrame, ts: str, labels, length: str, slide: str | None = None) -> DataFrame:
    """Events per label and window."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    d = events.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("increase"))
    return d.select(F.col("w.start").alias("window_start"), *labels, "increase")


def success_ratio(requests: DataFrame, length: str = "5 minutes") -> DataFrame:
    d = requests.groupBy(F.window("ts", length).alias("w"), "store").agg((F.avg(F.col("success").cast("double")) * 100).alias("success_percent"))
    return d.select(F.col("w.start").alias("window_start"), "store", "success_percent")


def duration_quantiles(requests: DataFrame, length: str = "5 minutes", exact: bool = False) -> DataFrame:
    """p50, p95 and p99 of durations per store and window; approximate unless asked otherwise."""
    points = (0.5, 0.95, 0.99)
    q = F.percentile("duration_ms", F.array(*[F.lit(p) for p in points])) if exact else F.percentile_approx("duration_ms", list(points), 1000)
    d = requests.groupBy(F.window("ts", length).alias("w"), "store").agg(q.alias("q"))
    return d.select(F.col("w.start").alias("window_start"), "store", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def false_positive_rate(alerts: DataFrame, keys) -> DataFrame:
    fp = F.count_if(F.col("false_positive_count") > 0)
    return alerts.groupBy(*keys).agg(F.count("*").alias("total"), fp.alias("false_positives"), (fp / F.count("*")).alias("false_positive_rate"))


def confidence_adjustment(rate: Column) -> Column:
    return F.when(rate > 0.5, 0.5).when(rate > 0.3, 0.7).when(rate > 0.1, 0.9).otherwise(1.0)


def adjust_confidence(deals: DataFrame, rates: DataFrame, key: str = "store") -> DataFrame:
    d = deals.join(rates.select(key, "false_positive_rate"), key, "left")
    factor = confidence_adjustment(F.coalesce("false_positive_rate", F.lit(0.0)))
    return d.withColumn("adjusted_confidence", F.col("confidence") * factor)


def feedback_accuracy(feedback: DataFrame) -> DataFrame:
    judged = F.count("is_correct")
    right = F.count_if("is_correct")
    return feedback.groupBy("task_type", "model_name").agg(
        F.count("*").alias("total"), judged.alias("validated"), right.alias("correct"), (judged - right).alias("incorrect"),
        F.coalesce(right / F.nullif(judged, F.lit(0)), F.lit(0.0)).alias("accuracy"),
    )


def corrected_examples(feedback: DataFrame, task: str, model: str, limit: int | None = None) -> DataFrame:
    """Corrected outputs of one task and model, newest first; write with the JSON sink."""
    d = feedback.filter((F.col("task_type") == task) & (F.col("model_name") == model) & F.col("user_correction").isNotNull())
    d = d.orderBy(F.desc("created_at"), F.desc("feedback_id"))
    d = d.limit(limit) if limit else d
    return d.select("feedback_id", F.col("output").alias("input"), F.col("user_correction").alias("output"), "notes")


def token_cost(usage: DataFrame, daily_limit: float = 10.0) -> DataFrame:
    """Cost per day against the limit. Dollars per thousand tokens of the two price classes."""
    dear = F.lower("model").contains("gpt-4")
    cost = F.col("prompt_tokens") / 1000 * F.when(dear, 0.01).otherwise(0.0015) + F.col("completion_tokens") / 1000 * F.when(dear, 0.03).otherwise(0.002)
    return usage.groupBy("day").agg(F.sum(cost).alias("cost")).withColumn("over_limit", F.col("cost") >= daily_limit)


def stale_jobs(jobs: DataFrame, heartbeats: DataFrame, now: Column, limit_seconds: int = 7200, heartbeat_seconds: int = 300) -> DataFrame:
    """Running jobs that ran too long or stopped reporting, marked failed with the reason."""
    newest = heartbeats.groupBy("run_id").agg(F.max("beat_at").alias("beat_at"))
    d = jobs.join(newest, "run_id", "left")
    elapsed = hours_between(F.col("started_at"), now) * 3600
    silent = hours_between(F.col("beat_at"), now) * 3600
    why = F.when(
        F.col("status") == "running",
        F.when(elapsed > limit_seconds, "exceeded max duration")
        .when(F.col("beat_at").isNull() & (elapsed > heartbeat_seconds), "missing heartbeat")
        .when(silent > heartbeat_seconds, "stale heartbeat"),
    )
    d = d.withColumn("stale_reason", why)
    return d.withColumns({
        "status": F.when(F.col("stale_reason").isNotNull(), "failed").otherwise(F.col("status")),
        "completed_at": F.when(F.col("stale_reason").isNotNull(), now).otherwise(F.col("completed_at")),
    })
