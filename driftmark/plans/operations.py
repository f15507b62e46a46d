"""Prioritisation and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions.numbers import round_to
from driftmark.operators import monitor as V, priority as H, skew
from driftmark.plans.listings import found_deals, with_deals
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import N_STORES, STORES, r, with_views
from driftmark.sources.tables import Tables, pick

NAMES = ("Electronics Deals", "New Arrivals", "Home", "Gaming Laptops", "Clearance", "Books", "Flash Sale", "Computers")
ERRORS = ("HTTP 403 Forbidden", "ReadTimeout: x", "odd failure", "", "HTTP 503", "blocked or bot challenge detected")


def targets(t: Tables):
    k, now = F.col("c_custkey"), t.as_of()

    def ago(minutes):
        return F.timestamp_add("MINUTE", -minutes, now)

    return t.raw("customer").select(
        k.alias("target_id"), pick(params.TEST_STORES, k % N_STORES).alias("store"), pick(NAMES, k % 8).alias("category_name"), F.lit("https://c.example/x").alias("category_url"),
        ((k % 6 + 1) * 5).cast("int").alias("scan_interval"), (k % 10 + 1).cast("int").alias("priority"), F.when(k % 9 != 0, (k % 8).cast("int")).alias("deals_found"), (k % 12 != 11).alias("enabled"),
        (k % 11 != 0).alias("healthy"), F.when(k % 7 != 0, ago((k % 97).cast("int"))).alias("last_scanned"),
        F.when(k % 5 < 2, pick(ERRORS, k % 6)).alias("last_error"), F.when(k % 5 < 2, ago((k % 500).cast("int"))).alias("last_error_at"),
    )


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


TARGET_SQL = f""", tg AS (SELECT c_custkey AS target_id, ({STORES})[1 + c_custkey % {N_STORES}] AS store, ({_list(NAMES)})[1 + c_custkey % 8] AS category_name, CAST((c_custkey % 6 + 1) * 5 AS INT) AS base, CAST(c_custkey % 10 + 1 AS INT) AS priority,
      CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 8 END AS deals_found, c_custkey % 12 <> 11 AS enabled, c_custkey % 11 <> 0 AS healthy, CASE WHEN c_custkey % 7 <> 0 THEN as_of - to_minutes(c_custkey % 97) END AS last_scanned,
      CASE WHEN c_custkey % 5 < 2 THEN ({_list(ERRORS)})[1 + c_custkey % 6] END AS last_error, CASE WHEN c_custkey % 5 < 2 THEN as_of - to_minutes(c_custkey % 500) END AS last_error_at, as_of FROM customer, ref_time),
    tgm AS (SELECT *, lower(category_name) AS nm, coalesce(deals_found, 0) AS df FROM tg),
    tgi AS (SELECT *, greatest(CAST(trunc(base * (CASE WHEN priority >= 8 THEN 1.0 WHEN priority >= 5 THEN 1.5 ELSE 2.0 END::DOUBLE * CASE WHEN df = 0 AND last_scanned IS NOT NULL THEN 1.25 WHEN df >= 5 THEN 0.8 ELSE 1.0 END::DOUBLE
        * CASE WHEN healthy THEN 1.0 ELSE 1.5 END::DOUBLE * CASE WHEN regexp_matches(nm, 'new|arrival') THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN regexp_matches(nm, 'flash|lightning|deal|sale|clearance') THEN 0.7 ELSE 1.0 END::DOUBLE)) AS INT), base, 1) AS eff,
      CASE WHEN contains(lower(last_error), 'http 403') THEN 28800 WHEN contains(lower(last_error), 'http 503') THEN 1800 WHEN contains(lower(last_error), 'readtimeout') THEN 1800 WHEN contains(lower(last_error), 'blocked or bot challenge detected') THEN 21600 END AS rest,
      epoch(as_of - last_error_at) / 3600 AS eh FROM tgm),
    tgs AS (SELECT *, greatest(0.0, priority + CASE WHEN df >= 5 THEN 2 WHEN df > 0 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(nm, 'electronics|computer|gaming') THEN 1.5 ELSE 0 END - CASE WHEN length(last_error) > 0 AND eh < 1 THEN 2 WHEN length(last_error) > 0 AND eh < 6 THEN 1 ELSE 0 END) AS score,
      priority + CASE WHEN regexp_matches(nm, 'electronics|computers|gaming|laptops|tablets|phones|cameras|tvs|monitors') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(nm, 'clearance|deal|sale|discount|outlet|bargain') THEN 2 ELSE 0 END + CASE WHEN df >= 5 THEN 2 WHEN df > 0 THEN 1 ELSE 0 END AS focus FROM tgi)
"""


@query("h01_effective_interval", with_views("ref_time", body=TARGET_SQL + "SELECT target_id, eff AS effective_interval FROM tgi"))
def effective_interval(t: Tables):
    return H.effective_interval(targets(t)).select("target_id", "effective_interval")


@query("h02_due_targets", with_views("ref_time", body=TARGET_SQL + f"""
    SELECT target_id, {r('score')} AS scan_score, row_number() OVER (ORDER BY score DESC, priority DESC, last_scanned NULLS FIRST, target_id) AS place FROM tgs
    WHERE enabled AND (last_scanned IS NULL OR epoch(as_of - last_scanned) >= eff * 60) AND NOT coalesce(epoch(as_of - last_error_at) < rest, false) ORDER BY place LIMIT 100"""))
def due_targets(t: Tables):
    from pyspark.sql import Window as W

    top = H.due_targets(targets(t), t.as_of()).orderBy(*H.scan_order()).limit(100)
    # the hundred next targets are numbered after the limit
    place = F.row_number().over(W.orderBy(*H.scan_order()))
    return top.select("target_id", round_to("scan_score").alias("scan_score"), place.cast("long").alias("place"))


@query("h03_target_priority", with_views("ref_time", body=TARGET_SQL + f"SELECT target_id, {r('score')} AS scan_score, {r('focus')} AS focus_score FROM tgs"))
def target_priority(t: Tables):
    d = H.target_priority(targets(t), t.as_of())
    return d.select("target_id", round_to("scan_score").alias("scan_score"), round_to("focus_score").alias("focus_score"))


@query("h04_error_cooldown", with_views("ref_time", body=TARGET_SQL + "SELECT target_id, last_error, CAST(rest AS INT) AS cooldown_seconds FROM tgi"))
def error_cooldown(t: Tables):
    return targets(t).select("target_id", "last_error", H.error_cooldown(F.col("last_error")).alias("cooldown_seconds"))


OUTCOMES = ("ok", "blocked", "blocked", "timeout", "other", "blocked", "parsing_empty")


def scan_results(t: Tables):
    k = F.col("o_orderkey")
    bucket = (k * k % 11) % 7
    error = (
        F.when(bucket.isin(1, 2), "HTTP 403").when(bucket == 3, "ReadTimeout").when(bucket == 4, F.when(k % 13 == 0, "HTTP 404 not found").otherwise("HTTP 503"))
        .when(bucket == 5, "captcha page").when(bucket == 6, "no rows")
    )
    return t.raw("orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderdate").alias("scanned_at"), k.alias("result_id"), error.alias("error"), pick(OUTCOMES, bucket).alias("outcome"))


RESULT_SQL = f""", res AS (SELECT o_custkey AS target_id, o_orderdate AS done_at, o_orderkey AS id, (o_orderkey * o_orderkey % 11) % 7 AS b, CASE (o_orderkey * o_orderkey % 11) % 7 WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'HTTP 403' WHEN 3 THEN 'ReadTimeout'
      WHEN 4 THEN CASE WHEN o_orderkey % 13 = 0 THEN 'HTTP 404 not found' ELSE 'HTTP 503' END WHEN 5 THEN 'captcha page' WHEN 6 THEN 'no rows' END AS error FROM orders),
    rr AS (SELECT *, b IN (1, 2, 5) AS bl, row_number() OVER (PARTITION BY target_id ORDER BY done_at DESC, id DESC) AS rn FROM res),
    runs AS (SELECT target_id, coalesce(min(rn) FILTER (NOT bl), max(rn) + 1) - 1 AS run FROM rr GROUP BY target_id),
    ls AS (SELECT rr.*, run FROM rr JOIN runs USING (target_id) WHERE rn = 1)
"""


@query("h05_target_state_update", with_views("ref_time", body=TARGET_SQL + RESULT_SQL + """
    SELECT tg.target_id, enabled AND NOT coalesce(error = 'HTTP 404 not found' OR (bl AND run >= 3), false) AS enabled, coalesce(error = 'HTTP 404 not found', false) AS broken_url,
      CASE WHEN error IS NULL OR error = 'HTTP 404 not found' OR (bl AND run >= 3) THEN NULL WHEN bl THEN done_at + INTERVAL 24 HOUR WHEN b = 3 THEN done_at + INTERVAL 1 HOUR WHEN b = 4 THEN done_at + INTERVAL 30 MINUTE END AS cooldown_until,
      CASE WHEN ls.target_id IS NULL THEN last_error ELSE error END AS last_error FROM tg LEFT JOIN ls ON ls.target_id = tg.target_id"""))
def target_state_update(t: Tables):
    d = H.target_state(targets(t), scan_results(t))
    return d.select("target_id", "enabled", "broken_url", "cooldown_until", "last_error")


FRESH_SQL = ", cr AS (SELECT product_id, min(fetched_at) AS created_at FROM observations GROUP BY product_id), fr0 AS (SELECT p.product_id, store, epoch((SELECT max(created_at) FROM cr) - created_at) / 3600 AS age FROM products p JOIN cr USING (product_id)), fr AS (SELECT *, CASE WHEN age < 1 THEN 1 WHEN age >= 2160 THEN 0 ELSE 1 - age / 2160 * 0.5 END AS fresh FROM fr0)\n"


def fresh_products(t: Tables):
    created = t.raw("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.min("l_shipdate").alias("created_at"))
    now = created.agg(F.max("created_at")).scalar()
    return H.freshness(t.products().join(created, "product_id"), now, hours=2160)


@query("h06_freshness_score", with_views("observations", "products", body=FRESH_SQL + f"SELECT product_id, age < 2160 AS is_new, {r('fresh')} AS freshness FROM fr"))
def freshness_score(t: Tables):
    return fresh_products(t).select("product_id", "is_new", round_to("freshness").alias("freshness"))


@query("h06_new_product_counts", with_views("observations", "products", body=FRESH_SQL + "SELECT store, count(*) FILTER (age < 2160) AS new_products, count(*) AS products FROM fr GROUP BY store"))
def new_product_counts(t: Tables):
    return H.new_product_counts(fresh_products(t))


@query("h07_fresh_boost", with_views("observations", "products", body=FRESH_SQL + f"""
    SELECT product_id, {r('CASE WHEN age < 2160 THEN (product_id % 10) * (1 + fresh) ELSE product_id % 10 END')} AS boosted_priority, CAST(CASE WHEN age < 2160 THEN least(1, product_id % 6) ELSE product_id % 6 END AS INT) AS scan_interval FROM fr"""))
def fresh_boost(t: Tables):
    k = F.col("product_id")
    d = H.fresh_boost(fresh_products(t).withColumns({"base_priority": (k % 10).cast("double"), "base_interval": (k % 6).cast("int")}))
    return d.select("product_id", round_to("boosted_priority").alias("boosted_priority"), "scan_interval")


def requests(t: Tables):
    return t.requests().withColumn("blocked", F.col("status_code") == 503)


HEALTH_SQL = """, rq AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY ts DESC, request_id DESC) AS rn FROM requests),
    hl AS (SELECT store, count(*) AS total_requests, count(*) FILTER (success) AS successful_requests, max(ts) FILTER (status_code = 429) AS last_429_at, max(ts) FILTER (status_code = 503) AS last_block_at,
      1 - count(*) FILTER (success AND rn <= 100) / count(*) FILTER (rn <= 100) AS error_rate, coalesce(avg(duration_ms) FILTER (success AND rn <= 100), 0) AS avg_ms, coalesce(min(rn) FILTER (success), max(rn) + 1) - 1 AS run FROM rq GROUP BY store),
    hs AS (SELECT *, (SELECT max(ts) FROM requests) AS now FROM hl)
"""


@query("i01_store_health", with_views("requests", body=HEALTH_SQL + f"""
    SELECT store, total_requests, successful_requests, last_429_at, last_block_at, {r('error_rate')} AS error_rate, {r('avg_ms')} AS avg_response_ms, run AS consecutive_failures,
      CASE WHEN error_rate > 0.5 THEN 'critical' WHEN error_rate > 0.2 THEN 'degraded' WHEN run > 3 THEN 'warning' ELSE 'healthy' END AS status, run < 10 AND error_rate <= 0.8 AS healthy FROM hs"""))
def store_health(t: Tables):
    d = V.store_health(requests(t))
    return d.withColumns({"error_rate": round_to("error_rate"), "avg_response_ms": round_to("avg_response_ms")})


@query("i02_recommended_delay", with_views("requests", body=HEALTH_SQL + f"""
    , b AS (SELECT store, 2.0 * CASE WHEN error_rate > 0.3 THEN 1 + error_rate * 2 ELSE 1 END * CASE WHEN epoch(now - last_429_at) < 300 THEN 1 + 3.0 * (1 - epoch(now - last_429_at) / 300) ELSE 1 END
      * CASE WHEN epoch(now - last_block_at) < 300 THEN 1 + 2.0 * (1 - epoch(now - last_block_at) / 300) ELSE 1 END * CASE WHEN avg_ms > 5000 THEN 1.5 ELSE 1 END * CASE WHEN run > 0 THEN least(1 + run * 0.5, 5.0) ELSE 1 END AS delay FROM hs)
    SELECT store, {r('least(delay, 30.0)')} AS recommended_delay FROM b"""))
def recommended_delay(t: Tables):
    now = t.raw("events").agg(F.max("ts")).scalar()
    return V.recommended_delay(V.store_health(requests(t)), now).select("store", round_to("recommended_delay").alias("recommended_delay"))


@query("i03_latency_percentiles", with_views("requests", body=f"""
    , x AS (SELECT domain, duration_ms, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, request_id DESC) AS rn FROM requests),
    s AS (SELECT domain, duration_ms, row_number() OVER (PARTITION BY domain ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM x WHERE rn <= 100)
    SELECT domain, n AS samples, {r('max(duration_ms) FILTER (i = n // 2)')} AS p50, {r('max(duration_ms) FILTER (i = CASE WHEN n > 20 THEN CAST(floor(n * 0.95) AS BIGINT) ELSE n - 1 END)')} AS p95,
      {r('max(duration_ms) FILTER (i = CASE WHEN n > 50 THEN CAST(floor(n * 0.99) AS BIGINT) ELSE n - 1 END)')} AS p99, {r('avg(duration_ms)')} AS avg_ms, {r('min(duration_ms)')} AS min_ms, {r('max(duration_ms)')} AS max_ms,
      max(duration_ms) FILTER (i = CASE WHEN n > 20 THEN CAST(floor(n * 0.95) AS BIGINT) ELSE n - 1 END) > 2000 AS is_slow FROM s GROUP BY domain, n HAVING n >= 5"""))
def latency_percentiles(t: Tables):
    d = V.latency_percentiles(t.requests(), "domain")
    return d.withColumns({c: round_to(c) for c in ("p50", "p95", "p99", "avg_ms", "min_ms", "max_ms")})


def sources(t: Tables):
    k = F.col("source_id")
    d = V.source_stats(t.requests())
    return d.withColumns({"source_type": F.when(k % 3 == 0, "residential").otherwise("datacenter"), "cost_per_gb": F.when(k % 6 == 0, 12.0).when(k % 3 == 0, 6.0), "pool": k % 7})


SOURCE_SQL = """RECURSIVE , ok AS MATERIALIZED (SELECT source_id, duration_ms AS d, row_number() OVER (PARTITION BY source_id ORDER BY ts, request_id) AS rn FROM requests WHERE success),
    ew AS (SELECT source_id, rn, d AS v FROM ok WHERE rn = 1 UNION ALL SELECT o.source_id, o.rn, e.v * 0.9 + o.d * 0.1 FROM ew e JOIN ok o ON o.source_id = e.source_id AND o.rn = e.rn + 1),
    lastew AS (SELECT source_id, max_by(v, rn) AS v FROM ew GROUP BY source_id),
    ss AS (SELECT source_id, count(*) AS total_requests, count(*) FILTER (success) AS successful_requests, count(*) FILTER (NOT success) AS failed_requests, max(ts) AS last_used, max(ts) FILTER (success) AS last_success FROM requests GROUP BY source_id),
    src AS (SELECT ss.*, coalesce(v, 0) AS lat, successful_requests / total_requests AS rate, CASE WHEN source_id % 3 = 0 THEN 'residential' ELSE 'datacenter' END AS source_type, CASE WHEN source_id % 6 = 0 THEN 12.0 WHEN source_id % 3 = 0 THEN 6.0 END AS cost,
      epoch((SELECT max(ts) FROM requests) - last_success) / 3600 AS h FROM ss LEFT JOIN lastew USING (source_id)),
    sco AS (SELECT *, greatest(0.0, rate * 50 + CASE WHEN lat > 0 THEN greatest(0.0, 30 - lat / 100) ELSE 15 END + CASE WHEN h < 1 THEN 10 WHEN h < 24 THEN 5 ELSE 0 END - CASE WHEN cost > 10 THEN 10 WHEN cost > 5 THEN 5 ELSE 0 END) AS score FROM src)
"""


@query("i04_source_health_score", with_views("requests", body=SOURCE_SQL + f"SELECT source_id, {r('score')} AS health_score FROM sco"))
def source_health_score(t: Tables):
    now = t.raw("events").agg(F.max("ts")).scalar()
    return V.source_health_score(sources(t), now).select("source_id", round_to("health_score").alias("health_score"))


@query("i04_best_source", with_views("requests", body=SOURCE_SQL + f", b AS (SELECT *, row_number() OVER (PARTITION BY source_id % 7 ORDER BY score DESC, source_id) AS rk FROM sco) SELECT source_id % 7 AS pool, source_id, {r('score')} AS health_score FROM b WHERE rk = 1"))
def best_source(t: Tables):
    now = t.raw("events").agg(F.max("ts")).scalar()
    return V.best_source(V.source_health_score(sources(t), now), "pool").withColumn("health_score", round_to("health_score"))


@query("i05_source_stats", with_views("requests", body=SOURCE_SQL + f"""
    SELECT source_id, total_requests, successful_requests, failed_requests, last_used, last_success, {r('rate')} AS success_rate, {r('lat')} AS avg_latency_ms, {r('coalesce(total_requests * 0.5 / 1024 * cost, 0)')} AS cost FROM src"""))
def source_stats(t: Tables):
    d = sources(t)
    cost = F.coalesce(V.traffic_cost(F.col("total_requests") * 0.5, F.col("cost_per_gb")), F.lit(0.0))
    return d.select("source_id", "total_requests", "successful_requests", "failed_requests", "last_used", "last_success", round_to("success_rate").alias("success_rate"), round_to("avg_latency_ms").alias("avg_latency_ms"), round_to(cost).alias("cost"))


@query("i06_source_summary", with_views("requests", body=SOURCE_SQL + f"""
    SELECT source_type, count(*) AS sources, {r('avg(rate)')} AS avg_success_rate, {r('avg(lat)')} AS avg_latency_ms, count(*) FILTER (rate < 0.5) AS unhealthy, count(*) FILTER (failed_requests >= 5) AS to_disable FROM src GROUP BY source_type"""))
def source_summary(t: Tables):
    return V.source_summary(sources(t)).withColumns({"avg_success_rate": round_to("avg_success_rate"), "avg_latency_ms": round_to("avg_latency_ms")})


@query("i07_strategy_stats", with_views("requests", body=f"""
    , x AS (SELECT store, success, (['static', 'headless', 'headless_stealth'])[1 + source_id % 3] AS strategy FROM requests), g AS (SELECT DISTINCT store, s AS strategy FROM x, (SELECT unnest(['static', 'static_js_headers', 'headless', 'headless_stealth']) AS s)),
    c AS (SELECT store, strategy, count(*) FILTER (success) AS s, count(*) FILTER (NOT success) AS f FROM x GROUP BY ALL)
    SELECT store, strategy, coalesce(s, 0) AS success, coalesce(f, 0) AS failure, coalesce(s + f, 0) AS total, {r('coalesce(s / nullif(s + f, 0), 0)')} AS rate FROM g LEFT JOIN c USING (store, strategy)"""))
def strategy_stats(t: Tables):
    d = t.requests().withColumn("strategy", pick(("static", "headless", "headless_stealth"), F.col("source_id") % 3))
    return V.strategy_stats(d).withColumn("rate", round_to("rate"))


def jobs(t: Tables):
    o = t.raw("orders")
    month = F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz")
    d = o.groupBy(month.alias("started_at")).agg(
        F.count_if(F.col("o_orderstatus") != "F").alias("success_count"), F.count_if(F.col("o_orderstatus") == "F").alias("error_count"),
        F.count("*").alias("products_found"), F.count_if(F.col("o_orderstatus") == "P").alias("deals_found"), F.max("o_orderdate").alias("completed_at"),
    )
    m = F.month("started_at")
    return d.withColumns({"run_id": F.date_format("started_at", "yyyy-MM"), "created_at": F.col("started_at"), "status": F.when(m % 4 == 3, "running").when(m % 6 == 5, "failed").otherwise("completed")})


JOB_SQL = """, jb AS (SELECT date_trunc('month', o_orderdate) AS started_at, count(*) FILTER (o_orderstatus <> 'F') AS sc, count(*) FILTER (o_orderstatus = 'F') AS ec, count(*) AS pf, count(*) FILTER (o_orderstatus = 'P') AS df, max(o_orderdate) AS completed_at FROM orders GROUP BY 1),
    jobs AS (SELECT *, strftime(started_at, '%Y-%m') AS run_id, CASE WHEN month(started_at) % 4 = 3 THEN 'running' WHEN month(started_at) % 6 = 5 THEN 'failed' ELSE 'completed' END AS status FROM jb)
"""


@query("i08_scan_stats", with_views("ref_time", body=JOB_SQL + f"""
    , n AS (SELECT max(started_at) AS now FROM jobs)
    SELECT count(*) AS total_jobs, count(*) FILTER (started_at >= date_trunc('day', now)) AS jobs_today, CAST(sum(pf) AS BIGINT) AS total_products, CAST(sum(df) AS BIGINT) AS total_deals,
      {r("avg(CASE WHEN status = 'completed' THEN sc / (sc + ec) END)")} AS average_success_rate, max(completed_at) FILTER (status = 'completed') AS last_scan_at FROM jobs, n"""))
def scan_stats(t: Tables):
    j = jobs(t)
    now = j.agg(F.max("started_at")).scalar()
    return V.scan_stats(j, now).withColumn("average_success_rate", round_to("average_success_rate"))


@query("i09_store_counts", with_views("ref_time", body=TARGET_SQL + f"""
    , e AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN '*' ELSE ({STORES})[1 + s_suppkey % {N_STORES}] END AS store, s_suppkey % 13 <> 12 AS enabled FROM supplier)
    SELECT 'categories' AS kind, store, count(*) AS total, count(*) FILTER (enabled) AS enabled FROM tg GROUP BY store UNION ALL SELECT 'exclusions', store, count(*), count(*) FILTER (enabled) FROM e GROUP BY store"""))
def store_counts(t: Tables):
    from driftmark.plans.listings import exclusions

    a = V.store_counts(targets(t)).select(F.lit("categories").alias("kind"), "store", "total", "enabled")
    return a.unionByName(V.store_counts(exclusions(t)).select(F.lit("exclusions").alias("kind"), "store", "total", "enabled"))


@query("i10_dashboard_stats", with_views("products", "alerts", body="""
    SELECT (SELECT count(*) FROM products) AS products, (SELECT count(DISTINCT store) FROM products) AS stores, (SELECT count(*) FROM alerts WHERE sent_at >= date_trunc('day', (SELECT max(sent_at) FROM alerts))) AS alerts_today"""))
def dashboard_stats(t: Tables):
    return V.dashboard_stats(t.products(), t.alerts(), t.raw("orders").agg(F.max("o_orderdate")).scalar())


@query("i11_scan_log", with_views("observations", "products", body=f"""
    , s AS (SELECT o.*, lag(price) OVER (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty) AS prev_price FROM observations o),
    top AS (SELECT * FROM s ORDER BY fetched_at DESC, order_id DESC, line_no DESC, supp_id DESC, product_id LIMIT 100),
    n AS (SELECT top.*, repeat(title || ' ', 3) AS t FROM top JOIN products USING (product_id))
    SELECT product_id, order_id, line_no, price, prev_price, {r('(price - prev_price) / CAST(prev_price AS DOUBLE) * 100')} AS price_change, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS shown_title, t AS title FROM n"""))
def scan_log(t: Tables):
    seq = skew.sliced_lag(t.observations(), ["product_id"], t.NEWEST, ["price"], "YEAR")
    top = seq.join(t.products().select("product_id", F.repeat(F.concat("title", F.lit(" ")), 3).alias("title")), "product_id")
    d = V.scan_log(top, [F.desc("fetched_at"), F.desc("order_id"), F.desc("line_no"), F.desc("supp_id"), F.asc("product_id")])
    return d.select("product_id", "order_id", "line_no", "price", "prev_price", round_to("price_change").alias("price_change"), "shown_title", "title")


@query("i12_job_rollup", f"""
    WITH x AS (SELECT o_custkey % 50 AS run_id, o_custkey % 30 AS products_found, o_custkey % 4 AS deals_found, o_orderstatus = 'F' AS bad FROM orders), ru AS (SELECT c_custkey % 60 AS run_id, count(*) * 12 AS total_items FROM customer GROUP BY 1),
    a AS (SELECT run_id, count(*) AS completed, sum(products_found) AS p, sum(deals_found) AS d, count(*) FILTER (bad) AS e FROM x GROUP BY run_id)
    SELECT run_id, total_items, coalesce(completed, 0) AS completed, CAST(coalesce(p, 0) AS BIGINT) AS products, CAST(coalesce(d, 0) AS BIGINT) AS deals, coalesce(e, 0) AS errors, {r('coalesce(completed, 0) / total_items * 100')} AS progress_percent,
      coalesce(completed, 0) >= total_items AS is_complete FROM ru LEFT JOIN a USING (run_id)""")
def job_rollup(t: Tables):
    k = F.col("o_custkey")
    res = t.raw("orders").select((k % 50).alias("run_id"), (k % 30).alias("products_found"), (k % 4).alias("deals_found"), F.when(F.col("o_orderstatus") == "F", "x").alias("error"))
    runs = t.raw("customer").groupBy((F.col("c_custkey") % 60).alias("run_id")).agg((F.count("*") * 12).alias("total_items"))
    return V.job_rollup(res, runs).withColumn("progress_percent", round_to("progress_percent"))


@query("i13_metric_increase", with_views("signals", body="""
    SELECT 'hour' AS kind, date_trunc('hour', detected_at) AS window_start, retailer, signal_type, count(*) AS increase FROM signals GROUP BY ALL
    UNION ALL SELECT 'sliding', w, retailer, signal_type, count(*) FROM (SELECT retailer, signal_type, unnest(generate_series(0, 11)) AS k, time_bucket(INTERVAL 5 MINUTE, detected_at) - to_minutes(5 * k) AS w FROM signals) GROUP BY ALL
    UNION ALL SELECT 'day', date_trunc('day', detected_at), retailer, signal_type, count(*) FROM signals GROUP BY ALL"""))
def metric_increase(t: Tables):
    s = t.signals()
    labels = ["retailer", "signal_type"]
    a = V.metric_increase(s, "detected_at", labels, "1 hour").withColumn("kind", F.lit("hour"))
    b = V.metric_increase(s, "detected_at", labels, "1 hour", "5 minutes").withColumn("kind", F.lit("sliding"))
    c = V.metric_increase(s, "detected_at", labels, "1 day").withColumn("kind", F.lit("day"))
    return a.unionByName(b).unionByName(c)


@query("i14_success_ratio", with_views("requests", body=f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, store, {r('100.0 * count(*) FILTER (success) / count(*)')} AS success_percent FROM requests GROUP BY ALL"))
def success_ratio(t: Tables):
    return V.success_ratio(t.requests()).withColumn("success_percent", round_to("success_percent"))


@query("i15_histogram_quantile", with_views("requests", body=f"""
    SELECT date_trunc('day', ts) AS window_start, store, {r('quantile_cont(duration_ms, 0.5)')} AS p50, {r('quantile_cont(duration_ms, 0.95)')} AS p95, {r('quantile_cont(duration_ms, 0.99)')} AS p99 FROM requests GROUP BY ALL"""))
def histogram_quantile(t: Tables):
    d = V.duration_quantiles(t.requests(), "1 day", exact=True)
    return d.withColumns({c: round_to(c) for c in ("p50", "p95", "p99")})


FP_SQL = ", fp AS (SELECT a.*, store FROM alerts a JOIN products p USING (product_id))\n"


@query("i16_false_positive_rate", with_views("alerts", "products", body=FP_SQL + f"""
    SELECT store, NULL::INT AS rule_id, count(*) AS total, count(*) FILTER (false_positive_count > 0) AS false_positives, {r('count(*) FILTER (false_positive_count > 0) / count(*)')} AS false_positive_rate FROM fp GROUP BY store
    UNION ALL SELECT store, rule_id, count(*), count(*) FILTER (false_positive_count > 0), {r('count(*) FILTER (false_positive_count > 0) / count(*)')} FROM fp GROUP BY store, rule_id"""))
def false_positive_rate(t: Tables):
    d = t.alerts().join(t.products().select("product_id", "store"), "product_id")
    a = V.false_positive_rate(d, ["store"]).withColumn("rule_id", F.lit(None).cast("int"))
    return a.unionByName(V.false_positive_rate(d, ["store", "rule_id"])).withColumn("false_positive_rate", round_to("false_positive_rate"))


@query("i17_confidence_adjustment", with_deals(f"""
    , fp AS (SELECT nullif(p.store, 'woot') AS store, count(*) FILTER (o_orderstatus = 'P') / count(*) AS rate FROM orders JOIN products p ON p.product_id = o_custkey GROUP BY 1)
    SELECT product_id, {r('conf * CASE WHEN rate > 0.5 THEN 0.5 WHEN rate > 0.3 THEN 0.7 WHEN rate > 0.1 THEN 0.9 ELSE 1.0 END')} AS adjusted_confidence FROM deals LEFT JOIN fp USING (store)"""))
def confidence_adjustment(t: Tables):
    # alerts of one store come without it, so its deals have no rate
    d = t.alerts().join(t.products().select("product_id", F.nullif("store", F.lit("woot")).alias("store")), "product_id")
    out = V.adjust_confidence(found_deals(t), V.false_positive_rate(d, ["store"]))
    return out.select("product_id", round_to("adjusted_confidence").alias("adjusted_confidence"))


def feedback(t: Tables):
    k = F.col("doc_id")
    return t.raw("labels").select(
        k.alias("feedback_id"), pick(("review", "extract", "classify"), k % 3).alias("task_type"), pick(("gpt-4", "small"), F.floor(k / 3) % 2).alias("model_name"), F.when(k % 5 != 0, F.col("quality") == 1).alias("is_correct"),
        F.concat(F.lit("out-"), k.cast("string")).alias("output"), F.when(F.col("quality") == 0, F.concat(F.lit("fix-"), k.cast("string"))).alias("user_correction"), F.lit("n").alias("notes"), (k % 17).alias("created_at"),
    )


FB_SQL = """WITH fb AS (SELECT doc_id, (['review', 'extract', 'classify'])[1 + doc_id % 3] AS task_type, (['gpt-4', 'small'])[1 + (doc_id // 3) % 2] AS model_name, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS ok, quality, doc_id % 17 AS created_at FROM labels)\n"""


@query("i18_feedback_accuracy", FB_SQL + f"""
    SELECT task_type, model_name, count(*) AS total, count(ok) AS validated, count(*) FILTER (ok) AS correct, count(ok) - count(*) FILTER (ok) AS incorrect, {r('coalesce(count(*) FILTER (ok) / nullif(count(ok), 0), 0)')} AS accuracy FROM fb GROUP BY ALL""")
def feedback_accuracy(t: Tables):
    return V.feedback_accuracy(feedback(t)).withColumn("accuracy", round_to("accuracy"))


@query("i19_finetune_export", FB_SQL + "SELECT doc_id AS feedback_id, 'out-' || doc_id AS input, 'fix-' || doc_id AS output, 'n' AS notes FROM fb WHERE task_type = 'extract' AND model_name = 'small' AND quality = 0 ORDER BY created_at DESC, doc_id DESC")
def finetune_export(t: Tables):
    return V.corrected_examples(feedback(t), "extract", "small")


@query("i20_token_cost", f"""
    WITH u AS (SELECT DATE '2024-01-01' + CAST(conv_id % 20 AS INT) AS day, turn % 2 = 0 AS dear, length(text) AS p, length(text) // 3 AS c FROM conversations)
    SELECT day, {r('sum(p / 1000 * CASE WHEN dear THEN 0.01 ELSE 0.0015 END::DOUBLE + c / 1000 * CASE WHEN dear THEN 0.03 ELSE 0.002 END::DOUBLE)')} AS cost, sum(p / 1000 * CASE WHEN dear THEN 0.01 ELSE 0.0015 END::DOUBLE + c / 1000 * CASE WHEN dear THEN 0.03 ELSE 0.002 END::DOUBLE) >= 0.2 AS over_limit FROM u GROUP BY day""")
def token_cost(t: Tables):
    n = F.length("text")
    u = t.raw("conversations").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 20).cast("int")).alias("day"), F.when(F.col("turn") % 2 == 0, "gpt-4-x").otherwise("small").alias("model"),
        n.alias("prompt_tokens"), F.floor(n / 3).alias("completion_tokens"),
    )
    return V.token_cost(u, 0.2).withColumn("cost", round_to("cost"))


@query("i21_stale_jobs", with_views("ref_time", body=JOB_SQL + """
    , n AS (SELECT max(started_at) + INTERVAL 1 HOUR AS now FROM jobs), hb AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 40 MINUTE END) AS beat FROM orders GROUP BY 1),
    s AS (SELECT jobs.*, now, CASE WHEN status = 'running' THEN CASE WHEN epoch(now - started_at) > 7200 * 24 * 400 THEN 'exceeded max duration' WHEN beat IS NULL AND epoch(now - started_at) > 300 THEN 'missing heartbeat' WHEN epoch(now - beat) > 300 THEN 'stale heartbeat' END END AS why FROM jobs LEFT JOIN hb USING (run_id), n)
    SELECT run_id, CASE WHEN why IS NULL THEN status ELSE 'failed' END AS status, why AS stale_reason, CASE WHEN why IS NULL THEN completed_at ELSE now END AS completed_at FROM s"""))
def stale_jobs(t: Tables):
    j = jobs(t)
    now = j.agg(F.timestamp_add("HOUR", F.lit(1), F.max("started_at"))).scalar()
    # every second beat has no time
    beat = F.when(F.col("o_orderkey") % 2 == 0, F.timestamp_add("MINUTE", F.lit(40), F.col("o_orderdate")))
    beats = t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), beat.alias("beat_at"))
    return V.stale_jobs(j, beats, now, limit_seconds=7200 * 24 * 400).select("run_id", "status", "stale_reason", "completed_at")
