"""Suppression, candidate and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions.numbers import round_to
from driftmark.operators import dedupe as G
from driftmark.plans.listings import found_deals, with_deals
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, with_views
from driftmark.sources.tables import Tables


def alerts_of_signals(t: Tables):
    return t.signals().select(
        "signal_id", F.col("retailer").alias("store"), F.col("product_id").alias("sku"), F.col("detected_price").alias("price"), "detected_at"
    )


def greedy_sql(key: str, accept: str, where: str = "true") -> str:
    """Fold over each key's rows in time order; ``accept`` reads ``s`` (row) and ``f`` (state)."""
    return f"""RECURSIVE , seq AS MATERIALIZED (SELECT signal_id, {key} AS k, detected_at AS seen, CAST(detected_price AS DOUBLE) AS price,
        row_number() OVER (PARTITION BY {key} ORDER BY detected_at, signal_id) AS rn FROM signals WHERE {where}),
    fold AS (SELECT signal_id, k, rn, seen AS last_at, price AS last_price, true AS accepted FROM seq WHERE rn = 1
      UNION ALL SELECT s.signal_id, s.k, s.rn, CASE WHEN {accept} THEN s.seen ELSE f.last_at END, CASE WHEN {accept} THEN s.price ELSE f.last_price END, {accept}
      FROM fold f JOIN seq s ON s.k = f.k AND s.rn = f.rn + 1)
"""


@query("g01_alert_dedupe", with_views("signals", body=greedy_sql("product_id || '/' || CAST(round_even(detected_price, 0) AS BIGINT)", "s.seen - f.last_at >= INTERVAL 12 HOUR") + "SELECT signal_id, accepted FROM fold"))
def alert_dedupe(t: Tables):
    return G.alert_dedupe(alerts_of_signals(t), "detected_at", "signal_id").select("signal_id", "accepted")


@query("g02_cooldown_bypass", with_views("signals", body=greedy_sql("product_id", "(s.seen - f.last_at >= INTERVAL 1440 MINUTE OR s.price < f.last_price)") + "SELECT signal_id, accepted FROM fold"))
def cooldown_bypass(t: Tables):
    return G.cooldown_bypass(alerts_of_signals(t), "detected_at", "signal_id", minutes=1440).select("signal_id", "accepted")


def sightings(t: Tables):
    d = alerts_of_signals(t)
    return d.withColumn("item", F.concat(F.lit("sku:"), (F.split("sku", ":")[1].cast("long") % 20).cast("string"))).withColumn("row_id", F.col("signal_id"))


AGGREGATED = "retailer IN ('saveyourdeals', 'slickdeals', 'woot')"
ITEM = "'sku:' || (CAST(split_part(product_id, ':', 2) AS BIGINT) % 20)"
BEST_SQL = greedy_sql(ITEM, "(s.seen - f.last_at >= INTERVAL 43200 SECOND OR s.price < f.last_price)", AGGREGATED)


@query("g04_best_price_across_sources", with_views("signals", body=BEST_SQL + f"SELECT signal_id, accepted FROM fold UNION ALL SELECT signal_id, true FROM signals WHERE NOT {AGGREGATED}"))
def best_price_across_sources(t: Tables):
    return G.best_price_across_sources(sightings(t), "item", "detected_at", "signal_id", 43200).select("signal_id", "accepted")


@query("g04_best_known_price", with_views("signals", body=BEST_SQL + f"""
    , a AS (SELECT k, seen, s.signal_id, row_number() OVER (PARTITION BY k ORDER BY seen DESC, s.signal_id DESC) AS rk FROM fold JOIN seq s USING (signal_id, k) WHERE accepted)
    SELECT k AS item, retailer AS store, detected_price AS price, seen AS seen_at FROM a JOIN signals USING (signal_id) WHERE rk = 1"""))
def best_known_price(t: Tables):
    d = G.best_price_across_sources(sightings(t), "item", "detected_at", "signal_id", 43200).filter(F.col("store").isin(*params.AGGREGATOR_STORES))
    return G.best_known_price(d, "item", "detected_at").select("item", "store", "price", "seen_at")


@query("d07_baseline_history_throttle", with_views("signals", body=greedy_sql("product_id", "s.seen - f.last_at >= INTERVAL 48 HOUR") + "SELECT signal_id, accepted FROM fold"))
def baseline_history_throttle(t: Tables):
    return G.throttle(t.signals(), ["product_id"], "detected_at", "signal_id", 48).select("signal_id", "accepted")


@query("g05_signal_dedupe", with_views("signals", body="""
    SELECT signal_id, retailer, product_id, detected_price, signal_type FROM (SELECT *, row_number() OVER (PARTITION BY retailer, product_id, floor(detected_price), signal_type ORDER BY detected_at, signal_id) AS rn FROM signals) WHERE rn = 1"""))
def signal_dedupe(t: Tables):
    return G.signal_dedupe(t.signals()).select("signal_id", "retailer", "product_id", "detected_price", "signal_type")


@query("g06_recent_signal_antijoin", with_views("signals", body="""
    SELECT signal_id FROM signals n WHERE NOT EXISTS (SELECT 1 FROM signals o WHERE o.retailer = n.retailer AND o.signal_type = n.signal_type AND abs(o.detected_price - n.detected_price) <= 1
      AND o.detected_at < n.detected_at AND n.detected_at - o.detected_at <= INTERVAL 12 HOUR)"""))
def recent_signal_antijoin(t: Tables):
    s = t.signals().withColumn("product_id", F.col("retailer"))
    return G.recent_signal_antijoin(s, s, same_batch=True).select("signal_id")


STATUSES = ("pending", "verified", "scanning_datacenter", "rejected", "scanning_residential")


def candidates(t: Tables):
    from driftmark.sources.tables import pick

    d = G.candidate_priority(t.signals())
    status = F.when(F.col("signal_id") % 3 == 0, pick(STATUSES, F.col("signal_id") % 5)).otherwise("expired")
    return d.select(
        F.col("signal_id").alias("candidate_id"), F.col("signal_id").alias("source_signal_id"), "retailer", "product_id", "priority_score",
        status.alias("status"), F.col("detected_at").alias("created_at"), "detected_price", "signal_type",
    )


PRIORITY_SQL = """, pr AS (SELECT *, (1 - detected_price / CAST(nullif(meta_baseline, 0) AS DOUBLE)) * 100 AS off FROM signals),
    prio AS (SELECT *, (CASE WHEN detected_price <= 1 THEN 10 ELSE 0 END + CASE WHEN off >= 70 THEN 8 WHEN off >= 50 THEN 5 ELSE 0 END + CASE WHEN meta_changes >= 2 THEN 5 ELSE 0 END
      + CASE WHEN detected_price >= 200 THEN 3 ELSE 0 END + CASE WHEN signal_type IN ('new_low', 'clearance') THEN 2 ELSE 0 END)::DOUBLE AS priority_score FROM pr),
    cand AS (SELECT *, CASE WHEN signal_id % 3 = 0 THEN (['pending', 'verified', 'scanning_datacenter', 'rejected', 'scanning_residential'])[1 + signal_id % 5] ELSE 'expired' END AS status FROM prio)
"""


@query("g07_active_candidate_antijoin", with_views("signals", body=PRIORITY_SQL + """
    SELECT signal_id FROM signals s WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.product_id = s.product_id AND c.retailer = s.retailer AND c.status IN ('pending', 'scanning_datacenter', 'scanning_residential')
      AND abs(c.detected_price - s.detected_price) <= 1)"""))
def active_candidate_antijoin(t: Tables):
    return G.active_candidate_antijoin(t.signals(), candidates(t), t.signals()).select("signal_id")


@query("g08_hourly_budget", with_views("signals", body="""RECURSIVE , seq AS MATERIALIZED (SELECT signal_id, retailer AS k, detected_at AS seen, row_number() OVER (PARTITION BY retailer ORDER BY detected_at, signal_id) AS rn FROM signals),
    fold AS (SELECT signal_id, k, rn, [seen] AS adm, true AS accepted FROM seq WHERE rn = 1
      UNION ALL SELECT signal_id, k, rn, CASE WHEN ok THEN list_append(adm, seen) ELSE adm END, ok FROM (SELECT s.signal_id, s.k, s.rn, s.seen, f.adm,
          len(list_filter(f.adm, lambda x: x >= s.seen - INTERVAL 24 HOUR)) < 12 AND len(list_filter(f.adm, lambda x: x >= s.seen - INTERVAL 168 HOUR)) < 60 AS ok
        FROM fold f JOIN seq s ON s.k = f.k AND s.rn = f.rn + 1))
    SELECT signal_id, accepted FROM fold"""))
def hourly_budget(t: Tables):
    limits = [(24 * 3600, 12), (168 * 3600, 60)]
    return G.trailing_budget(t.signals(), ["retailer"], "detected_at", "signal_id", limits).select("signal_id", "accepted")


@query("g08_tumbling_budget", with_views("signals", body="""
    SELECT signal_id, retailer, place FROM (SELECT *, row_number() OVER (PARTITION BY retailer, date_trunc('hour', detected_at) ORDER BY detected_at, signal_id) AS place FROM signals) WHERE place <= 2"""))
def tumbling_budget(t: Tables):
    d = G.tumbling_budget(t.signals(), ["retailer"], "detected_at", "signal_id", 2)
    return d.select("signal_id", "retailer", F.col("place").cast("long").alias("place"))


@query("g09_candidate_priority", with_views("signals", body=PRIORITY_SQL + "SELECT signal_id, priority_score FROM prio"))
def candidate_priority(t: Tables):
    return G.candidate_priority(t.signals()).select("signal_id", "priority_score")


@query("g10_next_candidates", with_views("signals", body=PRIORITY_SQL + "SELECT signal_id AS candidate_id, retailer, priority_score FROM cand WHERE status = 'pending' ORDER BY priority_score DESC, detected_at, signal_id LIMIT 10"))
def next_candidates(t: Tables):
    return G.next_candidates(candidates(t)).select("candidate_id", "retailer", "priority_score")


def escalations(t: Tables):
    k = F.col("signal_id")
    d = G.candidate_priority(t.signals()).select(
        "signal_id", "priority_score", "signal_type",
        F.when(F.col("signal_type") == "error", F.when(k % 2 == 0, "HTTP 503 upstream").otherwise("parse failure")).alias("error"),
        (F.lit(1.0) - (k % 7) * 0.05).alias("price_confidence"), (k % 3 == 0).alias("triggered"), ((k % 10) / 10).alias("detection_confidence"),
        F.col("detected_price").alias("current_price"), F.when(k % 4 != 0, F.col("detected_price") * (k % 5 + 1)).alias("msrp"),
    )
    return G.escalation(d)


ESC_SQL = PRIORITY_SQL + """, ev AS (SELECT signal_id, priority_score, CASE WHEN signal_type = 'error' THEN CASE WHEN signal_id % 2 = 0 THEN 'HTTP 503 upstream' ELSE 'parse failure' END END AS error, 1.0 - (signal_id % 7) * 0.05::DOUBLE AS pc,
      signal_id % 3 = 0 AS trig, (signal_id % 10) / 10 AS dc, detected_price AS p, CASE WHEN signal_id % 4 <> 0 THEN detected_price * (signal_id % 5 + 1) END AS m FROM prio),
    esc AS (SELECT *, CASE WHEN error IS NOT NULL AND regexp_matches(lower(error), '403|429|503|captcha|blocked|cloudflare|timeout') THEN 'error' WHEN pc < 0.75 THEN 'low_confidence' WHEN trig AND dc >= 0.7 THEN 'high_score' WHEN trig AND dc < 0.9 THEN 'unsure'
      WHEN trig AND p > 0 AND p <= 1 THEN 'penny' WHEN trig AND m > 0 AND (1 - CAST(p AS DOUBLE) / CAST(m AS DOUBLE)) * 100 >= 70 THEN 'deep_discount' WHEN priority_score >= 10 THEN 'priority' END AS why FROM ev)
"""


@query("g11_escalation_flag", with_views("signals", body=ESC_SQL + "SELECT signal_id, why AS escalation_reason, why IS NOT NULL AS escalate FROM esc"))
def escalation_flag(t: Tables):
    return escalations(t).select("signal_id", "escalation_reason", "escalate")


def evidence(t: Tables):
    k = F.col("signal_id")
    e = escalations(t).select("signal_id", "current_price", "triggered", "escalate")
    first = e.select(
        k.alias("candidate_id"), F.lit("datacenter").alias("scan_pass"), F.when(k % 7 != 0, F.col("current_price")).alias("price"), F.when(k % 7 != 0, F.col("triggered")).alias("triggered"),
        "escalate", (k % 11 != 0).alias("budget_ok"),
    )
    second = e.filter("escalate").select(
        k.alias("candidate_id"), F.lit("residential").alias("scan_pass"), F.when(k % 5 != 0, F.col("current_price")).alias("price"), F.when(k % 5 != 0, k % 2 == 0).alias("triggered"),
        F.lit(None).cast("boolean").alias("escalate"), F.lit(None).cast("boolean").alias("budget_ok"),
    )
    return first.unionByName(second)


OUTCOME_SQL = ESC_SQL + """, oc AS (SELECT signal_id, p, why IS NOT NULL AS e, signal_id % 11 <> 0 AS b, signal_id % 7 <> 0 AS has1, signal_id % 5 <> 0 AS has2, trig FROM esc),
    oc2 AS (SELECT *, e AND b AND has2 AS second FROM oc),
    outc AS (SELECT signal_id AS candidate_id, CASE WHEN second OR has1 THEN p END AS price, CASE WHEN second THEN 'residential' ELSE 'datacenter' END AS final_pass,
      CASE WHEN e AND NOT b THEN 'pending' WHEN second THEN CASE WHEN signal_id % 2 = 0 THEN 'verified' ELSE 'rejected' END WHEN has1 AND trig THEN 'verified' ELSE 'rejected' END AS status FROM oc2)
"""


@query("g12_candidate_outcome", with_views("signals", body=OUTCOME_SQL + "SELECT * FROM outc"))
def candidate_outcome(t: Tables):
    return G.candidate_outcome(evidence(t))


STORES_SQL = "[" + ", ".join(f"'{s}'" for s in params.TEST_STORES) + "]"


@query("g13_subscriber_fanout", with_deals(f"""
    , sub AS (SELECT n_nationkey AS w, n_nationkey * 2 AS md, (n_nationkey % 5) / 10 AS mc, CASE WHEN n_nationkey % 3 = 0 THEN [] ELSE [({STORES_SQL})[1 + n_nationkey % 18], ({STORES_SQL})[1 + (n_nationkey + 7) % 18]] END AS st,
        CASE n_nationkey % 4 WHEN 0 THEN ['electronics', 'tv'] WHEN 1 THEN ['home'] ELSE [] END AS ct, n_nationkey % 11 = 10 AS broken FROM nation WHERE n_nationkey % 6 <> 5)
    SELECT w AS webhook_id, product_id FROM deals, sub WHERE broken OR (pct >= md AND conf >= mc AND (len(st) = 0 OR list_contains(st, store)) AND (len(ct) = 0 OR len(list_filter(ct, lambda c: contains(lower(category), c))) > 0))"""))
def subscriber_fanout(t: Tables):
    return G.subscriber_fanout(found_deals(t), t.subscriptions()).select("webhook_id", "product_id")


@query("g14_delivery_stats", f"""
    WITH d AS (SELECT o_custkey % 40 AS webhook_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'sent' END AS status, o_orderdate AS sent_at FROM orders)
    SELECT webhook_id, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'failed') AS failed, max(sent_at) FILTER (status = 'sent') AS last_sent_at, count(*) AS total,
           {r("count(*) FILTER (status <> 'failed') / count(*)")} AS success_rate FROM d GROUP BY webhook_id""")
def delivery_stats(t: Tables):
    d = t.raw("orders").select((F.col("o_custkey") % 40).alias("webhook_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("sent").alias("status"), F.col("o_orderdate").alias("sent_at"))
    return G.delivery_stats(d).withColumn("success_rate", round_to("success_rate"))


@query("g15_signal_run_summary", with_views("signals", body=OUTCOME_SQL + """
    SELECT (SELECT count(*) FROM (SELECT DISTINCT retailer, product_id, floor(detected_price), signal_type FROM signals)) AS signals_ingested, (SELECT count(*) FROM cand) AS candidates_created,
           (SELECT count(*) FROM outc WHERE status <> 'pending') AS candidates_processed, (SELECT count(*) FROM outc WHERE status = 'verified') AS verified_deals"""))
def signal_run_summary(t: Tables):
    return G.run_summary(G.signal_dedupe(t.signals()), candidates(t), G.candidate_outcome(evidence(t)))
