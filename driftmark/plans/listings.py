"""Filter, rule and deal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions import text as T
from driftmark.functions.numbers import MONEY, round_to
from driftmark.operators import anomaly as A, baseline as B, deals as D, filters as X, rules as R, skew
from driftmark.plans.detectors import DETECT_SQL, inputs, with_detectors
from driftmark.plans.projections import ATTR_SQL, attr_title
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, txt, with_views
from driftmark.sources.tables import Tables, pick

def cut(price, by):
    """A price divided by a number and rounded to cents, the same way in both engines."""
    return F.round((price.cast("double") / by).cast("decimal(28,8)"), 2).cast(MONEY)


def sql_cut(price: str, by: str) -> str:
    return f"CAST(ROUND(CAST(CAST({price} AS DOUBLE) / {by} AS DECIMAL(28,8)), 2) AS DECIMAL(10,2))"


CONFIGS = (
    # category, keywords, exclude_keywords, brands, min_price, max_price, excluded_skus, excluded_brands
    ("electronics", '["widget|ring", "bolt"]', '["old"]', "[]", 0, 950, ["P7", "P19", "P1208"], []),
    ("home", "[]", '["^Brand#1\\\\d "]', '["brand#2"]', 200, None, [], ["brand#21"]),
    ("toys", '["small"]', "not json", "[]", None, 600, [], []),
    ("clearance", "[]", "[]", "[]", 100, 10000, ["P5"], ["BRAND#3 "]),
    ("apparel", None, '["hot r", "cold"]', '["Brand#5", "Brand#9"]', None, None, [], []),
)


def configs(t: Tables):
    return t.spark.createDataFrame(
        list(CONFIGS),
        "category string, keywords string, exclude_keywords string, brands string, min_price int, max_price int, excluded_skus array<string>, excluded_brands array<string>",
    ).withColumns({"min_price": F.col("min_price").cast(MONEY), "max_price": F.col("max_price").cast(MONEY)})


@query("c01_listing_filter", with_views("listings", body="""
    , cfg(category, kw, xkw, br, lo, hi, skus, xbr) AS (VALUES
        ('electronics', ['widget|ring', 'bolt'], ['old'], NULL::VARCHAR[], NULL::INT, 950, ['P7', 'P19', 'P1208'], NULL::VARCHAR[]),
        ('home', NULL, ['^Brand#1\\d '], ['brand#2'], 200, NULL, NULL, ['brand#21']), ('toys', ['small'], NULL, NULL, NULL, 600, NULL, NULL),
        ('clearance', NULL, NULL, NULL, 100, 10000, ['P5'], ['brand#3 ']), ('apparel', NULL, ['hot r', 'cold'], ['brand#5', 'brand#9'], NULL, NULL, NULL, NULL)),
    x AS (SELECT l.*, kw, xkw, br, lo, hi, skus, xbr, title || ' ' || sku AS full_text FROM listings l LEFT JOIN cfg USING (category))
    SELECT product_id, CASE WHEN list_contains(skus, sku) THEN 'sku' WHEN len(list_filter(xkw, lambda k: regexp_matches(full_text, k, 'i'))) > 0 THEN 'exclude_keyword'
        WHEN len(list_filter(xbr, lambda k: contains(lower(title), k))) > 0 THEN 'excluded_brand' WHEN kw IS NOT NULL AND len(list_filter(kw, lambda k: regexp_matches(full_text, k, 'i'))) = 0 THEN 'keyword'
        WHEN br IS NOT NULL AND len(list_filter(br, lambda k: contains(lower(title), k))) = 0 THEN 'brand' WHEN current_price < lo OR current_price > hi THEN 'price' END AS dropped_by FROM x"""))
def listing_filter(t: Tables):
    return X.listing_filter(t.listings(), configs(t)).select("product_id", "dropped_by")


def exclusions(t: Tables):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(
        F.when(k % 10 == 0, "*").otherwise(pick(params.TEST_STORES, k % len(params.TEST_STORES))).alias("store"),
        F.when(k % 3 == 0, F.concat(F.lit("P"), (k * 7).cast("string"))).alias("sku"),
        F.when(k % 3 == 1, F.concat(F.lit("\\bbrand#"), (k % 25).cast("string"), F.lit(" (old|new)"))).alias("keyword"),
        F.when(k % 3 == 2, F.concat(F.lit("Brand#"), (k % 25).cast("string"), F.lit(" H"))).alias("brand"),
        (k % 13 != 12).alias("enabled"),
    )


EXCLUSION_SQL = """, exc AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN '*' ELSE (STORES)[1 + s_suppkey % 18] END AS xstore, CASE WHEN s_suppkey % 3 = 0 THEN 'P' || (s_suppkey * 7) END AS xsku,
      CASE WHEN s_suppkey % 3 = 1 THEN '\\bbrand#' || (s_suppkey % 25) || ' (old|new)' END AS kw, CASE WHEN s_suppkey % 3 = 2 THEN lower('Brand#' || (s_suppkey % 25) || ' H') END AS br
    FROM supplier WHERE s_suppkey % 13 <> 12)
""".replace("STORES", "[" + ", ".join(f"'{s}'" for s in params.TEST_STORES) + "]")


@query("c02_exclusion_antijoin", with_views("listings", body=EXCLUSION_SQL + """
    SELECT product_id, store, sku, title FROM listings l WHERE NOT EXISTS (SELECT 1 FROM exc WHERE xstore IN (l.store, '*')
      AND (xsku = l.sku OR regexp_matches(l.title || ' ' || l.sku, kw, 'i') OR contains(lower(l.title), br)))"""))
def exclusion_antijoin(t: Tables):
    return X.without_excluded(t.listings(), exclusions(t)).select("product_id", "store", "sku", "title")


def cheap_listings(t: Tables):
    k = F.col("product_id")
    word = F.when(k % 5 == 0, " toy").when(k % 5 == 1, " play kitchen set").when(k % 5 == 2, " agesome").otherwise("")
    sku = F.when(k % 100 == 55, params.LOW_PRICE_SKUS[1]).otherwise(F.col("sku"))
    price = cut(F.col("current_price"), k % 60 + 1)
    return t.listings().select("product_id", "store", sku.alias("sku"), F.concat("title", word).alias("title"), price.alias("current_price"))


@query("c03_low_price_keyword_filter", with_views("listings", body=rf"""
    , x AS (SELECT product_id, store, CASE WHEN product_id % 100 = 55 THEN '780568056' ELSE sku END AS sku,
        title || CASE product_id % 5 WHEN 0 THEN ' toy' WHEN 1 THEN ' play kitchen set' WHEN 2 THEN ' agesome' ELSE '' END AS title,
        {sql_cut('current_price', '(product_id % 60 + 1)')} AS p FROM listings)
    SELECT product_id, sku FROM x WHERE NOT (store = 'walmart' AND sku IN ('5116478924', '780568056', '5152678945', '10025719060', '16501550266'))
      AND NOT (p <= 30 AND regexp_matches(title || ' ' || sku, '\b({'|'.join(params.LOW_PRICE_WORDS)})\b', 'i'))"""))
def low_price_keyword_filter(t: Tables):
    c = F.col
    d = cheap_listings(t).filter(~X.low_price_keyword(c("current_price"), c("title"), c("sku"), c("store")))
    return d.select("product_id", "sku")


@query("c04_min_retail_filter", with_views("listings", body=f"""
    , x AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN NULL ELSE {sql_cut('original_price', '(product_id % 40 + 1)')} END AS o, CASE WHEN product_id % 6 = 0 THEN NULL ELSE msrp END AS m, current_price FROM listings)
    SELECT product_id FROM x WHERE coalesce(o, m, current_price) >= 50"""))
def min_retail_filter(t: Tables):
    k = F.col("product_id")
    d = t.listings().withColumn("original_price", F.when(k % 3 != 0, cut(F.col("original_price"), k % 40 + 1))).withColumn("msrp", F.when(k % 6 != 0, F.col("msrp")))
    return X.min_retail_filter(d).select("product_id")


THRESHOLDS_SQL = ", th(ord, k, d, m, lo, hi) AS (VALUES " + ", ".join(
    f"({i}, '{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for i, (k, v) in enumerate(params.CATEGORY_THRESHOLDS.items())) + ")\n"
CATRULES_SQL = THRESHOLDS_SQL + """, cats AS (SELECT DISTINCT category FROM products),
    ranked_rules AS (SELECT category, d, m, lo, hi, row_number() OVER (PARTITION BY category ORDER BY lower(category) <> k, ord) AS rn FROM cats JOIN th ON contains(lower(category), k) OR contains(k, lower(category))),
    catrules AS (SELECT c.category, coalesce(d, 40.0) AS d, coalesce(m, 0.6) AS m, coalesce(lo, 10.0) AS lo, coalesce(hi, 10000.0) AS hi FROM cats c LEFT JOIN ranked_rules r ON r.category = c.category AND rn = 1)
"""


@query("c05_msrp_context_filter", with_views("listings", body=CATRULES_SQL + f"""
    , x AS (SELECT product_id, category, msrp, CASE WHEN product_id % 3 = 0 THEN {sql_cut('current_price', '40')} WHEN product_id % 3 = 1 THEN {sql_cut('current_price', '12')} ELSE current_price END AS p FROM listings),
    y AS (SELECT x.*, lo, hi, (1 - p / CAST(msrp AS DOUBLE)) * 100 AS off FROM x JOIN catrules USING (category))
    SELECT product_id, CASE WHEN off >= 90 AND category <> 'clearance' THEN {txt('off', 1)} || '% off MSRP ($' || msrp || ') - potential error'
        WHEN p < lo THEN 'Price $' || p || ' below category minimum $' || {txt('lo', 2)} WHEN p > hi THEN 'Price $' || p || ' above category maximum $' || {txt('hi', 2)} END AS reject_reason FROM y"""))
def msrp_context_filter(t: Tables):
    k = F.col("product_id") % 3
    p = F.when(k == 0, cut(F.col("current_price"), 40)).when(k == 1, cut(F.col("current_price"), 12)).otherwise(F.col("current_price"))
    d = t.listings().withColumn("current_price", p)
    return X.msrp_context_filter(d, F.col("category") == "clearance").select("product_id", "reject_reason")


@query("c06_category_rules_lookup", with_views("products", body=CATRULES_SQL + """
    SELECT product_id, category, d AS min_discount_percent, m AS msrp_threshold, lo AS min_price, hi AS max_price FROM products JOIN catrules USING (category)"""))
def category_rules_lookup(t: Tables):
    return t.products().withColumn("r", X.category_rules(F.col("category"))).select("product_id", "category", "r.*")


def previous_snapshot(t: Tables):
    before = skew.newest_rows(t.observations(), ["product_id"], t.NEWEST, 1, skip=1)
    d = before.join(t.products().select("product_id", "store", "sku"), "product_id")
    h = X.listing_hash(F.col("sku"), F.col("price"), F.col("original_price"))
    return d.select("store", "sku", h.alias("stored_hash"), F.col("fetched_at").alias("stored_at"))


CHANGED_SQL = """, prev AS (SELECT product_id, price, original_price AS oo, fetched_at AS stored_at FROM history WHERE hrank = 1),
    chg AS (SELECT l.product_id, store, md5(sku || ':' || current_price || ':' || l.original_price) AS listing_hash,
        NOT coalesce(epoch(seen_at - stored_at) < 100 * 86400 AND md5(sku || ':' || price || ':' || oo) = md5(sku || ':' || current_price || ':' || l.original_price), false) AS changed
      FROM listings l LEFT JOIN prev USING (product_id))
"""


@query("c07_changed_listings", with_views("listings", "history", body=CHANGED_SQL + "SELECT product_id, listing_hash, changed FROM chg"))
def changed_listings(t: Tables):
    return X.changed_listings(t.listings(), previous_snapshot(t), 100 * 86400).select("product_id", "listing_hash", "changed")


@query("c07_change_stats", with_views("listings", "history", body=CHANGED_SQL + """
    SELECT store, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS skipped FROM chg GROUP BY store"""))
def change_stats(t: Tables):
    return X.change_stats(X.changed_listings(t.listings(), previous_snapshot(t), 100 * 86400))


@query("c08_filtered_list", with_views("alerts", body="""
    SELECT alert_id, product_id, triggered_price, sent_at FROM alerts WHERE rule_id = 3 AND false_positive_count = 0 ORDER BY sent_at DESC, alert_id LIMIT 50 OFFSET 10"""))
def filtered_list(t: Tables):
    d = t.alerts().filter((F.col("rule_id") == 3) & (F.col("false_positive_count") == 0))
    return X.page_of(d.select("alert_id", "product_id", "triggered_price", "sent_at"), [F.desc("sent_at"), F.col("alert_id")], 50, 10)


# prices for the rules: the current price cut down on some products so that every rule type fires
def rule_prices(t: Tables):
    base = B.current_baseline(B.profile_before_newest(t.observations(), t.NEWEST, t.as_of()), t.products())
    d = base.join(t.products().drop("msrp"), "product_id")
    kk = F.col("product_id")
    k, c = kk % 10, F.col("current_price")
    p = F.when(k == 0, cut(c, 1000)).when(k == 1, cut(F.col("msrp"), 100)).when(k == 2, cut(c, 11)).when(k == 3, cut(c, 2.5)).otherwise(c)
    return d.select(
        "product_id", "store", "category", "sku", "title", "url", "msrp", p.alias("current_price"), F.col("current_baseline").alias("baseline_price"), "baseline_source",
        F.col("current_availability").alias("availability"), F.col("current_confidence").alias("confidence"),
        F.when(kk % 4 == 0, "fba").when(kk % 4 == 1, "third").alias("seller_type"), F.when(kk % 5 == 0, "clearance").alias("signal_type"),
        F.when(kk % 3 == 0, F.col("msrp") * F.lit("0.8").cast("decimal(2,1)")).alias("sold_median"), F.when(kk % 6 == 0, 0.75).when(kk % 6 == 1, 0.5).alias("ml_score"),
    )


RULES_SQL = f""", rp AS (SELECT l.product_id, store, msrp, availability, l.confidence, category, sku, title, url,
        CASE l.product_id % 10 WHEN 0 THEN {sql_cut('l.current_price', '1000')} WHEN 1 THEN {sql_cut('msrp', '100')} WHEN 2 THEN {sql_cut('l.current_price', '11')} WHEN 3 THEN {sql_cut('l.current_price', '2.5')} ELSE l.current_price END AS p,
        current_baseline AS b, baseline_source, CASE product_id % 4 WHEN 0 THEN 'fba' WHEN 1 THEN 'third' END AS seller_type, CASE WHEN product_id % 5 = 0 THEN 'clearance' END AS signal_type,
        CASE WHEN product_id % 3 = 0 THEN msrp * CAST(0.8 AS DECIMAL(2,1)) END AS sold_median, CASE product_id % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 END AS ml_score
      FROM listings l JOIN (SELECT product_id, current_baseline, baseline_source FROM based) USING (product_id)),
    rules(id, name, kind, lim, enabled, prio) AS (VALUES {', '.join(f"({i}, '{n}', '{k}', {th}::DOUBLE, {str(e).lower()}, {pr})" for i, n, k, th, e, pr in params.RULES)}),
    pred AS (SELECT rp.*, id, name, kind, lim, prio, coalesce(CASE kind WHEN 'percent_drop' THEN b > 0 AND p <= b * lim WHEN 'absolute' THEN p <= lim WHEN 'msrp_ratio' THEN p <= msrp * lim
        WHEN 'penny_pricing' THEN p <= 1 AND msrp >= lim WHEN 'currency_error' THEN abs(CAST(p AS DOUBLE) - CAST(msrp AS DOUBLE) / 100) < 0.01 WHEN 'msrp_deviation' THEN CAST(p AS DOUBLE) / CAST(msrp AS DOUBLE) <= lim END, false) AS triggered
      FROM rp, rules WHERE enabled),
    why AS (SELECT *, CASE WHEN NOT triggered THEN NULL ELSE CASE kind WHEN 'percent_drop' THEN {txt('(1 - p / b) * 100', 1)} || '% off baseline ($' || {txt('b', 2)} || ')'
        WHEN 'absolute' THEN 'Price $' || p || ' <= threshold $' || {txt('lim', 2)} WHEN 'msrp_ratio' THEN {txt('(1 - p / CAST(msrp AS DOUBLE)) * 100', 1)} || '% off MSRP ($' || msrp || ')'
        WHEN 'penny_pricing' THEN 'Penny pricing detected: $' || p || ' for item expected $' || msrp WHEN 'currency_error' THEN 'Possible currency error: $' || p || ' vs MSRP $' || msrp
        WHEN 'msrp_deviation' THEN {txt('(1 - p / CAST(msrp AS DOUBLE)) * 100', 1)} || '% off MSRP ($' || msrp || ') - potential error' END END AS reason FROM pred)
"""


def with_rules(body: str) -> str:
    from driftmark.plans.statistics import with_profile

    return with_profile(RULES_SQL + body, "listings")


@query("r01_rule_predicates", with_rules("SELECT product_id, CAST(id AS INT) AS rule_id, triggered, reason FROM why"))
def rule_predicates(t: Tables):
    d = R.rule_predicates(rule_prices(t), R.rules_table(t.spark))
    return d.select("product_id", F.col("rule.id").alias("rule_id"), "triggered", "reason")


POLICY_SQL = """, pol0 AS (SELECT *, CAST(floor(p * 100) AS BIGINT) % 100 IN (0, 88, 97) AS odd, coalesce(signal_type = 'clearance', false) AS clr FROM rp),
    pol AS (SELECT *, CASE WHEN store IN ('amazon_us', 'walmart', 'costco') AND availability = 'out_of_stock' THEN false WHEN store = 'ebay' AND p > CAST(sold_median AS DOUBLE) * 1.1 THEN false ELSE true END AS allowed,
        CASE store WHEN 'walmart' THEN CASE WHEN availability = 'out_of_stock' THEN 0 ELSE CASE WHEN odd THEN 0.05 ELSE 0 END + CASE WHEN clr THEN 0.05 ELSE 0 END END
                   WHEN 'costco' THEN CASE WHEN availability <> 'out_of_stock' AND (odd OR clr) THEN 0.05 ELSE 0 END
                   WHEN 'ebay' THEN CASE WHEN p < CAST(sold_median AS DOUBLE) * 0.8 THEN 0.05 ELSE 0 END ELSE 0 END AS delta,
        CASE store WHEN 'amazon_us' THEN CASE WHEN availability = 'out_of_stock' THEN 'Amazon item out of stock' ELSE 'Amazon validation' END
                   WHEN 'walmart' THEN CASE WHEN availability = 'out_of_stock' THEN 'Walmart item out of stock' ELSE 'Walmart validation' END
                   WHEN 'costco' THEN CASE WHEN availability = 'out_of_stock' THEN 'Costco item out of stock' WHEN odd OR clr THEN 'Costco warehouse markdown' ELSE 'Costco validation' END
                   WHEN 'ebay' THEN CASE WHEN p > CAST(sold_median AS DOUBLE) * 1.1 THEN 'Above sold median comps' ELSE 'eBay comps check' END END AS policy_reason,
        CASE WHEN store = 'amazon_us' AND availability <> 'out_of_stock' AND p <= 1 AND coalesce(seller_type, '') NOT IN ('amazon', 'fba') THEN 'seller_type'
             WHEN store IN ('walmart', 'costco') AND availability <> 'out_of_stock' THEN 'in_stock' WHEN store = 'ebay' AND sold_median IS NOT NULL THEN 'sold_comps' ELSE '' END AS evidence FROM pol0)
"""


@query("r05_store_policy", with_rules(POLICY_SQL + f"SELECT product_id, store, allowed, policy_reason AS reason, {r('delta')} AS delta, evidence FROM pol"))
def store_policy(t: Tables):
    d = R.store_policy(rule_prices(t))
    return d.select("product_id", "store", "policy.allowed", "policy.reason", round_to("policy.delta").alias("delta"), F.array_join("policy.evidence", ",").alias("evidence"))


FIRST_SQL = POLICY_SQL + """, best AS (SELECT product_id, id, reason, row_number() OVER (PARTITION BY product_id ORDER BY prio DESC, id) AS rn FROM why WHERE triggered),
    firsts AS (SELECT pol.*, CASE WHEN allowed AND NOT (availability = 'out_of_stock' AND pol.confidence < 0.8) THEN best.id END AS rid, best.reason AS rule_reason
      FROM pol LEFT JOIN best ON best.product_id = pol.product_id AND rn = 1),
    outcome AS (SELECT *, CASE WHEN rid IS NULL THEN confidence ELSE least(1.0, CASE WHEN delta <> 0 THEN greatest(0.0, least(1.0, confidence * 0.9 + delta)) ELSE confidence * 0.9 END + CASE WHEN ml_score > 0.7 THEN 0.1 ELSE 0 END) END AS conf,
        CASE WHEN rid IS NOT NULL THEN CASE WHEN b > 0 THEN (1 - p / b) * 100 ELSE (1 - p / CAST(msrp AS DOUBLE)) * 100 END END AS discount FROM firsts)
"""


@query("r02_first_rule_match", with_rules(FIRST_SQL + """
    SELECT product_id, CAST(rid AS INT) AS rule_id, rid IS NOT NULL AS triggered, CASE WHEN rid IS NOT NULL THEN concat_ws(' | ', rule_reason, policy_reason)
        WHEN availability = 'out_of_stock' AND confidence < 0.8 THEN 'Product out of stock' ELSE 'No rules triggered' END AS detection_reason FROM outcome"""))
def first_rule_match(t: Tables):
    d = R.first_rule_match(rule_prices(t), R.rules_table(t.spark))
    return d.select("product_id", F.col("rule.id").alias("rule_id"), "triggered", "detection_reason")


@query("r06_detection_confidence", with_rules(FIRST_SQL + f"SELECT product_id, {r('conf')} AS detection_confidence, {r('discount')} AS detection_discount FROM outcome"))
def detection_confidence(t: Tables):
    d = R.first_rule_match(rule_prices(t), R.rules_table(t.spark))
    return d.select("product_id", round_to("detection_confidence").alias("detection_confidence"), round_to("detection_discount").alias("detection_discount"))


@query("r03_velocity_gate", with_views("signals", body="""
    SELECT s.signal_id, CAST(count(DISTINCT o.detected_price) AS BIGINT) AS distinct_prices, count(DISTINCT o.detected_price) <= 3 AS velocity_ok
    FROM signals s JOIN signals o ON o.retailer = s.retailer AND o.detected_at BETWEEN s.detected_at - INTERVAL 10 MINUTE AND s.detected_at GROUP BY s.signal_id"""))
def velocity_gate(t: Tables):
    d = t.signals().select("signal_id", "retailer", "detected_at", "detected_price")
    return R.velocity_gate(d, "retailer", "detected_at", "detected_price").select("signal_id", "distinct_prices", "velocity_ok")


@query("r04_previous_price", with_views("observations", body="""
    SELECT product_id, order_id, line_no, supp_id, price, lag(price) OVER (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty) AS prev_price FROM observations"""))
def previous_price(t: Tables):
    d = skew.sliced_lag(t.observations(), ["product_id"], t.NEWEST, ["price"], "YEAR")
    return d.select("product_id", "order_id", "line_no", "supp_id", "price", "prev_price")


CONFIG_SQL = THRESHOLDS_SQL + ", mult(store, f) AS (VALUES " + ", ".join(f"('{s}', {v}::DOUBLE)" for s, v in params.STORE_DISCOUNT_MULTIPLIER.items()) + """),
    pairs AS (SELECT DISTINCT category, store FROM products),
    cand AS (SELECT category, p.store, d, m, lo, hi, row_number() OVER (PARTITION BY category, p.store ORDER BY CASE WHEN k = p.store THEN 0 WHEN k = lower(category) THEN 1 WHEN contains(lower(category), k) OR contains(k, lower(category)) THEN 2 ELSE 3 END, ord) AS rn
      FROM pairs p JOIN th ON k = p.store OR contains(lower(category), k) OR contains(k, lower(category)) OR k = 'default'),
    conf AS (SELECT category, c.store, d * coalesce(f, 1.0) AS d, m, lo, hi FROM cand c LEFT JOIN mult USING (store) WHERE rn = 1)
"""


@query("r07_threshold_config", with_views("products", body=CONFIG_SQL + f"SELECT product_id, {r('d')} AS min_discount_percent, m AS msrp_threshold, lo AS min_price, hi AS max_price FROM products JOIN conf USING (category, store)"))
def threshold_config(t: Tables):
    d = t.products().withColumn("c", D.threshold_config(F.col("category"), F.col("store")))
    return d.select("product_id", round_to("c.min_discount_percent").alias("min_discount_percent"), "c.msrp_threshold", "c.min_price", "c.max_price")


# listings with some of the reference prices missing or raised, so that every detection method occurs
def deal_listings(t: Tables):
    k = F.col("product_id") % 8
    o, m = F.col("original_price"), F.col("msrp")
    two = F.lit(2).cast("decimal(2,0)")
    return t.listings().withColumns({
        "original_price": F.when(k == 0, F.lit(None)).when(k == 1, o * two).when(k == 2, F.lit(0).cast(MONEY)).when(k == 5, o * two).otherwise(o).cast(MONEY),
        "msrp": F.when(k == 1, F.lit(None)).when(k == 3, m * two).when(k.isin(4, 5), m * F.lit("2.5").cast("decimal(2,1)")).otherwise(m).cast(MONEY),
    })


DEALS_SQL = f""", dl AS (SELECT l.product_id, l.store, l.category, current_price AS p,
        CAST(CASE l.product_id % 8 WHEN 0 THEN NULL WHEN 1 THEN original_price * 2 WHEN 2 THEN 0 WHEN 5 THEN original_price * 2 ELSE original_price END AS DECIMAL(10,2)) AS o,
        CAST(CASE l.product_id % 8 WHEN 1 THEN NULL WHEN 3 THEN msrp * 2 WHEN 4 THEN msrp * 2.5 WHEN 5 THEN msrp * 2.5 ELSE msrp END AS DECIMAL(10,2)) AS m, d, conf.m AS mt, lo, hi
      FROM listings l JOIN conf USING (category, store)),
    dl1 AS (SELECT *, (1 - p / CAST(o AS DOUBLE)) * 100 AS off_o, (1 - p / CAST(m AS DOUBLE)) * 100 AS off_m, p / CAST(m AS DOUBLE) AS ratio FROM dl),
    dl2 AS (SELECT *, coalesce(o > 0 AND p < o AND off_o >= d, false) AS st, coalesce(m > 0 AND p < m AND ratio <= mt, false) AS ms FROM dl1 WHERE p BETWEEN lo AND hi),
    dl3 AS (SELECT *, ms AND (NOT st OR off_m > off_o) AS mw FROM dl2 WHERE st OR ms),
    dl4 AS (SELECT *, CASE WHEN mw THEN off_m ELSE off_o END AS pct, concat_ws(',', CASE WHEN st THEN 'strikethrough' END, CASE WHEN ms THEN 'msrp' END) AS signals FROM dl3),
    dl5 AS (SELECT *, greatest(0.1, least(1.0, 0.5 + CASE WHEN pct BETWEEN 50 AND 70 THEN 0.2 WHEN pct > 70 AND pct <= 85 THEN 0.15 WHEN pct > 85 AND pct <= 95 THEN 0.1 ELSE -0.1 END
        + CASE WHEN coalesce(o, 0) <> 0 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(m, 0) <> 0 THEN 0.1 ELSE 0 END)) AS c0 FROM dl4),
    deals AS (SELECT product_id, store, category, p, o, m, pct, signals, CASE WHEN st AND ms THEN least(1.0, c0 + 0.15) ELSE c0 END AS conf, CASE WHEN st AND ms THEN 'combined' WHEN mw THEN 'msrp' ELSE 'strikethrough' END AS method,
        {txt('pct', 1)} || CASE WHEN st AND ms THEN '% off (verified by ' || replace(signals, ',', ', ') || ')' WHEN mw THEN '% off MSRP ($' || m || ')' ELSE '% off (was $' || o || ')' END AS reason FROM dl5)
"""


def with_deals(body: str, detectors: bool = False) -> str:
    if detectors:
        return with_detectors(CONFIG_SQL + DEALS_SQL + body, "listings")
    return with_views("listings", "products", body=CONFIG_SQL + DEALS_SQL + body)


def found_deals(t: Tables, least: float = 0.0):
    return D.batch(deal_listings(t), least, D.threshold_config(F.col("category"), F.col("store")))


@query("r08_deal_detect", with_deals(f"SELECT product_id, {r('pct')} AS discount_percent, method AS detection_method, signals, reason FROM deals"))
def deal_detect(t: Tables):
    d = found_deals(t)
    return d.select("product_id", round_to("discount_percent").alias("discount_percent"), "detection_method", F.array_join("signals", ",").alias("signals"), "reason")


@query("r09_deal_confidence", with_deals(f"SELECT product_id, {r('conf')} AS confidence FROM deals"))
def deal_confidence(t: Tables):
    return found_deals(t).select("product_id", round_to("confidence").alias("confidence"))


FLAGS_SQL = """, fl AS (SELECT *, (pct >= 40 AND conf >= 0.6) AS sig, ((pct >= 70 AND conf >= 0.8) OR (contains(signals, ',') AND pct >= 60)) AS err FROM deals)\n"""


def flagged(t: Tables, least: float = 0.0):
    return D.with_flags(found_deals(t, least).withColumn("anomaly_score", F.lit(None).cast("double")))


@query("r10_deal_flags", with_deals(FLAGS_SQL + f"SELECT product_id, sig AS is_significant, err AS is_price_error, {r('conf')} AS combined_score FROM fl"))
def deal_flags(t: Tables):
    return flagged(t).select("product_id", "is_significant", "is_price_error", round_to("combined_score").alias("combined_score"))


@query("r11_deals_batch", with_deals(f"SELECT product_id, category, {r('pct')} AS discount_percent, {r('conf')} AS confidence FROM deals WHERE conf >= 0.6 ORDER BY pct DESC, product_id"))
def deals_batch(t: Tables):
    d = found_deals(t, 0.6).orderBy(F.desc("discount_percent"), "product_id")
    return d.select("product_id", "category", round_to("discount_percent").alias("discount_percent"), round_to("confidence").alias("confidence"))


@query("r12_significant_topk", with_deals(FLAGS_SQL + f"""
    , a AS (SELECT 'significant' AS kind, product_id, pct, conf FROM fl WHERE sig ORDER BY pct DESC, product_id LIMIT 20),
    b AS (SELECT 'price_error' AS kind, product_id, pct, conf FROM fl WHERE err ORDER BY {r('conf', 8)} DESC, pct DESC, product_id LIMIT 10)
    SELECT kind, product_id, {r('pct')} AS discount_percent, {r('conf')} AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""))
def significant_topk(t: Tables):
    d = flagged(t).withColumn("confidence", round_to("confidence", 8))
    a = D.significant(d).withColumn("kind", F.lit("significant"))
    b = D.price_errors(d).withColumn("kind", F.lit("price_error"))
    return a.unionByName(b).select("kind", "product_id", round_to("discount_percent").alias("discount_percent"), round_to("confidence").alias("confidence"))


@query("r13_category_deal_cut", with_deals(f"SELECT product_id, {r('pct')} AS discount_percent FROM deals JOIN catd USING (category) WHERE pct >= greatest(coalesce(cd, 50.0), 50.0)".replace(
    "FROM deals", "FROM deals").replace("catd", "(SELECT k AS category, d AS cd FROM th UNION ALL SELECT c, NULL FROM (SELECT DISTINCT category AS c FROM products) WHERE c NOT IN (SELECT k FROM th))")))
def category_deal_cut(t: Tables):
    own = F.when(F.lit(False), F.lit(0.0))
    for name, values in params.CATEGORY_THRESHOLDS.items():
        own = own.when(F.col("category") == name, values[0])
    d = D.category_cut(found_deals(t), own)
    return d.select("product_id", round_to("discount_percent").alias("discount_percent"))


ENRICH_SQL = """, en AS (SELECT d.product_id, d.category, p, pct, coalesce(score, 0) AS score, coalesce(k, 0) AS nm, coalesce(k > 0, false) AS odd, f.conf AS aconf, d.conf AS c0, d.signals, f.methods FROM deals d LEFT JOIN fused f USING (product_id)),
    enr AS (SELECT *, CASE WHEN odd AND aconf > 0.6 THEN least(1.0, c0 * 1.1) ELSE c0 END AS conf,
        array_to_string(list_sort(string_split(CASE WHEN odd THEN signals || ',' || methods ELSE signals END, ',')), ',') AS sigs FROM en)
"""


def enriched(t: Tables):
    a = A.statistical_detectors(inputs(t)).select("product_id", "anomaly_score", "methods", "is_anomaly", F.col("confidence_score").alias("anomaly_confidence"))
    return D.enrich(found_deals(t), a)


@query("r14_deal_enrich", with_deals(ENRICH_SQL + f"SELECT product_id, sigs AS signals, {r('conf')} AS confidence, {r('score')} AS anomaly_score, {r('CASE WHEN score > 0 THEN (conf + score * 1.5) / 2.5 ELSE conf END')} AS combined_score FROM enr", True))
def deal_enrich(t: Tables):
    d = D.with_flags(enriched(t), n_methods=F.col("n_methods"))
    return d.select("product_id", F.array_join("signals", ",").alias("signals"), *[round_to(c).alias(c) for c in ("confidence", "anomaly_score", "combined_score")])
