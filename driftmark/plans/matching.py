"""Embedding, matching and join queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftmark.functions import text as T
from driftmark.functions.numbers import MONEY, round_to
from driftmark.operators import activity as V, deals as D, matching as M
from driftmark.plans.detectors import with_detectors
from driftmark.plans.listings import CONFIG_SQL, DEALS_SQL, FIRST_SQL, deal_listings, found_deals, rule_prices, with_deals, with_rules
from driftmark.plans.projections import ATTR_SQL, attr_title
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, txt, with_views
from driftmark.session import checkpoint_root
from driftmark.sources.tables import Tables

LEVEL = 0.25  # the test vectors are far apart; the product's own threshold is params.SIMILARITY_THRESHOLD

EMB_SQL = f""", emb AS MATERIALIZED (SELECT vec_id AS id, label AS g, embedding::DOUBLE[] AS v FROM embeddings),
    sims AS MATERIALIZED (SELECT a.id, b.id AS match_id, a.g AS ga, b.g AS gb, round(list_cosine_similarity(a.v, b.v), 8) AS similarity FROM emb a JOIN emb b ON a.id <> b.id),
    near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rank FROM sims WHERE similarity >= {LEVEL}),
    far AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rank FROM sims WHERE similarity >= {LEVEL} AND ga <> gb)
"""


def with_emb(body: str, *views: str) -> str:
    return with_views("products", *views, body=EMB_SQL + body)


def neighbours(t: Tables, k: int, other_store: bool = False, index: M.InvertedFile | None = None, probes: int = 26):
    """Exact neighbours or, given an inverted file, those of its nearest cells."""
    e = t.embeddings()
    group = "store" if other_store else None
    return M.knn(e, e, k, LEVEL, other_group=group) if index is None else index.knn(e, k, LEVEL, probes, other_group=group)


@query("f01_embed_text")
def embed_text(t: Tables):
    return M.embed_text(t.products())


@query("f02_embedding_backfill", with_views("products", body="""
    , cur AS (SELECT product_id, title AS text, sha256(title) AS h FROM products),
    old AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN sha256(title || ' old') ELSE sha256(title) END AS h FROM products WHERE product_id % 3 <> 0)
    SELECT product_id, text, h AS text_hash FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.product_id = cur.product_id AND old.h = cur.h)"""))
def embedding_backfill(t: Tables):
    k = F.col("product_id")
    title = F.when(k % 4 == 0, F.concat("title", F.lit(" old"))).otherwise(F.col("title"))
    stored = t.products().filter(k % 3 != 0).select("product_id", F.lit("test").alias("model_name"), M.text_hash(title).alias("text_hash"))
    return M.embedding_backlog(t.products(), stored, "test").select("product_id", "text", "text_hash")


@query("f03_embedding_upsert", """
    WITH b AS (SELECT vec_id AS product_id, embedding[1]::DOUBLE AS head, 1 AS updated_at FROM embeddings WHERE vec_id % 3 <> 0
      UNION ALL SELECT vec_id, embedding[2]::DOUBLE, 2 FROM embeddings WHERE vec_id % 2 = 0)
    SELECT product_id, head, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY updated_at DESC) AS rn FROM b) WHERE rn = 1""")
def embedding_upsert(t: Tables):
    e = t.raw("embeddings").select(F.col("vec_id").alias("product_id"), F.lit("test").alias("model_name"), "embedding")
    stored = e.filter(F.col("product_id") % 3 != 0).withColumn("updated_at", F.lit(1))
    new = e.filter(F.col("product_id") % 2 == 0).withColumn("embedding", F.reverse(F.slice("embedding", 1, 2))).withColumn("updated_at", F.lit(2))
    return M.upsert_embeddings(stored, new).select("product_id", F.get("embedding", F.lit(0)).cast("double").alias("head"), "updated_at")


@query("f04_knn_cosine", with_emb(f"SELECT id, match_id, {r('similarity', 6)} AS similarity, rank FROM near WHERE rank <= 10"))
def knn_cosine(t: Tables):
    return neighbours(t, 10).select("id", "match_id", round_to("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def inverted_file(t: Tables):
    """The test vectors as an inverted file; they have no clusters, so a search needs most of its cells."""
    path = f"{checkpoint_root(t.spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    return M.InvertedFile.build(t.embeddings(), path, group="store", cells=32, block_rows=5000)


@query("f05_ann_index", with_emb("""
    , top AS (SELECT id, match_id FROM near WHERE rank <= 10)
    SELECT (SELECT count(*) FROM embeddings) AS stored_rows, (SELECT count(*) FROM top) AS exact_pairs, true AS recall_reached, true AS similarities_exact, true AS cells_bounded"""))
def ann_index(t: Tables):
    index = inverted_file(t)
    found, exact = index.knn(t.embeddings(), 10, LEVEL, probes=26), neighbours(t, 10)
    both = M.recall(found, exact)
    per_block = index.vectors.groupBy("cell", "block").agg(F.count("*").alias("n")).agg(F.max("n"))
    return both.select(
        index.vectors.agg(F.count("*")).scalar().alias("stored_rows"), F.col("pairs").alias("exact_pairs"), (F.col("recall") >= 0.95).alias("recall_reached"),
        (F.col("differing") == 0).alias("similarities_exact"), (per_block.scalar() <= 6000).alias("cells_bounded"),
    )


def product_facts(t: Tables):
    k = F.col("product_id")
    return t.products().withColumn("baseline_price", F.when(k % 6 != 0, F.round(F.col("msrp") * (F.lit(1.0) - (k % 5) * 0.06).cast("decimal(4,2)"), 2).cast(MONEY)))


FACTS_SQL = ", facts AS (SELECT *, CASE WHEN product_id % 6 <> 0 THEN CAST(round(msrp * CAST(1.0 - (product_id % 5) * 0.06 AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) END AS baseline_price FROM products)\n"


@query("f06_similar_products", with_emb(FACTS_SQL + f"""
    SELECT f.id, match_id, b.store, b.sku, b.title, {r('similarity', 6)} AS similarity FROM far f JOIN facts a ON a.product_id = f.id JOIN facts b ON b.product_id = f.match_id WHERE rank <= 10"""))
def similar_products(t: Tables):
    d = M.with_details(neighbours(t, 10, True), product_facts(t))
    return d.select("id", "match_id", F.col("b_store").alias("store"), F.col("b_sku").alias("sku"), F.col("b_title").alias("title"), round_to("similarity", 6).alias("similarity"))


@query("f07_match_confidence", with_emb(FACTS_SQL + f"""
    , m AS (SELECT f.id, match_id, similarity, abs(CAST(a.baseline_price AS DOUBLE) - b.baseline_price) / ((CAST(a.baseline_price AS DOUBLE) + b.baseline_price) / 2) AS ratio, abs(CAST(a.msrp AS DOUBLE) - b.msrp) < 0.01 AS same
      FROM far f JOIN facts a ON a.product_id = f.id JOIN facts b ON b.product_id = f.match_id WHERE rank <= 10)
    SELECT id, match_id, {r('least(1.0, greatest(0.0, similarity + CASE WHEN ratio < 0.1 THEN 0.1 WHEN ratio < 0.2 THEN 0.05 ELSE 0 END + CASE WHEN same THEN 0.1 ELSE 0 END))', 6)} AS match_confidence FROM m"""))
def match_confidence(t: Tables):
    d = M.with_details(neighbours(t, 10, True), product_facts(t))
    c = M.match_confidence(F.col("similarity"), *[F.col(x) for x in ("a_baseline_price", "b_baseline_price", "a_msrp", "b_msrp")])
    return d.select("id", "match_id", round_to(c, 6).alias("match_confidence"))


@query("f08_cross_store_match", with_emb("""
    , p AS (SELECT vec_id AS product_1, (vec_id * 7 + k) % (SELECT count(*) FROM embeddings) AS product_2 FROM embeddings, generate_series(0, 39) AS g(k))
    SELECT product_1, product_2 FROM p WHERE EXISTS (SELECT 1 FROM far WHERE id = product_1 AND match_id = product_2 AND rank <= 5)"""))
def cross_store_match(t: Tables):
    ids = t.raw("embeddings").select(F.col("vec_id").alias("product_1"))
    every = ids.agg(F.count("*")).scalar()
    pairs = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("product_1", ((F.col("product_1") * 7 + F.col("k")) % every).alias("product_2"))
    return M.cross_store_match(pairs, neighbours(t, 5, True)).select("product_1", "product_2")


@query("f09_match_edges", with_emb(f"""
    SELECT least(id, match_id) AS product_id_1, greatest(id, match_id) AS product_id_2, {r('max(similarity)', 6)} AS similarity FROM near WHERE rank <= 10 GROUP BY 1, 2"""))
def match_edges(t: Tables):
    return M.match_edges(neighbours(t, 10)).select("product_id_1", "product_id_2", round_to("similarity", 6).alias("similarity"))


@query("g03_semantic_dedupe", with_emb("""
    , edges AS (SELECT DISTINCT least(id, match_id) AS a, greatest(id, match_id) AS b FROM near WHERE rank <= 10),
    dirs AS (SELECT a AS p, b AS q FROM edges UNION ALL SELECT b, a FROM edges)
    SELECT alert_id, product_id, sent_at FROM alerts x WHERE NOT EXISTS (SELECT 1 FROM dirs JOIN alerts y ON y.product_id = dirs.q
      WHERE dirs.p = x.product_id AND y.sent_at < x.sent_at AND x.sent_at - y.sent_at < INTERVAL 240 HOUR)""", "alerts"))
def semantic_dedupe(t: Tables):
    return M.semantic_duplicates(t.alerts(), M.match_edges(neighbours(t, 10)), 240).select("alert_id", "product_id", "sent_at")


@query("f10_latest_deals_join", with_views("observations", "products", body=f"""
    , latest AS (SELECT product_id, max(fetched_at) AS at FROM observations GROUP BY product_id),
    j AS (SELECT o.*, p.store, p.sku, p.msrp, count(*) OVER () AS total_count FROM observations o JOIN latest l ON l.product_id = o.product_id AND l.at = o.fetched_at JOIN products p ON p.product_id = o.product_id)
    SELECT product_id, store, sku, price, order_id, line_no, fetched_at, {r('(original_price - price) / CAST(original_price AS DOUBLE) * 100')} AS discount_percent, total_count
    FROM j ORDER BY fetched_at DESC, product_id, order_id, line_no LIMIT 300 OFFSET 20"""))
def latest_deals_join(t: Tables):
    d = V.latest_deals(t.observations(), t.products())
    page = V.deals_page(d, limit=300, offset=20)
    return page.select("product_id", "store", "sku", "price", "order_id", "line_no", "fetched_at", round_to("discount_percent").alias("discount_percent"), "total_count")


@query("f11_activity_join", with_views("observations", "products", body="""
    , top AS (SELECT * FROM observations ORDER BY fetched_at DESC, order_id DESC, line_no DESC, supp_id DESC LIMIT 200)
    SELECT top.product_id, coalesce(title, 'Unknown') AS title, coalesce(store, 'Unknown') AS store, coalesce(sku, 'Unknown') AS sku, price, fetched_at
    FROM top LEFT JOIN (SELECT product_id, CASE WHEN product_id % 5 <> 0 THEN title END AS title, CASE WHEN product_id % 5 <> 0 THEN store END AS store, CASE WHEN product_id % 5 <> 0 THEN sku END AS sku FROM products) p ON p.product_id = top.product_id"""))
def activity_join(t: Tables):
    # every fifth product has lost its facts
    known = t.products().withColumns({c: F.when(F.col("product_id") % 5 != 0, F.col(c)) for c in ("title", "store", "sku")})
    d = V.recent_activity(t.observations(), known, ["fetched_at", "order_id", "line_no", "supp_id"], 200)
    return d.select("product_id", "title", "store", "sku", "price", "fetched_at")


@query("f12_alerts_join", with_views("alerts", "products", body="""
    SELECT alert_id, a.product_id, title, store, triggered_price, sent_at FROM alerts a JOIN products p USING (product_id) ORDER BY sent_at DESC, alert_id DESC LIMIT 100"""))
def alerts_join(t: Tables):
    return V.recent_alerts(t.alerts(), t.products(), 100).select("alert_id", "product_id", "title", "store", "triggered_price", "sent_at")


CONTEXT_SQL = """, ctx AS (SELECT product_id, string_agg(price || '@' || strftime(fetched_at, '%Y-%m-%d %H:%M'), ' ' ORDER BY rn DESC) AS recent FROM ranked WHERE rn <= {n} GROUP BY product_id)\n"""


@query("f13_context_bundle", with_views("ranked", "products", body=CONTEXT_SQL.format(n=5) + "SELECT product_id, recent, title, store, sku, msrp FROM ctx JOIN products USING (product_id)"))
def context_bundle(t: Tables):
    d = V.context_bundle(t.observations(), t.products(), t.NEWEST, 5)
    line = F.transform("recent", lambda x: F.concat(x["price"].cast("string"), F.lit("@"), F.date_format(x["fetched_at"], "yyyy-MM-dd HH:mm")))
    return d.select("product_id", F.array_join(line, " ").alias("recent"), "title", "store", "sku", "msrp")


@query("f14_review_prompts", with_detectors(f"""
    , h AS (SELECT product_id, string_agg('  ' || k || '. $' || price || ' on ' || strftime(fetched_at, '%Y-%m-%d %H:%M'), chr(10) ORDER BY k) AS lines, max(total) AS total FROM
      (SELECT product_id, price, fetched_at, row_number() OVER (PARTITION BY product_id ORDER BY rn DESC) AS k, count(*) OVER (PARTITION BY product_id) AS total FROM ranked WHERE rn <= 20) WHERE k <= 10 GROUP BY product_id)
    SELECT f.product_id, 'Product: ' || title || chr(10) || 'Store: ' || store || chr(10) || 'SKU: ' || sku || chr(10) || 'Current Price: $' || f.current_price || chr(10) || 'MSRP: $' || f.msrp || chr(10)
      || 'Baseline Price: $' || {txt('current_baseline', 2)} || chr(10) || chr(10) || 'Anomaly Detection Results:' || chr(10) || '- Anomaly Score: ' || {txt('score', 3)} || chr(10) || '- Confidence: ' || {txt('conf', 3)} || chr(10)
      || '- Detection Methods: ' || replace(methods, ',', ', ') || coalesce(chr(10) || '- Z-Score: ' || {txt('z', 2)}, '') || chr(10) || chr(10) || 'Recent Price History (last ' || h.total || ' prices):' || chr(10) || lines || chr(10) || chr(10)
      || 'Is this a genuine pricing error or a false positive?' AS prompt
    FROM fused f JOIN products p ON p.product_id = f.product_id JOIN h ON h.product_id = f.product_id WHERE k > 0"""))
def review_prompts(t: Tables):
    from driftmark.operators.anomaly import statistical_detectors
    from driftmark.plans.detectors import inputs

    flagged = statistical_detectors(inputs(t)).filter("is_anomaly").drop("msrp")
    ctx = V.context_bundle(t.observations(), t.products(), t.NEWEST, 20)
    return V.review_prompts(flagged.join(ctx, "product_id")).select("product_id", "prompt")


@query("f15_product_cascade_delete", with_views("products", "alerts", body="""
    , gone AS (SELECT p_partkey AS product_id FROM part WHERE p_size = 7), p AS (SELECT product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM gone)),
    h AS (SELECT l_partkey AS product_id FROM lineitem WHERE l_partkey NOT IN (SELECT product_id FROM gone)), a AS (SELECT product_id FROM alerts WHERE product_id NOT IN (SELECT product_id FROM gone))
    SELECT 'products' AS kind, count(*) AS n, CAST(sum(product_id) AS BIGINT) AS id_sum FROM p UNION ALL SELECT 'history', count(*), CAST(sum(product_id) AS BIGINT) FROM h UNION ALL SELECT 'alerts', count(*), CAST(sum(product_id) AS BIGINT) FROM a"""))
def product_cascade_delete(t: Tables):
    doomed = t.raw("part").filter("p_size = 7").select(F.col("p_partkey").alias("product_id"))
    history = t.raw("lineitem").select(F.col("l_partkey").alias("product_id"))
    out = M.product_sets(t.products(), {"history": history, "alerts": t.alerts()}, doomed)
    rows = None
    for name, df in out.items():
        one = df.agg(F.count("*").alias("n"), F.sum("product_id").alias("id_sum")).select(F.lit(name).alias("kind"), "n", "id_sum")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("r15_deal_enrich_cross_store", with_views("listings", "products", body=CONFIG_SQL + DEALS_SQL + EMB_SQL + FACTS_SQL + ATTR_SQL + f"""
    , mt AS (SELECT d.product_id, count(*) AS n FROM deals d JOIN far f ON f.id = d.product_id AND rank <= 5 JOIN facts b ON b.product_id = f.match_id WHERE similarity + 0.65 > 0.9 AND CAST(p AS DOUBLE) - CAST(b.baseline_price AS DOUBLE) < -10 GROUP BY d.product_id),
    e AS (SELECT d.product_id, coalesce(n, 0) AS n, least(1.0, conf + coalesce(n, 0) * 0.1) AS c1, brand IS NOT NULL OR model IS NOT NULL AS known FROM deals d LEFT JOIN mt USING (product_id) JOIN attrs USING (product_id))
    SELECT product_id, n AS cheaper_matches, {r('CASE WHEN known THEN least(1.0, c1 + 0.05) ELSE c1 END')} AS confidence FROM e"""))
def deal_enrich_cross_store(t: Tables):
    facts = product_facts(t).select(F.col("product_id").alias("match_id"), F.col("baseline_price").alias("matched_baseline"))
    # the test vectors are far apart, so their similarity is raised to let some pass the .9 line
    near = neighbours(t, 5, True).withColumn("similarity", F.col("similarity") + 0.65)
    matches = near.join(facts, "match_id").select(F.col("id").alias("product_id"), "similarity", "matched_baseline")
    attributes = T.with_attributes(attr_title(t), "attr_title")
    d = D.enrich_cross_store(found_deals(t), matches, attributes)
    return d.select("product_id", "cheaper_matches", round_to("confidence").alias("confidence"))


@query("r16_candidate_deal", with_rules(FIRST_SQL + f"""
    SELECT event_id, sku, title, p AS current_price, store, {r('coalesce(discount, 0)')} AS discount_percent, {r('conf')} AS confidence,
      'signal,' || CASE event_type WHEN 'purchase' THEN 'clearance' WHEN 'click' THEN 'new_low' ELSE event_type END || CASE WHEN event_id % 3 = 0 THEN ',two_pass' ELSE ',datacenter_pass' END AS signals, evidence AS requirements
    FROM events JOIN outcome ON product_id = user_id WHERE rid IS NOT NULL"""))
def candidate_deal(t: Tables):
    from driftmark.operators import rules as R

    found = R.first_rule_match(rule_prices(t), R.rules_table(t.spark)).filter("triggered").drop("signal_type")
    signals = t.signals().select(F.split("product_id", ":")[1].cast("long").alias("pid"), "signal_id", "retailer", "signal_type")
    d = signals.join(found, F.col("pid") == F.col("product_id"))
    d = d.withColumns({"escalated": F.col("signal_id") % 3 == 0, "scan_pass": F.lit("datacenter"), "evidence": F.col("policy.evidence"), "product_id": F.col("product_id").cast("string"), "event_id": F.col("signal_id"), "retailer": F.col("store")})
    return D.candidate_deal(d, "event_id").select(
        "event_id", "product.sku", "product.title", "product.current_price", "product.store", round_to("discount_percent").alias("discount_percent"),
        round_to("confidence").alias("confidence"), F.array_join("signals", ",").alias("signals"),
        F.array_join("verification.requirements", ",").alias("requirements"),
    )
