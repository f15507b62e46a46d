"""Hand-worked boundary cases and brute-force comparisons."""

import datetime as dt
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions import cleaning, identity, text
from driftmark.operators import anomaly as A, baseline as B, deals as D, learning as L, matching as M, monitor, pages as P, rules as R, skew

DAY = dt.datetime(2024, 3, 1)
OBS = "product_id long, price decimal(10,2), original_price decimal(10,2), availability string, confidence double, fetched_at timestamp, id long"


def observations(spark, prices, product=1):
    rows = [
        (product, None if p is None else Decimal(str(p)), Decimal("100"), "in_stock", 1.0, DAY + dt.timedelta(hours=i), i)
        for i, p in enumerate(prices)
    ]
    return spark.createDataFrame(rows, OBS)


def profile(spark, prices):
    return B.product_profile(observations(spark, prices), F.lit(DAY + dt.timedelta(days=1))).first()


@pytest.mark.parametrize("prices", [[5], [5, 7], [5, 7, 9], [1, 2, 3, 4], [3, 1, 2, 2, 9], [10.5] * 6, [99.99, 0.01, 50, 50, 50, 12.34, 7]])
def test_profile_matches_formulas(spark, prices):
    r = profile(spark, prices)
    s = sorted(prices)
    assert r["n"] == len(prices)
    assert r["mean"] == pytest.approx(statistics.mean(prices))
    assert r["median"] == pytest.approx(statistics.median(prices))
    assert r["std_dev"] == pytest.approx(statistics.stdev(prices) if len(prices) > 1 else 0.0)
    assert (float(r["q1"]), float(r["q3"])) == (s[len(s) // 4], s[3 * len(s) // 4])
    assert (float(r["min_price"]), float(r["max_price"])) == (s[0], s[-1])


def test_constant_price_has_no_deviation(spark):
    r = profile(spark, [899.10] * 30)
    assert r["std_dev"] == 0.0 and r["stability"] == 1.0


def test_non_positive_prices_count_only_as_observations(spark):
    r = profile(spark, [10, 0, -3, None, 20])
    assert (r["observation_count"], r["n"]) == (5, 2)
    assert float(r["min_price"]) == 10


def test_newest_is_taken_out(spark):
    o = observations(spark, [10, 20, 30, 30])
    r = B.profile_before_newest(o, ("fetched_at", "id"), F.lit(DAY + dt.timedelta(days=1))).first()
    assert (float(r["current_price"]), r["n"], float(r["max_price"])) == (30, 3, 30)
    assert r["recent_mean"] == pytest.approx(20)
    one = B.profile_before_newest(observations(spark, [5]), ("fetched_at", "id"), F.lit(DAY))
    assert one.count() == 0


@pytest.mark.parametrize("z,want", [(-3.1, 0.1), (3.1, 99.9), (0.0, 50.0), (-2.0, 20.0), (None, 50.0)])
def test_percentile_from_z(spark, z, want):
    d = spark.createDataFrame([(z,)], "z double")
    assert d.select(B.percentile_from_z(F.col("z")).alias("p")).first()["p"] == pytest.approx(want)


@pytest.mark.parametrize("old,new,want", [("500.00", "50.00", True), ("500.00", "45.00", True), ("500.00", "44.99", False), ("500.00", "5.00", True), ("19.99", "1.99", True), ("10.00", "9.00", False), ("0.00", "1.00", False)])
def test_decimal_shift(spark, old, new, want):
    d = spark.createDataFrame([(Decimal(old), Decimal(new))], "o decimal(10,2), n decimal(10,2)")
    assert d.select(A.decimal_shift(F.col("o"), F.col("n")).alias("x")).first()["x"] is want


@pytest.mark.parametrize("percent,want", [(49.9, 0.65), (50, 0.95), (70, 0.95), (70.1, 0.9), (85, 0.9), (85.1, 0.85), (95, 0.85), (95.1, 0.65)])
def test_deal_confidence_bands(spark, percent, want):
    d = spark.createDataFrame([(float(percent),)], "p double")
    got = d.select(D.deal_confidence(F.col("p"), F.lit(True), F.lit(True)).alias("c")).first()["c"]
    assert got == pytest.approx(want)


def test_strikethrough_wins_ties(spark):
    rows = [("a", Decimal("40"), Decimal("100"), Decimal("100")), ("b", Decimal("40"), None, Decimal("100")), ("c", Decimal("60"), Decimal("100"), Decimal("100")), ("d", Decimal("0"), Decimal("100"), None)]
    d = D.detect(spark.createDataFrame(rows, "sku string, current_price decimal(10,2), original_price decimal(10,2), msrp decimal(10,2)"))
    got = {r["sku"]: (r["detection_method"], r["signals"]) for r in d.collect()}
    assert got == {"a": ("combined", ["strikethrough", "msrp"]), "b": ("msrp", ["msrp"])}


def test_rules_go_by_priority_then_id(spark):
    rules = R.rules_table(spark, [(5, "e", "absolute", 10.0, True, 1), (2, "b", "absolute", 10.0, True, 7), (1, "a", "absolute", 10.0, True, 7), (9, "off", "absolute", 10.0, False, 99)])
    d = spark.createDataFrame([("x", Decimal("5"), "in_stock", None, None, None, 100.0, Decimal("100"), 1.0, None)], "store string, current_price decimal(10,2), availability string, seller_type string, signal_type string, sold_median double, baseline_price double, msrp decimal(10,2), confidence double, ml_score double")
    assert R.first_rule_match(d, rules).first()["rule"]["id"] == 1


@pytest.mark.parametrize("raw,want", [("unavailable", "out_of_stock"), ("Available now", "in_stock"), ("pre-order", "preorder"), ("", "unknown"), (None, "unknown")])
def test_availability(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "a string")
    assert d.select(cleaning.availability(F.col("a")).alias("x")).first()["x"] == want


URLS = [
    ("amazon_us", "https://www.amazon.com/dp/B012345678?x", "B012345678"), ("amazon_us", "https://a/gp/product/B012345678", "B012345678"), ("walmart", "https://w/ip/99", "99"), ("walmart", "https://w/x?itemId=7", "7"),
    ("target", "https://t/p/x/-/A-55", "55"), ("target", "https://t/?preselect=5", "5"), ("bestbuy", "https://b/site/abc/123.p", "123"), ("bestbuy", "https://b/?skuId=1", "1"), ("costco", "https://c/a.product.4.html", "4"),
    ("newegg", "https://n/p/N82-E1", "N82-E1"), ("macys", "https://m/shop/product/x/12", "12"), ("homedepot", "https://h/p/x/3", "3"), ("lowes", "https://l/pd/x/8", "8"), ("microcenter", "https://m/product/6/x", "6"),
    ("gamestop", "https://g/p/1", "1"), ("bhphotovideo", "https://b/c/product/9-REG", "9"), ("kohls", "https://k/product/prd-2/x", "2"), ("officedepot", "https://o/catalog/catalogSku.do?id=4", "4"), ("ebay", "https://e/itm/11", "11"),
]


def test_product_ids(spark):
    d = spark.createDataFrame(URLS + [("ebay", "https://e/none", None)], "r string, u string, want string")
    for row in d.select("want", "u", identity.extract_product_id(F.col("r"), F.col("u")).alias("got"), identity.canonical_product_id(F.col("r"), F.lit(None).cast("string"), F.col("u")).alias("c")).collect():
        assert row["got"] == row["want"], row["u"]
        assert row["want"] is not None or len(row["c"].split(":")[1]) == 40


def test_unescape_is_complete(spark):
    d = spark.createDataFrame([("&eacute;&#233; &amp;lt;<b>x</b>  w/case est 5",)], "t string")
    assert d.select(text.normalize(F.col("t")).alias("x")).first()["x"] == "éé &lt;x withcase estimated 5"


def test_sliced_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}", DAY + dt.timedelta(seconds=rng.randint(0, 200000)), i, rng.randint(1, 5)) for i in range(1500)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, id long, v int")
    by = {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(k, []).append((ts, i, v))
    want = {}
    for k, xs in by.items():
        total = 0
        for j, (ts, i, v) in enumerate(xs):
            total += v
            inside = [x for x in xs if dt.timedelta(0) <= ts - x[0] <= dt.timedelta(seconds=3600)]
            want[i] = (xs[j - 1][2] if j else None, j + 1, total, len(inside), len({x[2] for x in inside}))
    lag = {r["id"]: r["prev_v"] for r in skew.sliced_lag(d, ["k"], ["ts", "id"], ["v"], "HOUR").collect()}
    rank = {r["id"]: r["rank"] for r in skew.sliced_rank(d, ["k"], ["ts", "id"], "HOUR").collect()}
    run = {r["id"]: r["s"] for r in skew.sliced_sum(d, ["k"], ["ts", "id"], F.col("v"), "DAY", "s").collect()}
    trail = {r["id"]: r["c"] for r in skew.sliced_trailing(d, ["k"], "ts", 3600, {"c": F.count("*")}).collect()}
    distinct = {r["id"]: r["distinct_values"] for r in R.trailing_distinct(d, "k", "ts", "v", 3600).collect()}
    assert {i: (lag[i], rank[i], run[i], trail[i], distinct[i]) for i in lag} == want


def test_results_do_not_depend_on_partitions(spark):
    o = observations(spark, [float(x % 17 + 1) for x in range(200)])
    as_of = F.lit(DAY + dt.timedelta(days=9))
    a = B.trend_features(o.repartition(1), ("fetched_at", "id"), as_of).first()
    b = B.trend_features(o.repartition(7), ("fetched_at", "id"), as_of).first()
    assert a["trend_slope"] == pytest.approx(b["trend_slope"]) and a["ma_7"] == pytest.approx(b["ma_7"])
    prices = [float(x % 17 + 1) for x in range(200)]
    assert a["trend_slope"] == pytest.approx(np.polyfit(range(200), prices, 1)[0])
    assert a["ma_14"] == pytest.approx(np.mean(prices[-14:]))


def clustered(spark, n=400, dims=16):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, dims))
    v = centers[np.arange(n) % 40] + rng.normal(scale=0.15, size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist(), str(i % 3)) for i, x in enumerate(v)], "product_id long, embedding array<double>, store string")


def test_exact_and_approximate_neighbours(spark):
    v, d = clustered(spark)
    sim = np.round(v @ v.T, 8)
    np.fill_diagonal(sim, -1)
    want = {(i, int(j)) for i in range(len(v)) for j in sorted(np.flatnonzero(sim[i] >= 0.8), key=lambda j: (-sim[i, j], j))[:10]}
    exact = {(r["id"], r["match_id"]) for r in M.knn(d, d, 10, 0.8, block_rows=40).collect()}
    assert exact == want
    near = {(r["id"], r["match_id"]) for r in M.approximate_knn(d, d, 10, 0.8, dims=16, tables=12, bits=4, block_rows=7).collect()}
    assert len(near & want) / len(want) >= 0.9


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    x[:6] = 9 + rng.normal(size=(6, 5))
    d = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in L.FEATURES))
    model = L.fit_forest(d, ["id"])
    top = [r["id"] for r in model.score(d).orderBy(F.desc("isolation_score")).limit(30).collect()]
    assert set(range(6)) <= set(top)
    assert L.fit_forest(d.limit(50), ["id"]) is None


def test_mixture_likelihood_never_falls():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(10, 1, (4, 20)), rng.normal(30, 2, (4, 20))], axis=1)
    used = np.ones_like(x, dtype=bool)
    used[0, 30:] = False
    *_, history = L.fit_mixture(x, used, 3)
    assert all((b - a > -1e-9).all() for a, b in zip(history, history[1:]))


def test_smoothed_latency_equals_recursion(spark):
    rng = random.Random(5)
    rows = [(1, i, DAY + dt.timedelta(minutes=i), rng.random() > 0.3, rng.uniform(1, 900)) for i in range(60)]
    avg = 0.0
    for *_, ok, ms in rows:
        if ok:
            avg = ms if avg == 0 else avg * 0.9 + ms * 0.1
    d = spark.createDataFrame(rows, "source_id long, request_id long, ts timestamp, success boolean, duration_ms double")
    assert monitor.source_stats(d, "HOUR").first()["avg_latency_ms"] == pytest.approx(avg)


@pytest.mark.parametrize("n,p95,p99", [(5, 4, 4), (20, 19, 19), (21, 19, 20), (51, 48, 50), (100, 95, 99)])
def test_positional_percentiles(spark, n, p95, p99):
    d = spark.createDataFrame([("d", DAY + dt.timedelta(seconds=i), i, float(i)) for i in range(n)], "domain string, ts timestamp, request_id long, duration_ms double")
    r = monitor.latency_percentiles(d, "domain").first()
    assert (r["p50"], r["p95"], r["p99"]) == (n // 2, p95, p99)


def test_block_pages_and_counts(spark):
    grid = '<div class="product-card">x</div>'
    rows = [(1, "walmart", "<title>Robot Check</title>"), (2, "walmart", "short 404"), (3, "walmart", "ok " * 500), (4, "walmart", "ok " * 500 + grid), (5, "walmart", "ok " * 500 + grid * 5), (6, "walmart", "ok " * 500 + grid * 10), (7, "walmart", "")]
    got = {r["page_id"]: (r["block_type"], r["product_count"], r["page_confidence"]) for r in P.analyze(spark.createDataFrame(rows, "page_id int, store string, html string")).collect()}
    assert got == {1: ("captcha", 0, 0.9), 2: ("error_page", 0, 0.9), 3: (None, 0, 0.3), 4: (None, 1, 0.7), 5: (None, 5, 0.85), 6: (None, 10, 0.95), 7: (None, 0, 0.0)}


def test_no_query_uses_a_cross_join_or_python_where_sql_will_do(spark, tables):
    from driftmark.plans import registry

    registry.load()
    for name in ("flagship_price_anomalies", "d05_baseline_cache", "e15_rapid_drop", "g13_subscriber_fanout", "c02_exclusion_antijoin"):
        plan = registry.QUERIES[name](spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan, name


def test_history_scan_prunes_and_pushes(spark, tables):
    d = B.history_scan(tables.observations(), tables.NEWEST, F.lit(dt.datetime(2000, 1, 1)), days=30, limit=5).select("product_id", "price")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan and "WindowGroupLimit" in plan


def test_rule_constants():
    assert len(params.CATEGORY_THRESHOLDS) == 25 and len(params.TEST_STORES) == 18


def test_category_links(spark):
    rows = [
        (1, "amazon_us", '<div class="a-breadcrumb"><a href="/x">All</a><a href="/y">Toys</a><a href="/s?k=puzzle">Puzzles</a></div>'),
        (2, "amazon_us", '<a href="/s?k=tv&b=1">TV Deals</a>'), (3, "costco", '<div class="breadcrumb"><a href="/">Home</a><a href="/Browse/a?b">Audio</a></div>'),
        (4, "lowes", '<div class="breadcrumb"><a href="/">Home</a><a href="/pl/saws?x">Saws</a></div>'), (5, "walmart", '<a href="/browse/tv?x=1">See all TVs</a>'), (6, "homedepot", "<p>none</p>"),
    ]
    got = {r["page_id"]: (r["category_url"], r["category_name"], r["category_confidence"]) for r in P.page_categories(spark.createDataFrame(rows, "page_id int, store string, html string")).collect()}
    assert got == {
        1: ("https://www.amazon.com/s?k=puzzle", "Toys > Puzzles", 0.9), 2: ("https://www.amazon.com/s?k=tv&b=1", "TV Deals", 0.7), 3: ("https://www.costco.com/Browse/a", "Audio", 0.8),
        4: ("https://www.lowes.com/pl/saws", "Saws", 0.9), 5: ("https://www.walmart.com/browse/tv", "see all tvs", 0.7),
    }
