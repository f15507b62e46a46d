"""Suppression against a plain loop, with runs cut into many slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftmark.operators import dedupe as G


def loop(rows, ttl, cheaper):
    state, out = {}, []
    for key, at, rid, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last = state.get(key)
        if last is None or (at - last[0]).total_seconds() >= ttl or (cheaper and price < last[1]):
            state[key] = (at, price)
            out.append(rid)
    return sorted(out)


def make_rows(n, keys, step, seed):
    rng = random.Random(seed)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, step, step * 2, step * 3]))
        rows.append((f"k{rng.choice(keys)}", at, i, float(rng.randint(1, 40))))
    return rows


@pytest.mark.parametrize("cheaper", [False, True])
@pytest.mark.parametrize("slice_seconds", [700, 2000, 100000])
def test_slices_equal_loop(spark, cheaper, slice_seconds):
    # one key holds most rows and is never quiet for a TTL
    rows = make_rows(3000, [0, 0, 0, 0, 1, 2], 20, 7)
    df = spark.createDataFrame(rows, "k string, at timestamp, id long, price double")
    ttl = 600
    got = G.ordered_fold(df, ["k"], "at", "id", ttl, lambda: G.Cooldown(ttl * 1_000_000, cheaper), "price", slice_seconds=slice_seconds)
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == loop(rows, ttl, cheaper)
    assert got.count() == len(rows)


def test_ttl_edges(spark):
    base = dt.datetime(2024, 1, 1)
    ttl = 12 * 3600
    rows = [(base, 1), (base + dt.timedelta(seconds=ttl - 1), 2), (base + dt.timedelta(seconds=ttl), 3), (base + dt.timedelta(seconds=2 * ttl + 1), 4)]
    df = spark.createDataFrame([("s", "k", at, i, 10.0) for at, i in rows], "store string, sku string, at timestamp, id long, price double")
    got = G.alert_dedupe(df.withColumn("price", df["price"].cast("decimal(10,2)")), "at", "id")
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == [1, 3, 4]


def test_half_even_bucket(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", "k", at + dt.timedelta(minutes=i), i, p) for i, p in enumerate(["0.50", "1.50", "2.50", "2.00"])], "store string, sku string, at timestamp, id long, p string")
    got = G.alert_dedupe(df.withColumn("price", df["p"].cast("decimal(10,2)")), "at", "id").collect()
    assert {r["id"]: (r["price_bucket"], r["accepted"]) for r in got} == {0: (0, True), 1: (2, True), 2: (2, False), 3: (2, False)}


def test_budget_counts_admitted_rows(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", base + dt.timedelta(minutes=m), m) for m in (0, 10, 20, 61, 62, 71)], "r string, at timestamp, id long")
    got = G.trailing_budget(df, ["r"], "at", "id", [(3600, 2)])
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == [0, 10, 61, 71]


def budget_loop(rows, limits):
    """rows (key, at, id): the plain policy, key by key."""
    out, policies = [], {}
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in policies:
            policies[key] = G.Budget(limits)
            policies[key].reset()
        if policies[key].admit(at, 0.0):
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("limits", [[(600, 3)], [(600, 3), (3000, 10)], [(600, 3), (3000, 4)], [(50, 1)], [(3000, 40), (600, 12)]])
@pytest.mark.parametrize("slices", [1, 7, 16])
def test_budget_equals_loop(spark, limits, slices):
    rng, rows, at = random.Random(11), [], 0
    for i in range(4000):
        at += rng.choice([0, 0, 1, 7, 40, 40, 300, 700]) * 1_000_000
        rows.append((rng.choice(["hot"] * 9 + ["a", "b", None]), at, i))
    df = spark.createDataFrame(rows, "k string, us long, id long").withColumn("at", F.timestamp_micros("us")).repartition(5)
    got = G.trailing_budget(df.select("k", "at", "id"), ["k"], "at", "id", limits, slices)
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == budget_loop(rows, [(s * 1_000_000, n) for s, n in limits])
    assert got.count() == len(rows)


def test_budget_of_a_hot_key(spark):
    """One key has 90 % of the rows and is never quiet."""
    n = 400_000
    d = spark.range(n).withColumn("k", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))))
    d = d.withColumn("us", F.col("id") * 900_000 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5_000_000)))
    limits = [(3600, 12), (6 * 3600, 60)]
    got = G.trailing_budget(d.withColumn("at", F.timestamp_micros("us")), ["k"], "at", "id", limits)
    want = budget_loop([tuple(r) for r in d.select("k", "us", "id").collect()], [(s * 1_000_000, m) for s, m in limits])
    assert sorted(r["id"] for r in got.filter("accepted").select("id").collect()) == want


def test_malformed_subscription_matches_all(spark):
    deals = spark.createDataFrame([(1, "a", "tv", 10.0, 0.2), (2, "b", None, 60.0, 0.9)], "product_id long, store string, category string, discount_percent double, confidence double")
    subs = spark.createDataFrame(
        [(1, "{bad", True), (2, '{"min_discount": 50, "stores": ["b"], "categories": ["tv"]}', True), (3, "{}", False), (4, '{"stores": ["a", "a"]}', True)],
        "webhook_id int, filters string, enabled boolean",
    )
    got = sorted((r["webhook_id"], r["product_id"]) for r in G.subscriber_fanout(deals, subs).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (4, 1)]


def test_null_keys_and_times(spark):
    """A null key is a key of its own, (null, a) is not (a, null), and rows without a time pass."""
    base = dt.datetime(2024, 1, 1)
    rows, rng = [], random.Random(3)
    for i in range(600):
        store, sku = rng.choice([(None, "a"), ("a", None), (None, None), ("a", "a")])
        rows.append((store, sku, base + dt.timedelta(minutes=rng.randint(0, 3000)), i, float(rng.randint(1, 9))))
    timeless = [("a", "a", None, 1000, 5.0), (None, None, None, 1001, 5.0)]
    df = spark.createDataFrame(rows + timeless, "store string, sku string, at timestamp, id long, price double")
    ttl = 1800
    got = G.ordered_fold(df, ["store", "sku"], "at", "id", ttl, lambda: G.Cooldown(ttl * 1_000_000, True), "price", slice_seconds=4000)
    want = loop([(str((s, k)), at, i, p) for s, k, at, i, p in rows], ttl, True)
    accepted = sorted(r["id"] for r in got.filter("accepted").collect())
    assert accepted == sorted(want + [1000, 1001])
    assert got.count() == len(rows) + 2
