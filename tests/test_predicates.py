"""Rules met through an index: equal to testing every rule, whatever the number of rules."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from driftmark.operators import dedupe as G, filters as X, predicates as P


LITERALS = {
    "refurbished": ["refurbished"], "open.?box": ["open"], "(refurb|renewed)": ["refurb", "renewed"], "a|b": ["a", "b"], "x(yes|no)?z": ["x"],
    r"\bbrand#7 (old|new)": ["brand#7 "], "colou?r case": ["r case"], "ab+c": ["ab"], "(ab){2,}cd": ["cd"], "[abc]def[^]]gh": ["def"], r"\d+ pack": [" pack"],
    "": [""], ".*": [""], "(?i)abc": [""], r"\x41bc": [""], "(?:used|pre-owned) item": [" item"], "(": None, "Straße": ["straße"], "a{0,2}bcd": ["bcd"],
    r"1\.5l": ["5l"], "(?P<n>abc)d": ["abcd"], "abc|": [""], "x{": None, "x*?yz": ["yz"], "((a|b)c)+defg": ["defg"], "*a": None, "[a": None, "ab)": None, r"abc\\d": ["abc"],
}


def literals(spark, patterns):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, p string").select("i", P.pattern_literals(F.col("p")).alias("found")).collect()
    found = {r.i: r.found for r in rows}
    return [found[i] for i in range(len(patterns))]


def test_literals(spark):
    assert dict(zip(LITERALS, literals(spark, list(LITERALS)))) == LITERALS


def test_every_match_holds_a_literal(spark):
    rng = random.Random(4)
    parts = ["ab", "c", "B", r"\.", "[ab]", "[^c]", ".", r"\w", r"\b", "^", "(a|bc)", "(?:ab|c)", "(a(b|c))", "(x|)", "(ab)", "((a)b)"]
    ends = ["", "", "", "?", "*", "+", "{2}", "{0,1}", "{1,}", "??", "+?"]
    texts = ["".join(rng.choice("abcABCx.") for _ in range(rng.randrange(12))) for _ in range(60)]
    patterns = []
    for _ in range(1500):
        pattern = "".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randrange(1, 6)))
        patterns.append("|".join([pattern, rng.choice(parts)]) if rng.random() < 0.2 else pattern)
    held = valid = 0
    for pattern, needles in zip(patterns, literals(spark, patterns)):
        try:
            found = re.compile(pattern, re.IGNORECASE | re.ASCII)
        except re.error:
            continue
        assert needles is not None, pattern
        valid += 1
        for t in texts:
            if found.search(t):
                assert any(n in t.lower() for n in needles), (pattern, t)
        held += needles != [""]
    assert held > valid / 4


def test_nodes_cover_each_band_once(spark):
    d = spark.range(16).select(F.col("id").cast("int").alias("b"))
    lows = {r.b: set(r.n) for r in d.select("b", P.nodes_from(F.col("b")).alias("n")).collect()}
    own = {r.b: list(r.n) for r in d.select("b", P.nodes_above(F.col("b")).alias("n")).collect()}
    for m, b in itertools.product(range(16), range(16)):
        assert len(lows[m] & set(own[b])) == (1 if b >= m else 0)
    values = spark.createDataFrame([(-5.0, 0), (0.0, 0), (6.24, 0), (6.25, 1), (99.0, 15), (1000.0, 15)], "v double, b int")
    assert values.filter(P.band(F.col("v"), 6.25) != F.col("b")).count() == 0


def excluded(listing, rules):
    store, title, sku = listing
    text = " ".join(x for x in (title, sku) if x is not None)
    for r_store, r_sku, keyword, brand, enabled in rules:
        if not enabled or r_store not in (store, "*"):
            continue
        if r_sku is not None and r_sku == sku:
            return True
        if keyword is not None and re.search(keyword, text, re.IGNORECASE | re.ASCII):
            return True
        if brand is not None and title is not None and brand.lower() in title.lower():
            return True
    return False


LISTING = "store string, title string, sku string"
RULE = "store string, sku string, keyword string, brand string, enabled boolean"


def test_exclusions_against_every_rule(spark):
    rng = random.Random(6)
    words = ["Open", "box", "refurb", "TV", "Köln", "4K", "brand#1", "brand#12", "x", "(new)", "case"]
    listings = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(5))), rng.choice([None, f"P{rng.randrange(9)}"])) for _ in range(400)]
    keywords = [r"\bopen.?box", "refurb|case$", r"\(NEW\)", "k..n", "4k (tv|x)", "brand#1(?!2)", ".{30}", "xx?", None]
    rules = [(rng.choice(["a", "b", "*", "c"]), rng.choice([None, None, f"P{rng.randrange(9)}"]), rng.choice(keywords) if rng.random() < 0.3 else None, rng.choice(["KÖLN", "brand#12", "tv", "", None]) if rng.random() < 0.2 else None, rng.random() < 0.8) for _ in range(12)]
    for some in (rules, rules[:3], []):
        got = X.without_excluded(spark.createDataFrame(listings, LISTING), spark.createDataFrame([*some, ("*", None, "(", None, True), ("*", None, None, "not there", True)], RULE))
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(x) for x in listings if not excluded(x, some))


def test_a_hundred_thousand_patterns_in_one_store(spark):
    n = 100_000
    rules = spark.range(n).select(
        F.lit("a").alias("store"), F.lit(None).cast("string").alias("sku"), F.concat(F.lit("model "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("( used)?$")).alias("keyword"),
        F.lit(None).cast("string").alias("brand"), F.lit(True).alias("enabled"),
    )
    listings = [("a", f"Model {i:06d} used", "s") for i in range(0, 3000, 7)] + [("a", f"model {i:06d}", None) for i in range(500)] + [("b", "model 000001", None), ("a", "model 7", None), ("a", f"MODEL {n:06d}", None)]
    got = X.without_excluded(spark.createDataFrame(listings, LISTING), rules).collect()
    want = [x for x in listings if not (x[0] == "a" and x[2] is None and re.fullmatch(r"model \d{6}", x[1], re.I) and int(x[1][6:]) < n)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


DEAL = "product_id long, store string, category string, discount_percent double, confidence double"


def fanned(deals, subs):
    out = []
    for product, store, category, discount, confidence in deals:
        for hook, text, enabled in subs:
            try:
                f = json.loads(text)
            except json.JSONDecodeError:
                f = {}
            if not enabled or discount is None or discount < (f.get("min_discount") or 0) or confidence is None or confidence < (f.get("min_confidence") or 0):
                continue
            if f.get("stores") and store not in f["stores"]:
                continue
            if f.get("categories") and category is not None and not any(c.lower() in category.lower() for c in f["categories"]):
                continue
            out.append((hook, product))
    return sorted(out)


def made_up(n_deals, n_subs, seed=5):
    rng = random.Random(seed)
    deals = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["Electronics TV", "home", "tv", "x", "", None, "Garden tools"]), rng.choice([None, rng.uniform(-5, 110), 6.25, 50.0]), rng.choice([None, rng.random()])) for i in range(n_deals)]
    subs = []
    for w in range(n_subs):
        f = {}
        if rng.random() < 0.6:
            f["min_discount"] = rng.choice([0, 6.25, 50, 93.75, rng.uniform(-1, 120)])
        if rng.random() < 0.5:
            f["stores"] = rng.choice([[], ["a"], ["a", "b", "a"], ["z"]])
        if rng.random() < 0.6:
            f["categories"] = rng.choice([[], ["TV", "electronics"], ["o"], ["home", "ome", "garden"], ["none such"], [""]])
        if rng.random() < 0.4:
            f["min_confidence"] = rng.random()
        subs.append((w, "{broken" if rng.random() < 0.05 else json.dumps(f), rng.random() < 0.85))
    return deals, subs


def test_fanout_against_every_pair(spark):
    deals, subs = made_up(120, 150)
    got = G.subscriber_fanout(spark.createDataFrame(deals, DEAL), spark.createDataFrame(subs, "webhook_id int, filters string, enabled boolean"))
    assert sorted((r.webhook_id, r.product_id) for r in got.collect()) == fanned(deals, subs) != []


def test_fanout_on_streams(spark, tmp_path):
    deals, subs = made_up(90, 60, 9)
    d = spark.createDataFrame(deals, DEAL)
    for part in range(3):
        d.filter(F.col("product_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.createDataFrame(subs, "webhook_id int, filters string, enabled boolean")
    live = G.subscriber_fanout(spark.readStream.schema(DEAL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), s)
    live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.webhook_id, r.product_id) for r in spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()) == fanned(deals, subs)


def test_fanout_to_many_subscriptions_follows_the_matches(spark):
    """A hundred thousand subscriptions, each to a category of its own: what meets grows with the matches."""
    n = 100_000
    subs = spark.range(n).select(F.col("id").cast("int").alias("webhook_id"), F.concat(F.lit('{"categories": ["cat '), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit('"]}')).alias("filters"), F.lit(True).alias("enabled"))
    deals = spark.createDataFrame([(i, "a", f"cat {i * 31 % n:06d} things", 50.0, 0.5) for i in range(300)], DEAL)
    got = G.subscriber_fanout(deals, subs)
    assert sorted((r.webhook_id, r.product_id) for r in got.collect()) == sorted((i * 31 % n, i) for i in range(300))
