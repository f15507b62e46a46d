"""Nothing is cut or lost: null keys in sliced windows, nested sitemaps, whole alert documents, long titles."""

import datetime as dt
import json
import random

from pyspark.sql import Window as W, functions as F

from driftmark.functions import markup as H, text
from driftmark.operators import pages as P, skew
from driftmark.sources import feeds, tablesync


def test_slices_keep_nulls(spark):
    rng, base = random.Random(1), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        key = rng.choice([None, "x", "y"])
        at = None if rng.random() < 0.1 else base + dt.timedelta(hours=rng.randint(0, 400))
        rows.append((key, at, i, rng.randint(1, 50)))
    df = spark.createDataFrame(rows, "k string, at timestamp, id long, v int")
    w = W.partitionBy("k").orderBy("at", "id")
    plain = df.select("id", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    lagged = skew.sliced_lag(df, ["k"], ["at", "id"], ["v"], "DAY").select("id", "prev_v")
    summed = skew.sliced_sum(df, ["k"], ["at", "id"], F.col("v"), "DAY", "s").select("id", "s")
    want = {r.id: (r.p, r.s) for r in plain.collect()}
    assert {r.id: r.prev_v for r in lagged.collect()} == {i: p for i, (p, _) in want.items()}
    assert {r.id: r.s for r in summed.collect()} == {i: s for i, (_, s) in want.items()}
    near = skew.sliced_trailing(df, ["k"], "at", 3600 * 30, {"n": F.count("*")}).select("id", "n").collect()
    assert len(near) == len(rows)
    for r in near:
        k, at = rows[r.id][0], rows[r.id][1]
        if at is not None:
            assert r.n == sum(1 for q in rows if q[0] == k and q[1] is not None and at - dt.timedelta(hours=30) <= q[1] <= at)


def test_nested_sitemaps(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    docs = [("root", index("mid", "leaf0")), ("mid", index("deep", "root")), ("deep", index(*[f"leaf{i}" for i in range(1, 40)]))]
    docs += [(f"leaf{i}", f"<urlset><url><loc>https://s/p/{i}</loc></url></urlset>") for i in range(40)]
    got = feeds.sitemap_urls(spark.createDataFrame(docs, "doc_url string, xml string"), spark.createDataFrame([("root",)], "doc_url string"))
    assert sorted(r.url for r in got.collect()) == sorted(f"https://s/p/{i}" for i in range(40))


def test_whole_alert_documents(spark):
    templates = [
        '{"tags": ["a", "b"], "one": ["z"]}', '{"type": "custom", "n": 1, "s": "1", "deep": {"x": [1, {"y": null}]}}',
        '{"quote\\"key": "say \\"hi\\"\\n\\\\ done", "": "left out", "flag": true, "none": null}', "[1, 2]", "{broken", None, '"text"',
    ]
    rows = [(i, t, 50.0, 0.9, "m", True, "r", "c", "s", 10.0, "b", "sku", "st\"ore", "ti\ntle", "u", 5.0, 9.0) for i, t in enumerate(templates)]
    schema = "id int, template string, discount_percent double, confidence double, detection_method string, is_price_error boolean, reason string, category string, signals string, baseline_price double, baseline_source string, sku string, store string, title string, url string, current_price double, original_price double"
    df = spark.createDataFrame(rows, schema).withColumn("sent_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for r in tablesync.alert_payload(df).collect():
        doc = json.loads(r.payload)
        try:
            own = json.loads(r.template) if r.template else {}
        except ValueError:
            own = {}
        own = {k: v for k, v in own.items() if k} if isinstance(own, dict) else {}
        assert {k: doc[k] for k in own} == own
        assert set(doc) == {"type", "timestamp", "deal", "product"} | set(own)
        if "type" not in own:
            assert doc["type"] == "price_alert" and doc["timestamp"].startswith("2024-01-02 03:04:05")
        assert doc["product"]["store"] == 'st"ore' and doc["product"]["title"] == "ti\ntle" and doc["deal"]["baseline_price"] == 10.0


def test_long_specs_are_whole(spark):
    title = "Acme " + " ".join(f"word{i}" for i in range(60))
    row = spark.createDataFrame([(title,)], "t string").select(text.leftover_spec(F.col("t"), F.lit("Acme"), F.lit(None).cast("string")).alias("s")).first()
    assert row.s == title[5:]


def test_markup_of_any_quoting(spark):
    from driftmark.functions import markup as H
    from driftmark.operators import pages as P

    page = """<ul><li class=sku-item data-sku-id='11'><img data-src=/i/11.png><h4 class='sku-title'><a href='/site/11.p?a=1&amp;b=2'>A &amp; B &quot;C&quot;</a></h4>
      <div class="priceView-customer-price"><span>$5.00</span></div></li>
      <li class="sku-item"><span class='sku-value'>22</span><h4 class="sku-title" title="x y=z w"><a href="/site/22.p">Second</a></h4></li></ul>"""
    df = spark.createDataFrame([("p", "bestbuy", page)], "page_id string, store string, html string")
    rows = {r.sku: r for r in P.page_listings(df, P.layout_table(spark)).collect()}
    assert set(rows) == {"11", "22"}
    assert rows["11"].title == 'A & B "C"' and rows["11"].url == "https://www.bestbuy.com/site/11.p?a=1&b=2"
    assert rows["11"].image_url == "https://www.bestbuy.com/i/11.png" and rows["22"].image_url is None
    forms = ["<a b='c' d=e f=\"g h=i j\">k =l 'm'</a>", "plain x=1 > y", '<script>{"a": "b=c"}</script><i x=\'y\'>']
    want = ['<a b="c" d="e" f="g h=i j">k =l \'m\'</a>', "plain x=1 > y", '<script>{"a": "b=c"}</script><i x="y">']
    got = spark.createDataFrame(list(enumerate(forms)), "i int, h string").select("i", H.canonical(F.col("h")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got][::2] == want[::2]
    link = spark.createDataFrame([("<a aria-label='Next' href='?page=2&amp;q=a'>n</a>",)], "h string").select(P.next_page(F.col("h"), F.lit("https://s.example")).alias("n")).first()
    assert link.n == "https://s.example/?page=2&q=a"


def test_learned_fusion(spark, tables):
    """The fused score follows from the methods' own columns, as a plain loop over rows gives it."""
    from driftmark.operators import anomaly as A
    from driftmark.plans.learned import learned_fusion

    rows = learned_fusion(tables).collect()
    assert rows and any(r.n_methods >= 3 for r in rows)
    for r in rows:
        learned = [s for s in (r.isolation_score, r.mixture_score, r.reconstruction_score) if s is not None]
        vote = len(learned) >= 2 and all(s > 0.5 for s in learned)
        assert bool(r.ensemble_hit) == vote
        if vote:
            assert abs(r.ensemble_score - sum(learned) / len(learned)) < 1e-9
        fired = [(name, r[score]) for hit, score, name in A.METHODS + A.LEARNED_METHODS if r[hit]]
        assert list(r.methods) == [n for n, _ in fired] and r.n_methods == len(fired)
        score = sum(s or 0.0 for _, s in fired) / max(1, len(fired))
        if len(fired) >= 2:
            score = min(1.0, score * 1.2)
        if len(fired) >= 3:
            score = min(1.0, score * 1.1)
        assert abs(r.anomaly_score - score) < 1e-9 and r.is_anomaly == bool(fired)


def test_nested_elements_of_one_name(spark):
    """Items and texts are whole elements: same-name tags nest, attributes come in any order, items lie within items."""
    amazon = (
        '<div class="grid"><div data-asin="B1" id="r1" data-component-type="s-search-result"><div><div>ad</div></div><h2 class="t"><a href="/dp/B1" class="x"><span>One <span>big</span> tv</span></a></h2>'
        '<span class="w a-price"><span class="a-offscreen"><span>$</span><span>1,299.00</span></span></span></div><div>between <span class="a-price"><span class="a-offscreen">$1.00</span></span></div>'
        '<div data-component-type="s-search-result" data-asin="B2"><h2><a href="/dp/B2"><span>Two</span></a></h2></div></div><h2><a href="/z"><span>outside</span></a></h2>'
    )
    target = (
        '<ul data-test="product-grid"><li><div><ul><li>new</li></ul></div><a href="/p/x/A-11">go</a><div data-test="product-title"><div>Inner</div> title</div><b data-test="current-price">$5.00</b></li>'
        '<li><a href="/p/x/A-12">go</a><p data-test="product-title">Second</p></li></ul><li><a href="/p/x/A-13">go</a><p data-test="product-title">not in the grid</p></li>'
    )
    woot = '<article class="a"><article class="b"><h2>In</h2><a class="dealLink" href="/offers/in">l</a></article><h2>Out</h2><a class="dealLink" href="/offers/out">l</a>'  # the outer one is never closed
    rows = [(1, "amazon_us", amazon), (2, "target", target), (3, "woot", woot)]
    df = spark.createDataFrame(rows, "page_id int, store string, html string")
    got = {(r.store, r.sku): (r.title, r.url, None if r.current_price is None else float(r.current_price)) for r in P.page_listings(df, P.layout_table(spark)).collect()}
    assert got[("amazon_us", "B1")] == ("One big tv", "https://www.amazon.com/dp/B1", 1299.0)
    assert got[("amazon_us", "B2")] == ("Two", "https://www.amazon.com/dp/B2", None)
    assert got[("target", "11")] == ("Inner title", "https://www.target.com/p/x/A-11", 5.0)
    assert got[("target", "12")][0] == "Second" and ("target", "13") not in got
    assert got[("woot", "woot-in")][0] == "In"
    assert {k for k in got if k[0] == "amazon_us"} == {("amazon_us", "B1"), ("amazon_us", "B2")}


def test_crumbs_in_nested_elements(spark):
    html = '<nav class="x breadcrumb"><nav><a href="/">Home</a></nav><a href="/c/toys?x=1">Toys</a></nav><a href="/c/other">Shop other</a>'
    got = P.page_categories(spark.createDataFrame([(1, "target", html)], "page_id int, store string, html string")).collect()
    assert [(r.category_url, r.category_name, r.category_confidence) for r in got] == [("https://www.target.com/c/toys", "Toys", 0.9)]


def test_intervals(spark):
    page = '<a><b>x<b>y</b></b><img><b>z</a>'
    tags = H.tagged(F.col("h"))
    row = spark.createDataFrame([(page,)], "h string").select(
        H.intervals(tags, F.transform(tags, lambda t: t["tag"] == "b")).alias("b"), H.intervals(tags, F.transform(tags, lambda t: t["tag"].isin("a", "img"))).alias("a"),
        H.element(F.col("h"), F.lit("<b>y")).alias("text"),
    ).first()
    assert [tuple(x) for x in row.b] == [(1, 4), (2, 3), (6, 7)] and [tuple(x) for x in row.a] == [(0, 7), (5, 5)]


def test_priced_objects_at_any_depth(spark):
    """Against a walk over the parsed text: nesting, arrays, braces and quotes within strings, keys of inner objects only."""
    def walk(node):
        out = []
        if isinstance(node, dict):
            out = [node] if {"title", "name"} & set(node) and {"price", "currentPrice", "priceValue"} & set(node) else []
        for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
            out += walk(child)
        return out

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, 2.5, None, True, "x", 'a "quoted" {brace}', "price", "back\\slash", "é\n"])
        if kind < 0.5:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["title", "name", "price", "currentPrice", "priceValue", "a", "b"]): make(depth - 1) for _ in range(rng.randrange(5))}

    rng = random.Random(12)
    made = [make(6) for _ in range(150)] + [{"title": "t", "price": {"title": "in", "price": 1}}]
    df = spark.createDataFrame([(i, json.dumps(m, indent=rng.choice([None, 1]))) for i, m in enumerate(made)] + [(999, None), (1000, '{"title": 1, "price"'), (1001, "")], "i int, t string")
    got = {r.i: r.found for r in df.select("i", P.priced_objects(F.col("t")).alias("found")).collect()}
    for i, m in enumerate(made):
        assert [json.loads(x) for x in got[i]] == walk(m)
    assert not got[999] and not got[1000] and not got[1001] and sum(len(got[i]) for i in range(len(made))) > 20
