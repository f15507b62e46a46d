"""Source, sink and page queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions.numbers import MONEY, round_to
from driftmark.operators import baseline as B, deals as D, pages as P
from driftmark.plans.listings import DEALS_SQL, CONFIG_SQL, FLAGS_SQL, deal_listings, flagged, found_deals, with_deals
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, with_views
from driftmark.plans.statistics import CACHE_SQL, cache_rows, with_profile
from driftmark.session import checkpoint_root
from driftmark.sources import feeds as S, tablesync as Y
from driftmark.sources.tables import Tables


def scratch(t: Tables, name: str) -> str:
    """A new folder beside the checkpoints, for a table that a query writes and reads back."""
    return f"{checkpoint_root(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a02_observation_append", with_views("observations", body="SELECT CAST(fetched_at AS DATE) AS dt, 2 * count(*) AS n, CAST(2 * sum(price) AS DECIMAL(20,2)) AS total FROM observations GROUP BY 1"))
def observation_append(t: Tables):
    path = scratch(t, "observations")
    o = t.observations().select("product_id", "price", F.date_trunc("YEAR", "fetched_at").cast("timestamp_ntz").alias("year"), "fetched_at")
    for _ in range(2):  # two appends, as two runs would make
        Y.append_observations(o, path, ts="year")
    back = t.spark.read.parquet(path)
    return back.groupBy(F.to_date("fetched_at").alias("dt")).agg(F.count("*").alias("n"), F.sum("price").cast("decimal(20,2)").alias("total"))


@query("a03_product_upsert", with_views("products", body="""
    , old AS (SELECT store, sku, CASE WHEN product_id % 4 = 0 THEN NULL ELSE url END AS url, title, CASE WHEN product_id % 5 = 0 THEN NULL ELSE msrp END AS msrp FROM products WHERE product_id % 3 <> 0),
    inc AS (SELECT store, sku, url || '?new' AS url, title || ' new' AS title, CAST(msrp + 1 AS DECIMAL(10,2)) AS msrp FROM products WHERE product_id % 2 = 0)
    SELECT coalesce(o.store, i.store) AS store, coalesce(o.sku, i.sku) AS sku, coalesce(nullif(o.url, ''), i.url) AS url, coalesce(nullif(o.title, ''), i.title) AS title, coalesce(nullif(o.msrp, 0), i.msrp) AS msrp, o.sku IS NULL AS is_new
    FROM old o FULL OUTER JOIN inc i ON o.store = i.store AND o.sku = i.sku"""))
def product_upsert(t: Tables):
    k, cols = F.col("product_id"), ("store", "sku", "url", "title", "msrp")
    p = t.products()
    old = p.filter(k % 3 != 0).withColumn("url", F.when(k % 4 != 0, F.col("url"))).withColumn("msrp", F.when(k % 5 != 0, F.col("msrp"))).select(*cols)
    inc = p.filter(k % 2 == 0).select("store", "sku", F.concat("url", F.lit("?new")).alias("url"), F.concat("title", F.lit(" new")).alias("title"), (F.col("msrp") + 1).cast(MONEY).alias("msrp"))
    return Y.product_upsert(old, inc).select(*cols, "is_new")


@query("a04_discovered_deal_upsert", with_deals("""
    , fresh AS (SELECT l.sku, d.* FROM deals d JOIN listings l USING (product_id) WHERE d.product_id % 3 = 0)
    SELECT 'product' AS kind, store, sku, coalesce(nullif(o, 0), m) AS reference_price, p AS price FROM fresh UNION ALL SELECT 'observation', store, sku, o, p FROM fresh"""))
def discovered_deal_upsert(t: Tables):
    known = t.products().filter(F.col("product_id") % 3 != 0)
    added, first = Y.discovered_deals(known, found_deals(t), t.as_of())
    a = added.select(F.lit("product").alias("kind"), "store", "sku", F.col("msrp").alias("reference_price"), F.col("baseline_price").alias("price"))
    b = first.select(F.lit("observation").alias("kind"), "store", "sku", F.col("original_price").alias("reference_price"), "price")
    return a.unionByName(b)


def feed_items(t: Tables):
    """Products as feed items under the different field names feeds use, a hundred to a document."""
    k = F.col("product_id")
    price = F.concat(F.lit("$"), F.regexp_replace(F.col("msrp").cast("string"), r"^(\d)(\d{3}\.)", "$1,$2"))
    plain = F.to_json(F.struct("title", "url", price.alias("price"), "sku"))
    other = F.to_json(F.struct(F.col("title").alias("name"), F.col("url").alias("link"), F.col("msrp").alias("current_price"), k.alias("id"), F.lit("http://i/x.png").alias("image")))
    third = F.to_json(F.struct(F.col("title"), F.col("msrp").alias("price")))  # no URL: left out
    item = F.when(k % 3 == 0, plain).when(k % 3 == 1, other).otherwise(third)
    d = t.products().select("store", F.floor(k / 100).alias("doc"), F.struct(k.alias("k"), item.alias("j")).alias("x"))
    return d.groupBy("store", "doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["j"]), ",").alias("list"))


@query("a05_json_feed_ingest", with_views("products", body="""
    SELECT store, title, url, CAST(msrp AS DECIMAL(12,2)) AS current_price, CASE WHEN product_id % 3 = 0 THEN sku ELSE CAST(product_id AS VARCHAR) END AS sku, CASE WHEN product_id % 3 = 1 THEN 'http://i/x.png' END AS image_url
    FROM products WHERE product_id % 3 <> 2"""))
def json_feed_ingest(t: Tables):
    kind = F.col("doc") % 5
    body = F.when(kind == 4, F.concat(F.lit("["), "list", F.lit("]")))
    for i, name in enumerate(S.WRAPPERS):
        body = body.when(kind == i, F.concat(F.lit(f'{{"count": 3, "{name}": ['), "list", F.lit("]}")))
    return S.json_feed(feed_items(t).select("store", body.alias("body")))


def xml_docs(t: Tables):
    k = F.col("product_id")
    rss = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "url", F.lit("</link>"), F.when(k % 4 != 0, F.concat(F.lit("<g:price>$"), F.col("msrp").cast("string"), F.lit("</g:price>"))).otherwise(""),
                   F.when(k % 2 == 0, F.concat(F.lit("<g:id>"), "sku", F.lit("</g:id>"))).otherwise(""), F.lit("<g:image_link>http://i/y.png</g:image_link></item>"))
    atom = F.concat(F.lit("<entry><title>"), "title", F.lit('</title><link href="'), "url", F.lit('"/><price>'), F.col("msrp").cast("string"), F.lit("</price></entry>"))
    d = t.products().select("store", F.floor(k / 100).alias("doc"), F.struct(k.alias("k"), rss.alias("r"), atom.alias("a")).alias("x"))
    d = d.groupBy("store", "doc").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    as_rss = F.concat(F.lit('<?xml version="1.0"?><rss xmlns:g="http://base.google.com/ns/1.0"><channel><title>f</title>'), F.array_join(F.transform("xs", lambda x: x["r"]), ""), F.lit("</channel></rss>"))
    as_atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform("xs", lambda x: x["a"]), ""), F.lit("</feed>"))
    return d.select("store", F.when(F.col("doc") % 2 == 0, as_rss).otherwise(as_atom).alias("body"))


@query("a06_xml_feed_ingest", with_views("products", body="""
    SELECT store, title, url, CAST(msrp AS DECIMAL(12,2)) AS current_price, CASE WHEN (product_id // 100) % 2 = 0 AND product_id % 2 = 0 THEN sku ELSE CAST(product_id AS VARCHAR) END AS sku, CASE WHEN (product_id // 100) % 2 = 0 THEN 'http://i/y.png' END AS image_url
    FROM products WHERE (product_id // 100) % 2 = 1 OR product_id % 4 <> 0"""))
def xml_feed_ingest(t: Tables):
    return S.xml_feed(xml_docs(t))


def sitemap_docs(t: Tables):
    k = F.col("product_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://s.example/about/"), k.cast("string"))).otherwise(F.col("url"))
    leaf = t.products().select("store", F.floor(k / 100).alias("n"), F.struct(k.alias("k"), url.alias("u")).alias("x")).groupBy("store", "n").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    name = F.concat(F.lit("https://s.example/"), "store", F.lit("/"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit(".xml"))
    entries = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("<url><loc> "), x["u"], F.lit(" </loc></url>"))), "\n")
    leaves = leaf.select("store", F.floor(F.col("n") / 15).alias("block"), name.alias("doc_url"), F.concat(F.lit("<urlset>"), entries, F.lit("</urlset>")).alias("xml"))
    locs = F.array_join(F.transform(F.sort_array(F.collect_list("doc_url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "")
    # an index names at most fifteen sitemaps
    index = leaves.groupBy("store", "block").agg(F.concat(F.lit("<sitemapindex>"), locs, F.lit("</sitemapindex>")).alias("xml"))
    index = index.select("store", "block", F.concat(F.lit("https://s.example/"), "store", F.lit("-"), F.col("block").cast("string"), F.lit(".xml")).alias("doc_url"), "xml")
    # and one more index per store names the store's indexes
    top = index.groupBy("store").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    top = top.select("store", F.lit(0).cast("long").alias("block"), F.concat(F.lit("https://s.example/"), "store", F.lit(".xml")).alias("doc_url"), "xml")
    return leaves.unionByName(index).unionByName(top), top.select("doc_url")


SITEMAP_SQL = """, site AS (SELECT DISTINCT 'https://s.example/' || store || '.xml' AS root, url FROM products WHERE product_id % 3 <> 0)
"""


@query("a07_sitemap_urls", with_views("products", body=SITEMAP_SQL + "SELECT root, url FROM site"))
def sitemap_urls(t: Tables):
    docs, roots = sitemap_docs(t)
    return S.sitemap_urls(docs, roots)


@query("a08_new_urls", with_views("products", body=SITEMAP_SQL + "SELECT DISTINCT url FROM site WHERE url NOT IN (SELECT url FROM products WHERE product_id % 4 = 0)"))
def new_urls(t: Tables):
    docs, roots = sitemap_docs(t)
    return S.new_urls(S.sitemap_urls(docs, roots), t.products().filter(F.col("product_id") % 4 == 0))


def json_pages(t: Tables):
    k = F.col("product_id")
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), "sku", F.struct(F.col("msrp").alias("price")).alias("offers")))
    ld = F.concat(F.lit('<html><script type="application/ld+json">'), product, F.lit("</script></html>"))
    listed = F.concat(F.lit('<html><script type="application/ld+json">{"@type": ["ItemList"], "itemListElement": [{"item": '), product, F.lit('}, {"item": {"@type": "Offer"}}]}</script><script type="application/ld+json">{broken</script></html>'))
    nxt = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"rows": [{"deep": {"title": "'), "title", F.lit('", "price": 5, "sku": "'), "sku", F.lit('"}}, {"title": "no price"}]}}}</script></html>'))
    state = F.concat(F.lit('<html><script>window.__INITIAL_STATE__ = {"a": {"b": 1}};</script><p>'), "title", F.lit("</p></html>"))
    return t.products().select(k.alias("page_id"), "store", F.when(k % 4 == 0, ld).when(k % 4 == 1, listed).when(k % 4 == 2, nxt).otherwise(state).alias("html"))


@query("a09_page_embedded_json", with_views("products", body="""
    SELECT product_id AS page_id, CASE product_id % 4 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'item_list' ELSE 'next_data' END AS source, title AS name, sku FROM products WHERE product_id % 4 <> 3"""))
def page_embedded_json(t: Tables):
    d = P.embedded_products(json_pages(t))
    name = F.coalesce(F.get_json_object("product", "$.name"), F.get_json_object("product", "$.title"))
    return d.select("page_id", "source", name.alias("name"), F.get_json_object("product", "$.sku").alias("sku"))


# test pages: one item of a store's listing page; {id}, {id9}, {title}, {price} and {was} are filled in
ITEM_FORMS = {
    "amazon_us": '<div class="s-result" data-component-type="s-search-result" data-asin="B{id9}"><h2><a class="x" href="/dp/B{id9}"><span>{title}</span></a></h2><span class="a-price"><span class="a-offscreen">${price}</span></span><span class="a-price a-text-price" data-a-strike="true"><span class="a-offscreen">${was}</span></span></div>',
    "walmart": '<div data-item-id="{id}"><a link-identifier="{id}" href="/ip/{id}"><span data-automation-id="product-title">{title}</span></a><div data-automation-id="product-price"><b class="f2">${price}</b></div><s class="strike">${was}</s></div>',
    "bestbuy": '<li class="sku-item" data-sku-id="{id}"><h4 class="sku-title"><a href="/site/{id}.p">{title}</a></h4><div class="priceView-customer-price"><span>${price}</span></div><div class="pricing-price__was-price">Was ${was}</div></li>',
    "target": '<section class="ProductCardWrapper"><a href="/p/x/A-{id}">go</a><p class="ProductCardTitle">{title}</p><i data-test="current-price">${price}</i><i data-test="comparison-price">${was}</i></section>',
    "costco": '<div class="product-tile"><a class="product-tile-link" href="/x.product.{id}.html">v</a><p class="description">{title}</p><p class="price">${price}</p></div>',
    "newegg": '<div class="item-cell"><a class="item-title" href="/p/N{id}" title="{title}">t</a><ul class="price-main"><li class="price-current"><strong>{price}</strong></li></ul><span class="price-was-data">${was}</span></div>',
    "macys": '<div class="productThumbnail"><a href="/shop/product/x?ID={id}">l</a><div class="productDescription">{title}</div><div class="prices"><span class="regular">${was}</span><span class="price">${price}</span></div></div>',
    "homedepot": '<div class="browse-search__pod"><a href="/p/x/{id}">l</a><h3 class="product-header__title">{title}</h3><div class="price-format__main-price"><span>$</span><span>{price}</span></div><u class="price-format__strike-price">${was}</u></div>',
    "lowes": '<div class="product-card"><a href="/pd/x/{id}">l</a><h3 class="description">{title}</h3><b data-selector="price-value">${price}</b><i class="was-price">${was}</i></div>',
    "microcenter": '<li class="product_wrapper" data-id="{id}"><a class="productClickItemV2" data-name="{title}" href="/product/{id}/x">l</a><span itemprop="price">${price}</span><i class="was-price">${was}</i></li>',
    "gamestop": '<div class="product-tile"><a class="product-tile-link" href="/products/x/{id}.html">l</a><p class="product-name">{title}</p><b class="actual-price">${price}</b><i class="strike-price">${was}</i></div>',
    "bhphotovideo": '<div data-selenium="miniProductPage"><a data-selenium="productTitle" href="/c/product/{id}-REG/x">{title}</a><b data-selenium="pricingPrice">${price}</b><i data-selenium="wasPrice">${was}</i></div>',
    "kohls": '<li data-webid="{id}"><a class="prod_image_link" href="/product/prd-{id}/x.jsp">l</a><div class="prod_nameBlock"><a href="#">{title}</a></div><b class="prod_price_amount">${price}</b><i class="prod_price_original">${was}</i></li>',
    "officedepot": '<div data-sku="{id}"><a class="product_nameLink" href="/a/products/{id}/x">{title}</a><b class="sale-price">${price}</b><i class="original-price">${was}</i></div>',
    "ebay": '<div data-testid="item-card" data-itemid="{id}"><a data-testid="item-link" href="https://www.ebay.com/itm/{id}">l</a><h3 class="item-title">{title}</h3><b class="deal-price">${price}</b><s class="STRIKETHROUGH">${was}</s></div>',
    "saveyourdeals": '<article><a href="https://www.amazon.com/dp/B{id9}">l</a><h3>{title}</h3><b class="deal-price">${price}</b><i class="original">${was}</i></article>',
    "slickdeals": '<div class="fpDeal" data-deal-id="{id}"><a class="dealTitle" href="/f/{id}-x">{title}</a><h2>{title}</h2><b class="dealPrice">${price}</b><del>${was}</del></div>',
    "woot": '<div class="woot-deal"><a class="dealLink" href="/offers/w-{id}">l</a><h2>{title}</h2><b class="sale-price">${price}</b><s>${was}</s></div>',
}


def listing_pages(t: Tables):
    k = F.col("product_id").cast("string")
    item = F.when(F.lit(False), F.lit(""))
    for store, form in ITEM_FORMS.items():
        x = F.lit(form)
        for mark, value in (("{id9}", F.lpad(k, 9, "0")), ("{id}", k), ("{title}", F.col("title")), ("{price}", F.col("current_price").cast("string")), ("{was}", F.col("original_price").cast("string"))):
            x = F.replace(x, F.lit(mark), value)
        item = item.when(F.col("store") == store, x)
    # a third of the items is written with single quotes, titles hold entities, and some links hold no id
    n = F.col("product_id")
    item = F.when((F.col("store") == "woot") & (n % 5 == 0), F.replace(item, F.lit("/offers/w-"), F.lit("/deals?a=1&amp;x="))).otherwise(item)
    item = F.when(n % 4 == 0, F.replace(item, F.col("title"), F.concat("title", F.lit(" &amp; more")))).otherwise(item)
    item = F.when(n % 3 == 1, F.replace(item, F.lit('"'), F.lit("'"))).otherwise(item)
    d = t.listings().select("store", F.floor(F.col("product_id") / 180).alias("n"), F.struct(F.col("product_id").alias("k"), item.alias("h")).alias("x"))
    d = d.groupBy("store", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), "\n").alias("items"))
    head = F.lit("<html><head><title>List</title></head><body><nav><a href=\"/\">Home</a></nav>")
    return d.select(F.concat("store", F.lit("-"), F.col("n").cast("string")).alias("page_id"), "store", F.concat(head, "items", F.lit("</body></html>")).alias("html"))


FORM_SKU = {"amazon_us": "'B' || lpad(CAST(product_id AS VARCHAR), 9, '0')", "saveyourdeals": "'B' || lpad(CAST(product_id AS VARCHAR), 9, '0')", "newegg": "'N' || product_id", "slickdeals": "'sd-' || product_id",
            "woot": "'woot-' || CASE WHEN product_id % 5 = 0 THEN left(md5('/deals?a=1&x=' || product_id), 10) ELSE 'w-' || product_id END"}
FORM_URL = {s: f.split('href="')[1].split('"')[0] for s, f in ITEM_FORMS.items()}


@query("a10_page_listings", with_views("listings", body="""
    SELECT store || '-' || (product_id // 180) AS page_id, store, CASE store """ + " ".join(f"WHEN '{s}' THEN {x}" for s, x in FORM_SKU.items()) + """ ELSE CAST(product_id AS VARCHAR) END AS sku, title || CASE WHEN product_id % 4 = 0 THEN ' & more' ELSE '' END AS title,
      replace(replace(CASE WHEN store = 'woot' AND product_id % 5 = 0 THEN 'https://www.woot.com/deals?a=1&x={id}' ELSE CASE store """ + " ".join(f"WHEN '{s}' THEN '{u if u.startswith('http') else P.LAYOUTS[s].base_url + u}'" for s, u in FORM_URL.items()) + """ END END, '{id9}', lpad(CAST(product_id AS VARCHAR), 9, '0')), '{id}', CAST(product_id AS VARCHAR)) AS url,
      CAST(current_price AS DECIMAL(20,4)) AS current_price, CASE WHEN store = 'costco' THEN NULL ELSE CAST(original_price AS DECIMAL(20,4)) END AS original_price FROM listings"""))
def page_listings(t: Tables):
    return P.page_listings(listing_pages(t), P.layout_table(t.spark)).select("page_id", "store", "sku", "title", "url", "current_price", "original_price")


def product_pages(t: Tables):
    k, kid = F.col("product_id") % 4, F.col("product_id").cast("string")
    cat = F.regexp_replace(F.lower("category"), "[^a-z]+", "-")
    crumb = F.concat(F.lit('<nav class="breadcrumb"><a href="/">Home</a> <a href="/site/'), cat, F.lit('/c/?x=1">'), "category", F.lit("</a></nav>"))
    shop = F.concat(F.lit('<a href="/product/x">p</a><a class="b" href="/c/'), cat, F.lit('">Shop '), "category", F.lit("</a>"))
    other = F.concat(F.lit('<p>x</p><a href="/site/'), cat, F.lit('?q=1">more</a>'))
    html = F.concat(F.lit("<html><body>"), F.when(k == 0, crumb).when(k == 1, shop).when(k == 2, other).otherwise("<p>none</p>"), F.lit("</body></html>"))
    store = F.when(F.floor(F.col("product_id") / 4) % 2 == 0, "bestbuy").otherwise("target")
    # a small file is one task, and building and reading pages is the work: the rows are dealt out first
    rows = t.products().select("product_id", "category").repartition(4 * t.spark.sparkContext.defaultParallelism)
    return rows.select(F.col("product_id").alias("page_id"), store.alias("store"), html.alias("html"))


@query("a11_page_category", with_views("products", body="""
    , x AS (SELECT product_id, product_id % 4 AS k, CASE WHEN (product_id // 4) % 2 = 0 THEN 'bestbuy' ELSE 'target' END AS store, regexp_replace(lower(category), '[^a-z]+', '-', 'g') AS cat, category FROM products)
    SELECT product_id AS page_id, store, 'https://www.' || store || '.com' || CASE k WHEN 0 THEN '/site/' || cat || '/c/' WHEN 1 THEN '/c/' || cat ELSE '/site/' || cat END AS category_url,
      CASE k WHEN 0 THEN CASE WHEN store = 'target' AND lower(category) = 'home' THEN 'Discovered Category' ELSE category END WHEN 1 THEN lower('Shop ' || category) ELSE 'Discovered from Product' END AS category_name, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.6 END::DOUBLE AS category_confidence
    FROM x WHERE k < 2 OR (k = 2 AND store = 'bestbuy')"""))
def page_category(t: Tables):
    return P.page_categories(product_pages(t))


def payloads(t: Tables):
    k = F.col("product_id")
    flat = F.to_json(F.struct(F.concat(F.lit("$"), F.col("msrp").cast("string")).alias("sale_price"), F.lit("n/a").alias("list_price"), F.col("msrp").alias("was_price"), F.col("title").alias("product_name"), (k % 2 == 0).alias("in_stock")))
    nested = F.concat(F.lit('{"name": "'), "title", F.lit('", "priceInfo": {"currentPrice": {"price": '), F.col("msrp").cast("string"), F.lit("}}}"))
    cents = (F.col("msrp") * 100).cast("int").cast("string")
    series = F.when(k % 5 == 0, F.lit("[[1],[]]")).otherwise(F.concat(F.lit("[[1],[100,"), cents, F.lit("]]")))
    tracker = F.concat(F.lit('{"products": [{"title": "'), "title", F.lit('", "listPrice": '), cents, F.lit(', "csv": '), series, F.lit("}]}"))
    return t.products().select("product_id", flat.alias("flat"), nested.alias("nested"), tracker.alias("tracker"))


@query("a12_raw_price_fields", with_views("products", body="""
    SELECT product_id, 'api' AS kind, title, CAST(msrp AS DECIMAL(12,2)) AS current_price, CASE WHEN product_id % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM products
    UNION ALL SELECT product_id, 'path', title, CAST(msrp AS DECIMAL(12,2)), NULL FROM products
    UNION ALL SELECT product_id, 'tracker', title, CASE WHEN product_id % 5 = 0 THEN NULL ELSE CAST(msrp AS DECIMAL(12,2)) END, CASE WHEN product_id % 5 = 0 THEN 'out_of_stock' ELSE 'in_stock' END FROM products"""))
def raw_price_fields(t: Tables):
    p = payloads(t)
    cols = ("product_id", "kind", "title", "current_price", "availability")
    a = S.api_fields(p.select("product_id", F.lit("api").alias("kind"), F.col("flat").alias("body"))).select(*cols)
    b = S.path_fields(p.select("product_id", F.lit("path").alias("kind"), F.col("nested").alias("body")), "priceInfo.currentPrice.price", "name").withColumn("availability", F.lit(None).cast("string")).select(*cols)
    c = S.tracker_fields(p.select("product_id", F.lit("tracker").alias("kind"), F.col("tracker").alias("body"))).select(*cols)
    return a.unionByName(b).unionByName(c)


def seeds(t: Tables):
    k = F.col("s_suppkey")
    from driftmark.sources.tables import pick

    return t.raw("supplier").select(
        k.alias("k"), pick(params.TEST_STORES, k % len(params.TEST_STORES)).alias("store"), F.col("s_name").alias("category_name"),
        F.concat(F.lit("https://c.example/"), (k % 70).cast("string")).alias("category_url"), (k % 10 + 1).cast("int").alias("priority"), (k % 4 != 3).alias("on"),
    )


@query("a13_seed_load", with_views("products", body="""
    , s AS (SELECT s_suppkey AS k, (""" + "[" + ", ".join(f"'{x}'" for x in params.TEST_STORES) + """])[1 + s_suppkey % 18] AS store, 'https://c.example/' || (s_suppkey % 70) AS category_url, s_suppkey % 4 <> 3 AS on_ FROM supplier)
    SELECT DISTINCT store, category_url FROM s WHERE k % 6 <> 5 AND NOT EXISTS (SELECT 1 FROM s e WHERE e.k % 5 = 0 AND e.store = s.store AND e.category_url = s.category_url)"""))
def seed_load(t: Tables):
    s = seeds(t)
    enabled = F.when(F.col("k") % 6 != 5, F.concat(F.lit(', "enabled": '), F.col("on").cast("string"))).otherwise("")
    item = F.concat(F.lit('{"store": "'), "store", F.lit('", "category_name": "'), "category_name", F.lit('", "category_url": "'), "category_url", F.lit('", "priority": '), F.col("priority").cast("string"), enabled, F.lit("}"))
    docs = s.groupBy(F.floor(F.col("k") / 50).alias("doc")).agg(F.concat(F.lit('{"categories": ['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("body"))
    return S.seed_rows(docs, s.filter("k % 5 = 0")).select("store", "category_url")


@query("a14_baseline_cache_write", with_profile(", c AS (" + CACHE_SQL + ") SELECT product_id, current_baseline, observation_count, CASE WHEN product_id % 3 = 0 THEN 'updated' ELSE 'created' END AS change FROM c"))
def baseline_cache_write(t: Tables):
    path = scratch(t, "baseline-cache")
    rows = cache_rows(t)
    Y.write_baseline_cache(rows.filter(F.col("product_id") % 3 == 0).withColumn("current_baseline", F.lit(0.0)), path)
    Y.write_baseline_cache(rows, path)
    return t.spark.read.parquet(path).select("product_id", "current_baseline", "observation_count", "change")


@query("a15_prune_history", with_views("observations", "ref_time", body="""
    SELECT (SELECT count(*) FROM observations, ref_time WHERE fetched_at >= as_of - INTERVAL 90 DAY) AS kept, (SELECT count(*) FROM observations, ref_time WHERE fetched_at < as_of - INTERVAL 90 DAY) AS expired"""))
def prune_history(t: Tables):
    path = scratch(t, "observations")
    Y.append_observations(t.observations(), path, unit="YEAR")
    before = t.spark.read.parquet(path).count()
    cut = t.spark.range(1).select(t.as_of() - F.make_dt_interval(F.lit(params.RETENTION_DAYS))).first()[0]
    Y.prune_table(t.spark, path, cut, unit="YEAR")
    return t.spark.read.parquet(path).agg(F.count("*").alias("kept"), (F.lit(before) - F.count("*")).alias("expired"))


@query("a16_alert_payload", with_deals(FLAGS_SQL + f"""
    SELECT product_id, CASE WHEN product_id % 5 = 0 THEN 'custom' ELSE 'price_alert' END AS kind, {r('pct')} AS discount_percent, err AS is_price_error, CASE WHEN product_id % 5 = 1 THEN 'none' ELSE store END AS store,
      CASE WHEN pct >= 70 THEN 16711680 WHEN pct >= 50 THEN 65280 ELSE 16753920 END AS color FROM fl"""))
def alert_payload(t: Tables):
    k = F.col("product_id") % 5
    template = F.when(k == 0, '{"type": "custom", "extra": {"a": 1}}').when(k == 1, '{"product": {"store": "none"}}').when(k == 2, "{broken").when(k == 3, "[1, 2]")
    d = flagged(t).withColumns({"template": template, "sent_at": t.as_of(), "baseline_price": F.col("msrp"), "baseline_source": F.lit("msrp")})
    d = Y.alert_payload(d)
    return d.select(
        "product_id", F.get_json_object("payload", "$.type").alias("kind"), round_to(F.get_json_object("payload", "$.deal.discount_percent").cast("double")).alias("discount_percent"),
        F.get_json_object("payload", "$.deal.is_price_error").cast("boolean").alias("is_price_error"), F.get_json_object("payload", "$.product.store").alias("store"), "color",
    )


PRICED = "html || CASE page_id % 4 WHEN 0 THEN ' <b>$0.00 then $1,299.99</b>' WHEN 1 THEN ' {\"price\": \"$24.50\"}' WHEN 2 THEN ' {\"currentPrice\": 77.25, \"current_price\": \"1,077.25\"}' ELSE '' END"


@query("a17_page_price_regex", f"""
    WITH x AS (SELECT page_id, {PRICED} AS h FROM pages),
    y AS (SELECT page_id, h, list_filter(list_transform(regexp_extract_all(h, '\\$(\\d{{1,4}}(?:,\\d{{3}})*(?:\\.\\d{{2}})?)', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DECIMAL(12,2))), lambda v: v BETWEEN 0.01 AND 50000)[1] AS p1,
      list_filter(list_transform(regexp_extract_all(h, '"price":\\s*"?\\$?(\\d{{1,4}}(?:,\\d{{3}})*(?:\\.\\d{{2}})?)"?', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DECIMAL(12,2))), lambda v: v BETWEEN 0.01 AND 50000)[1] AS p2,
      list_filter(list_transform(regexp_extract_all(h, '"currentPrice":\\s*(\\d{{1,4}}(?:,\\d{{3}})*(?:\\.\\d{{2}})?)', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DECIMAL(12,2))), lambda v: v BETWEEN 0.01 AND 50000)[1] AS p3 FROM x)
    SELECT page_id, coalesce(p1, p2, p3) AS page_price, TRY_CAST(replace(nullif(regexp_extract(h, '"current_price"\\s*:\\s*"([^"]+)"', 1), ''), ',', '') AS DECIMAL(12,2)) AS quoted_price,
      nullif(trim(regexp_extract(h, '<h1[^>]*>([^<]+)</h1>', 1)), '') AS heading FROM y""")
def page_price_regex(t: Tables):
    d = priced_pages(t)
    price, heading = P.quoted_price(F.col("html"))
    return d.select("page_id", P.page_price(F.col("html")).alias("page_price"), price.alias("quoted_price"), heading.alias("heading"))


def priced_pages(t: Tables):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, " <b>$0.00 then $1,299.99</b>").when(k == 1, ' {"price": "$24.50"}').when(k == 2, ' {"currentPrice": 77.25, "current_price": "1,077.25"}').otherwise("")
    return t.raw("pages").withColumn("html", F.concat("html", tail))


MARKS = ("", "<p>Enter the characters</p>", "<b>Robot Check</b>", "Checking your browser", "<p>Access Denied</p>", "Too many requests", "enable JavaScript", "protected by PerimeterX", '<div class="product-x" data-sku="1">a</div>')
MARK_SQL = "CASE page_id % 13 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MARKS)) + " WHEN 9 THEN '" + '<div class="product-x" data-sku="1">a</div>' * 6 + "' ELSE '' END"
PAGES_SQL = f"""WITH pg AS (SELECT page_id, url, CASE WHEN page_id % 13 = 11 THEN '<html><title>Oops 404</title></html>' WHEN page_id % 13 = 12 THEN '' ELSE html || {MARK_SQL} END AS html,
      (['amazon_us', 'walmart', 'other', 'costco'])[1 + page_id % 4] AS store FROM pages),
    bt AS (SELECT *, lower(coalesce(CASE WHEN regexp_matches(html, '(?is)<title\\b[^>]*>') THEN trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) || ' ' END, '') || html) AS content,
      CASE WHEN regexp_matches(html, '(?is)<title\\b[^>]*>') THEN trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) END AS page_title FROM pg),
    bl AS (SELECT *, CASE WHEN html = '' THEN NULL """ + " ".join("WHEN regexp_matches(content, '{}') THEN '{}'".format(p.replace("'", "''"), k) for p, k in P.BLOCK_TYPES) + """ WHEN length(html) < 1000 AND regexp_matches(content, 'error|404|403') THEN 'error_page' END AS block_type FROM bt)
"""


def marked_pages(t: Tables):
    k = F.col("page_id") % 13
    tail = F.when(k == 9, MARKS[8] * 6)
    for i, m in enumerate(MARKS):
        tail = tail.when(k == i, m)
    html = F.when(k == 11, "<html><title>Oops 404</title></html>").when(k == 12, "").otherwise(F.concat("html", tail.otherwise("")))
    from driftmark.sources.tables import pick

    return t.raw("pages").select("page_id", "url", html.alias("html"), pick(("amazon_us", "walmart", "other", "costco"), F.col("page_id") % 4).alias("store"))


@query("p01_page_block_type", PAGES_SQL + ", n AS (SELECT *, regexp_replace(lower(html), '\\s+', ' ', 'g') AS flat FROM bl) SELECT page_id, block_type, CASE WHEN html = '' THEN 'Empty response' " + " ".join(
    f"WHEN contains(flat, '{w}') THEN '{x}'" for w, x in P.BLOCK_REASONS) + " END AS block_reason FROM n")
def page_block_type(t: Tables):
    return marked_pages(t).select("page_id", P.block_type(F.col("html")).alias("block_type"), P.block_reason(F.col("html")).alias("block_reason"))


def _count(attr: str, value: str | None = None) -> str:
    cond = attr if value is None else f"{attr}=\"[^\"]*{value}[^\"]*\""
    tail = "(?:[=\\s>/])" if value is None else ""
    return f"len(regexp_extract_all(html, '(?is)<[a-z][\\w-]*\\b[^>]*\\s{cond}{tail}'))"


COUNT_SQL = ", pc AS (SELECT *, CASE WHEN block_type IS NOT NULL OR html = '' THEN 0 WHEN store = 'amazon_us' THEN len(regexp_extract_all(html, 'data-asin=')) WHEN store = 'walmart' THEN len(regexp_extract_all(html, 'data-item-id='))" \
    " WHEN store = 'costco' THEN len(regexp_extract_all(html, 'class=\"product\"')) ELSE greatest(" + ", ".join((_count("class", "product"), _count("class", "item"), _count("data-sku"), _count("data-product"))) + ") END AS product_count FROM bl)\n"


@query("p02_page_product_count", PAGES_SQL + COUNT_SQL + "SELECT page_id, store, CAST(product_count AS INT) AS product_count FROM pc")
def page_product_count(t: Tables):
    return P.analyze(marked_pages(t)).select("page_id", "store", "product_count")


HASH_SQL = "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'))"
CONF_SQL = "CASE WHEN html = '' THEN 0 WHEN block_type IS NOT NULL THEN 0.9 WHEN product_count >= 10 THEN 0.95 WHEN product_count >= 5 THEN 0.85 WHEN product_count >= 1 THEN 0.7 ELSE 0.3 END::DOUBLE"


@query("p03_page_analysis", PAGES_SQL + COUNT_SQL + f"""
    SELECT page_id, block_type IS NOT NULL AS is_blocked, block_type IS NULL AND product_count >= 1 AND html <> '' AS is_valid, {CONF_SQL} AS page_confidence, page_title, CAST(length(html) AS INT) AS content_length FROM pc""")
def page_analysis(t: Tables):
    return P.analyze(marked_pages(t)).select("page_id", "is_blocked", "is_valid", "page_confidence", "page_title", "content_length")


@query("p04_page_content_hash", f"SELECT page_id, {HASH_SQL.format(c='html')} AS content_hash, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS whitespace_hash FROM pages")
def page_content_hash(t: Tables):
    h = F.col("html")
    return t.raw("pages").select("page_id", P.content_hash(h).alias("content_hash"), P.whitespace_hash(h).alias("whitespace_hash"))


@query("p05_page_changed", """
    WITH n AS (SELECT page_id, url, md5(trim(regexp_replace(html || CASE WHEN page_id % 3 = 0 THEN ' new' ELSE '  ' END, '\\s+', ' ', 'g'))) AS new_hash FROM pages),
    s AS (SELECT url, min(md5(trim(regexp_replace(html, '\\s+', ' ', 'g')))) AS stored_hash FROM pages WHERE page_id % 4 <> 0 GROUP BY url)
    SELECT page_id, new_hash FROM n LEFT JOIN s USING (url) WHERE new_hash IS DISTINCT FROM stored_hash""")
def page_changed(t: Tables):
    p = t.raw("pages")
    stored = p.filter("page_id % 4 <> 0").groupBy("url").agg(F.min(P.whitespace_hash(F.col("html"))).alias("stored_hash"))
    now = p.withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, " new").otherwise("  ")))
    return P.changed_pages(now, stored).select("page_id", "new_hash")


@query("p06_response_outcome", with_views("requests", body="""
    , x AS (SELECT request_id, CASE request_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 206 WHEN 2 THEN 403 WHEN 3 THEN 301 ELSE status_code END AS s, 'https://' || domain || CASE WHEN request_id % 17 = 0 THEN '/Blocked?x' WHEN request_id % 19 = 0 THEN '/challenge' ELSE '/ok' END AS u FROM requests)
    SELECT request_id, CASE WHEN contains(lower(u), '/blocked') OR contains(lower(u), '/challenge') THEN 'blocked' WHEN s = 404 THEN 'not_found' WHEN s = 206 AND (request_id % 2 = 0 OR request_id % 3 = 0) THEN 'partial_content_suspect'
      WHEN s IN (401, 403) THEN 'blocked' WHEN s BETWEEN 200 AND 299 THEN 'ok_html' ELSE 'retryable_network' END AS outcome FROM x"""))
def response_outcome(t: Tables):
    k = F.col("request_id")
    status = F.when(k % 9 == 0, 404).when(k % 9 == 1, 206).when(k % 9 == 2, 403).when(k % 9 == 3, 301).otherwise(F.col("status_code"))
    url = F.concat(F.lit("https://"), "domain", F.when(k % 17 == 0, "/Blocked?x").when(k % 19 == 0, "/challenge").otherwise("/ok"))
    return t.requests().select("request_id", P.response_outcome(status, url, k % 2 == 0, k % 3 != 0, ("/challenge",)).alias("outcome"))


@query("p07_page_triage", PAGES_SQL + COUNT_SQL + f"""
    , tr AS (SELECT *, strlen(html) < (strlen(html) + CASE WHEN page_id % 5 = 0 THEN 400000 ELSE 0 END) * 0.9 OR page_id % 6 = 0 AS partial FROM pc)
    SELECT page_id, partial AS is_partial, {CONF_SQL} AS page_confidence, CASE WHEN html = '' THEN 'Empty HTML content' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN block_type IS NOT NULL THEN 'Blocked: ' || block_type END,
      CASE WHEN partial THEN 'Partial content detected' END, CASE WHEN product_count = 0 THEN 'No product indicators' END), ''), 'Content appears valid') END AS reason FROM tr""")
def page_triage(t: Tables):
    k, n = F.col("page_id"), F.octet_length("html")
    d = marked_pages(t).withColumn("declared_length", n + F.when(k % 5 == 0, 400000).otherwise(0)).withColumn("status", F.when(k % 6 == 0, 206).otherwise(200))
    return P.triage(d).select("page_id", "is_partial", "page_confidence", "reason")


@query("p08_refresh_due", """
    WITH x AS (SELECT event_id, ts, (['critical', 'high', 'normal', 'low', 'odd'])[1 + user_id % 5] AS priority, (['electronics', 'apparel', 'home', 'books'])[1 + event_id % 4] AS category, max(ts) OVER () AS now FROM events),
    y AS (SELECT *, CASE priority WHEN 'critical' THEN 60 WHEN 'high' THEN 300 WHEN 'low' THEN 1800 ELSE 600 END AS base FROM x)
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN true ELSE epoch(now - ts) >= CASE category WHEN 'electronics' THEN floor(base * 0.5) WHEN 'apparel' THEN base * 2 ELSE base END END AS due FROM y""")
def refresh_due(t: Tables):
    from driftmark.sources.tables import pick

    e = t.raw("events")
    now = e.agg(F.max("ts")).scalar()
    d = e.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("last_refresh"), pick(("critical", "high", "normal", "low", "odd"), F.col("user_id") % 5).alias("priority"),
                 pick(("electronics", "apparel", "home", "books"), F.col("event_id") % 4).alias("category"))
    return P.refresh_due(d, now).select("event_id", "due")
