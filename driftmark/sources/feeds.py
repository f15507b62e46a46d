"""Feeds, sitemaps, API payloads and seeds: text in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftmark.session import cut_lineage

WRAPPERS = ("products", "items", "data", "results")
ITEM = "map<string,string>"


def _money(text: Column) -> Column:
    return F.trim(F.translate(text, "$,", "")).try_cast("decimal(12,2)")


def _first(m: Column, *names: str) -> Column:
    """First name whose value is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names])


def json_feed(docs: DataFrame, body: str = "body") -> DataFrame:
    """Products of JSON feeds: a list, or an object that wraps one. Keeps rows with title, URL and price."""
    text = F.col(body)
    wrapped = F.from_json(text, ", ".join(f"{w} array<{ITEM}>" for w in WRAPPERS))
    items = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{ITEM}>")).otherwise(F.coalesce(*[wrapped[w] for w in WRAPPERS]))
    d = docs.select("store", F.explode(items).alias("m"))
    m = F.col("m")
    d = d.select(
        "store", _first(m, "title", "name").alias("title"), _first(m, "url", "link").alias("url"),
        _money(_first(m, "price", "current_price")).alias("current_price"),
        F.coalesce(_first(m, "sku", "id", "product_id"), F.lit("unknown")).alias("sku"),
        _first(m, "image_url", "image", "thumbnail").alias("image_url"),
    )
    return d.filter(F.col("title").isNotNull() & F.col("url").isNotNull() & (F.col("current_price") != 0))


XML_ITEM = "title string, link string, price string, id string, image_link string, image string"
ATOM_ITEM = "title string, link struct<_href string>, price string, id string, image_link string, image string"


def _feed_rows(d: DataFrame) -> DataFrame:
    tail = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"\?.*$", "")
    d = d.withColumn("current_price", _money(F.col("price"))).withColumn("sku", F.coalesce(F.nullif("id", F.lit("")), F.nullif(tail, F.lit("")), F.lit("unknown")))
    d = d.withColumn("image_url", F.coalesce("image_link", "image"))
    keep = (F.length("title") > 0) & (F.length("url") > 0) & (F.col("current_price") != 0)
    return d.filter(keep).select("store", "title", "url", "current_price", "sku", "image_url")


def xml_feed(docs: DataFrame, body: str = "body") -> DataFrame:
    """Products of RSS and Atom feeds, with or without the shopping namespace."""
    opts = {"ignoreNamespace": "true"}
    rss = docs.select("store", F.explode(F.from_xml(F.col(body), f"channel struct<item array<struct<{XML_ITEM}>>>", opts)["channel"]["item"]).alias("i"))
    rss = rss.select("store", "i.title", F.trim("i.link").alias("url"), "i.price", "i.id", "i.image_link", "i.image")
    atom = docs.select("store", F.explode(F.from_xml(F.col(body), f"entry array<struct<{ATOM_ITEM}>>", opts)["entry"]).alias("i"))
    atom = atom.select("store", "i.title", F.col("i.link._href").alias("url"), "i.price", "i.id", "i.image_link", "i.image")
    return _feed_rows(rss.unionByName(atom))


def read_xml_feed(spark: SparkSession, path: str, store: str) -> DataFrame:
    """RSS files, one row per item, read by the XML source."""
    d = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(XML_ITEM).load(path)
    return _feed_rows(d.select(F.lit(store).alias("store"), "title", F.trim("link").alias("url"), "price", "id", "image_link", "image"))


# Parts of a URL that mark a product page.
PRODUCT_URL_PARTS = ("/dp/", "/product/", "/p/", "/item/", "/products/", "?sku=", "?product_id=")


def sitemap_urls(docs: DataFrame, roots: DataFrame, cap: int | None = None, parts=PRODUCT_URL_PARTS) -> DataFrame:
    """Product URLs of sitemaps and of all sitemaps that indexes lead to, indexes within indexes too.

    ``docs`` holds ``doc_url, xml`` of all fetched documents, ``roots`` the ``doc_url`` to start from.  Each level
    of indexes is checkpointed, so finding the next one does not repeat those before; an index met again is not followed twice.
    ``cap`` bounds the URLs per root where the caller wants a bounded scan; by default all are kept.
    """
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
    d = docs.select("doc_url", F.col("xml").rlike(r"(?i)<sitemapindex\b").alias("is_index"), locs.alias("locs"))
    level = seen = roots.select(F.col("doc_url").alias("root"), "doc_url").distinct()
    leaves = None
    while leaves is None or not level.isEmpty():
        here = level.join(d, "doc_url")
        flat = here.filter(~F.col("is_index")).select("root", "locs")
        leaves = flat if leaves is None else leaves.unionByName(flat)
        named = here.filter("is_index").select("root", F.explode("locs").alias("doc_url")).distinct()
        level = cut_lineage(named.join(seen, ["root", "doc_url"], "left_anti"))
        seen = seen.unionByName(level)
    urls = leaves.select("root", F.explode("locs").alias("url"))
    wanted = F.lit(False)
    for p in parts:
        wanted = wanted | F.contains(F.lower("url"), F.lit(p))
    urls = urls.filter(wanted).distinct()
    if cap is not None:
        from driftmark.operators.skew import newest_rows

        urls = newest_rows(urls, ["root"], ["url"], cap).select("root", "url")
    return urls


def new_urls(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.select("url").distinct().join(before.select("url"), "url", "left_anti")


# Field names of product APIs, tried in order.
PRICE_FIELDS = ("price", "current_price", "sale_price", "final_price", "amount")
ORIGINAL_FIELDS = ("original_price", "list_price", "regular_price", "was_price")
TITLE_FIELDS = ("title", "name", "product_name", "display_name")
AVAILABILITY_FIELDS = ("availability", "in_stock", "stock_status", "status")


def api_fields(d: DataFrame, body: str = "body") -> DataFrame:
    """Price, original price, MSRP, title and availability of a flat API payload."""
    def at(name: str) -> Column:
        return F.get_json_object(body, f"$.{name}")

    def amount(names) -> Column:
        return F.coalesce(*[_money(at(n)) for n in names])

    def stock(name: str) -> Column:
        s = F.lower(at(name))
        return F.when(s.contains("in stock") | s.isin("true", "1"), "in_stock").when(s.contains("out of stock") | s.isin("false", "0"), "out_of_stock")

    return d.withColumns({
        "current_price": amount(PRICE_FIELDS), "original_price": amount(ORIGINAL_FIELDS), "msrp": amount(("msrp",)),
        "title": F.coalesce(*[at(n) for n in TITLE_FIELDS]),
        "availability": F.coalesce(*[stock(n) for n in AVAILABILITY_FIELDS], F.lit("unknown")),
    })


def path_fields(d: DataFrame, price_path: str, title_path: str, body: str = "body") -> DataFrame:
    """Price and title at dotted paths of a nested payload, e.g. ``priceInfo.currentPrice.price``."""
    return d.withColumns({"current_price": _money(F.get_json_object(body, f"$.{price_path}")), "title": F.get_json_object(body, f"$.{title_path}")})


def tracker_fields(d: DataFrame, body: str = "body") -> DataFrame:
    """Payload of a price tracker: cents, the last entry of the second series being the price."""
    product = F.from_json(body, "products array<struct<csv array<array<int>>, listPrice int, title string>>")["products"]
    first = F.get(product, F.lit(0))
    series = F.get(first["csv"], F.lit(1))
    cents = F.when(F.size(series) > 0, F.get(series, F.size(series) - 1))
    price = F.when(cents > 0, (cents / 100).cast("decimal(12,2)"))
    return d.withColumns({
        "current_price": price, "msrp": F.when(first["listPrice"] > 0, (first["listPrice"] / 100).cast("decimal(12,2)")), "title": first["title"],
        "availability": F.when(price.isNotNull(), "in_stock").otherwise("out_of_stock"), "confidence": F.when(price.isNotNull(), 0.9).otherwise(0.5),
    })


SEED = "store string, category_name string, category_url string, max_pages int, scan_interval_minutes int, priority int, min_discount_percent double, enabled string"


def seed_rows(docs: DataFrame, existing: DataFrame, body: str = "body") -> DataFrame:
    """Categories of seed documents with all required fields and not yet known by store and URL."""
    d = docs.select(F.explode(F.from_json(body, f"categories array<struct<{SEED}>>")["categories"]).alias("c")).select("c.*")
    complete = F.col("store").isNotNull() & F.col("category_name").isNotNull() & F.col("category_url").isNotNull() & F.col("enabled").isin("true", "false")
    d = d.filter(complete).withColumn("enabled", F.col("enabled") == "true")
    return d.dropDuplicates(["store", "category_url"]).join(existing.select("store", "category_url"), ["store", "category_url"], "left_anti")
