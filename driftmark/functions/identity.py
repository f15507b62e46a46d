"""Product, retailer and page identity from identifiers and URLs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# URL patterns that hold a retailer's product id, tried in order.
ID_PATTERNS = {
    "amazon_us": (r"/dp/([A-Z0-9]{10})", r"/gp/product/([A-Z0-9]{10})", r"/product/([A-Z0-9]{10})"),
    "walmart": (r"/ip/(\d+)", r"[?&]itemId=(\d+)"),
    "target": (r"/A-(\d+)", r"[?&]preselect=(\d+)"),
    "bestbuy": (r"/site/[^/]+/(\d+)\.p", r"[?&]skuId=(\d+)"),
    "costco": (r"\.product\.(\d+)\.html", r"[?&]productId=(\d+)"),
    "newegg": (r"/p/([A-Z0-9\-]+)", r"[?&]Item=([A-Z0-9\-]+)"),
    "macys": (r"/shop/product/[^/]+/([0-9]+)", r"[?&]ID=(\d+)"),
    "homedepot": (r"/p/[^/]+/(\d+)",),
    "lowes": (r"/pd/[^/]+/(\d+)", r"[?&]productId=(\d+)"),
    "microcenter": (r"/product/(\d+)",),
    "gamestop": (r"/p/(\d+)", r"[?&]sku=(\d+)"),
    "bhphotovideo": (r"/c/product/(\d+)-", r"[?&]sku=(\d+)"),
    "kohls": (r"/product/prd-(\d+)", r"[?&]prdPV=(\d+)"),
    "officedepot": (r"/catalog/catalogSku\.do\?id=(\d+)", r"[?&]sku=(\d+)"),
    "ebay": (r"/itm/(\d+)", r"[?&]item=(\d+)"),
}
# What a retailer calls its product id.
ID_LABELS = {
    "amazon_us": "asin", "walmart": "item_id", "target": "tcin", "bestbuy": "sku", "costco": "item_id",
    "newegg": "item_number", "macys": "product_id", "homedepot": "sku", "lowes": "item_id",
    "microcenter": "product_id", "gamestop": "sku", "bhphotovideo": "product_id", "kohls": "product_id",
    "officedepot": "sku", "ebay": "item_id",
}
# Patterns for a SKU in any URL, tried in order.
SKU_PATTERNS = (r"/dp/([A-Z0-9]{10})", r"/ip/([0-9]+)", r"/p/([A-Za-z0-9-]+)", r"/product/([0-9]+)", r"/([0-9]{6,})")
# Domain of each store, also used with a leading "www.".
STORE_DOMAINS = {
    "bestbuy.com": "bestbuy", "amazon.com": "amazon_us", "walmart.com": "walmart", "target.com": "target",
    "newegg.com": "newegg", "microcenter.com": "microcenter", "gamestop.com": "gamestop",
    "bhphotovideo.com": "bhphotovideo", "kohls.com": "kohls", "officedepot.com": "officedepot",
    "ebay.com": "ebay", "macys.com": "macys", "costco.com": "costco", "homedepot.com": "homedepot",
    "lowes.com": "lowes",
}
ASIN_IN_URL = r"(?i)/(?:dp|product|gp/product)/([A-Z0-9]{10})"
ASIN_ALONE = r"(?i)^[A-Z0-9]{10}$"


def first_match(text: Column, patterns) -> Column:
    """Group 1 of the first pattern that matches, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(None).cast("string"))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table, as an expression."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def extract_product_id(retailer: Column, url: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, patterns in ID_PATTERNS.items():
        found = found.when(F.lower(retailer) == name, first_match(url, patterns))
    return found


def canonical_product_id(retailer: Column, product_id: Column, url: Column, digits: int | None = None) -> Column:
    """``retailer:id`` from the given id, the URL, or a hash of the URL (whole, or its first ``digits``)."""
    digest = F.sha1(url) if digits is None else F.substring(F.sha1(url), 1, digits)
    hashed = F.when(F.length(url) > 0, digest).otherwise("unknown")
    raw = F.coalesce(F.nullif(product_id, F.lit("")), extract_product_id(retailer, url), hashed)
    return F.concat(F.lower(F.coalesce(retailer, F.lit(""))), F.lit(":"), raw)


def split_canonical(canonical: Column) -> tuple[Column, Column]:
    """Retailer and raw id; both NULL when there is no colon."""
    parts = F.split(canonical, ":", 2)
    has = canonical.contains(":")
    return F.when(has, F.get(parts, F.lit(0))), F.when(has, F.get(parts, F.lit(1)))


def normalized_sku(sku: Column, url: Column) -> Column:
    """``asin:…`` for ten-character ids and marketplace URLs, else ``sku:…``."""
    from_url = F.when(
        F.lower(url).contains("amazon.com"), F.nullif(F.upper(F.regexp_extract(url, ASIN_IN_URL, 1)), F.lit(""))
    )
    return (
        F.when(sku.rlike(ASIN_ALONE), F.concat(F.lit("asin:"), F.upper(sku)))
        .when(from_url.isNotNull(), F.concat(F.lit("asin:"), from_url))
        .otherwise(F.concat(F.lit("sku:"), sku))
    )


def cross_source_key(normalized: Column) -> Column:
    return F.concat(F.lit("xsource:"), F.md5(normalized))


def sku_from_url(url: Column) -> Column:
    return first_match(url, SKU_PATTERNS)


def store_from_url(url: Column) -> Column:
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    return lookup(STORE_DOMAINS, F.regexp_replace(host, r"^www\.", ""))
