"""Cleaning, identity and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark import params
from driftmark.functions import cleaning as C, identity as I, temporal, text as T, titles
from driftmark.functions.numbers import MONEY, round_to
from driftmark.operators import skew
from driftmark.plans.registry import query
from driftmark.plans.sqlviews import r, with_views
from driftmark.sources.tables import Tables, pick

RAW_AVAILABILITY = ("In_Stock", "Available now", "UNAVAILABLE", "pre-order", "", "out_of_stock now")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


RAW_SQL = f""", raw AS (
    SELECT product_id, CASE product_id % 25 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -current_price ELSE current_price END AS p,
           CASE WHEN product_id % 9 = 4 THEN title || ' See price in cart' ELSE title END AS t,
           ({sql_list(RAW_AVAILABILITY)})[1 + product_id % 6] AS av, confidence AS cf,
           CASE WHEN product_id % 3 = 0 THEN 4.99 END AS sh, CASE product_id % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'cad' WHEN 2 THEN '' END AS cu
    FROM listings),
canon AS (SELECT *, CASE WHEN contains(lower(av), 'out_of_stock') OR contains(lower(av), 'unavailable') THEN 'out_of_stock'
        WHEN contains(lower(av), 'in_stock') OR contains(lower(av), 'available') THEN 'in_stock'
        WHEN contains(lower(av), 'preorder') OR contains(lower(av), 'pre-order') THEN 'preorder' ELSE 'unknown' END AS availability FROM raw)
"""


def raw_prices(t: Tables):
    k = F.col("product_id")
    return t.listings().select(
        "product_id",
        F.when(k % 25 == 0, F.lit(None).cast(MONEY)).when(k % 25 == 1, F.lit(0).cast(MONEY))
        .when(k % 25 == 2, -F.col("current_price")).otherwise(F.col("current_price")).cast(MONEY).alias("raw_price"),
        F.when(k % 9 == 4, F.concat("title", F.lit(" See price in cart"))).otherwise(F.col("title")).alias("raw_title"),
        pick(RAW_AVAILABILITY, k % 6).alias("raw_availability"),
        F.col("confidence").alias("raw_confidence"),
        F.when(k % 3 == 0, F.lit("4.99").cast(MONEY)).alias("raw_shipping"),
        F.when(k % 4 == 0, "usd").when(k % 4 == 1, "cad").when(k % 4 == 2, "").alias("raw_currency"),
    )


@query("b01_normalize_price", with_views("listings", body=RAW_SQL + f"""
    SELECT product_id, CASE WHEN p IS NULL THEN 'no price' WHEN p = 0 THEN 'zero price' WHEN p < 0 THEN 'negative price' END AS reject_reason,
           availability, {r("least(cf, CASE WHEN contains(lower(t), 'see price in cart') THEN 0.3 ELSE 1e9 END, CASE WHEN availability = 'out_of_stock' THEN 0.5 ELSE 1e9 END)")} AS confidence,
           CAST(coalesce(sh, 0) AS DECIMAL(10,2)) AS shipping, upper(coalesce(nullif(cu, ''), 'USD')) AS currency FROM canon"""))
def normalize_price(t: Tables):
    d = C.normalize_price(raw_prices(t))
    return d.select("product_id", "reject_reason", "availability", round_to("confidence").alias("confidence"), "shipping", "currency")


@query("b02_availability_canon", with_views("listings", body=RAW_SQL + """
    SELECT av AS raw_availability, availability, CASE WHEN contains(lower(av), 'in_stock') OR contains(lower(av), 'available') THEN 'in_stock' ELSE availability END AS literal_availability,
           count(*) AS n FROM canon GROUP BY ALL"""))
def availability_canon(t: Tables):
    a = F.col("raw_availability")
    d = raw_prices(t).select("raw_availability", C.availability(a).alias("availability"), C.availability(a, literal=True).alias("literal_availability"))
    return d.groupBy("raw_availability", "availability", "literal_availability").agg(F.count("*").alias("n"))


@query("b03_parse_price_text", r"""
    WITH d AS (SELECT doc_id, translate(text, '$,', '') AS plain FROM documents)
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(plain, '(\d+\.?\d*)', 1), '') AS DECIMAL(20,4)) AS price,
           TRY_CAST(nullif(regexp_extract(plain, '[\d.]+'), '') AS DECIMAL(20,4)) AS dotted_price FROM d""")
def parse_price_text(t: Tables):
    x = F.col("text")
    return t.raw("documents").select("doc_id", C.parse_price(x).alias("price"), C.parse_price_dotted(x).alias("dotted_price"))


# test URLs: the form each store uses, with {id} for the product
URL_FORMS = {
    "amazon_us": "https://www.amazon.com/gp/product/B{id9}", "walmart": "https://www.walmart.com/ip/{id}", "bestbuy": "https://bestbuy.com/site/x/{id}.p?skuId={id}",
    "target": "https://www.target.com/p/-/A-{id}", "costco": "https://www.costco.com/thing.product.{id}.html", "newegg": "https://www.newegg.com/p/N82E{id}",
    "macys": "https://www.macys.com/shop/product/thing/{id}?ID=9", "homedepot": "https://www.homedepot.com/p/thing/{id}", "lowes": "https://www.lowes.com/pd/thing/{id}",
    "microcenter": "https://www.microcenter.com/product/{id}/thing", "gamestop": "https://www.gamestop.com/x?sku={id}", "bhphotovideo": "https://www.bhphotovideo.com/c/product/{id}-REG",
    "kohls": "https://www.kohls.com/product/prd-{id}/x.jsp", "officedepot": "https://www.officedepot.com/catalog/catalogSku.do?id={id}", "ebay": "https://www.ebay.com/itm/{id}",
    "saveyourdeals": "https://www.saveyourdeals.example/d/{id}", "slickdeals": "https://www.amazon.com/dp/B{id9}?tag=x", "woot": "https://www.woot.example/offers/{id}",
}


def store_url(t: Tables):
    k = F.col("product_id").cast("string")
    url = F.when(F.lit(False), F.lit(""))
    for store, form in URL_FORMS.items():
        u = F.replace(F.replace(F.lit(form), F.lit("{id9}"), F.lpad(k, 9, "0")), F.lit("{id}"), k)
        url = url.when(F.col("store") == store, u)
    bare = F.concat(F.lit("https://unknown.example/item"), k)
    return t.products().withColumn("url", F.when(F.col("product_id") % 10 == 9, bare).otherwise(url))


URL_SQL = ", urls AS (SELECT * EXCLUDE (url), CASE WHEN product_id % 10 = 9 THEN 'https://unknown.example/item' || product_id ELSE CASE store " + " ".join(
    f"WHEN '{s}' THEN replace(replace('{f}', '{{id9}}', lpad(CAST(product_id AS VARCHAR), 9, '0')), '{{id}}', CAST(product_id AS VARCHAR))" for s, f in URL_FORMS.items()
) + " END END AS url FROM products)\n"


def sql_first(patterns, col: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '{p}', 1), '')" for p in patterns) + ", NULL)"


CANON_SQL = "lower(store) || ':' || coalesce(CASE lower(store) " + " ".join(
    f"WHEN '{s}' THEN {sql_first(p, 'url')}" for s, p in I.ID_PATTERNS.items()
) + " END, sha1(url))"


@query("b04_canonical_product_id", with_views("products", body=URL_SQL + f""", c AS (SELECT product_id, {CANON_SQL} AS canonical FROM urls)
    SELECT product_id, canonical, left(canonical, strpos(canonical, ':') - 1) AS retailer, substr(canonical, strpos(canonical, ':') + 1) AS raw_id,
           coalesce(CASE left(canonical, strpos(canonical, ':') - 1) {' '.join(f"WHEN '{s}' THEN '{x}'" for s, x in I.ID_LABELS.items())} END, 'product_id') AS id_label FROM c"""))
def canonical_product_id(t: Tables):
    d = store_url(t).withColumn("canonical", I.canonical_product_id(F.col("store"), F.lit(None).cast("string"), F.col("url")))
    retailer, raw = I.split_canonical(F.col("canonical"))
    return d.select("product_id", "canonical", retailer.alias("retailer"), raw.alias("raw_id"), F.coalesce(I.lookup(I.ID_LABELS, retailer), F.lit("product_id")).alias("id_label"))


@query("b05_asin_normalize", with_views("products", body=URL_SQL + r"""
    , k AS (SELECT product_id, url, CASE WHEN product_id % 8 = 0 THEN 'b' || lpad(CAST(product_id AS VARCHAR), 9, '0') ELSE sku END AS sku FROM urls),
    n AS (SELECT product_id, CASE WHEN regexp_matches(sku, '^[A-Z0-9]{10}$', 'i') THEN 'asin:' || upper(sku)
        WHEN contains(lower(url), 'amazon.com') AND regexp_extract(url, '/(?:dp|product|gp/product)/([A-Z0-9]{10})', 1, 'i') <> ''
        THEN 'asin:' || upper(regexp_extract(url, '/(?:dp|product|gp/product)/([A-Z0-9]{10})', 1, 'i')) ELSE 'sku:' || sku END AS normalized FROM k)
    SELECT product_id, normalized, 'xsource:' || md5(normalized) AS source_key FROM n"""))
def asin_normalize(t: Tables):
    k = F.col("product_id")
    d = store_url(t).withColumn("sku", F.when(k % 8 == 0, F.concat(F.lit("b"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("sku")))
    n = I.normalized_sku(F.col("sku"), F.col("url"))
    return d.select("product_id", n.alias("normalized"), I.cross_source_key(n).alias("source_key"))


@query("b06_sku_from_url", with_views("products", body=URL_SQL + f"SELECT product_id, {sql_first(I.SKU_PATTERNS, 'url')} AS url_sku FROM urls"))
def sku_from_url(t: Tables):
    return store_url(t).select("product_id", I.sku_from_url(F.col("url")).alias("url_sku"))


HOST_SQL = "CASE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') " + " ".join(
    f"WHEN '{d}' THEN '{s}'" for d, s in I.STORE_DOMAINS.items()) + " END"


@query("b07_store_from_url", with_views("products", body=URL_SQL + f"""
    SELECT 'product' AS kind, product_id AS id, {HOST_SQL} AS url_store FROM urls
    UNION ALL SELECT 'page', page_id, {HOST_SQL} FROM pages"""))
def store_from_url(t: Tables):
    a = store_url(t).select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), "url")
    b = t.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return a.unionByName(b).select("kind", "id", I.store_from_url(F.col("url")).alias("url_store"))


W_OUT, W_IN = r"[^\pL\pN_]", r"[\pL\pN_]"


def sql_normalize(col: str, lower: bool = True) -> str:
    """Abbreviations that can still match once the earlier ones are replaced; twice, since a match takes its neighbours."""
    x = f"{col}"
    for ent, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for short, long in (("w/", "with"), ("&", "and"), (r"\+", "plus")):
        left = rf"(^|{W_OUT})" if short == "w/" else rf"({W_IN})"
        for _ in range(2):
            x = f"regexp_replace({x}, '{left}{short}({W_IN})', '\\1{long}\\2', 'gi')"
    for short, long in (("vs", "versus"), ("approx", "approximately"), ("est", "estimated"), ("inc", "including"), ("excl", "excluding")):
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|{W_OUT}){short}($|{W_OUT})', '\\1{long}\\2', 'gi')"
    x = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"lower({x})" if lower else x


@query("b08_text_normalize", f"""
    SELECT 'page' AS kind, page_id AS id, md5({sql_normalize('html')}) AS digest, length({sql_normalize('html')}) AS n_chars FROM pages
    UNION ALL SELECT 'doc', doc_id, md5({sql_normalize('text')}), length({sql_normalize('text')}) FROM documents""")
def text_normalize(t: Tables):
    a = t.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    b = t.raw("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    d = a.unionByName(b).withColumn("y", T.normalize(F.col("x")))
    return d.select("kind", "id", F.md5("y").alias("digest"), F.length("y").cast("long").alias("n_chars"))


TAGGED_SQL = "CASE product_id % 4 WHEN 0 THEN '[BEST SELLER] ' WHEN 1 THEN '(NEW)  ' WHEN 2 THEN '[A](b) ' ELSE '' END || '<b>' || title || '</b> &amp; w/case'"


def tagged_title():
    k = F.col("product_id") % 4
    head = F.when(k == 0, "[BEST SELLER] ").when(k == 1, "(NEW)  ").when(k == 2, "[A](b) ").otherwise("")
    return F.concat(head, F.lit("<b>"), "title", F.lit("</b> &amp; w/case"))


@query("b09_clean_title", with_views("products", body=rf"""
    , x AS (SELECT product_id, {sql_normalize('(' + TAGGED_SQL + ')', False)} AS n FROM products)
    SELECT product_id, trim(regexp_replace(regexp_replace(regexp_replace(n, '^\[.*?\]\s*', ''), '^\(.*?\)\s*', ''), '\s+', ' ', 'g')) AS cleaned FROM x"""))
def clean_title(t: Tables):
    return t.products().select("product_id", T.clean_title(tagged_title()).alias("cleaned"))


TOKENS_SQL = f"""list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: NOT list_contains({sql_list(T.STOPWORDS)}, w) AND length(w) > 1)"""


@query("b10_tokens", f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents")
def tokens(t: Tables):
    d = t.raw("documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("b11_keywords_topk", f"""
    WITH w AS (SELECT doc_id, unnest({TOKENS_SQL}) AS word, generate_subscripts({TOKENS_SQL}, 1) AS pos FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rk FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS pos FROM k WHERE rk <= 20 AND length(word) >= 3)
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS keywords FROM f WHERE pos <= 10 GROUP BY doc_id""")
def keywords_topk(t: Tables):
    return T.keywords(t.raw("documents"), "doc_id", "text").select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("b12_language_flag", "SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in T.ENGLISH_HINTS) + """ AS INT) AS hints,
    CASE WHEN length(text) > 0 THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def language_flag(t: Tables):
    x = F.col("text")
    return t.raw("documents").select("doc_id", T.english_hints(x).alias("hints"), T.language(x).alias("language"))


def attr_title(t: Tables):
    k = F.col("product_id")
    tail = F.when(k % 5 == 0, F.concat(F.lit(" QX-"), (k + 1000).cast("string"))).when(k % 5 == 1, F.concat(F.lit(" Model A"), k.cast("string"))).when(
        k % 5 == 2, " Alpha Ultra 12 x 40 cm").when(k % 5 == 3, " laptop Table").otherwise("")
    head = F.when(k % 7 == 0, F.regexp_replace(F.col("market_key"), " ", "-")).otherwise(F.concat(F.initcap("market_key"), F.lit(" "), "p_size", F.lit(" inch")))
    d = t.products().join(t.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("string").alias("p_size")), "product_id")
    return d.select("product_id", "store", F.concat(head, tail).alias("attr_title"))


ATTR_SQL = """, a0 AS (SELECT product_id, store, CASE WHEN product_id % 7 = 0 THEN replace(market_key, ' ', '-')
        ELSE upper(left(split_part(market_key, ' ', 1), 1)) || substr(split_part(market_key, ' ', 1), 2) || ' '
          || upper(left(split_part(market_key, ' ', 2), 1)) || substr(split_part(market_key, ' ', 2), 2) || ' ' || p_size || ' inch' END
      || CASE product_id % 5 WHEN 0 THEN ' QX-' || (product_id + 1000) WHEN 1 THEN ' Model A' || product_id WHEN 2 THEN ' Alpha Ultra 12 x 40 cm'
         WHEN 3 THEN ' laptop Table' ELSE '' END AS attr_title FROM products JOIN part ON p_partkey = product_id),
a1 AS (SELECT *, coalesce(trim(nullif(regexp_extract(attr_title, '\\b([A-Z][a-z]+)\\s+(?:[A-Z][a-z]+\\s+)?(?:Pro|Max|Plus|Ultra|Elite|Premium)\\b', 1, 'i'), '')),
        trim(nullif(regexp_extract(attr_title, '\\b([A-Z][a-z]+)\\s+(?:[A-Z][a-z]+)\\b', 1, 'i'), '')),
        list_filter(list_slice(regexp_split_to_array(attr_title, '\\s+'), 1, 3), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 2
          AND NOT list_contains(['the', 'new', 'best', 'top', 'premium'], lower(w)))[1]) AS brand FROM a0),
a2 AS (SELECT *, nullif(regexp_extract(attr_title, '\\b([A-Z0-9]{3,}-?[A-Z0-9]{2,})\\b', 1), '') AS m1,
        nullif(regexp_extract(attr_title, '\\b(Model\\s+[A-Z0-9-]+)\\b', 1), '') AS m2, nullif(regexp_extract(attr_title, '\\b([A-Z][a-z]+\\s+\\d+[A-Z]?)\\b', 1), '') AS m3 FROM a1),
attrs AS (SELECT product_id, store, attr_title, brand,
        CASE WHEN m1 IS NOT NULL AND NOT contains(lower(m1), lower(coalesce(brand, '~'))) THEN m1 WHEN m2 IS NOT NULL AND NOT contains(lower(m2), lower(coalesce(brand, '~'))) THEN m2
             WHEN m3 IS NOT NULL AND NOT contains(lower(m3), lower(coalesce(brand, '~'))) THEN m3 END AS model,
        coalesce(nullif(regexp_extract(attr_title, '\\b(\\d+(?:\\.\\d+)?)\\s*(?:inch|in|\"|cm|mm|oz|lb|kg|g)\\b', 1, 'i'), ''),
          CASE WHEN regexp_matches(attr_title, '\\b(\\d+)\\s*x\\s*(\\d+)\\s*(?:inch|in|cm|mm)\\b', 'i') THEN
            regexp_extract(attr_title, '\\b(\\d+)\\s*x\\s*(\\d+)\\s*(?:inch|in|cm|mm)\\b', 1, 'i') || 'x' || regexp_extract(attr_title, '\\b(\\d+)\\s*x\\s*(\\d+)\\s*(?:inch|in|cm|mm)\\b', 2, 'i') END) AS size,
        nullif(upper(left(c, 1)) || substr(c, 2), '') AS color,
        CASE """ + " ".join(f"WHEN regexp_matches(lower(attr_title), '{'|'.join(w)}') THEN '{n}'" for n, w in T.CATEGORY_WORDS.items()) + """ END AS category
    FROM (SELECT *, regexp_extract(lower(attr_title), '\\b(black|white|red|blue|green|yellow|orange|purple|pink|brown|gray|grey|silver|gold|bronze)\\b', 1) AS c FROM a2))
"""


@query("b13_attributes_rules", with_views("products", body=ATTR_SQL + "SELECT product_id, brand, model, size, color, category FROM attrs"))
def attributes_rules(t: Tables):
    return T.with_attributes(attr_title(t), "attr_title").select("product_id", *T.ATTRIBUTES)


@query("b14_attribute_merge", with_views("products", body=ATTR_SQL + """
    , m AS (SELECT *, coalesce(brand, 'ner-' || store) AS eb, coalesce(model, 'nm') AS em FROM attrs),
    q AS (SELECT *, 2 + CAST(size IS NOT NULL AS INT) + CAST(color IS NOT NULL AS INT) + CAST(category IS NOT NULL AS INT) < 3 AS asks FROM m)
    SELECT product_id, eb AS brand, em AS model, CASE WHEN asks THEN coalesce('m-size', size) ELSE size END AS size, color,
           CASE WHEN asks AND product_id % 2 = 0 THEN 'other' ELSE category END AS category FROM q"""))
def attribute_merge(t: Tables):
    d = T.with_attributes(attr_title(t), "attr_title").withColumnsRenamed({a: f"r_{a}" for a in T.ATTRIBUTES})
    none = F.lit(None).cast("string")
    d = d.withColumns({
        "e_brand": F.concat(F.lit("ner-"), "store"), "e_model": F.lit("nm"), "e_size": none, "e_color": none, "e_category": none,
        "m_brand": F.lit(""), "m_model": none, "m_size": F.lit("m-size"), "m_color": F.lit(""),
        "m_category": F.when(F.col("product_id") % 2 == 0, "other"),
    })
    return T.merge_attributes(d, "e", "r", "m").select("product_id", *T.ATTRIBUTES)


@query("b15_title_template", with_views("products", body=ATTR_SQL + r"""
    , s AS (SELECT product_id, concat_ws(' - ', brand, model, 'Size: ' || size, 'Color: ' || color) AS joined, attr_title,
        CASE WHEN brand IS NULL THEN attr_title ELSE trim(replace(attr_title, brand, '')) END AS x, model FROM attrs),
    y AS (SELECT *, trim(regexp_replace(CASE WHEN model IS NULL THEN x ELSE trim(replace(x, model, '')) END, '\s+', ' ', 'g')) AS rest FROM s)
    SELECT product_id, CASE WHEN joined <> '' THEN joined ELSE attr_title END AS template, CASE WHEN length(rest) > 5 THEN rest END AS spec FROM y"""))
def title_template(t: Tables):
    d = T.with_attributes(attr_title(t), "attr_title")
    c = F.col
    return d.select(
        "product_id", T.title_template(c("brand"), c("model"), c("size"), c("color"), c("attr_title")).alias("template"),
        T.leftover_spec(c("attr_title"), c("brand"), c("model")).alias("spec"),
    )


FLAG = "CASE WHEN regexp_matches(lower({col}), '{words}') THEN 1.0 ELSE 0.0 END::DOUBLE"


@query("b16_title_category_flags", "SELECT doc_id, " + ", ".join(
    f"{FLAG.format(col='text', words='|'.join(w))} AS {n}" for n, w in (("is_electronics", titles.ELECTRONICS_WORDS), ("is_apparel", titles.APPAREL_WORDS), ("is_home", titles.HOME_WORDS))) + " FROM documents")
def title_category_flags(t: Tables):
    flags = titles.title_flags(F.col("text"))
    return t.raw("documents").select("doc_id", *[v.alias(k) for k, v in flags.items()])


SECTIONS = ("Clearance {c}", "{c} Flash Sale", "New Arrivals in {c}", "{c}", "Outlet {c}", "Latest {c} deal of the day")


def sections(t: Tables):
    k = F.col("product_id") % len(SECTIONS)
    name = F.when(F.lit(False), F.lit(""))
    for i, form in enumerate(SECTIONS):
        name = name.when(k == i, F.replace(F.lit(form), F.lit("{c}"), F.col("category")))
    return t.products().select("product_id", name.alias("name"), F.concat(F.lit("https://shop.example/c/"), "category").alias("url"))


SECTION_SQL = ", sec AS (SELECT product_id, replace(CASE product_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SECTIONS)) + " END, '{c}', category) AS name, 'https://shop.example/c/' || category AS url FROM products)\n"


@query("b17_section_flags", with_views("products", body=SECTION_SQL + f"""
    SELECT product_id, {', '.join(f"regexp_matches(lower({c}), '{'|'.join(w)}') AS {n}" for n, c, w in (
        ("is_clearance", "name || ' ' || url", T.CLEARANCE_WORDS), ("is_flash_sale", "name || ' ' || url", T.FLASH_SALE_WORDS), ("is_new_arrivals", "name || ' ' || url", T.NEW_ARRIVAL_WORDS),
        ("is_high_value", "name", T.HIGH_VALUE_WORDS), ("is_deal_section", "name || ' ' || url", T.DEAL_WORDS)))} FROM sec"""))
def section_flags(t: Tables):
    flags = T.section_flags(F.col("name"), F.col("url"))
    return sections(t).select("product_id", *[v.alias(k) for k, v in flags.items()])


@query("b18_flash_sale_listings", with_views("products", body=f"""
    , x AS (SELECT product_id, title || CASE product_id % 9 WHEN 0 THEN ' - Limited Time' WHEN 1 THEN ' Ends in 2h' WHEN 2 THEN ' expired' ELSE '' END AS title FROM products)
    SELECT product_id, title, 2.0::DOUBLE AS priority_boost, 1 AS scan_interval FROM x WHERE regexp_matches(lower(title), '{'|'.join(T.TIME_LIMIT_WORDS)}')"""))
def flash_sale_listings(t: Tables):
    k = F.col("product_id") % 9
    tail = F.when(k == 0, " - Limited Time").when(k == 1, " Ends in 2h").when(k == 2, " expired").otherwise("")
    d = t.products().select("product_id", F.concat("title", tail).alias("title"))
    return d.filter(T.is_time_limited(F.col("title"))).select("product_id", "title", F.lit(2.0).alias("priority_boost"), F.lit(1).alias("scan_interval"))


SALE_SQL = "(month({c}) IN (11, 12) OR (month({c}) = 7 AND day({c}) BETWEEN 10 AND 16) OR (month({c}) = 1 AND day({c}) <= 7))"


@query("b19_season_factor", f"""
    SELECT o_orderdate AS at, count(*) AS n, CASE WHEN month(o_orderdate) IN (11, 12) THEN 0.85 WHEN month(o_orderdate) = 1 THEN 0.8 WHEN month(o_orderdate) IN (7, 8) THEN 0.9 ELSE 1.0 END::DOUBLE AS season_factor,
           {SALE_SQL.format(c='o_orderdate')} AS is_sale_period,
           CASE WHEN {SALE_SQL.format(c='o_orderdate')} THEN 0.5 WHEN hour(o_orderdate) < 2 THEN 0.7 WHEN isodow(o_orderdate) >= 6 THEN 0.9 ELSE 1.0 END::DOUBLE AS interval_multiplier
    FROM orders GROUP BY o_orderdate""")
def season_factor(t: Tables):
    from driftmark.operators.baseline import season_factor as factor

    at = F.col("at")
    d = t.raw("orders").groupBy(F.col("o_orderdate").alias("at")).agg(F.count("*").alias("n"))
    return d.select("at", "n", factor(at).alias("season_factor"), temporal.is_sale_period(at).alias("is_sale_period"), temporal.interval_multiplier(at).alias("interval_multiplier"))


@query("b20_temporal_features", """
    SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(hour(ts) AS INT) AS hour, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
           CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_business_hours, CAST(month(ts) AS INT) AS month FROM events""")
def temporal_features(t: Tables):
    return t.raw("events").select("event_id", *[v.alias(k) for k, v in temporal.time_features(F.col("ts")).items()])


@query("b21_discount_percent", with_views("listings", body=f"""
    , x AS (SELECT product_id, current_price, CASE WHEN product_id % 3 = 0 THEN NULL WHEN product_id % 3 = 1 THEN original_price ELSE 0 END AS o, CASE WHEN product_id % 12 = 0 THEN NULL ELSE msrp END AS m FROM listings)
    SELECT product_id, {r('CASE WHEN o > 0 THEN (1 - current_price / CAST(o AS DOUBLE)) * 100 WHEN m > 0 THEN (1 - current_price / CAST(m AS DOUBLE)) * 100 END')} AS discount_percent,
           {r('CASE WHEN m IS NOT NULL THEN greatest(0.0, (1 - current_price / CAST(m AS DOUBLE)) * 100) ELSE 0 END')} AS msrp_discount FROM x"""))
def discount_percent(t: Tables):
    k = F.col("product_id")
    d = t.listings().select(
        "product_id", "current_price", F.when(k % 3 == 1, F.col("original_price")).when(k % 3 == 2, F.lit(0).cast(MONEY)).alias("o"),
        F.when(k % 12 != 0, F.col("msrp")).alias("m"),
    )
    return d.select(
        "product_id", round_to(C.discount_percent(F.col("current_price"), F.col("o"), F.col("m"))).alias("discount_percent"),
        round_to(C.msrp_discount(F.col("current_price"), F.col("m"))).alias("msrp_discount"),
    )


@query("b22_tier_buckets", with_views("observations", body="""
    , d AS (SELECT (1 - price / CAST(original_price AS DOUBLE)) * 100 AS pct, product_id, price,
            lag(price) OVER (PARTITION BY product_id ORDER BY fetched_at, order_id, line_no, supp_id, ext_price, qty) AS prev FROM observations),
    e AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT 'discount' AS kind, CASE WHEN pct >= 70 THEN '70%+' WHEN pct >= 60 THEN '60-70%' ELSE '50-60%' END AS tier, count(*) AS n FROM d WHERE pct >= 50 GROUP BY ALL
    UNION ALL SELECT 'direction', CASE WHEN price > prev THEN 'up' ELSE 'down' END, count(*) FROM d WHERE price <> prev GROUP BY ALL
    UNION ALL SELECT 'similarity', CASE WHEN s >= 0.95 THEN '0.95+' WHEN s >= 0.9 THEN '0.9-0.95' WHEN s >= 0.85 THEN '0.85-0.9' ELSE '<0.85' END, count(*) FROM e GROUP BY ALL"""))
def tier_buckets(t: Tables):
    o = t.observations()
    pct = C.discount_percent(F.col("price"), F.col("original_price"), F.col("original_price"))
    a = o.withColumn("pct", pct).filter(F.col("pct") >= 50).groupBy(F.lit("discount").alias("kind"), C.discount_tier(F.col("pct")).alias("tier"))
    seq = skew.sliced_lag(o, ["product_id"], Tables.NEWEST, ["price"], "YEAR").filter(F.col("price") != F.col("prev_price"))
    b = seq.groupBy(F.lit("direction").alias("kind"), C.direction(F.col("prev_price"), F.col("price")).alias("tier"))
    e = t.embeddings().select(F.col("product_id").alias("id"), F.col("embedding").alias("x"))
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    c = e.join(nxt, "id").withColumn("s", dot).groupBy(F.lit("similarity").alias("kind"), C.similarity_tier(F.col("s")).alias("tier"))
    n = F.count("*").alias("n")
    return a.agg(n).unionByName(b.agg(n)).unionByName(c.agg(n))
