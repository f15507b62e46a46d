"""The test-table views once more as plain SQL, for the checking side only."""

from __future__ import annotations

from driftmark import params


def _names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STORES = _names(params.TEST_STORES)
CATEGORIES = _names(params.TEST_CATEGORIES)
N_STORES = len(params.TEST_STORES)
N_CATEGORIES = len(params.TEST_CATEGORIES)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "products": ((), f"""
        SELECT p_partkey AS product_id, 'P' || p_partkey AS sku, p_name AS market_key,
               ({STORES})[1 + p_partkey % {N_STORES}] AS store,
               p_brand || ' ' || p_name || ' ' || p_size || ' inch' AS title,
               CAST(p_retailprice AS DECIMAL(10,2)) AS msrp,
               ({CATEGORIES})[1 + p_size % {N_CATEGORIES}] AS category,
               'https://shop.example/p/' || p_partkey AS url
        FROM part"""),
    "observations": ((), """
        SELECT l_partkey AS product_id,
               CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2))
                 * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))
                 * CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN CAST(0.1 AS DECIMAL(2,1))
                        ELSE CAST(1 AS DECIMAL(2,1)) END, 2) AS DECIMAL(10,2)) AS price,
               CAST(p_retailprice AS DECIMAL(10,2)) AS original_price,
               CASE WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
               1.0::DOUBLE - l_tax AS confidence, l_shipdate AS fetched_at,
               l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS supp_id,
               l_extendedprice AS ext_price, l_quantity AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "ref_time": ((), "SELECT max(l_shipdate) AS as_of FROM lineitem"),
    "ranked": (("observations",), """
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, order_id DESC,
               line_no DESC, supp_id DESC, ext_price DESC, qty DESC) AS rn
        FROM observations"""),
    "current_prices": (("ranked",), """
        SELECT product_id, price AS current_price, original_price AS current_original,
               availability AS current_availability, confidence AS current_confidence,
               fetched_at AS current_at
        FROM ranked WHERE rn = 1"""),
    "history": (("ranked",), "SELECT * EXCLUDE (rn), rn - 1 AS hrank FROM ranked WHERE rn > 1"),
    "listings": (("current_prices", "products"), """
        SELECT product_id, sku, title, url, current_price, current_original AS original_price, msrp, store,
               category, current_availability AS availability, current_confidence AS confidence,
               current_at AS seen_at
        FROM current_prices JOIN products USING (product_id)"""),
    "signals": ((), f"""
        SELECT event_id AS signal_id, ({STORES})[1 + user_id % {N_STORES}] AS retailer,
               ({STORES})[1 + user_id % {N_STORES}] || ':' || user_id AS product_id,
               CAST(value AS DECIMAL(10,2)) AS detected_price, ts AS detected_at,
               CASE event_type WHEN 'purchase' THEN 'clearance' WHEN 'click' THEN 'new_low'
                    ELSE event_type END AS signal_type,
               '{{"baseline_price": ' || (CAST(props->>'$.k' AS INT) * 5) || ', "price_change_count_24h": '
                 || (CAST(props->>'$.k' AS INT) % 4) || '}}' AS metadata,
               CAST(props->>'$.k' AS INT) * 5 AS meta_baseline, CAST(props->>'$.k' AS INT) % 4 AS meta_changes
        FROM events"""),
    "requests": ((), f"""
        SELECT event_id AS request_id, ({STORES})[1 + user_id % {N_STORES}] AS store,
               'd' || (user_id % 40) || '.example' AS domain, user_id AS source_id,
               event_type <> 'error' AS success, value * 100 AS duration_ms,
               CASE WHEN event_type = 'error' AND value > 100 THEN 429 WHEN event_type = 'error' THEN 503
                    ELSE 200 END AS status_code, ts
        FROM events"""),
    "alerts": ((), """
        SELECT o_orderkey AS alert_id, o_custkey AS product_id, CAST(1 + o_orderkey % 5 AS INT) AS rule_id,
               CAST(o_totalprice AS DECIMAL(12,2)) AS triggered_price, o_orderdate AS sent_at,
               CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS false_positive_count
        FROM orders"""),
}


# computed once: views that queries read several times, and a join whose dictionary columns DuckDB 2.0 fails to pass
# into text functions
STORED = ("listings", "ranked", "history", "current_prices")


def with_views(*names: str, body: str) -> str:
    """``body`` preceded by the views it needs, each after those it depends on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({VIEWS[n][1]})" for n in order)
    body = body.strip()
    recursive = False
    if body.upper().startswith("RECURSIVE"):
        recursive, body = True, body[len("RECURSIVE"):].strip()
    joiner = ",\n" if body.startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joiner}{body.lstrip(',')}"


def r(expr: str, digits: int = 4) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def txt(expr: str, digits: int) -> str:
    return f"CAST(CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DECIMAL(28,{digits})) AS VARCHAR)"
