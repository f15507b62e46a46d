"""Thresholds, lists and tables the results depend on."""

# Stores that play the retailers in the test tables, in natural order.
KNOWN_STORES = (
    "amazon_us", "walmart", "bestbuy", "target", "costco", "newegg", "macys", "homedepot", "lowes",
    "microcenter", "gamestop", "bhphotovideo", "kohls", "officedepot", "ebay",
)
AGGREGATOR_STORES = ("saveyourdeals", "slickdeals", "woot")
TEST_STORES = KNOWN_STORES + AGGREGATOR_STORES
TEST_CATEGORIES = (
    "electronics", "Gaming Laptops", "home", "toys", "Kitchen & Dining", "clearance", "misc",
    "apparel", "TV & Video", "power tools", "books", "Open-Box",
)

# Baseline and statistics.
MIN_OBSERVATIONS = 3
STABLE_CV = 0.15
BASELINE_STABILITY = 0.7
Z_THRESHOLD = 2.5
IQR_MULTIPLIER = 1.5
RATE_OF_CHANGE_THRESHOLD = 50.0
BASELINE_DISCOUNT_THRESHOLD = 50.0
HISTORY_THROTTLE_HOURS = 6
RETENTION_DAYS = 90
MARKET_WINDOW_DAYS = 30
MARKET_SIGMA = 3.0
RAPID_DROP_THRESHOLD = 50.0

# Category name -> (least discount %, price/MSRP ratio, least price, greatest price).
CATEGORY_THRESHOLDS = {
    "electronics": (35.0, 0.65, 25.0, 5000.0),
    "computers": (30.0, 0.70, 50.0, 10000.0),
    "gaming": (25.0, 0.75, 15.0, 3000.0),
    "tv": (30.0, 0.70, 100.0, 10000.0),
    "deals": (30.0, 0.70, 10.0, 10000.0),
    "clearance": (40.0, 0.60, 5.0, 10000.0),
    "open-box": (20.0, 0.80, 25.0, 10000.0),
    "rollback": (25.0, 0.75, 10.0, 5000.0),
    "special": (30.0, 0.70, 10.0, 5000.0),
    "apparel": (55.0, 0.45, 10.0, 1000.0),
    "shoes": (50.0, 0.50, 15.0, 500.0),
    "home": (40.0, 0.60, 15.0, 5000.0),
    "kitchen": (40.0, 0.60, 15.0, 3000.0),
    "appliances": (30.0, 0.70, 50.0, 10000.0),
    "tools": (30.0, 0.70, 15.0, 3000.0),
    "power tools": (30.0, 0.70, 25.0, 2000.0),
    "toys": (45.0, 0.55, 10.0, 500.0),
    "toy": (45.0, 0.55, 10.0, 500.0),
    "videogames": (30.0, 0.70, 10.0, 500.0),
    "video games": (30.0, 0.70, 10.0, 500.0),
    "aggregator": (50.0, 0.50, 1.0, 10000.0),
    "saveyourdeals": (50.0, 0.50, 1.0, 10000.0),
    "slickdeals": (50.0, 0.50, 1.0, 10000.0),
    "woot": (50.0, 0.50, 1.0, 10000.0),
    "default": (40.0, 0.60, 1.0, 10000.0),
}
# Store -> multiplier on the least discount.
STORE_DISCOUNT_MULTIPLIER = {
    "homedepot": 0.85, "lowes": 0.85, "costco": 0.75, "bestbuy": 0.90, "newegg": 0.80,
    "microcenter": 0.75, "gamestop": 0.85, "bhphotovideo": 0.80, "kohls": 1.10,
    "officedepot": 0.90, "ebay": 0.85, "macys": 1.15,
}
CATEGORY_FILTER_FALLBACK = (40.0, 0.60, 10.0, 10000.0)

# Alert suppression and queues.
DEDUPE_TTL_HOURS = 12
COOLDOWN_MINUTES = 60
CROSS_SOURCE_TTL_SECONDS = 600
SIMILARITY_THRESHOLD = 0.85
CANDIDATES_PER_HOUR = 200
SUMMARY_BATCH = 20

# Low-priced items of these words are left out, as are the listed SKUs of one store.
LOW_PRICE_MAX = 30.0
LOW_PRICE_WORDS = (
    "kid", "kids", "child", "children", "toddler", "toy", "play", "playset", "pretend", "ages", "age",
    "play kitchen", "doctor kit", "magnetic tiles",
)
LOW_PRICE_STORE = "walmart"
LOW_PRICE_SKUS = ("5116478924", "780568056", "5152678945", "10025719060", "16501550266")
GLOBAL_MIN_PRICE = 50.0
GLOBAL_MIN_DISCOUNT = 50.0
DELTA_TTL_SECONDS = 3600
VELOCITY_SECONDS = 600
VELOCITY_MAX_PRICES = 3

# The detection rules used by the registered queries.
RULES = (
    # id, name, type, threshold, enabled, priority
    (1, "seventy percent off", "percent_drop", 0.3, True, 50),
    (2, "under a dollar", "absolute", 1.0, True, 90),
    (3, "tenth of MSRP", "msrp_deviation", 0.1, True, 80),
    (4, "half of MSRP", "msrp_ratio", 0.5, True, 40),
    (5, "penny price", "penny_pricing", 50.0, True, 100),
    (6, "currency slip", "currency_error", 0.0, True, 60),
    (7, "fast repricing", "velocity", 3.0, True, 95),
    (8, "any discount", "percent_drop", 0.93, True, 10),
    (9, "switched off", "absolute", 100000.0, False, 99),
)

#: A page with an error word is an error page only below this many characters: longer ones carry content.
ERROR_PAGE_BELOW = 1000
