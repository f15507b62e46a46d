"""Text normalisation, tokens and rule-based attributes."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

# Abbreviations and their expansions, applied in this order.
ABBREVIATIONS = {
    "w/": "with", "w/o": "without", "&": "and", "+": "plus", "vs": "versus", "vs.": "versus",
    "approx": "approximately", "approx.": "approximately", "est": "estimated", "est.": "estimated",
    "inc": "including", "inc.": "including", "excl": "excluding", "excl.": "excluding",
}
# Words left out of tokens.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its",
    "of", "on", "that", "the", "to", "was", "will", "with", "this",
)
# Words that hint at English.
ENGLISH_HINTS = (
    "the", "and", "or", "for", "with", "from", "this", "that", "product", "price", "sale", "deal", "discount",
)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Every named and numeric HTML entity."""
    return text.map(lambda s: None if s is None else _html.unescape(s))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def normalize(text: Column, lowercase: bool = True, remove_html: bool = True) -> Column:
    """Unescape, drop tags, expand abbreviations, squeeze white space, lower-case."""
    out = F.coalesce(text, F.lit(""))
    if remove_html:
        out = F.regexp_replace(unescape(out), "<[^>]+>", "")
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?iU)\b{_literal(short)}\b", long)
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.lower(out) if lowercase else out


def clean_title(title: Column) -> Column:
    """Normalised without lower-casing, then without a leading ``[…]`` and ``(…)``."""
    out = normalize(title, lowercase=False)
    out = F.regexp_replace(out, r"^\[.*?\]\s*", "")
    out = F.regexp_replace(out, r"^\(.*?\)\s*", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))


def keywords(docs: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """The most frequent tokens per document: top 2k by count, of those three letters or more, top k.

    Equal counts keep the order of first occurrence.  Texts are dealt by their key once, so that their words, several
    times as large, do not travel: all later steps keep that partitioning.
    """
    words = docs.select(key, text).repartition(key).select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = W.partitionBy(key).orderBy(F.desc("n"), "first")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * k)
    top = top.filter(F.length("word") >= 3)
    # at most 2k words are left per document, so this list is small
    listed = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy(key).agg(F.transform(F.slice(listed, 1, k), lambda x: x["word"]).alias("keywords"))


def english_hints(text: Column) -> Column:
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in ENGLISH_HINTS), F.lit(0))


def language(text: Column) -> Column:
    """Always English for a text; unknown for none."""
    return F.when(F.length(text) > 0, "en").otherwise("unknown")


# Patterns for brand, model, size and colour, and category words, each tried in order.
BRAND_PATTERNS = (
    r"(?i)\b([A-Z][a-z]+)\s+(?:[A-Z][a-z]+\s+)?(?:Pro|Max|Plus|Ultra|Elite|Premium)\b",
    r"(?i)\b([A-Z][a-z]+)\s+(?:[A-Z][a-z]+)\b",
)
NOT_BRANDS = ("the", "new", "best", "top", "premium")
MODEL_PATTERNS = (
    r"\b([A-Z0-9]{3,}-?[A-Z0-9]{2,})\b",
    r"\b(Model\s+[A-Z0-9-]+)\b",
    r"\b([A-Z][a-z]+\s+\d+[A-Z]?)\b",
)
SIZE_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:inch|in|\"|cm|mm|oz|lb|kg|g)\b"
DIMENSION_PATTERN = r"(?i)\b(\d+)\s*x\s*(\d+)\s*(?:inch|in|cm|mm)\b"
COLOR_PATTERN = (
    r"\b(black|white|red|blue|green|yellow|orange|purple|pink|brown|gray|grey|silver|gold|bronze)\b"
)
CATEGORY_WORDS = {
    "electronics": ("tv", "television", "monitor", "laptop", "computer", "phone", "tablet", "headphones"),
    "apparel": ("shirt", "pants", "shoes", "jacket", "dress", "sweater"),
    "home": ("furniture", "chair", "table", "sofa", "bed", "lamp"),
    "sports": ("bike", "bicycle", "treadmill", "weights", "gym"),
    "toys": ("toy", "game", "puzzle", "doll"),
}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def brand(text: Column) -> Column:
    head = F.slice(F.split(F.trim(text), r"\s+"), 1, 3)
    capital = F.filter(
        head, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2) & ~F.lower(w).isin(*NOT_BRANDS)
    )
    return F.coalesce(*[F.trim(_found(text, p)) for p in BRAND_PATTERNS], F.get(capital, F.lit(0)))


def model(text: Column, of_brand: Column) -> Column:
    def usable(pattern: str) -> Column:
        hit = _found(text, pattern)
        clash = F.coalesce(F.lower(hit).contains(F.lower(of_brand)), F.lit(False))
        return F.when(~clash, F.trim(hit))

    return F.coalesce(*[usable(p) for p in MODEL_PATTERNS])


def size(text: Column) -> Column:
    a, b = _found(text, DIMENSION_PATTERN, 1), _found(text, DIMENSION_PATTERN, 2)
    return F.coalesce(_found(text, SIZE_PATTERN), F.concat(a, F.lit("x"), b))


def color(text: Column) -> Column:
    return F.initcap(_found(F.lower(text), COLOR_PATTERN))


def category(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in CATEGORY_WORDS.items():
        out = out.when(low.rlike("|".join(words)), name)
    return out


ATTRIBUTES = ("brand", "model", "size", "color", "category")


def with_attributes(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    df = df.withColumn("brand", brand(t)).withColumn("model", model(t, F.col("brand")))
    return df.withColumns({"size": size(t), "color": color(t), "category": category(t)})


def merge_attributes(df: DataFrame, entities: str, rules: str, model_layer: str) -> DataFrame:
    """Later layers win: entities, then rules, then non-empty model values.

    The three arguments are column prefixes.  The model layer counts only where the first two gave
    fewer than three attributes or no brand.
    """
    early = {a: F.coalesce(F.col(f"{rules}_{a}"), F.col(f"{entities}_{a}")) for a in ATTRIBUTES}
    known = sum((v.isNotNull().cast("int") for v in early.values()), F.lit(0))
    asks = (known < 3) | early["brand"].isNull()
    late = {a: F.when(asks, F.nullif(F.col(f"{model_layer}_{a}"), F.lit(""))) for a in ATTRIBUTES}
    return df.withColumns({a: F.coalesce(late[a], early[a]) for a in ATTRIBUTES})


def title_template(df_brand: Column, df_model: Column, df_size: Column, df_color: Column, title: Column) -> Column:
    """"Brand - Model - Size: x - Color: y", or the cleaned title when nothing is known."""
    joined = F.concat_ws(
        " - ", df_brand, df_model, F.concat(F.lit("Size: "), df_size), F.concat(F.lit("Color: "), df_color)
    )
    return F.when(F.length(joined) > 0, joined).otherwise(clean_title(title))


def leftover_spec(title: Column, df_brand: Column, df_model: Column, limit: int | None = None) -> Column:
    """What is left of the title without brand and model, if longer than five characters; whole unless ``limit`` is given."""
    rest = F.when(df_brand.isNotNull(), F.trim(F.replace(title, df_brand, F.lit("")))).otherwise(title)
    rest = F.when(df_model.isNotNull(), F.trim(F.replace(rest, df_model, F.lit("")))).otherwise(rest)
    rest = normalize(rest, lowercase=False)
    return F.when(F.length(rest) > 5, rest if limit is None else F.substring(rest, 1, limit))


# Words that mark a section of a store or a listing.
CLEARANCE_WORDS = ("clearance", "closeout", "final sale", "liquidation", "overstock")
FLASH_SALE_WORDS = (
    "flash sale", "limited time", "today only", "24 hour sale", "daily deal", "lightning deal",
    "deal of the day", "time limited", "ending soon",
)
NEW_ARRIVAL_WORDS = ("new arrivals", "new products", "just added", "latest", "recently added", "new items")
HIGH_VALUE_WORDS = (
    "electronics", "computers", "gaming", "laptops", "tablets", "phones", "cameras", "tvs", "monitors",
)
DEAL_WORDS = ("clearance", "deal", "sale", "discount", "outlet", "bargain")
TIME_LIMIT_WORDS = ("ends in", "expires", "limited time", "today only", "flash sale")


def section_flags(name: Column, url: Column) -> dict[str, Column]:
    both = F.lower(F.concat_ws(" ", name, url))
    return {
        "is_clearance": both.rlike("|".join(CLEARANCE_WORDS)),
        "is_flash_sale": both.rlike("|".join(FLASH_SALE_WORDS)),
        "is_new_arrivals": both.rlike("|".join(NEW_ARRIVAL_WORDS)),
        "is_high_value": F.lower(name).rlike("|".join(HIGH_VALUE_WORDS)),
        "is_deal_section": both.rlike("|".join(DEAL_WORDS)),
    }


def is_time_limited(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike("|".join(TIME_LIMIT_WORDS)), F.lit(False))
