"""Flags from words in a title."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that place a title in a product family.
ELECTRONICS_WORDS = (
    "tv", "television", "monitor", "laptop", "computer", "phone", "tablet", "headphones", "speaker", "camera",
)
APPAREL_WORDS = ("shirt", "pants", "shoes", "jacket", "dress", "sweater")
HOME_WORDS = ("furniture", "chair", "table", "sofa", "bed", "lamp")


def has_any(text: Column, words) -> Column:
    """Does the text contain one of the plain words?"""
    return text.rlike("|".join(words))


def title_flags(title: Column) -> dict[str, Column]:
    low = F.lower(title)
    return {
        name: F.when(has_any(low, words), 1.0).otherwise(0.0)
        for name, words in (("is_electronics", ELECTRONICS_WORDS), ("is_apparel", APPAREL_WORDS), ("is_home", HOME_WORDS))
    }
