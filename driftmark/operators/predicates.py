"""Rules as rows, met through an index: a rule is filed under what any text it matches must hold.

Containment and patterns are filed under one gram (three characters) of a literal that a match cannot do without, the
rarest one in the texts at hand; "at least" conditions under the dyadic nodes that cover their bands.  Texts and values
look up their own grams and nodes by equi joins, and only what meets there is tested.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
LEVELS = 4


def grams(text: Column) -> Column:
    """Every gram of a text once, and the empty one, under which needles too short for a gram are filed."""
    n = F.length(text)
    all_of = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.array_union(F.array(F.lit("")), F.coalesce(all_of, F.array().cast("array<string>")))


def counted(texts: DataFrame, text: Column) -> DataFrame:
    """In how many rows each gram occurs."""
    return texts.select(F.explode(grams(text)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def filed(needles: DataFrame, needle: str, rule: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rule`` and ``needle`` with ``gram``: the rarest gram of the needle by ``counts`` (else the first), or the empty one."""
    own = F.when(F.length(needle) < GRAM, F.array(F.lit(""))).otherwise(F.filter(grams(F.col(needle)), lambda g: g != ""))
    each = needles.select(*rule, needle, F.explode(own).alias("gram"))
    if counts is None:
        return each.groupBy(*rule, needle).agg(F.min("gram").alias("gram"))
    known = counts.select(F.col("gram").alias("_gram"), "n")
    each = each.join(known, F.col("gram") == F.col("_gram"), "left")
    return each.groupBy(*rule, needle).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("least")).select(*rule, needle, "least.gram")


BREAK = "\u0001"
QUANTIFIER = r"(?:[*+?]|\{\d+(?:,\d*)?\})"


def pattern_literals(pattern: Column) -> Column:
    """Lower-case literals of which every match of a pattern, whatever the case of A-Z, holds one.

    One empty literal where nothing is known, NULL for a text that is no pattern (brackets that do not close, a
    quantifier without anything before it).  Constructs are taken away from the inside out: what may match anything, or
    nothing, becomes a break, and of each alternative the longest piece between breaks is left.
    """
    def swap(c: Column, what: str, by: str) -> Column:
        return F.regexp_replace(c, what, by)

    s = swap(swap(pattern, r"\\\\", BREAK), r"\\[bBAZ]", "")
    s = swap(s, r"\((?:\?:|\?P?<[A-Za-z]\w*>)", "(")
    unknown = F.rlike(s, F.lit(r"\\[^\WdDwWsSntrfv]")) | F.contains(s, F.lit("(?"))
    s = swap(swap(s, r"\\.", BREAK), r"\[\^?\]?[^\[\]]*\]", BREAK)
    dangling = F.rlike(s, F.lit(r"(^|[(|])[*+?]|\\$")) & ~F.contains(s, F.lit("(?"))
    s = swap(s, r"^\(([^()]*)\)$", "$1")
    for _ in range(6):
        s = swap(s, r"\(([^()|]*)\)(?!" + QUANTIFIER + ")", "$1")
        s = swap(s, r"\([^()]*\)" + QUANTIFIER + "*", BREAK)
    unclosed = F.length(F.replace(s, F.lit("("))) != F.length(F.replace(s, F.lit(")")))
    unclosed = unclosed | (F.contains(s, F.lit("[")) != F.contains(s, F.lit("]")))
    unknown = unknown | F.rlike(s, F.lit(r"[()\[\]]"))
    s = swap(s, r"[^|](?:[*?]|\{\d+(?:,\d*)?\})[?+]?", BREAK)
    unclosed = unclosed | F.contains(s, F.lit("{"))
    s = swap(swap(s, r"\+[?+]?|\.", BREAK), r"[\^$]", "")
    longest = F.transform(F.split(s, r"\|"), lambda branch: F.aggregate(
        F.split(branch, BREAK), F.lit(""), lambda best, piece: F.when(F.length(piece) > F.length(best), piece).otherwise(best)
    ))
    folded = F.array_distinct(F.transform(longest, lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase)))
    nothing = F.array(F.lit(""))
    return F.when(dangling | unclosed, F.lit(None).cast("array<string>")).when(unknown | F.array_contains(folded, ""), nothing).otherwise(folded)


def band(value: Column, width: float) -> Column:
    """Number of the band of a value: 0 to 15, the last one open to above, the first to below."""
    top = (1 << LEVELS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor(value / width).cast("int")))


def nodes_above(number: Column) -> Column:
    """Dyadic nodes that hold a band: one a level."""
    return F.array(*[F.lit(level * 100).cast("int") + F.shiftright(number, level) for level in range(LEVELS + 1)])


def nodes_from(number: Column) -> Column:
    """The dyadic nodes that together cover all bands from ``number`` on, each band once.

    A node is one of them if it begins at or after ``number`` and its parent does not.
    """
    found = []
    for level in range(LEVELS + 1):
        for k in range(1 << (LEVELS - level)):
            begins, parent = k << level, (k >> 1) << (level + 1)
            inside = number <= begins
            if level < LEVELS:
                inside = inside & (number > parent)
            found.append(F.when(inside, F.lit(level * 100 + k)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())
