"""Simple CSS selectors as regular expressions over page text, so that pages stay in the JVM.

Supported: ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``, ``[attr*=v]``, ``[attr^=v]``, ``:not([…])``, any
combination of these on one element, and descendants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_PART = re.compile(r":not\(([^)]*)\)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^]?=)\"?([^\"\]]*)\"?)?\]|^([a-zA-Z][\w-]*)")


# The character entities that texts and attributes of shop pages use; the ampersand comes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "),
    ("&#x2F;", "/"), ("&#47;", "/"), ("&trade;", "™"), ("&reg;", "®"), ("&copy;", "©"), ("&deg;", "°"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&eacute;", "é"), ("&euro;", "€"), ("&pound;", "£"), ("&#38;", "&"), ("&amp;", "&"),
)
_TAG_END = r"(?=[^<>\"]*+(?:\"[^<>\"]*+\"[^<>\"]*+)*+>)"


def canonical(html: Column) -> Column:
    """The page with single-quoted and bare attribute values in double quotes; only text within tags changes."""
    single = F.regexp_replace(html, r"(\s[\w:-]+)\s*=\s*'([^'\"<>]*)'(?=[^<>]*>)", '$1="$2"')
    bare = F.regexp_replace(single, r"(\s[\w:-]+)\s*=\s*([^\s\"'<>=`]++)(?=[\s>])" + _TAG_END, '$1="$2"')
    return F.when(html.rlike(r"\s[\w:-]+\s*=\s*[^\s\"]"), bare).otherwise(html)


def decode(text: Column) -> Column:
    """Character entities as characters."""
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in text)


def _attribute(name: str, op: str | None, value: str | None) -> str:
    head = rf"\s{_quoted(name)}"
    if not op:
        return rf"{head}(?=[\s=>/])"
    v = _quoted(value or "")
    inside = {"=": v, "*=": f"[^\"]*{v}[^\"]*", "^=": f"{v}[^\"]*"}[op]
    return rf"{head}\s*=\s*\"{inside}\""


def _element(selector: str) -> str:
    """Start tag of one compound selector."""
    tag, conditions = "[a-zA-Z][\\w-]*", ""
    for m in _PART.finditer(selector):
        negated, cls, ident, attr, op, value, name = m.groups()
        if name:
            tag = _quoted(name)
        elif negated:
            inner = next(_PART.finditer(negated)).groups()
            cond = _attribute(inner[3], inner[4], inner[5]) if inner[3] else rf"\sclass\s*=\s*\"(?:[^\"]*\s)?{_quoted(inner[1])}(?:\s[^\"]*)?\""
            conditions += rf"(?![^>]*{cond})"
        elif cls:
            conditions += rf"(?=[^>]*\sclass\s*=\s*\"(?:[^\"]*\s)?{_quoted(cls)}(?:\s[^\"]*)?\")"
        elif ident:
            conditions += rf"(?=[^>]*\sid\s*=\s*\"{_quoted(ident)}\")"
        else:
            conditions += rf"(?=[^>]*{_attribute(attr, op, value)})"
    return rf"<(?:{tag})\b{conditions}[^>]*>"


def start_tag(selector: str) -> str:
    """Pattern of the start tag a selector picks, ancestors first."""
    parts = [p for p in selector.split() if p != ">"]
    ahead = "".join(_element(p) + ".*?" for p in parts[:-1])
    return "(?is)" + ahead + _element(parts[-1])


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def attribute_pattern(name: str) -> str:
    """Pattern of an attribute's value within a start tag."""
    return rf"(?is)\s{_quoted(name)}\s*=\s*\"([^\"]*)\"[^>]*>$"


def extract(text: Column, pattern: Column, group: int) -> Column:
    """``regexp_extract`` with the pattern in a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def first_of(values: Column) -> Column:
    """First value of an array that is not NULL."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def first_text(page: Column, selectors: Column) -> Column:
    """Text of the first selector that matches, all of its element; ``selectors`` is an array of start-tag patterns."""
    matched = F.get(F.filter(selectors, lambda s: F.rlike(page, s)), F.lit(0))
    return F.when(matched.isNotNull(), strip_tags(element(page, matched)))


def first_attribute(page: Column, starts: Column, attribute: Column) -> Column:
    """Attribute of the element of the first start-tag pattern that matches and carries it."""
    def one(start: Column) -> Column:
        return F.nullif(extract(extract(page, start, 0), attribute, 1), F.lit(""))

    return first_of(F.transform(starts, one))


def count_elements(page: Column, selector: str) -> Column:
    return F.size(F.regexp_extract_all(page, F.lit(start_tag(selector)), F.lit(0)))


def any_of(selectors) -> str:
    """One pattern for the start tag of any of the selectors."""
    return "(?is)(?:" + "|".join(start_tag(s.strip())[len("(?is)"):] for s in selectors) + ")"


# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def tagged(page: Column) -> Column:
    """The page cut before every ``<``: each piece is one tag with the text behind it, numbered from 0."""
    name = r"^<(/?[a-zA-Z][\w-]*)"
    return F.transform(F.split(page, "(?=<)"), lambda p, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(p, name, 1)).alias("tag"), p.alias("piece")))


def intervals(tags: Column, begins: Column) -> Column:
    """First and last piece of every element that begins at a piece for which ``begins`` (an array of flags) is true.

    One pass keeps the elements still open, each with the number of its own name's tags that are open within it, so
    elements of one name may nest.  One that is never closed reaches to the end; one without content is its own piece.
    """
    none = "array<struct<i: int, tag: string, depth: int>>"
    done = "array<struct<i: int, j: int>>"

    def step(state: Column, x: Column) -> Column:
        t = x["t"]
        counted = F.transform(state["open"], lambda e: F.struct(
            e["i"].alias("i"), e["tag"].alias("tag"), (e["depth"] + (t["tag"] == e["tag"]).cast("int") - (t["tag"] == F.concat(F.lit("/"), e["tag"])).cast("int")).alias("depth")
        ))
        void = t["tag"].isin(*VOID)
        fresh = F.when(x["hit"] & ~void, F.array(F.struct(t["i"].alias("i"), t["tag"].alias("tag"), F.lit(1).alias("depth")))).otherwise(F.array().cast(none))
        closed = F.transform(F.filter(counted, lambda e: e["depth"] == 0), lambda e: F.struct(e["i"].alias("i"), t["i"].alias("j")))
        alone = F.when(x["hit"] & void, F.array(F.struct(t["i"].alias("i"), t["i"].alias("j")))).otherwise(F.array().cast(done))
        moved = F.struct(F.concat(F.filter(counted, lambda e: e["depth"] > 0), fresh).alias("open"), F.concat(state["done"], closed, alone).alias("done"))
        idle = (F.size(state["open"]) == 0) & ~x["hit"]
        return F.when(idle, state).otherwise(moved)

    def end(state: Column) -> Column:
        rest = F.transform(state["open"], lambda e: F.struct(e["i"].alias("i"), (F.size(tags) - 1).alias("j")))
        return F.sort_array(F.concat(state["done"], rest))

    start = F.struct(F.array().cast(none).alias("open"), F.array().cast(done).alias("done"))
    return F.aggregate(F.zip_with(tags, begins, lambda t, h: F.struct(t.alias("t"), h.alias("hit"))), start, step, end)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def within(tags: Column, span: Column) -> Column:
    """Text of the pieces of an interval."""
    return F.array_join(F.transform(F.slice(tags, span["i"] + 1, span["j"] - span["i"] + 1), lambda t: t["piece"]), "")


def element(text: Column, start: Column) -> Column:
    """The element whose start tag ends the first match of the pattern ``start``, from that tag to its own end tag."""
    found = extract(text, start, 0)
    tag = F.regexp_extract(found, "(?s)<[^<]*$", 0)
    behind = F.concat(tag, F.substring(text, F.instr(text, found) + F.length(found), F.length(text)))
    return bound(tagged(behind), lambda tags: within(tags, F.get(intervals(tags, F.transform(tags, lambda t: t["i"] == 0)), F.lit(0))))


def selector_pairs(group: str) -> list[tuple[str, str | None]]:
    """Each selector of a comma list as the patterns of its own start tag and of its ancestor's, if it names one."""
    out = []
    for selector in group.split(","):
        parts = [p for p in selector.split() if p != ">"]
        out.append(("(?is)^" + _element(parts[-1]), "(?is)^" + _element(parts[-2]) if len(parts) > 1 else None))
    return out


def element_items(page: Column, groups: Column) -> Column:
    """Texts of the elements that the first group of selectors with any match picks, in order, nested ones too.

    ``groups`` is an array of ``own, outer, inner``: a pattern of start tags, and a pair of which the second counts
    only within an element of the first.
    """
    def picked(tags: Column) -> Column:
        def hits(pattern: Column) -> Column:
            return F.transform(tags, lambda t: F.coalesce(F.rlike(t["piece"], pattern), F.lit(False)))

        def below(g: Column) -> Column:
            return bound(intervals(tags, hits(g["outer"])), lambda around: F.zip_with(
                tags, hits(g["inner"]), lambda t, h: h & F.exists(around, lambda s: (s["i"] < t["i"]) & (t["i"] <= s["j"]))
            ))

        def spans(g: Column) -> Column:
            return intervals(tags, F.when(g["outer"].isNull(), hits(g["own"])).otherwise(F.zip_with(hits(g["own"]), below(g), lambda a, b: a | b)))

        found = F.filter(F.transform(F.filter(groups, lambda g: F.rlike(page, g["any"])), spans), lambda f: F.size(f) > 0)
        return F.transform(F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<struct<i: int, j: int>>")), lambda s: within(tags, s))

    return bound(tagged(page), picked)
