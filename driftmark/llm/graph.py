"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every end of ``edges`` (columns a, b of one orderable type).

    Rounds of large-star and small-star joins: every node is hooked to the smallest node among its neighbours until
    only stars are left.  A hub's links are never gathered: its minimum comes from a partial aggregate and goes back
    by a join.  Null ends are no links; an empty table gives no rows.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    state = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(state)
    for _ in range(most_rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        state = stored(small, "links")
        before, mark = mark, _mark(state)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _mark(state: DataFrame):
    """Count and checksum of a link table."""
    return tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(near: np.ndarray) -> np.ndarray:
    """Smallest row of its component for each row of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    linked = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
