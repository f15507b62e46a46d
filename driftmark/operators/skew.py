"""Order-dependent helpers that do not put a whole key into one task.

A plain window over a key sorts every row of that key in a single task.  Here a key is cut into
time slices; each slice is windowed on its own and a small per-slice summary carries the state over
the borders.  The results equal those of the plain window: null keys are one key, and null times come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICE = "_slice"


OWN = "_own"


def in_slices(df: DataFrame, keys: Sequence[str], ts: str, unit: str) -> DataFrame:
    """Rows with ``OWN``: their key and slice as one struct.

    Structs are equal where nulls meet nulls, so a plain equality on it takes null keys and times for values like
    others, and one shuffle by it serves a join and the windows that follow.
    """
    return with_slice(df, ts, unit).withColumn(OWN, F.struct(*keys, SLICE)).drop(SLICE)


def beside(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Rows with the columns of the one side row of their key and slice."""
    return rows.join(side, OWN)


def with_slice(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return df.withColumn(SLICE, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz"))


def sliced_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], unit: str) -> DataFrame:
    """Adds ``prev_<v>`` for every value: its value on the previous row of the key.

    ``order`` starts with the time column that is cut into slices.
    """
    rows = in_slices(df, keys, order[0], unit)
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("last")
    over_slices = W.partitionBy(*[f"{OWN}.{k}" for k in keys]).orderBy(f"{OWN}.{SLICE}")
    borders = rows.groupBy(OWN).agg(last).select(OWN, F.lag("last").over(over_slices).alias("border"))
    inside = W.partitionBy(OWN).orderBy(*order)
    rows = beside(rows, borders)
    first = F.row_number().over(inside) == 1
    rows = rows.withColumns(
        {f"prev_{v}": F.when(first, F.col(f"border.{v}")).otherwise(F.lag(v).over(inside)) for v in values}
    )
    return rows.drop("border", OWN)


def sliced_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, unit: str, name: str) -> DataFrame:
    """Adds the running sum of ``value`` over the rows of the key, oldest first."""
    rows = in_slices(df.withColumn("_v", value), keys, order[0], unit)
    sizes = rows.groupBy(OWN).agg(F.sum("_v").alias("n"))
    before = W.partitionBy(*[f"{OWN}.{k}" for k in keys]).orderBy(f"{OWN}.{SLICE}").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(OWN, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(OWN).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return beside(rows, sizes).withColumn(name, F.col("offset") + F.sum("_v").over(inside)).drop("offset", "_v", OWN)


def sliced_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], unit: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based position of the row within its key, oldest first."""
    return sliced_sum(df, keys, order, F.lit(1), unit, name)


def sliced_trailing(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, aggregates: dict[str, Column]
) -> DataFrame:
    """Aggregates over the rows of the key within the trailing ``seconds``, both ends included.

    Every row is also handed to the next slice as context, so one slice and its context hold all
    rows a range frame can reach.  Rows without a time are a frame of their own.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    rows = df.withColumn("_at", micros).withColumn("_own", F.floor(F.col("_at") / span))
    rows = rows.withColumn(SLICE, F.explode(F.when(F.col("_own").isNull(), F.array("_own")).otherwise(F.array("_own", F.col("_own") + 1))))
    frame = W.partitionBy(*keys, SLICE).orderBy("_at").rangeBetween(-span, 0)
    rows = rows.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
    return rows.filter(F.col(SLICE).eqNullSafe(F.col("_own"))).drop("_at", "_own", SLICE)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, name: str = "newest_rank", skip: int = 0) -> DataFrame:
    """The newest ``limit`` rows per key, after the ``skip`` newest ones, which are left out; ranks begin at 1.

    Spark cuts each map task's share of a key to the rows wanted before the shuffle (group limit), so a hot key sends
    only so many rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    d = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit + skip)
    return d.filter(F.col(name) > skip).withColumn(name, F.col(name) - skip) if skip else d


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value with the count of rows up to and including it.

    Counting first combines equal values on the map side; the running count then goes over distinct
    values, not rows.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))


def value_at(position: Column, value: str) -> Column:
    """Aggregate: the value at a zero-based position of the sorted rows behind ``value_counts``."""
    return F.min(F.when(F.col("upto") > position, F.col(value)))


def salted_join(
    facts: DataFrame, rules: DataFrame, key: str, salt_from: Column, salts: int = 16, how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join on a key that few values may dominate: facts are spread over salts, the rule side is
    repeated once per salt.  Meant for a small rule side without a proven bound."""
    left = facts.withColumn("_salt", F.abs(F.hash(salt_from)) % salts)
    right = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<int>")))
    right = right.withColumnRenamed(key, "_rkey").withColumnRenamed("_salt", "_rsalt")
    on = (F.col(key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt"))
    if condition is not None:
        on = on & condition
    return left.join(right, on, how).drop("_salt", "_rsalt", "_rkey")
