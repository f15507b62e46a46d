"""Event-time order on streams: rows wait until the watermark has passed them, late ones are set apart.

A key's rows are held in list state.  A timer at the earliest of them fires once the watermark has passed it; what lies
behind the watermark is then handed on in order of time and id, so a row that came late but within the lateness gets
the verdict of the batch twin.  A row that comes behind the watermark is not dropped and not judged: it leaves at once
with ``late`` true, for a side table (``start_split``).  Rows without a time cannot be put in order: they pass at once,
with the verdict the fold has for them, and change no state.

Every stream of this module returns the columns it was asked to carry, the fold's own, and ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from driftmark import params
from driftmark.operators.dedupe import Budget, Cooldown

AT = "at_micros"


class Fold:
    """What happens to a key's rows (time in microseconds, id, values…), released in order.

    ``extras`` and ``state`` are schemas.  ``take`` gets the rows with the state left by earlier ones (None at first)
    and returns one tuple of extras per row and the new state.  ``until`` is the time at which a state has no more say.
    """

    extras = "accepted boolean"
    state = ""
    untimed: tuple = (True,)

    def take(self, saved: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def until(self, saved: tuple) -> int:
        raise NotImplementedError


class CooldownFold(Fold):
    state = "at long, price double"

    def __init__(self, ttl_seconds: int, cheaper: bool):
        self.ttl, self.cheaper = ttl_seconds * 1_000_000, cheaper

    def take(self, saved, rows):
        policy = Cooldown(self.ttl, self.cheaper)
        policy.reset()
        if saved:
            policy.at, policy.price = saved
        taken = [(policy.admit(r[0], r[2] if self.cheaper else 0.0),) for r in rows]
        return taken, (policy.at, policy.price)

    def until(self, saved):
        return saved[0] + self.ttl


class BudgetFold(Fold):
    state = "times array<long>"

    def __init__(self, limits: Sequence[tuple[int, int]]):
        self.limits = [(s * 1_000_000, n) for s, n in limits]
        self.longest = max(s for s, _ in self.limits)

    def take(self, saved, rows):
        policy = Budget(self.limits)
        policy.reset()
        past = list(saved[0]) if saved else []
        for queue in policy.past:
            queue.extend(past)
        taken = []
        for r in rows:
            taken.append((policy.admit(r[0], 0.0),))
            if taken[-1][0]:
                past.append(r[0])
        return taken, ([at for at in past if at >= rows[-1][0] - self.longest],)

    def until(self, saved):
        return max(saved[0], default=0) + self.longest


class ChangedFold(Fold):
    state = "digest string, at long"

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def take(self, saved, rows):
        last, seen = saved or (None, None)
        out = []
        for at, _, digest in rows:
            out.append((seen is None or last != digest or at - seen >= self.ttl,))
            last, seen = digest, at
        return out, (last, seen)

    def until(self, saved):
        return saved[1] + self.ttl


class DropFold(Fold):
    """Drop against the previous price, with the number of observations in the trailing span; peers in time see each other."""

    extras = "prev_price double, drop_percent double, change_velocity double, accepted boolean"
    state = "times array<long>, last double"
    untimed = (None, None, None, False)

    def __init__(self, hours: int, threshold: float):
        self.span, self.hours, self.threshold = hours * 3_600_000_000, hours, threshold

    def take(self, saved, rows):
        times, last = (list(saved[0]), saved[1]) if saved else ([], None)
        times += [r[0] for r in rows]
        low, high, out = 0, 0, []
        for at, _, price in rows:
            while times[low] < at - self.span:
                low += 1
            while high < len(times) and times[high] <= at:
                high += 1
            drop = (last - price) / last * 100 if last and last > 0 and price is not None else None
            hit = drop is not None and drop >= self.threshold and high - low >= 3
            out.append((last, drop, (high - low - 1) / self.hours, hit))
            last = price
        return out, ([t for t in times if t >= rows[-1][0] - self.span], last)

    def until(self, saved):
        return max(saved[0]) + self.span


class Release(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them."""

    def __init__(self, n_keys: int, columns: list[str], waiting: StructType, extras: list[str], untimed: tuple):
        self.n_keys, self.columns, self.schema, self.extras, self.untimed = n_keys, columns, waiting, extras, untimed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.next = handle.getValueState("next", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the fold."""

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Extras of rows released in order."""
        raise NotImplementedError

    def expire(self, watermark: int) -> None:
        """Drops state that has no more say once the watermark (microseconds) has come so far."""

    def _wake(self, at: int) -> None:
        """A timer just behind ``at``, unless one is set before it."""
        due = at // 1000 + 1
        if not self.next.exists() or due < self.next.get()[0]:
            self.next.update((due,))
            self.handle.registerTimer(due)

    def _out(self, key: tuple, rows: list[tuple], extras: list[tuple], late: bool) -> pd.DataFrame:
        whole = [(*key, *r, *e, late) for r, e in zip(rows, extras)]
        names = [*[f"key{i}" for i in range(len(key))], *self.columns, *self.extras, "late"]
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*whole))})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held, late, untimed = [], [], []
        for pdf in rows:
            for row in zip(*[_plain(pdf[c]) for c in self.columns]):
                (untimed if row[0] is None else late if row[0] < watermark else held).append(row)
        if held:
            self.waiting.appendList(held)
            self._wake(min(r[0] for r in held))
        if late:
            yield self._out(key, late, [(None,) * len(self.extras)] * len(late), True)
        if untimed:
            yield self._out(key, untimed, [self.untimed] * len(untimed), False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # whichever timer fires first, rows are released before any state they may need expires
        if self.next.exists() and self.next.get()[0] * 1000 <= watermark:
            self.next.clear()
            rows = [tuple(r) for r in self.waiting.get()]
            ready = sorted((r for r in rows if r[0] < watermark), key=lambda r: r[:2])
            stay = [r for r in rows if r[0] >= watermark]
            if stay:
                self.waiting.put(stay)
                self._wake(min(r[0] for r in stay))
            else:
                self.waiting.clear()
            if ready:
                yield self._out(key, ready, self.fold(key, ready), False)
        self.expire(watermark)

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Python values of a column; NaN and NaT stand for null."""
    if column.dtype == object:
        return [v.tolist() if isinstance(v, np.ndarray) else v for v in column]
    if column.dtype.kind == "f":
        whole = column.name == AT  # long with nulls arrives as double
        return [None if v != v else int(v) if whole else v for v in column.tolist()]
    return column.tolist()


class ValueRelease(Release):
    """Rows released to a fold whose whole state is one small value."""

    def __init__(self, fold: Fold, *args):
        super().__init__(*args)
        self.rule = fold

    def open(self, handle):
        self.value = handle.getValueState("value", self.rule.state)

    def fold(self, key, rows):
        extras, saved = self.rule.take(tuple(self.value.get()) if self.value.exists() else None, rows)
        self.value.update(saved)
        self.handle.registerTimer(self.rule.until(saved) // 1000 + 1)
        return extras

    def expire(self, watermark):
        if self.value.exists() and self.rule.until(tuple(self.value.get())) < watermark:
            self.value.clear()


def released(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, values: Sequence[str], extras: str, lateness: str, make) -> DataFrame:
    """``rows`` through a release; ``make`` gets what ``Release`` takes and returns the processor.

    The watermark column itself does not go into the operator: Spark would drop late rows there.
    """
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    slim = timed.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.unix_micros(ts).alias(AT), row_id, *values)
    columns = [AT, row_id, *values]
    waiting = slim.select(*columns).schema
    more = StructType.fromDDL(extras)
    out = StructType([*slim.schema.fields, *more.fields, StructField("late", BooleanType())])
    for f in out.fields:
        f.nullable = True
    grouped = slim.groupBy(*[f"key{i}" for i in range(len(keys))])
    processor = make(len(keys), columns, waiting, [f.name for f in more.fields])
    found = grouped.transformWithStateInPandas(processor, out, "Append", "EventTime")
    own = [F.col(f"key{i}").alias(k) for i, k in enumerate(keys)]
    return found.select(*own, F.timestamp_micros(AT).alias(ts), row_id, *values, *[f.name for f in more.fields], "late")


def folded(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, fold: Fold, values: Sequence[str] = (), lateness: str = "1 hour") -> DataFrame:
    """Rows of each key folded in event-time order."""
    return released(rows, keys, ts, row_id, values, fold.extras, lateness, lambda *a: ValueRelease(fold, *a, fold.untimed))


def alert_dedupe(alerts: DataFrame, ts: str, row_id: str, ttl_hours: int = params.DEDUPE_TTL_HOURS, lateness: str = "1 hour") -> DataFrame:
    d = alerts.withColumn("price_bucket", F.bround("price", 0).cast("long"))
    return folded(d, ["store", "sku", "price_bucket"], ts, row_id, CooldownFold(ttl_hours * 3600, False), lateness=lateness)


def _as_double(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("double"))


def cooldown_bypass(alerts: DataFrame, ts: str, row_id: str, minutes: int = params.COOLDOWN_MINUTES, lateness: str = "1 hour") -> DataFrame:
    return folded(_as_double(alerts, "price"), ["store", "sku"], ts, row_id, CooldownFold(minutes * 60, True), ["price"], lateness)


def best_price(sightings: DataFrame, key: str, ts: str, row_id: str, ttl_seconds: int = params.CROSS_SOURCE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Aggregator sightings; those of other stores need no order and are to be united by the caller."""
    d = _as_double(sightings.filter(F.col("store").isin(*params.AGGREGATOR_STORES)), "price")
    return folded(d, [key], ts, row_id, CooldownFold(ttl_seconds, True), ["price"], lateness)


def throttle(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, hours: int = params.HISTORY_THROTTLE_HOURS, lateness: str = "1 hour") -> DataFrame:
    return folded(rows, keys, ts, row_id, CooldownFold(hours * 3600, False), lateness=lateness)


def budget(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, limits: Sequence[tuple[int, int]], lateness: str = "1 hour") -> DataFrame:
    return folded(rows, keys, ts, row_id, BudgetFold(limits), lateness=lateness)


def changed(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, digest: str, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    return folded(rows, keys, ts, row_id, ChangedFold(ttl_seconds), [digest], lateness)


def rapid_drop(observations: DataFrame, hours: int = 24, threshold: float = params.RAPID_DROP_THRESHOLD, lateness: str = "1 hour") -> DataFrame:
    """Reads ``product_id, row_id, fetched_at, price``; ``accepted`` marks the drops."""
    return folded(_as_double(observations, "price"), ["product_id"], "fetched_at", "row_id", DropFold(hours, threshold), ["price"], lateness)


class CellRelease(Release):
    """Signals against earlier ones within a dollar and the time to live.

    A map from dollar to the newest time of each price in it; a price looks into its own dollar and both beside it.
    Each dollar has a timer at the time its newest price has no more say.
    """

    def __init__(self, ttl_seconds: int, *args):
        super().__init__(*args)
        self.span = ttl_seconds * 1_000_000

    def open(self, handle):
        self.cells = handle.getMapState("cells", "dollar long", "cents array<long>, at array<long>")

    def fold(self, key, rows):
        if any(k is None or k != k for k in key):  # a null equals nothing
            return [(True,)] * len(rows)
        cells: dict[int, dict[int, int]] = {}

        def cell(dollar: int) -> dict[int, int]:
            if dollar not in cells:
                known = self.cells.getValue((dollar,)) if self.cells.containsKey((dollar,)) else None
                cells[dollar] = dict(zip(known[0], known[1])) if known else {}
            return cells[dollar]

        out: list[tuple] = []
        touched, i = set(), 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            peers = rows[i:j]  # signals of one time do not see each other
            for at, _, cents in peers:
                near = () if cents is None else (t for d in (-1, 0, 1) for c, t in cell(cents // 100 + d).items() if abs(c - cents) <= 100)
                out.append((not any(at - t <= self.span for t in near),))
            for at, _, cents in peers:
                if cents is not None:
                    cell(cents // 100)[cents] = at
                    touched.add(cents // 100)
            i = j
        for dollar in touched:
            held = cells[dollar]
            self.cells.updateValue((dollar,), (list(held), list(held.values())))
            self.handle.registerTimer((max(held.values()) + self.span) // 1000 + 1)
        return out

    def expire(self, watermark):
        gone, kept = [], []
        for dollar, (cents, at) in self.cells.iterator():
            live = [(c, t) for c, t in zip(cents, at) if t + self.span >= watermark]
            if not live:
                gone.append(dollar)
            elif len(live) < len(cents):
                kept.append((dollar, live))
        for dollar in gone:
            self.cells.removeKey(tuple(dollar))
        for dollar, live in kept:
            self.cells.updateValue(tuple(dollar), ([c for c, _ in live], [t for _, t in live]))


def recent_signals(signals: DataFrame, ttl_hours: int = params.DEDUPE_TTL_HOURS, lateness: str = "1 hour") -> DataFrame:
    """Signals, ``accepted`` where none of the same retailer, product and type came before within a dollar and the time.

    Prices are DECIMAL(…, 2).  The state of a key is bounded by the cents of the dollars seen within the time.
    """
    d = signals.withColumn("cents", (F.col("detected_price") * 100).cast("long"))
    found = released(
        d, ["retailer", "product_id", "signal_type"], "detected_at", "signal_id", ["cents"], "accepted boolean", lateness,
        lambda *a: CellRelease(ttl_hours * 3600, *a, (True,)),
    )
    return found.withColumn("detected_price", (F.col("cents") / 100).cast("decimal(12,2)")).drop("cents")


class VectorRelease(Release):
    """Alerts against earlier alerts of similar products, whose vectors are held in the bucket with the time of the last."""

    def __init__(self, threshold: float, ttl_seconds: int, *args):
        super().__init__(*args)
        self.threshold, self.span = threshold, ttl_seconds * 1_000_000

    def open(self, handle):
        self.held = handle.getMapState("held", "product long", "vector array<double>, at long")

    def fold(self, key, rows):
        if key[0] is None or key[0] != key[0]:  # no vector
            return [(True,)] * len(rows)
        known = [(p[0], v[0], v[1]) for p, v in self.held.iterator()]
        place = {p: i for i, (p, _, _) in enumerate(known)}
        for r in rows:
            place.setdefault(r[2], len(place))
        vectors = np.zeros((len(place), len(rows[0][3])))
        newest = np.full(len(place), np.iinfo(np.int64).min // 2)
        for i, (_, v, at) in enumerate(known):
            vectors[i], newest[i] = v, at
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            for at, _, product, vector, own in rows[i:j]:
                if not own:
                    out.append((None,))
                    continue
                recent = np.flatnonzero(newest > at - self.span)
                recent = recent[recent != place[product]]
                similar = np.round(vectors[recent] @ np.array(vector), 8) >= self.threshold
                out.append((not similar.any(),))
            for at, _, product, vector, _ in rows[i:j]:
                vectors[place[product]], newest[place[product]] = vector, at
            i = j
        for product in {r[2] for r in rows}:
            k = place[product]
            self.held.updateValue((product,), (vectors[k].tolist(), int(newest[k])))
            self.handle.registerTimer((int(newest[k]) + self.span) // 1000 + 1)
        return out

    def expire(self, watermark):
        for product in [p for p, v in self.held.iterator() if v[1] + self.span < watermark]:
            self.held.removeKey(tuple(product))


def angle_buckets(vectors: DataFrame, vector: str, threshold: float, pivots: int = 2, seed: int = 42) -> DataFrame:
    """Each row once for its own bucket (``own``) and once for each bucket beside it.

    A bucket is a cell of angles to fixed directions, as wide as the angle of the threshold: two vectors at least that
    similar differ by one cell at most in each direction, so the bucket of either holds both.  Null and zero vectors
    have a null bucket.
    """
    @F.pandas_udf("array<long>")
    def cells(column: pd.Series) -> pd.Series:
        width = np.arccos(min(1.0, threshold)) + 1e-6
        out = []
        for v in column:
            x = None if v is None else np.asarray(v, float)
            norm = 0.0 if x is None else np.linalg.norm(x)
            if not norm > 0:
                out.append(None)
                continue
            directions = np.random.default_rng(seed).normal(size=(pivots, len(x)))
            directions /= np.linalg.norm(directions, axis=1)[:, None]
            out.append(np.floor(np.arccos(np.clip(directions @ x / norm, -1, 1)) / width).astype(np.int64).tolist())
        return pd.Series(out)

    around = [[]]
    for _ in range(pivots):
        around = [[*a, d] for a in around for d in (-1, 0, 1)]
    steps = F.array(*[F.array(*[F.lit(d).cast("long") for d in a]) for a in around])
    d = vectors.withColumn("_cell", cells(vector))
    d = d.withColumn("_step", F.explode(F.when(F.col("_cell").isNull(), F.array(F.array(*[F.lit(0).cast("long")] * pivots))).otherwise(steps)))
    own = F.forall("_step", lambda x: x == 0)
    bucket = F.when(F.col("_cell").isNotNull(), F.xxhash64(F.zip_with("_cell", "_step", lambda a, b: a + b)))
    return d.withColumns({"bucket": bucket, "own": own}).drop("_cell", "_step")


def semantic_dedupe(alerts: DataFrame, threshold: float = params.SIMILARITY_THRESHOLD, ttl_hours: int = params.DEDUPE_TTL_HOURS, lateness: str = "1 hour") -> DataFrame:
    """Alerts, ``accepted`` where no product at least so similar was alerted within the time before.

    Reads ``alert_id, product_id, sent_at`` and ``embedding``, the product's normalised vector.  Alerts of the product
    itself do not count.  Each vector is held in its own bucket and those beside it, so one look into a row's own bucket
    finds every similar one; a timer lets a product go when its last alert has no more say.
    """
    d = angle_buckets(alerts, "embedding", threshold).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    found = released(
        d, ["bucket"], "sent_at", "alert_id", ["product_id", "embedding", "own"], "accepted boolean", lateness,
        lambda *a: VectorRelease(threshold, ttl_hours * 3600, *a, (True,)),
    )
    return found.filter("own").drop("bucket", "own", "embedding")


def start_split(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts writing a stream of this module: rows judged and, apart from them, late rows, each exactly once."""
    return (
        stream.writeStream.format("parquet").partitionBy("late").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def judged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(~F.col("late").cast("boolean")).drop("late")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The side table of rows that came behind the watermark."""
    return spark.read.parquet(path).filter(F.col("late").cast("boolean")).drop("late")
