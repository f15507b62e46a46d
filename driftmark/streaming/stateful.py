"""Streaming twins of the order-dependent operators.

Each keeps one small state per key and drops it by an event-time timer.  Expiry is also checked when a
row arrives, so results do not depend on when a timer fires.  Within a micro-batch a key's rows are
taken in order of time and id; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftmark import params
from driftmark.operators.dedupe import Budget, Cooldown
from driftmark.streaming.ordered import DropFold

TIMER = GroupStateTimeout.EventTimeTimeout


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


def _sorted(batches: Iterator[pd.DataFrame], ts: str, row_id: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values([ts, row_id])


def _keep(state: GroupState, value: tuple, until_micros: int) -> None:
    """Stores the state until an event time, which has to lie ahead of the watermark."""
    state.update(value)
    state.setTimeoutTimestamp(max(until_micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def cooldown_stream(
    rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, ttl_seconds: int, price: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Accepted rows: the first per key, those a TTL after the last accepted, and, given a price, cheaper ones."""
    ttl = ttl_seconds * 1_000_000
    schema = rows.select(*keys, ts, row_id, *([price] if price else [])).schema
    columns = schema.names

    def fold(_key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        policy = Cooldown(ttl, price is not None)
        policy.reset()
        if state.exists:
            policy.at, policy.price = state.get
        pdf = _sorted(batches, ts, row_id)
        prices = pdf[price].astype(float) if price else [0.0] * len(pdf)
        taken = [policy.admit(int(at), p) for at, p in zip(_micros(pdf[ts]), prices)]
        _keep(state, (policy.at, policy.price), policy.at + ttl)
        yield pdf.loc[taken, columns]

    return (
        rows.select(*columns).withWatermark(ts, lateness).groupBy(*keys)
        .applyInPandasWithState(fold, schema, "at long, price double", "append", TIMER)
    )


def alert_dedupe_stream(alerts: DataFrame, ts: str, row_id: str, ttl_hours: int = params.DEDUPE_TTL_HOURS, lateness: str = "1 hour") -> DataFrame:
    d = alerts.withColumn("price_bucket", F.bround("price", 0).cast("long"))
    return cooldown_stream(d, ["store", "sku", "price_bucket"], ts, row_id, ttl_hours * 3600, lateness=lateness)


def cooldown_bypass_stream(alerts: DataFrame, ts: str, row_id: str, minutes: int = params.COOLDOWN_MINUTES, lateness: str = "1 hour") -> DataFrame:
    return cooldown_stream(alerts, ["store", "sku"], ts, row_id, minutes * 60, "price", lateness)


def best_price_stream(sightings: DataFrame, key: str, ts: str, row_id: str, ttl_seconds: int = params.CROSS_SOURCE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Accepted aggregator sightings; other stores need no state and are to be united by the caller."""
    d = sightings.filter(F.col("store").isin(*params.AGGREGATOR_STORES))
    return cooldown_stream(d, [key], ts, row_id, ttl_seconds, "price", lateness)


def throttle_stream(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, hours: int = params.HISTORY_THROTTLE_HOURS, lateness: str = "1 hour") -> DataFrame:
    return cooldown_stream(rows, keys, ts, row_id, hours * 3600, lateness=lateness)


def budget_stream(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, limits: Sequence[tuple[int, int]], lateness: str = "1 hour") -> DataFrame:
    """Rows admitted under the limits; the state holds the admission times of the longest span."""
    micros = [(s * 1_000_000, n) for s, n in limits]
    longest = max(s for s, _ in micros)
    schema = rows.select(*keys, ts, row_id).schema

    def fold(_key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        policy = Budget(micros)
        policy.reset()
        past = list(state.get[0]) if state.exists else []
        for queue in policy.past:
            queue.extend(past)
        pdf = _sorted(batches, ts, row_id)
        taken = []
        for at in _micros(pdf[ts]):
            taken.append(policy.admit(int(at), 0.0))
            if taken[-1]:
                past.append(int(at))
        newest = int(_micros(pdf[ts]).iloc[-1])
        _keep(state, ([at for at in past if at >= newest - longest],), newest + longest)
        yield pdf.loc[taken, schema.names]

    return (
        rows.select(*schema.names).withWatermark(ts, lateness).groupBy(*keys)
        .applyInPandasWithState(fold, schema, "times array<long>", "append", TIMER)
    )


def changed_stream(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, digest: str, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Rows whose digest is new for the key, differs from the last one, or follows an expired one."""
    ttl = ttl_seconds * 1_000_000
    schema = rows.select(*keys, ts, row_id, digest).schema

    def fold(_key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, None)
        pdf = _sorted(batches, ts, row_id)
        changed = []
        for at, value in zip(_micros(pdf[ts]), pdf[digest]):
            changed.append(not (last == value and at - seen < ttl))
            last, seen = value, int(at)
        _keep(state, (last, seen), seen + ttl)
        yield pdf.loc[changed, schema.names]

    return (
        rows.select(*schema.names).withWatermark(ts, lateness).groupBy(*keys)
        .applyInPandasWithState(fold, schema, "digest string, at long", "append", TIMER)
    )


DROP_SCHEMA = "product_id long, row_id long, fetched_at timestamp, prev_price double, price double, drop_percent double, change_velocity double"


def rapid_drop_stream(observations: DataFrame, hours: int = 24, threshold: float = params.RAPID_DROP_THRESHOLD, lateness: str = "1 hour") -> DataFrame:
    """Drops against the previous price; the state holds the times of the trailing span and the last price.

    Reads ``product_id, row_id, fetched_at, price``.
    """
    rule = DropFold(hours, threshold)

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _sorted(batches, "fetched_at", "row_id")
        at, prices = _micros(pdf["fetched_at"]).tolist(), pdf["price"].astype(float).tolist()
        # rows at one time see each other, as peers of a range frame do
        extras, saved = rule.take(state.get if state.exists else None, [(t, None, p) for t, p in zip(at, prices)])
        _keep(state, saved, rule.until(saved))
        found = [(key[0], i, when, prev, p, drop, rate) for (prev, drop, rate, hit), i, when, p in zip(extras, pdf["row_id"], pdf["fetched_at"], prices) if hit]
        if found:
            yield pd.DataFrame(found, columns=["product_id", "row_id", "fetched_at", "prev_price", "price", "drop_percent", "change_velocity"])

    d = observations.select("product_id", "row_id", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("price").cast("double").alias("price"))
    return (
        d.withWatermark("fetched_at", lateness).groupBy("product_id")
        .applyInPandasWithState(fold, DROP_SCHEMA, "times array<long>, last double", "append", TIMER)
    )


HEALTH_SCHEMA = "store string, total_requests long, successful_requests long, error_rate double, avg_response_ms double, consecutive_failures long"


def store_health_stream(requests: DataFrame, last: int = 100) -> DataFrame:
    """Health of each store after every micro-batch (update mode); the state is a ring of outcomes."""
    def fold(key, batches, state: GroupState):
        total, good, run, oks, durations = state.get if state.exists else (0, 0, 0, [], [])
        pdf = _sorted(batches, "ts", "request_id")
        total += len(pdf)
        good += int(pdf["success"].sum())
        for ok in pdf["success"]:
            run = 0 if ok else run + 1
        oks = (list(oks) + pdf["success"].astype(bool).tolist())[-last:]
        durations = (list(durations) + pdf["duration_ms"].astype(float).tolist())[-last:]
        state.update((total, good, run, oks, durations))
        fine = [d for d, ok in zip(durations, oks) if ok]
        row = (key[0], total, good, 1.0 - sum(oks) / len(oks), sum(fine) / len(fine) if fine else 0.0, run)
        yield pd.DataFrame([row], columns=["store", "total_requests", "successful_requests", "error_rate", "avg_response_ms", "consecutive_failures"])

    return requests.groupBy("store").applyInPandasWithState(
        fold, HEALTH_SCHEMA, "total long, good long, run long, oks array<boolean>, durations array<double>", "update", GroupStateTimeout.NoTimeout
    )


LATENCY_SCHEMA = "{key} string, seen long, samples long, p50 double, p95 double, p99 double, avg_ms double, min_ms double, max_ms double, is_slow boolean"


def latency_percentiles_stream(requests: DataFrame, key: str, last: int = 100, least: int = 5, slow_ms: float = 2000.0) -> DataFrame:
    """Positional percentiles of each key's newest latencies after every micro-batch (update mode).

    The state is the newest ``last`` rows by time and id, so rows that arrive late fall into their place.  ``seen`` counts
    the key's rows so far: its greatest value marks the newest state.
    """
    def fold(group, batches, state: GroupState):
        seen, times, ids, durations = state.get if state.exists else (0, [], [], [])
        pdf = pd.concat(list(batches))
        rows = [*zip(times, ids, durations), *zip(_micros(pdf["ts"]).tolist(), pdf["request_id"].tolist(), pdf["duration_ms"].astype(float).tolist())]
        rows = sorted(rows, key=lambda r: r[:2])[-last:]
        seen += len(pdf)
        state.update((seen, *([r[i] for r in rows] for i in range(3))))
        if len(rows) < least:
            return
        s = sorted(r[2] for r in rows)
        n = len(s)
        p95, p99 = s[int(n * 0.95)] if n > 20 else s[-1], s[int(n * 0.99)] if n > 50 else s[-1]
        yield pd.DataFrame([(group[0], seen, n, s[n // 2], p95, p99, sum(s) / n, s[0], s[-1], p95 > slow_ms)], columns=LATENCY_SCHEMA.format(key=key).replace(",", "").split()[::2])

    slim = requests.select(key, "ts", "request_id", F.col("duration_ms").cast("double").alias("duration_ms"))
    return slim.groupBy(key).applyInPandasWithState(
        fold, LATENCY_SCHEMA.format(key=key), "seen long, times array<long>, ids array<long>, durations array<double>", "update", GroupStateTimeout.NoTimeout
    )
