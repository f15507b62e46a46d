"""Suppression of repeated alerts and signals, and admission under a budget.

Whether a row is let through depends on which earlier rows of its key were.  A quiet time as long as
the TTL resets that dependence, so a key is cut into runs at its quiet times.  A run that goes on for
long is cut again into time slices: each slice is first summed up as a function from the state it is
entered with to the state it is left with, the short summaries are walked slice by slice, and then all
slices are folded at once, each from its known state.  The folds see rows that Spark has shuffled and
sorted and keep only the last accepted row, never a run.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from driftmark import params
from driftmark.operators import predicates as P, skew

RUN = "_run"
FOLD_COLUMNS = "_key string, _id long, _at long, _price double, accepted boolean"


def _runs(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, ttl_seconds: int, unit: str) -> DataFrame:
    """Adds the number of quiet times of at least the TTL before each row of its key."""
    d = skew.sliced_lag(df, keys, [ts, row_id], [ts], unit)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))
    quiet = F.coalesce(gap >= ttl_seconds * 1_000_000, F.lit(True)).cast("int")
    return skew.sliced_sum(d.withColumn("_quiet", quiet), keys, [ts, row_id], F.col("_quiet"), unit, RUN).drop("_quiet", f"prev_{ts}")


class Cooldown:
    """Accepts the first row, rows a TTL after the last accepted one, and, if asked, cheaper rows."""

    def __init__(self, ttl_micros: int, cheaper_passes: bool):
        self.ttl = ttl_micros
        self.cheaper = cheaper_passes

    def reset(self) -> None:
        self.at: int | None = None
        self.price = 0.0

    def admit(self, at: int, price: float) -> bool:
        if self.at is None or at - self.at >= self.ttl or (self.cheaper and price < self.price):
            self.at, self.price = at, price
            return True
        return False


class Budget:
    """Accepts while fewer than the limit were accepted within each trailing span."""

    def __init__(self, limits: Sequence[tuple[int, int]]):
        self.limits = limits  # (span in microseconds, most rows)

    def reset(self) -> None:
        self.past = [deque() for _ in self.limits]

    def admit(self, at: int, price: float) -> bool:
        for queue, (span, _) in zip(self.past, self.limits):
            while queue and queue[0] < at - span:
                queue.popleft()
        if any(len(queue) >= most for queue, (_, most) in zip(self.past, self.limits)):
            return False
        for queue in self.past:
            queue.append(at)
        return True


SLICES_PER_TTL = 16
ENTRY, STEP, RECORD = 0, 1, 2
SUMMARY_COLUMNS = f"_key string, {RUN} long, _slice long, kind int, at long, price double, exit_at long, exit_price double"
STATE_COLUMNS = f"_key string, {RUN} long, _slice long, in_at long, in_price double"


def _fold(make: Callable[[], Cooldown]):
    """Runs a policy over sorted rows, batch by batch, starting anew with every key, run and slice.

    A row without an id carries the state its slice is entered with.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy, current = make(), None
        for batch in batches:
            verdicts = []
            groups = zip(batch["_key"], batch[RUN], batch["_slice"])
            for group, at, price, entry in zip(groups, batch["_at"], batch["_price"], batch["_entry"]):
                if group != current:
                    current = group
                    policy.reset()
                if entry:
                    policy.at, policy.price = at, price
                    verdicts.append(False)
                else:
                    verdicts.append(policy.admit(at, price))
            yield batch.assign(accepted=verdicts).loc[~batch["_entry"], ["_key", "_id", "_at", "_price", "accepted"]]

    return run


def slice_summary(at: np.ndarray, price: np.ndarray, start: int, ttl: int, cheaper: bool) -> list[tuple]:
    """What a slice does to a state: a step function of time, and the records of falling prices.

    Entered with the last acceptance (t, p), the slice's first acceptance is its first row at or after
    t + ttl, or its first row below p if that comes earlier.  From there on the chain is fixed, so each
    such row leads to one last acceptance.
    """
    n = len(at)
    nxt = np.searchsorted(at, at + ttl)
    if cheaper:
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            while stack and price[stack[-1]] >= price[i]:
                stack.pop()
            if stack:
                nxt[i] = min(nxt[i], stack[-1])
            stack.append(i)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    reach = min(n, int(np.searchsorted(at, start + ttl)) + 1)
    rows = [(ENTRY, int(at[0]), float(price[0]), int(at[last[0]]), float(price[last[0]]))]
    for i in range(reach):
        if i + 1 == reach or last[i] != last[i + 1]:
            rows.append((STEP, int(at[i]), 0.0, int(at[last[i]]), float(price[last[i]])))
    if cheaper:
        lowest = np.inf
        for i in range(reach):
            if price[i] < lowest:
                lowest = price[i]
                rows.append((RECORD, int(at[i]), float(price[i]), int(at[last[i]]), float(price[last[i]])))
    return rows


def _summaries(ttl: int, cheaper: bool, span: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_id"])
        rows = slice_summary(pdf["_at"].to_numpy(), pdf["_price"].to_numpy(), int(key[2]) * span, ttl, cheaper)
        return pd.DataFrame([tuple(key) + r for r in rows], columns=["_key", RUN, "_slice", "kind", "at", "price", "exit_at", "exit_price"])

    return run


def _walk(ttl: int):
    """Entry state of every slice but the first of its run, from the summaries in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, state, here, steps, records = None, None, None, [], []

        def passed(t: int, p: float) -> tuple[int, float]:
            """State after the slice just read, entered with (t, p)."""
            record = next((r for r in records if r[1] < p), None)
            if record and record[0] < t + ttl:
                return record[2:]
            step = next((s for s in steps if s[0] >= t + ttl), None)
            return step[2:] if step else (t, p)

        for batch in batches:
            out = []
            for key, runs, piece, kind, at, price, exit_at, exit_price in batch.itertuples(index=False):
                if (key, runs, piece) != here:
                    if (key, runs) != chain:
                        # entries sort first, and the first slice of a run starts with its first row
                        chain, state = (key, runs), (exit_at, exit_price)
                        steps, records = [], []
                        first = piece
                    else:
                        state = passed(*state)
                        steps, records = [], []
                        out.append((key, runs, piece, *state))
                    here = (key, runs, piece)
                if piece != first and kind != ENTRY:
                    (steps if kind == STEP else records).append((at, price, exit_at, exit_price))
            yield pd.DataFrame(out, columns=["_key", RUN, "_slice", "in_at", "in_price"])

    return run


def key_text(keys: Sequence[str]) -> Column:
    """The key as one text; nulls have a mark of their own, so (null, a) and (a, null) differ."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])


def ordered_fold(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, quiet_seconds: int, make, price: str | None = None,
    unit: str = "DAY", slice_seconds: int | None = None,
) -> DataFrame:
    """Adds ``accepted`` by folding a policy over each key's rows in time order.

    Only the key, time, price and id travel to Python; the verdict is joined back by ``row_id``.  A null key is a
    key like others.  A row without a time cannot be put in order: it is accepted and suppresses nothing.
    """
    policy = make()
    slim = df.filter(F.col(ts).isNotNull()).select(*keys, ts, row_id, *([price] if price else []))
    # of rows with one key, time and price only the first can be accepted: copies combine here
    slim = slim.groupBy(*keys, ts, *([price] if price else [])).agg(F.min(row_id).alias(row_id))
    runs = _runs(slim, keys, ts, row_id, quiet_seconds, unit)
    span = (slice_seconds or quiet_seconds * SLICES_PER_TTL) * 1_000_000
    rows = runs.select(
        key_text(keys).alias("_key"), RUN,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(row_id).alias("_id"),
        (F.col(price).cast("double") if price else F.lit(0.0)).alias("_price"),
    ).withColumn("_slice", F.floor(F.col("_at") / span))
    group = ["_key", RUN, "_slice"]
    extent = rows.groupBy("_key", RUN).agg(F.min("_slice").alias("lo"), F.max("_slice").alias("hi")).filter("hi > lo")
    long_runs = rows.join(extent.select("_key", RUN), ["_key", RUN], "left_semi")
    sums = long_runs.groupBy(*group).applyInPandas(_summaries(policy.ttl, policy.cheaper, span), SUMMARY_COLUMNS)
    walked = sums.repartition("_key", RUN).sortWithinPartitions(*group, "kind", "at").mapInPandas(_walk(policy.ttl), STATE_COLUMNS)
    entries = walked.select("_key", RUN, F.col("in_at").alias("_at"), F.lit(None).cast("long").alias("_id"), F.col("in_price").alias("_price"), "_slice", F.lit(True).alias("_entry"))
    placed = rows.withColumn("_entry", F.lit(False)).unionByName(entries)
    placed = placed.repartition("_key", RUN, "_slice").sortWithinPartitions("_key", RUN, "_slice", F.desc("_entry"), "_at", "_id")
    verdicts = placed.mapInPandas(_fold(make), FOLD_COLUMNS)
    judged = df.join(verdicts.select(F.col("_id").alias(row_id), "accepted"), row_id, "left")
    return judged.withColumn("accepted", F.coalesce("accepted", F.col(ts).isNull()))


def alert_dedupe(alerts: DataFrame, ts: str, row_id: str, ttl_hours: int = params.DEDUPE_TTL_HOURS) -> DataFrame:
    """One alert per store, SKU and dollar within the TTL of the last one let through.

    The dollar is rounded half to even.
    """
    span = ttl_hours * 3600
    d = alerts.withColumn("price_bucket", F.bround("price", 0).cast("long"))
    return ordered_fold(d, ["store", "sku", "price_bucket"], ts, row_id, span, lambda: Cooldown(span * 1_000_000, False))


def cooldown_bypass(alerts: DataFrame, ts: str, row_id: str, minutes: int = params.COOLDOWN_MINUTES) -> DataFrame:
    """A cooldown per product that a price below the last alert's passes."""
    span = minutes * 60
    return ordered_fold(alerts, ["store", "sku"], ts, row_id, span, lambda: Cooldown(span * 1_000_000, True), "price")


def best_price_across_sources(
    sightings: DataFrame, key: str, ts: str, row_id: str, ttl_seconds: int = params.CROSS_SOURCE_TTL_SECONDS
) -> DataFrame:
    """Aggregator sightings pass when first within the TTL or strictly cheaper; other stores always."""
    from_aggregator = F.col("store").isin(*params.AGGREGATOR_STORES)
    judged = ordered_fold(
        sightings.filter(from_aggregator), [key], ts, row_id, ttl_seconds,
        lambda: Cooldown(ttl_seconds * 1_000_000, True), "price",
    )
    rest = sightings.filter(~from_aggregator).withColumn("accepted", F.lit(True))
    return judged.unionByName(rest)


def best_known_price(accepted: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest accepted sighting per key: its store and price."""
    top = F.max(F.struct(ts, "row_id", "store", "price")).alias("t")
    return accepted.filter("accepted").groupBy(key).agg(top).select(key, "t.store", "t.price", F.col(f"t.{ts}").alias("seen_at"))


def throttle(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, hours: int = params.HISTORY_THROTTLE_HOURS, unit: str = "DAY") -> DataFrame:
    """At most one row per key within each stretch of hours since the last one kept."""
    span = hours * 3600
    return ordered_fold(rows, keys, ts, row_id, span, lambda: Cooldown(span * 1_000_000, False), unit=unit)


QUEUE_COLUMNS = "_key string, _slice long, _queue array<long>"


def admitted(at: np.ndarray, queue: Sequence[int], limits: Sequence[tuple[int, int]]) -> list[int]:
    """Which of a slice's rows (times, sorted) are admitted, given the times admitted before it.

    The slice is no longer than any span, so what it admits stays counted to its end and only entries of ``queue``
    make room: the j-th admission waits until, for each limit, enough of the last ones have left the span.  It is the
    first row behind both the admission before it and the latest of these times.
    """
    out: list[int] = []
    held = [(list(queue[-most:]), span, most) for span, most in limits]
    after = -1
    while True:
        here = after + 1
        for last, span, most in held:
            leave = len(out) + 1 - (most - len(last))  # so many must have left
            if leave > len(last):
                return out
            if leave > 0:
                here = max(here, int(np.searchsorted(at, last[leave - 1] + span, "right")))
        if here >= len(at):
            return out
        out.append(here)
        after = here


def _queues(limits: Sequence[tuple[int, int]]):
    """Times admitted before each slice, from the slices' times in order: one bounded queue a key."""
    longest, most = max(s for s, _ in limits), max(n for _, n in limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, queue = None, []
        for batch in batches:
            out = []
            for key, piece, times in zip(batch["_key"], batch["_slice"], batch["_times"]):
                if key != current:
                    current, queue = key, []
                queue = [t for t in queue if t >= times[0] - longest][-most:]
                out.append((key, piece, queue))
                queue = queue + [int(times[i]) for i in admitted(times, queue, limits)]
            yield pd.DataFrame(out, columns=["_key", "_slice", "_queue"])

    return run


def _admissions(limits: Sequence[tuple[int, int]]):
    """Verdicts of slices; rows come sorted, each slice led by a row with its queue."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, queue, ats, row_ids = None, [], [], []

        def judged() -> pd.DataFrame:
            taken = np.zeros(len(ats), bool)
            taken[admitted(np.array(ats, np.int64), queue, limits)] = True
            return pd.DataFrame({"_id": row_ids, "accepted": taken})

        for batch in batches:
            for key, piece, at, row_id, own in zip(*[batch[c] for c in ("_key", "_slice", "_at", "_id", "_queue")]):
                if (key, piece) != current:
                    if ats:
                        yield judged()
                    current, queue, ats, row_ids = (key, piece), [int(t) for t in own], [], []
                else:
                    ats.append(at)
                    row_ids.append(row_id)
        if ats:
            yield judged()

    return run


def trailing_budget(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, limits: Sequence[tuple[int, int]], slices_per_span: int = 16) -> DataFrame:
    """Admission under limits given as (span in seconds, most rows), counted over admitted rows.

    A key is cut into time slices shorter than the shortest span.  What a slice admits follows from its times and the
    queue of earlier admissions by a few binary searches (``admitted``), so the slices of a key are first reduced to
    their times, of which equal ones count no more often than a limit can admit them; one pass over these hands the
    queue from slice to slice; then all slices are judged at once in many tasks.  The pass is the only step that sees a
    whole key, as arrays of numbers.  Null keys are keys like others; rows without a time are admitted.
    """
    micros = [(s * 1_000_000, n) for s, n in limits]
    span = max(1, min(s for s, _ in micros) // slices_per_span)
    most = max(n for _, n in micros)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = rows.filter(F.col(ts).isNotNull()).select(key_text(keys).alias("_key"), F.floor(at / span).alias("_slice"), at.alias("_at"), F.col(row_id).alias("_id"))
    counted = slim.groupBy("_key", "_slice", "_at").agg(F.count("*").alias("n"))
    times = counted.groupBy("_key", "_slice").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", F.least("n", F.lit(most)).cast("int").alias("n")))), lambda x: F.array_repeat(x["_at"], x["n"])
    )).alias("_times"))
    queues = times.repartition("_key").sortWithinPartitions("_key", "_slice").mapInPandas(_queues(micros), QUEUE_COLUMNS)
    nothing = F.lit(None).cast("long")
    leads = queues.select("_key", "_slice", nothing.alias("_at"), F.lit(None).cast(slim.schema["_id"].dataType).alias("_id"), "_queue")
    both = slim.withColumn("_queue", F.lit(None).cast("array<long>")).unionByName(leads)
    placed = both.repartition("_key", "_slice").sortWithinPartitions("_key", "_slice", F.col("_at").asc_nulls_first(), "_id")
    verdicts = placed.mapInPandas(_admissions(micros), f"_id {slim.schema['_id'].dataType.simpleString()}, accepted boolean")
    judged = rows.join(verdicts.withColumnRenamed("_id", row_id), row_id, "left")
    return judged.withColumn("accepted", F.coalesce("accepted", F.col(ts).isNull()))


def tumbling_budget(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, limit: int) -> DataFrame:
    """The first ``limit`` rows per key and clock hour.

    Spark cuts every map task's share to the limit before the shuffle.
    """
    hour = F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz")
    d = rows.withColumn("hour", hour)
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "hour").orderBy(ts, row_id)
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def first_per(rows: DataFrame, keys: Sequence[Column], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row per key; the minimum of a struct combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *keep)).alias("f")).select("f.*")


def signal_dedupe(signals: DataFrame) -> DataFrame:
    """First signal per retailer, product, whole-dollar price and type."""
    dollar = F.floor("detected_price").alias("price_bucket")
    keys = [F.col("retailer"), F.col("product_id"), dollar, F.col("signal_type")]
    rest = ["retailer", "product_id", "detected_price", "signal_type", "metadata"]
    return first_per(signals, keys, ["detected_at", "signal_id"], rest)


def _dollar_neighbours(price: str) -> Column:
    b = F.floor(price)
    return F.explode(F.array(b - 1, b, b + 1))


def recent_signal_antijoin(
    new: DataFrame, stored: DataFrame, ttl_hours: int = params.DEDUPE_TTL_HOURS, same_batch: bool = False
) -> DataFrame:
    """New signals without a stored one of the same retailer, product and type within a dollar and the TTL.

    The ranges become equi keys: the dollar and its neighbours, the TTL slice and the one before.
    """
    span = ttl_hours * 3600 * 1_000_000

    def at(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    old = stored.select(
        F.col("signal_id").alias("o_id"), F.col("retailer").alias("o_retailer"), F.col("product_id").alias("o_product"),
        F.col("signal_type").alias("o_type"), F.col("detected_price").alias("o_price"), at("detected_at").alias("o_at"),
    ).withColumn("o_slice", F.floor(F.col("o_at") / span)).withColumn("o_dollar", F.floor("o_price"))
    probe = new.select(
        "signal_id", "retailer", "product_id", "signal_type", "detected_price", at("detected_at").alias("at"),
        _dollar_neighbours("detected_price").alias("dollar"),
    ).withColumn("slice", F.floor(F.col("at") / span))
    probe = probe.withColumn("slice", F.explode(F.array("slice", F.col("slice") - 1)))
    earlier = F.col("o_at") < F.col("at") if same_batch else F.col("o_at") <= F.col("at")
    hit = (
        (F.col("retailer") == F.col("o_retailer")) & (F.col("product_id") == F.col("o_product")) & (F.col("signal_type") == F.col("o_type"))
        & (F.col("dollar") == F.col("o_dollar")) & (F.col("slice") == F.col("o_slice"))
        & (F.abs(F.col("o_price") - F.col("detected_price")) <= 1) & earlier & (F.col("at") - F.col("o_at") <= span)
    )
    seen = probe.join(old, hit, "left_semi").select("signal_id").distinct()
    return new.join(seen, "signal_id", "left_anti")


ACTIVE = ("pending", "scanning_datacenter", "scanning_residential")


def active_candidate_antijoin(signals: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals without an active candidate of the product whose own signal lies within a dollar."""
    live = candidates.filter(F.col("status").isin(*ACTIVE)).join(
        sources.select(F.col("signal_id").alias("source_signal_id"), F.col("detected_price").alias("c_price")), "source_signal_id"
    ).select(F.col("retailer").alias("c_retailer"), F.col("product_id").alias("c_product"), "c_price", F.floor("c_price").alias("c_dollar")).distinct()
    probe = signals.select("signal_id", "retailer", "product_id", "detected_price", _dollar_neighbours("detected_price").alias("dollar"))
    hit = (
        (F.col("retailer") == F.col("c_retailer")) & (F.col("product_id") == F.col("c_product"))
        & (F.col("dollar") == F.col("c_dollar")) & (F.abs(F.col("c_price") - F.col("detected_price")) <= 1)
    )
    taken = probe.join(live, hit, "left_semi").select("signal_id").distinct()
    return signals.join(taken, "signal_id", "left_anti")


def candidate_priority(signals: DataFrame) -> DataFrame:
    """Adds ``priority_score`` from price, implied discount, repricing, value and signal type."""
    meta = F.from_json("metadata", "baseline_price double, msrp double, price_change_count_24h int")
    price = F.col("detected_price").cast("double")
    base = F.coalesce(F.nullif(meta["baseline_price"], F.lit(0.0)), meta["msrp"])
    off = F.when(base > 0, (F.lit(1.0) - price / base) * 100)
    score = (
        F.when(price <= 1, 10.0).otherwise(0.0)
        + F.when(off >= 70, 8.0).when(off >= 50, 5.0).otherwise(0.0)
        + F.when(meta["price_change_count_24h"] >= 2, 5.0).otherwise(0.0)
        + F.when(price >= 200, 3.0).otherwise(0.0)
        + F.when(F.lower("signal_type").isin("new_low", "clearance"), 2.0).otherwise(0.0)
    )
    return signals.withColumn("priority_score", score)


def next_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    pending = candidates.filter(F.col("status") == "pending")
    return pending.orderBy(F.desc("priority_score"), "created_at", "candidate_id").limit(k)


# Error texts that call for a second look.
ERROR_TOKENS = ("403", "429", "503", "captcha", "blocked", "cloudflare", "timeout")


def escalation(d: DataFrame, score_threshold: float = 0.7) -> DataFrame:
    """Adds ``escalate`` and the first reason for it.

    Reads ``error, price_confidence, triggered, detection_confidence, current_price, msrp,
    priority_score``.
    """
    price, msrp = F.col("current_price").cast("double"), F.col("msrp").cast("double")
    off = F.when(msrp > 0, (F.lit(1.0) - price / msrp) * 100)
    hit = F.coalesce(F.col("triggered"), F.lit(False))
    why = (
        F.when(F.lower("error").rlike("|".join(ERROR_TOKENS)), "error")
        .when(F.col("price_confidence") < 0.75, "low_confidence")
        .when(hit & (F.col("detection_confidence") >= score_threshold), "high_score")
        .when(hit & (F.col("detection_confidence") < 0.9), "unsure")
        .when(hit & (price > 0) & (price <= 1), "penny")
        .when(hit & (off >= 70), "deep_discount")
        .when(F.col("priority_score") >= 10, "priority")
    )
    return d.withColumn("escalation_reason", why).withColumn("escalate", F.col("escalation_reason").isNotNull())


def candidate_outcome(evidence: DataFrame) -> DataFrame:
    """Final status of each candidate from its one or two passes.

    ``evidence`` has one row per pass: ``candidate_id, scan_pass, price, triggered, error, escalate,
    budget_ok``.  The second pass counts when it found a price.
    """
    def of(name: str, col: str) -> Column:
        return F.max(F.when(F.col("scan_pass") == name, F.col(col)))

    d = evidence.groupBy("candidate_id").agg(
        of("datacenter", "price").alias("p1"), of("datacenter", "triggered").alias("t1"), of("datacenter", "escalate").alias("escalate"),
        of("datacenter", "budget_ok").alias("budget_ok"), of("residential", "price").alias("p2"), of("residential", "triggered").alias("t2"),
    )
    second = F.col("escalate") & F.col("budget_ok") & F.col("p2").isNotNull()
    hit = F.when(second, F.col("t2")).otherwise(F.col("t1"))
    status = (
        F.when(F.col("escalate") & ~F.col("budget_ok"), "pending").when(F.coalesce(hit, F.lit(False)), "verified").otherwise("rejected")
    )
    return d.select(
        "candidate_id", F.when(second, F.col("p2")).otherwise(F.col("p1")).alias("price"),
        F.when(second, "residential").otherwise("datacenter").alias("final_pass"), status.alias("status"),
    )


FILTER_SCHEMA = "min_discount double, stores array<string>, categories array<string>, min_confidence double"


BAND_PERCENT = 6.25
NO_CATEGORY = "\u0001none"


def _subscription_index(subscriptions: DataFrame) -> DataFrame:
    """Enabled subscriptions filed by store (or ``*``), a gram of each category, and the bands their discount allows.

    A subscription without categories is filed under the empty gram; one with categories also where deals without a
    category look.
    """
    subs = subscriptions.filter("enabled").select("webhook_id", F.from_json("filters", FILTER_SCHEMA).alias("f"))
    stores, wanted = F.col("f.stores"), F.transform("f.categories", lambda c: F.lower(c))
    any_store = F.coalesce(F.size(stores), F.lit(0)) <= 0
    any_category = F.coalesce(F.size(wanted), F.lit(0)) <= 0
    subs = subs.select(
        "webhook_id", F.coalesce("f.min_discount", F.lit(0.0)).alias("s_discount"), F.coalesce("f.min_confidence", F.lit(0.0)).alias("s_confidence"),
        F.when(~any_category, wanted).alias("s_categories"), F.when(any_store, F.array(F.lit("*"))).otherwise(F.array_distinct(stores)).alias("s_routes"),
    ).withColumn("s_row", F.struct("webhook_id", "s_discount", "s_confidence", "s_categories", "s_routes"))
    named = subs.select("s_row", F.posexplode("s_categories").alias("s_place", "needle")).filter(F.col("needle").isNotNull())
    by_gram = P.filed(named, "needle", ["s_row", "s_place"])
    plain = subs.select("s_row", F.lit(0).alias("s_place"), F.lit(None).cast("string").alias("needle"), F.explode(
        F.when(F.col("s_categories").isNull(), F.array(F.lit(""), F.lit(NO_CATEGORY))).otherwise(F.array(F.lit(NO_CATEGORY)))
    ).alias("gram"))
    index = by_gram.unionByName(plain).select("s_row.*", "s_place", "needle", F.col("gram").alias("s_gram"))
    index = index.withColumn("s_route", F.explode("s_routes"))
    return index.withColumn("s_node", F.explode(P.nodes_from(P.band(F.col("s_discount"), BAND_PERCENT)))).drop("s_routes")


def _looked_up(d: DataFrame) -> DataFrame:
    """Where a (store, lower-case category, band) looks: its store and the star, its grams, the nodes above its band."""
    d = d.withColumn("gram", F.explode(F.when(F.col("low").isNull(), F.array(F.lit(NO_CATEGORY))).otherwise(P.grams(F.col("low")))))
    d = d.withColumn("route", F.explode(F.array(F.lit("*"), F.col("store"))))
    return d.withColumn("node", F.explode(P.nodes_above(F.col("band"))))


def subscriber_fanout(deals: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deals per enabled subscription whose filters they pass; malformed filters match everything.

    Subscriptions are an index (``_subscription_index``), so the work follows the matches.  In a batch each distinct
    (store, category, discount band) looks up its candidates once; a streaming deal looks them up itself.  Candidates
    are tested; of a subscription's categories the first that the deal's holds counts, so no pair comes twice.
    """
    low = F.lower("category")
    named = deals.withColumns({"low": low, "band": P.band(F.col("discount_percent"), BAND_PERCENT)}).filter(F.col("discount_percent").isNotNull())
    index = _subscription_index(subscriptions)
    met = (F.col("route") == F.col("s_route")) & (F.col("gram") == F.col("s_gram")) & (F.col("node") == F.col("s_node"))
    earlier = F.exists(F.slice("s_categories", 1, F.col("s_place")), lambda c: F.coalesce(F.contains("low", c), F.lit(False)))
    in_category = F.col("needle").isNull() | (F.contains("low", F.col("needle")) & ~F.coalesce(earlier, F.lit(False)))
    passes = (F.col("discount_percent") >= F.col("s_discount")) & (F.col("confidence") >= F.col("s_confidence"))
    side = ["webhook_id", "s_discount", "s_confidence"]
    if deals.isStreaming:
        return _looked_up(named).join(index, met).filter(in_category & passes).select(*deals.columns, "webhook_id")
    kinds = named.select("store", "low", "band").distinct()
    found = _looked_up(kinds).join(index, met).filter(in_category).select(F.col("store").alias("c_store"), F.col("low").alias("c_low"), F.col("band").alias("c_band"), *side)
    same = F.col("store").eqNullSafe(F.col("c_store")) & F.col("low").eqNullSafe(F.col("c_low")) & (F.col("band") == F.col("c_band"))
    return named.join(found, same & passes).select(*deals.columns, "webhook_id")


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("webhook_id").agg(
        F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max(F.when(F.col("status") == "sent", F.col("sent_at"))).alias("last_sent_at"), F.count("*").alias("total"),
        (F.count_if(F.col("status") != "failed") / F.count("*")).alias("success_rate"),
    )


def run_summary(signals: DataFrame, candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signals taken in, candidates made, processed and verified, in one row."""
    def tally(df: DataFrame, name: str, cond: Column | None = None) -> DataFrame:
        return df.select(F.lit(name).alias("what"), (F.lit(1) if cond is None else cond.cast("int")).alias("n"))

    rows = (
        tally(signals, "signals_ingested").unionByName(tally(candidates, "candidates_created"))
        .unionByName(tally(outcomes, "candidates_processed", F.col("status") != "pending"))
        .unionByName(tally(outcomes, "verified_deals", F.col("status") == "verified"))
    )
    names = ("signals_ingested", "candidates_created", "candidates_processed", "verified_deals")
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
