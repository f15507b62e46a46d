"""Streams in event-time order: equal to the batch twins over shuffled, overlapping files; late rows set apart."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmark.operators import anomaly, dedupe as G, matching as M, monitor
from driftmark.streaming import ordered as O, stateful as S

LATENESS, JITTER = "5 days", 4 * 86400


def write_files(df, ts, row_id, root, files=6):
    """Files by time of arrival: up to four days after the event, so neighbouring files overlap; rows shuffled."""
    arrival = F.col(ts).cast("double") + F.pmod(F.xxhash64(row_id, F.lit("j")), F.lit(JITTER))
    d = df.withColumn("_arrival", arrival)
    lo, hi = d.agg(F.min("_arrival"), F.max("_arrival")).first()
    part = F.least(F.floor((F.col("_arrival") - lo) / ((hi - lo) / files)), F.lit(files - 1))
    for i in range(files):
        d.filter(part == i).orderBy(F.xxhash64(row_id)).drop("_arrival").coalesce(1).write.mode("append").parquet(root)


@pytest.fixture(scope="module")
def signals(spark, tables):
    s = tables.signals().withColumn("store", F.col("retailer")).withColumn("sku", F.col("product_id")).withColumn("price", F.col("detected_price"))
    s = s.withColumn("item", F.concat(F.lit("i"), (F.split("sku", ":")[1].cast("long") % 7).cast("string"))).withColumn("at", F.col("detected_at").cast("timestamp"))
    return s.withColumn("detected_at", F.col("at")).withColumn("digest", F.floor(F.col("price") / 200).cast("string")).cache()


@pytest.fixture(scope="module")
def feed(spark, signals, tmp_path_factory):
    """Overlapping files, then one row far ahead that lets the watermark pass all, then one behind it."""
    root = str(tmp_path_factory.mktemp("ordered") / "in")
    write_files(signals, "at", "signal_id", root)
    top = signals.agg(F.max("at")).first()[0]
    one = signals.limit(1)

    def alone(i, at):
        return one.withColumns({"signal_id": F.lit(i).cast("long"), "at": F.lit(at), "detected_at": F.lit(at), "store": F.lit("zz"), "sku": F.lit("zz"), "item": F.lit("zz"), "retailer": F.lit("zz"), "product_id": F.lit("zz")})

    for i, at in ((-1, top + dt.timedelta(days=400)), (-2, top - dt.timedelta(days=1))):
        alone(i, at).select(signals.columns).coalesce(1).write.mode("append").parquet(root)
    return root


def stream(spark, root):
    return spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 1).parquet(root)


def drained(spark, df, tmp_path, name="out"):
    path = str(tmp_path / name)
    O.start_split(df, path, path + "-c").awaitTermination()
    return O.judged(spark, path), O.late_rows(spark, path)


def ids(df, column="signal_id"):
    return sorted(r[0] for r in df.select(column).collect())


def same_as_batch(spark, live, batch, tmp_path, everything=True):
    good, late = drained(spark, live, tmp_path)
    assert ids(late) == [-2]
    assert ids(good.filter("accepted")) == ids(batch.filter("accepted"))
    if everything:
        assert ids(good) == ids(batch)


def test_alert_dedupe(spark, signals, feed, tmp_path):
    same_as_batch(spark, O.alert_dedupe(stream(spark, feed), "at", "signal_id", lateness=LATENESS), G.alert_dedupe(signals, "at", "signal_id"), tmp_path)


def test_cooldown_bypass(spark, signals, feed, tmp_path):
    same_as_batch(spark, O.cooldown_bypass(stream(spark, feed), "at", "signal_id", 2880, LATENESS), G.cooldown_bypass(signals, "at", "signal_id", 2880), tmp_path)


def test_best_price(spark, signals, feed, tmp_path):
    from driftmark import params

    shops = F.col("store").isin(*params.AGGREGATOR_STORES)
    s = stream(spark, feed).withColumn("store", F.when(F.col("store") == "zz", params.AGGREGATOR_STORES[0]).otherwise(F.col("store")))
    batch = G.best_price_across_sources(signals, "item", "at", "signal_id", 86400).filter(shops)
    same_as_batch(spark, O.best_price(s, "item", "at", "signal_id", 86400, LATENESS), batch, tmp_path)


def test_budget(spark, signals, feed, tmp_path):
    limits = [(86400, 2), (7 * 86400, 9)]
    same_as_batch(spark, O.budget(stream(spark, feed), ["store"], "at", "signal_id", limits, LATENESS), G.trailing_budget(signals, ["store"], "at", "signal_id", limits), tmp_path)


def test_throttle(spark, signals, feed, tmp_path):
    same_as_batch(spark, O.throttle(stream(spark, feed), ["sku"], "at", "signal_id", 48, LATENESS), G.throttle(signals, ["sku"], "at", "signal_id", 48), tmp_path)


def test_changed(spark, signals, feed, tmp_path):
    good, late = drained(spark, O.changed(stream(spark, feed), ["sku"], "at", "signal_id", "digest", 5 * 86400, LATENESS), tmp_path)
    want, last = [], {}
    for r in sorted(signals.select("sku", "at", "signal_id", "digest").collect(), key=lambda r: (r["sku"], r["at"], r["signal_id"])):
        seen = last.get(r["sku"])
        if not (seen and seen[0] == r["digest"] and (r["at"] - seen[1]).total_seconds() < 5 * 86400):
            want.append(r["signal_id"])
        last[r["sku"]] = (r["digest"], r["at"])
    assert ids(good.filter("accepted")) == sorted(want) and ids(late) == [-2]


def test_rapid_drop(spark, signals, feed, tmp_path):
    def shape(d):
        return d.select(F.coalesce(F.get(F.split("sku", ":"), F.lit(1)), F.lit("0")).cast("long").alias("product_id"), F.col("signal_id").alias("row_id"), F.col("at").alias("fetched_at"), "price")

    good, late = drained(spark, O.rapid_drop(shape(stream(spark, feed)), 240, lateness=LATENESS), tmp_path)
    batch = anomaly.rapid_drop(shape(signals), ["fetched_at", "row_id"], hours=240)
    assert ids(good.filter("accepted"), "row_id") == ids(batch, "row_id") != []
    assert ids(late, "row_id") == [-2]


def test_recent_signals(spark, signals, feed, tmp_path):
    """The self anti join of the batch, on fewer keys so that signals meet."""
    def few(d):
        return d.withColumn("product_id", F.col("retailer"))

    batch = G.recent_signal_antijoin(few(signals), few(signals), ttl_hours=240, same_batch=True)
    good, late = drained(spark, O.recent_signals(few(stream(spark, feed)), 240, LATENESS), tmp_path)
    assert ids(good.filter("accepted")) == ids(batch)
    assert ids(good) == ids(signals) and ids(late) == [-2]
    assert 0 < len(ids(batch)) < signals.count()


@pytest.mark.parametrize("level", [0.26, 0.33])
def test_semantic_dedupe(spark, tables, tmp_path, level):
    e = tables.embeddings()
    a = tables.alerts().withColumn("sent_at", F.col("sent_at").cast("timestamp")).select("alert_id", "product_id", "sent_at")
    a = a.join(e.select("product_id", "embedding"), "product_id", "left")
    edges = M.match_edges(M.knn(e, e, 10_000, level))
    batch = M.semantic_duplicates(a, edges, 240)
    root = str(tmp_path / "in")
    write_files(a, "sent_at", "alert_id", root, 4)
    top = a.agg(F.max("sent_at")).first()[0]
    end = a.filter("embedding is not null").limit(1).withColumn("alert_id", F.lit(-1).cast("long"))
    end.withColumn("sent_at", F.lit(top + dt.timedelta(days=400))).select(a.columns).coalesce(1).write.mode("append").parquet(root)
    good, late = drained(spark, O.semantic_dedupe(stream(spark, root), level, 240, LATENESS), tmp_path)
    assert ids(good.filter("accepted"), "alert_id") == ids(batch, "alert_id")
    assert ids(good, "alert_id") == ids(a, "alert_id") and late.count() == 0
    assert 0 < batch.count() < a.count()


def test_buckets_hold_every_similar_pair(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "id long, v array<double>")
    for level in (0.8, 0.95):
        d = O.angle_buckets(df, "v", level).collect()
        own = {r.id: r.bucket for r in d if r.own}
        held = {}
        for r in d:
            held.setdefault(r.bucket, set()).add(r.id)
        assert own[900] is None and own[901] is None and len(own) == len(x) + 2
        for i, j in zip(*np.nonzero(x @ x.T >= level)):
            assert i in held[own[j]]


def test_latency_percentiles(spark, tables, tmp_path):
    r = tables.requests().withColumn("ts", F.col("ts").cast("timestamp")).select("request_id", "domain", "duration_ms", "ts")
    root = str(tmp_path / "in")
    write_files(r, "ts", "request_id", root, 4)
    live = S.latency_percentiles_stream(stream(spark, root), "domain")
    q = live.writeStream.format("memory").queryName("latency_live").option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("latency_live").groupBy("domain").agg(F.max_by(F.struct("samples", "p50", "p95", "p99", "avg_ms", "min_ms", "max_ms", "is_slow"), "seen").alias("s")).select("domain", "s.*")
    batch = monitor.latency_percentiles(r, "domain")

    def plain(d):
        return {x.domain: (x.samples, x.p50, x.p95, x.p99, round(x.avg_ms, 6), x.min_ms, x.max_ms, x.is_slow) for x in d.collect()}

    assert plain(last) == plain(batch) != {}


# --- processors on their own, with states and timers in plain dictionaries

class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Rows(Value):
    def get(self):
        return iter(self.v or [])

    def appendList(self, rows):
        self.v = (self.v or []) + list(rows)

    put = Value.update


class Map(dict):
    containsKey = dict.__contains__
    getValue = dict.get

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Rows()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def driven(processor, key, batches, lateness_ms):
    """Rows (columns of the processor) through micro-batches; yields outputs, and the processor after each batch."""
    handle = Handle()
    processor.init(handle)
    watermark, out = 0, []
    for rows in batches:
        frame = pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(processor.columns, zip(*rows))})
        out += list(processor.handleInputRows(key, iter([frame]), Clock(watermark)))
        due = sorted(t for t in handle.timers if t <= watermark)
        for t in due:
            handle.timers.discard(t)
            out += list(processor.handleExpiredTimer(key, Clock(watermark), Clock(t)))
        watermark = max(watermark, max(r[0] for r in rows) // 1000 - lateness_ms)
    return pd.concat(out), processor


def test_state_of_signals_is_bounded():
    rng = random.Random(5)
    hour = 3_600_000_000
    rows = sorted((rng.randrange(2000 * hour), i, rng.randrange(3000)) for i in range(4000))
    span = 12 * hour
    want = {n[1] for n in rows if not any(o[0] < n[0] and n[0] - o[0] <= span and abs(o[2] - n[2]) <= 100 for o in rows)}
    arrived = sorted(rows, key=lambda r: r[0] + rng.randrange(5 * hour))
    batches = [arrived[i:i + 40] for i in range(0, len(arrived), 40)] + [[(5000 * hour, -1, 5)], [(6000 * hour, -2, 5)], [(7000 * hour, -3, 5)]]
    cells = O.CellRelease(12 * 3600, 1, [O.AT, "id", "cents"], None, ["accepted"], (True,))
    sizes = []
    fold = cells.fold
    cells.fold = lambda key, released: (sizes.append(sum(len(v[0]) for _, v in cells.cells.iterator())), fold(key, released))[1]
    out, _ = driven(cells, ("k",), batches, 5 * 3_600_000)
    assert not out["late"].any()
    assert {i for i, ok in zip(out["id"], out["accepted"]) if ok and i >= 0} == want
    assert sorted(i for i in out["id"] if i >= 0) == list(range(4000))
    live = max(sum(1 for r in rows if at - 60 * hour <= r[0] <= at) for at in range(0, 2000 * hour, 10 * hour))
    assert max(sizes) <= live < 400
    assert sum(len(v[0]) for _, v in cells.cells.iterator()) <= 2  # only the last rows are left


def test_state_of_vectors_is_let_go():
    rng = random.Random(7)
    hour = 3_600_000_000
    vectors = np.random.default_rng(2).normal(size=(200, 3))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = sorted((rng.randrange(3000 * hour), i, p := rng.randrange(200), vectors[p].tolist(), True) for i in range(1500))
    want = {n[1] for n in rows if not any(o[0] < n[0] and n[0] - o[0] < 12 * hour and o[2] != n[2] and np.dot(o[3], n[3]) >= 0.9 for o in rows)}
    batches = [rows[i:i + 30] for i in range(0, 1500, 30)] + [[(k * 1000 * hour, -k, 0, vectors[0].tolist(), True)] for k in (5, 6, 7)]
    release = O.VectorRelease(0.9, 12 * 3600, 1, [O.AT, "id", "product", "v", "own"], None, ["accepted"], (True,))
    out, _ = driven(release, (1,), batches, 3_600_000)
    assert {i for i, ok in zip(out["id"], out["accepted"]) if ok and i >= 0} == want
    assert len(release.held) <= 1


def test_late_and_untimed_rows():
    fold = O.CooldownFold(3600, False)
    release = O.ValueRelease(fold, 1, [O.AT, "id"], None, ["accepted"], fold.untimed)
    minute = 60_000_000
    batches = [[(600 * minute, 1)], [(560 * minute, 2), (620 * minute, 3)], [(500 * minute, 4), (2000 * minute, 5)], [(3000 * minute, 6)], [(4000 * minute, 7)]]
    out, _ = driven(release, ("k",), batches, 60 * 60_000)
    got = {r.id: (r.accepted, r.late) for r in out.itertuples()}
    assert got == {2: (True, False), 1: (False, False), 3: (True, False), 4: (None, True), 5: (True, False)}
    handle = Handle()
    release.init(handle)
    frame = pd.DataFrame({O.AT: pd.Series([None], dtype=object), "id": [9]})
    assert [(r.id, r.accepted, r.late) for d in release.handleInputRows(("k",), iter([frame]), Clock(10**6)) for r in d.itertuples()] == [(9, True, False)]
