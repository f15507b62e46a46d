"""Tables that are merged into and pruned: what is written again and what keeps its files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from driftmark.sources import tablesync as Y


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cache_is_merged_by_bucket(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = spark.range(1000).select(F.col("id").alias("product_id"), F.lit(1.0).alias("current_baseline"))
    Y.write_baseline_cache(first, path, buckets=16)
    before = files(path)
    assert len({os.path.dirname(f) for f in before}) == 16
    fresh = spark.createDataFrame([(7, 2.0), (5000, 3.0)], "product_id long, current_baseline double")
    touched = {r[0] for r in fresh.select(F.pmod(F.xxhash64("product_id"), F.lit(16))).collect()}
    Y.write_baseline_cache(fresh, path, buckets=16)
    after = files(path)
    assert {os.path.basename(os.path.dirname(f)) for f in before ^ after} == {f"bucket={b}" for b in touched}
    got = spark.read.parquet(path)
    want = [(i, 1.0, "created") for i in range(1000) if i != 7] + [(7, 2.0, "updated"), (5000, 3.0, "created")]
    assert rows(got, "product_id", "current_baseline", "change") == sorted(want)
    Y.write_baseline_cache(fresh.limit(0), path, buckets=16)
    assert files(path) == after


@pytest.mark.parametrize("unit, days", [("DAY", 30), ("MONTH", 200)])
def test_pruning_drops_partitions(spark, tmp_path, unit, days):
    path = str(tmp_path / "observations")
    start = dt.datetime(2024, 1, 1)
    made = [(i, start + dt.timedelta(hours=i * days * 24 / 500)) for i in range(500)]
    df = spark.createDataFrame(made, "id long, fetched_at timestamp").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    made = [(r.id, r.fetched_at) for r in df.collect()]
    Y.append_observations(df, path, unit=unit)
    before = files(path)
    cut = made[260][1] + dt.timedelta(minutes=1)
    dropped = Y.prune_table(spark, path, cut, unit=unit)
    assert rows(spark.read.parquet(path), "id") == [(i,) for i, at in made if at >= cut]
    assert len(dropped) > 2 and not any(os.path.exists(f"{path}/{name}") for name in dropped)
    edge = f"dt={cut.date() if unit == 'DAY' else cut.date().replace(day=1)}"
    later = {f for f in before if os.path.basename(os.path.dirname(f)) > edge}
    assert later and later <= files(path)
    assert Y.prune_table(spark, path, cut, unit=unit) == []
    Y.prune_table(spark, path, made[-1][1] + dt.timedelta(days=400), unit=unit)
    assert not files(path)
    assert Y.prune_table(spark, str(tmp_path / "none"), cut) == []
