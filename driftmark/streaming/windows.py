"""Windowed aggregates and stateless steps on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftmark.operators import monitor
from driftmark.sources import tablesync


def with_event_time(df: DataFrame, ts: str, lateness: str = "1 hour") -> DataFrame:
    """The event time as a timestamp with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def metric_increase_stream(events: DataFrame, ts: str, labels, length: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    return monitor.metric_increase(with_event_time(events, ts, lateness), ts, labels, length, slide)


def success_ratio_stream(requests: DataFrame, length: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    return monitor.success_ratio(with_event_time(requests, "ts", lateness), length)


def duration_quantiles_stream(requests: DataFrame, length: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    return monitor.duration_quantiles(with_event_time(requests, "ts", lateness), length)


def velocity_stream(observations: DataFrame, key: str, ts: str, price: str, most: int = 3, lateness: str = "1 hour") -> DataFrame:
    """Keys and ten-minute windows, sliding by one minute, with more than ``most`` distinct prices."""
    d = with_event_time(observations, ts, lateness)
    d = d.groupBy(F.window(ts, "10 minutes", "1 minute").alias("w"), key).agg(F.size(F.collect_set(price)).alias("distinct_prices"))
    return d.filter(F.col("distinct_prices") > most).select(F.col("w.end").alias("window_end"), key, "distinct_prices")


def signal_dedupe_stream(signals: DataFrame, lateness: str = "12 hours") -> DataFrame:
    """First signal per retailer, product, whole dollar and type within the watermark."""
    d = with_event_time(signals, "detected_at", lateness).withColumn("price_bucket", F.floor("detected_price"))
    return d.dropDuplicatesWithinWatermark(["retailer", "product_id", "price_bucket", "signal_type"])


def append_observations_stream(observations: DataFrame, path: str, checkpoint: str, ts: str = "fetched_at"):
    """Starts the append of observations to a parquet table partitioned by day."""
    d = observations.withColumn("dt", F.to_date(ts))
    return (
        d.writeStream.format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def upsert_products_stream(incoming: DataFrame, read_products, write_products, checkpoint: str):
    """Starts an upsert per micro-batch; ``read_products`` and ``write_products`` give and take the table."""
    def step(batch: DataFrame, batch_id: int) -> None:
        latest = batch.dropDuplicates(["store", "sku"])
        write_products(tablesync.product_upsert(read_products(), latest).drop("is_new"), batch_id)

    return incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
