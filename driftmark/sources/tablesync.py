"""Writing back: appends, upserts, pruning and alert documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftmark import params
from driftmark.functions.numbers import MONEY


def append_observations(observations: DataFrame, path: str, ts: str = "fetched_at", unit: str = "DAY") -> None:
    """Appends to a parquet table partitioned by day, or by the first day of each ``unit``.

    One shuffle brings a day together; adaptive execution splits a large day and joins small ones, so that days get
    few files and no day is bound to a fixed number of tasks.
    """
    d = observations.withColumn("dt", F.to_date(F.date_trunc(unit, F.col(ts)))).hint("rebalance", F.col("dt"))
    d.write.mode("append").partitionBy("dt").parquet(path)


def product_upsert(products: DataFrame, incoming: DataFrame, keys=("store", "sku"), fill=("url", "title", "msrp")) -> DataFrame:
    """New products are added; known ones get values only where they had none."""
    def empty(c: Column, kind: str) -> Column:
        return F.nullif(c, F.lit("")) if kind == "string" else F.nullif(c, F.lit(0).cast(kind))

    kinds = dict(products.dtypes)
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fill]).withColumn("_in", F.lit(True))
    both = products.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    filled = {c: F.coalesce(empty(F.col(c), kinds[c]), F.col(f"new_{c}"), F.col(c)) for c in fill}
    return both.withColumns(filled).withColumn("is_new", F.col("_old").isNull()).drop(*[f"new_{c}" for c in fill], "_in", "_old")


def discovered_deals(products: DataFrame, deals: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Products to add for deals of unknown products, and the first observation of each."""
    fresh = deals.join(products.select("store", "sku"), ["store", "sku"], "left_anti").dropDuplicates(["store", "sku"])
    added = fresh.select(
        "store", "sku", "title", "url", F.coalesce(F.nullif("original_price", F.lit(0).cast(MONEY)), F.col("msrp")).alias("msrp"),
        F.col("current_price").alias("baseline_price"),
    )
    first = fresh.select("store", "sku", F.col("current_price").alias("price"), "original_price", "confidence", at.alias("fetched_at"))
    return added, first


def baseline_cache_merge(cache: DataFrame, fresh: DataFrame, key: str = "product_id") -> DataFrame:
    """Fresh aggregates with ``change`` telling created from updated rows."""
    old = cache.select(key).distinct().withColumn("_known", F.lit(True))
    d = fresh.join(old, key, "left")
    return d.withColumn("change", F.when(F.col("_known").isNull(), "created").otherwise("updated")).drop("_known")


def _partitions(spark: SparkSession, path: str) -> tuple:
    """File system and the partition folders (name, folder) of a table; none if the table does not exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return files, []
    return files, [(x.getPath().getName(), x.getPath()) for x in files.listStatus(root) if x.isDirectory() and "=" in x.getPath().getName()]


def write_baseline_cache(fresh: DataFrame, path: str, key: str = "product_id", buckets: int = 64) -> None:
    """Merges fresh aggregates into a parquet table partitioned by a bucket of the key.

    Fresh rows replace those of their keys, ``change`` tells created from updated ones, and other rows stay.  Only the
    buckets that fresh rows fall into are read and written again (dynamic partition overwrite, committed as a whole);
    all others keep their files.
    """
    spark = fresh.sparkSession
    new = fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    _, parts = _partitions(spark, path)
    if parts:
        old = spark.read.parquet(path)
        touched = old.join(new.select("bucket").distinct(), "bucket", "left_semi")
        rest = touched.join(new.select(key), key, "left_anti")
        new = baseline_cache_merge(touched, new, key).select(*old.columns).unionByName(rest.select(*old.columns))
    else:
        new = new.withColumn("change", F.lit("created"))
    new.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def prune_table(spark: SparkSession, path: str, cut, ts: str = "fetched_at", unit: str = "DAY") -> list[str]:
    """Takes rows before ``cut`` (a datetime) out of a table that ``append_observations`` wrote by ``unit``.

    Partitions that end before the cut are dropped without being read; the one the cut falls into is written again
    with the rows to keep; later ones are not touched.  Returns the names of dropped partitions.
    """
    files, parts = _partitions(spark, path)
    if not parts:
        return []
    table = spark.read.parquet(path)
    since = F.lit(cut.isoformat(" ")).cast(table.schema[ts].dataType)
    edge = spark.range(1).select(F.to_date(F.date_trunc(unit, since)).cast("string")).first()[0]
    dropped = [(name, folder) for name, folder in parts if name.startswith("dt=") and name[3:] < edge]
    if any(name == f"dt={edge}" for name, _ in parts):
        kept = table.filter((F.col("dt") == F.lit(edge).cast("date")) & (F.col(ts) >= since))
        if kept.isEmpty():
            dropped += [(name, folder) for name, folder in parts if name == f"dt={edge}"]
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    for _, folder in dropped:
        files.delete(folder, True)
    return sorted(name for name, _ in dropped)


def prune(rows: DataFrame, ts: str, as_of: Column, days: int = params.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """The rows to keep, and one row with the count of expired ones.

    On a table partitioned by day the cut prunes partitions.
    """
    cut = as_of - F.make_dt_interval(F.lit(days))
    return rows.filter(F.col(ts) >= cut), rows.filter(F.col(ts) < cut).agg(F.count("*").alias("expired"))


# Colours of an alert by discount.
def severity_color(percent: Column) -> Column:
    return F.when(percent >= 70, 0xFF0000).when(percent >= 50, 0x00FF00).otherwise(0xFFA500)


def alert_payload(deals: DataFrame, template: str = "template") -> DataFrame:
    """Adds the JSON document of an alert; an object given as template replaces its top-level keys.

    Values of the template may be of any JSON kind and stay what they are; a template that is not an object is left out.
    """
    deal = F.struct(
        "discount_percent", "confidence", "detection_method", "is_price_error", "reason", "category", "signals",
        F.col("baseline_price").cast("double").alias("baseline_price"), "baseline_source",
    )
    product = F.struct(
        "sku", "store", "title", "url", F.col("current_price").cast("double").alias("current_price"),
        F.col("original_price").cast("double").alias("original_price"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    base = F.create_map(
        F.lit("type"), F.parse_json(F.lit('"price_alert"')), F.lit("timestamp"), F.parse_json(F.concat(F.lit('"'), F.col("sent_at").cast("string"), F.lit('"'))),
        F.lit("deal"), F.parse_json(F.to_json(deal, keep_nulls)), F.lit("product"), F.parse_json(F.to_json(product, keep_nulls)),
    )
    is_object = F.schema_of_variant(F.try_parse_json(template)).startswith("OBJECT")
    own = F.when(is_object, F.from_json(template, "map<string,variant>"))
    over = F.map_filter(F.coalesce(own, F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, v: F.length(k) > 0)
    plain = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    payload = F.to_json(F.map_concat(plain, over))
    return deals.withColumn("payload", payload).withColumn("color", severity_color(F.col("discount_percent")))
