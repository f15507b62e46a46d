"""Adapters from the given tables to the shapes the operators work on.

The operators themselves take any DataFrame with the columns listed in ``schemas``; this module
only says how the test tables play those roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftmark import params
from driftmark.functions.numbers import MONEY


def pick(names: tuple[str, ...], index) -> F.Column:
    """Element of a fixed list of names by a zero-based index column."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


class Tables:
    """Lazy views over one folder of parquet tables."""

    # total order of observations: newest first
    NEWEST = ("fetched_at", "order_id", "line_no", "supp_id", "ext_price", "qty")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.schemas: dict = {}

    def raw(self, name: str) -> DataFrame:
        """One table; its schema is read from the file once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def products(self) -> DataFrame:
        p = self.raw("part")
        key = F.col("p_partkey")
        return p.select(
            key.alias("product_id"),
            F.concat(F.lit("P"), key.cast("string")).alias("sku"),
            F.col("p_name").alias("market_key"),
            pick(params.TEST_STORES, key % len(params.TEST_STORES)).alias("store"),
            F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"), F.lit("inch")).alias("title"),
            F.col("p_retailprice").cast(MONEY).alias("msrp"),
            pick(params.TEST_CATEGORIES, F.col("p_size") % len(params.TEST_CATEGORIES)).alias("category"),
            F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("url"),
        )

    def observations(self) -> DataFrame:
        p = self.raw("part").select(
            F.col("p_partkey"), F.col("p_retailprice").cast(MONEY).alias("original_price")
        )
        glitch = F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), F.lit("0.1").cast("decimal(2,1)")
        ).otherwise(F.lit("1.0").cast("decimal(2,1)"))
        keep = F.lit("1").cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
        return (
            self.raw("lineitem")
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_partkey").alias("product_id"),
                F.round(F.col("original_price") * keep * glitch, 2).cast(MONEY).alias("price"),
                "original_price",
                F.when(F.col("l_linestatus") == "O", "in_stock").otherwise("out_of_stock").alias("availability"),
                (F.lit(1.0) - F.col("l_tax")).alias("confidence"),
                F.col("l_shipdate").alias("fetched_at"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_suppkey").alias("supp_id"),
                F.col("l_extendedprice").alias("ext_price"),
                F.col("l_quantity").alias("qty"),
            )
        )

    def as_of(self) -> F.Column:
        """The newest observation time, as a scalar subquery."""
        return self.raw("lineitem").agg(F.max("l_shipdate")).scalar()

    def newest(self) -> DataFrame:
        """Newest observation per product; the maximum of a struct combines before the shuffle."""
        o = self.observations()
        top = F.max(F.struct(*self.NEWEST, "price", "original_price", "availability", "confidence"))
        return o.groupBy("product_id").agg(top.alias("n")).select("product_id", "n.*")

    def current_prices(self) -> DataFrame:
        return self.newest().select(
            "product_id",
            F.col("price").alias("current_price"),
            F.col("original_price").alias("current_original"),
            F.col("availability").alias("current_availability"),
            F.col("confidence").alias("current_confidence"),
            F.col("fetched_at").alias("current_at"),
        )

    def history(self) -> DataFrame:
        """All observations older than the newest one of their product."""
        key = F.struct(*self.NEWEST)
        newest = self.newest().select("product_id", key.alias("newest_key"))
        return self.observations().join(newest, "product_id").filter(key < F.col("newest_key")).drop("newest_key")

    def listings(self) -> DataFrame:
        return self.current_prices().join(self.products(), "product_id").select(
            "product_id", "sku", "title", "url", "current_price",
            F.col("current_original").alias("original_price"), "msrp", "store", "category",
            F.col("current_availability").alias("availability"),
            F.col("current_confidence").alias("confidence"),
            F.col("current_at").alias("seen_at"),
        )

    def signals(self) -> DataFrame:
        e = self.raw("events")
        retailer = pick(params.TEST_STORES, F.col("user_id") % len(params.TEST_STORES))
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("signal_id"),
            retailer.alias("retailer"),
            F.concat(retailer, F.lit(":"), F.col("user_id").cast("string")).alias("product_id"),
            F.col("value").cast(MONEY).alias("detected_price"),
            F.col("ts").alias("detected_at"),
            F.when(F.col("event_type") == "purchase", "clearance")
            .when(F.col("event_type") == "click", "new_low")
            .otherwise(F.col("event_type")).alias("signal_type"),
            F.concat(
                F.lit('{"baseline_price": '), (k * 5).cast("string"),
                F.lit(', "price_change_count_24h": '), (k % 4).cast("string"), F.lit("}"),
            ).alias("metadata"),
        )

    def requests(self) -> DataFrame:
        err = F.col("event_type") == "error"
        return self.raw("events").select(
            F.col("event_id").alias("request_id"),
            pick(params.TEST_STORES, F.col("user_id") % len(params.TEST_STORES)).alias("store"),
            F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".example")).alias("domain"),
            F.col("user_id").alias("source_id"),
            (~err).alias("success"),
            (F.col("value") * 100).alias("duration_ms"),
            F.when(err & (F.col("value") > 100), 429).when(err, 503).otherwise(200).alias("status_code"),
            F.col("ts"),
        )

    def alerts(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("alert_id"),
            F.col("o_custkey").alias("product_id"),
            (F.lit(1) + F.col("o_orderkey") % 5).cast("int").alias("rule_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("triggered_price"),
            F.col("o_orderdate").alias("sent_at"),
            F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("false_positive_count"),
        )

    def subscriptions(self) -> DataFrame:
        k = F.col("n_nationkey")
        n = len(params.TEST_STORES)
        stores = F.when(k % 3 == 0, F.lit("[]")).otherwise(
            F.concat(
                F.lit('["'), pick(params.TEST_STORES, k % n), F.lit('","'),
                pick(params.TEST_STORES, (k + 7) % n), F.lit('"]'),
            )
        )
        cats = F.when(k % 4 == 0, F.lit('["electronics","tv"]')).when(k % 4 == 1, F.lit('["home"]')).otherwise(F.lit("[]"))
        body = F.concat(
            F.lit('{"min_discount": '), (k * 2).cast("string"), F.lit(', "min_confidence": '),
            (k % 5).cast("string"), F.lit('e-1, "stores": '), stores, F.lit(', "categories": '), cats, F.lit("}"),
        )
        return self.raw("nation").select(
            k.alias("webhook_id"),
            F.when(k % 11 == 10, F.lit("{not json")).otherwise(body).alias("filters"),
            (k % 6 != 5).alias("enabled"),
        )

    def embeddings(self) -> DataFrame:
        e = self.raw("embeddings")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        # the norm is repeated beside the entries: within the function of an entry it would be summed once per dimension
        unit = F.zip_with("v", F.array_repeat(norm, F.size("v")), lambda x, n: x / n)
        return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).select(
            F.col("vec_id").alias("product_id"), F.col("label").alias("store"), unit.alias("embedding")
        )
