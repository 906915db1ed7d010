"""Behaviour logs drawn from the events and order tables.

Columns: event_id, user_id, item_id, item_category, behavior_type (1 view, 2 favourite, 3 cart, 4 buy), time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .scratch import own_dir

REQUIRED = ["user_id", "item_id", "item_category", "behavior_type", "time"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _behaviour():
    kind = F.col("event_type")
    return F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 3).when(kind == "purchase", 4).otherwise(5)


def log_raw(spark: SparkSession, sf_dir: str, items: int = 20, categories: int = 5, unit: str = "hour", user: str = "value") -> DataFrame:
    """Events as a log; behaviour 5 stands for what isn't one of the four."""
    k = F.get_json_object("props", "$.k").cast("int")
    who = F.floor("value") if user == "value" else F.col(user)
    return _table(spark, sf_dir, "events").select(
        "event_id", who.cast("long").alias("user_id"), (k % items).cast("long").alias("item_id"), (k % items % categories).alias("item_category"), _behaviour().alias("behavior_type"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("time")
    )


def log_h(spark, sf_dir):
    """Skewed users, hours, the four behaviours."""
    return log_raw(spark, sf_dir).where(F.col("behavior_type").isin(1, 2, 3, 4))


def log_d(spark, sf_dir):
    """As ``log_h`` with times cut to days, so that rows repeat."""
    return log_raw(spark, sf_dir, unit="day").where(F.col("behavior_type").isin(1, 2, 3, 4))


def log_u(spark, sf_dir):
    """Even users, a hundred items."""
    return log_raw(spark, sf_dir, items=100, user="user_id").where(F.col("behavior_type").isin(1, 2, 3, 4))


def log_c(spark, sf_dir):
    """Items with several categories."""
    return log_h(spark, sf_dir).withColumn("item_category", (F.col("item_category") + F.pmod("user_id", F.lit(2))).cast("int"))


def log_o(spark, sf_dir, parts: int | None = None):
    """Volume: a behaviour for each order line. ``parts``: lines meet orders, and items too large to broadcast, in so many partitions."""
    dealt = lambda df, key: df.repartition(parts, key) if parts else df
    lines = dealt(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = dealt(_table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").cast("int").alias("item_category")), "p_partkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(items, F.col("l_partkey") == F.col("p_partkey"))
    return df.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "item_category", ((F.col("l_linenumber") - 1) % 4 + 1).alias("behavior_type"), F.col("l_shipdate").cast("timestamp_ntz").alias("time")
    )


def log_o_by_user(spark, sf_dir, *without: str, rows: int = 500_000):
    """``log_o``, but for the columns ``without``, written once in buckets of users of about ``rows`` events: its joins run once, and
    what is computed by user needs no exchange. An event is an order line, so lines tell how many there are."""
    buckets = files.buckets_for(_table(spark, sf_dir, "lineitem").count(), rows)
    many = buckets > int(spark.conf.get("spark.sql.shuffle.partitions"))  # else the session's own are enough
    return files.bucketed(log_o(spark, sf_dir, buckets if many else None).drop(*without), "user_id", buckets, f"{own_dir(spark)}/bucketed-{uuid.uuid4().hex}")
