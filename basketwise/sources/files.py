"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG_SCHEMA = "user_id long, item_id long, item_category int, behavior_type int, time timestamp_ntz"
HOUR = "yyyy-MM-dd HH"


def read_log_csv(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """A raw log with a header; hours that don't parse become null (cleaning removes them)."""
    return spark.read.schema(schema).option("timestampNTZFormat", HOUR).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a scan in the order of its splits, or all, whatever ``n``: counts by split tell which one is cut, and
    rows stay where they lie. ``df`` must give the same splits each time, as scans of files do."""
    placed = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    counts = placed.groupBy("__p").agg(F.count("*").alias("c"))
    upto = counts.select("__p", "c", F.sum("c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    cut = upto.where(F.col("upto") >= n).orderBy("__p").first()  # one row
    if cut is None:
        return df
    inside = F.col("__m") - F.shiftleft("__p", 33) < n - (cut["upto"] - cut["c"])
    return placed.where((F.col("__p") < cut["__p"]) | ((F.col("__p") == cut["__p"]) & inside)).select(*df.columns)


def buckets_for(n: int, rows: int = 500_000, least: int = 8) -> int:
    """So many buckets that ``n`` rows are about ``rows`` a bucket at most: buckets are tasks, and what a task holds doesn't grow
    with the table."""
    return max(least, -(-n // rows))


def bucketed(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` written under ``path`` in buckets of ``key``, sorted by it, and read as a table: groups and joins on the key, and
    on more columns with it, need no exchange, and two tables of as many buckets join where they lie."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str, limit_rows: int | None = None, schema: str | None = None) -> DataFrame:
    """A table by the suffix of its path: .csv, .parquet or .pq; at most ``limit_rows`` of it."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True)
    elif suffix in ("parquet", "pq"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table format: .{suffix}")
    return df if limit_rows is None else first_rows(df, limit_rows)


def iter_batches(df: DataFrame, columns: list[str], limit_rows: int | None = None) -> DataFrame:
    """Projection and row limit of a batched scan; Spark's splits are the batches."""
    df = df.select(*columns)
    return df if limit_rows is None else first_rows(df, limit_rows)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def key_sorted_parquet(df: DataFrame, path: str, *keys: str) -> None:
    """Ranges of keys, sorted within files, so that row-group statistics prune look-ups by key."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_metadata(spark: SparkSession, **values) -> DataFrame:
    """One row of counts, thresholds and times of a run, for ``write.json``."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
