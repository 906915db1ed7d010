"""Mergeable partial aggregates, one set a micro-batch, their merge, and the wide table from it.

Distinct pairs grow without bound, so they are no streaming state: each micro-batch writes its partials to a
folder of its own (writing a batch again replaces it), and a batch job merges all of them. Every partial is a sum, a
least, a largest or bits that are OR-ed, so batches may come in any order and any division of the log gives the same merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..operators.clean import valid_behaviours
from ..operators.dims import COUNTS, behaviour_counts
from ..sources.scratch import written

PARTS = ("pairs", "days", "items", "categories")


def whole_hours(log: DataFrame) -> DataFrame:
    """``log``, or an error where a time isn't a whole hour: a day's distinct times are kept as 24 bits."""
    whole = F.date_trunc("hour", "time").cast("timestamp_ntz") == F.col("time").cast("timestamp_ntz")
    return log.withColumn("time", F.when(whole, F.col("time")).otherwise(F.raise_error(F.lit("times must be whole hours")).cast(dict(log.dtypes)["time"])))


def pair_partials(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id", "user_id", "item_id").agg(F.min("item_category").alias("item_category"), *behaviour_counts())


def user_partials(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id", "user_id").agg(F.count("*").alias("n_events"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max(F.when(F.col("behavior_type") == 4, F.col("time"))).alias("last_buy_time"))


def day_partials(log: DataFrame) -> DataFrame:
    """A row a user and day: events by part of the day, first and last time, last buy, and a bit for each hour that has an event."""
    hour = F.hour("time")
    part = lambda a, b: F.count_if(hour.between(a, b))
    flag = F.bool_or("is_power_user") if "is_power_user" in log.columns else F.lit(False)
    return log.groupBy("batch_id", "user_id", F.to_date("time").alias("d")).agg(
        F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), hour)).alias("hours"), F.min("time").alias("first"), F.max("time").alias("last"),
        F.max(F.when(F.col("behavior_type") == 4, F.col("time"))).alias("last_buy"), part(6, 17).alias("n_day"), part(18, 23).alias("n_evening"), part(0, 5).alias("n_night"), flag.alias("is_power_user"),
    )


def item_partials(log: DataFrame) -> DataFrame:
    """The heat of each item and day."""
    return log.groupBy("batch_id", "item_id", F.to_date("time").alias("date")).agg(F.sum(features.heat()).alias("heat"))


def category_partials(log: DataFrame) -> DataFrame:
    """Buys of each user and category."""
    return log.where("behavior_type = 4").groupBy("batch_id", "user_id", "item_category").agg(F.count("*").alias("n"))


def merged_pairs(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "item_id").agg(F.min("item_category").alias("item_category"), *(F.sum(c).alias(c) for c in COUNTS.values()))


def merged_users(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(F.sum("n_events").alias("n_events"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.max("last_buy_time").alias("last_buy_time"))


def merged_days(parts: DataFrame) -> DataFrame:
    """The table of users' days that ``dims.user_days`` makes of the whole log."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_day", "n_evening", "n_night")]
    return parts.groupBy("user_id", "d").agg(
        *sums, F.bit_count(F.bit_or("hours")).cast("long").alias("n_times"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("last_buy").alias("last_buy"), F.bool_or("is_power_user").alias("is_power_user")
    )


def merged_items(parts: DataFrame) -> DataFrame:
    return parts.groupBy("item_id", "date").agg(F.sum("heat").alias("heat"))


def merged_categories(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "item_category").agg(F.sum("n").alias("n"))


def users_of(days: DataFrame) -> DataFrame:
    return days.groupBy("user_id").agg(F.sum("n").alias("n_events"), F.min("first").alias("first_time"), F.max("last").alias("last_time"), F.max("last_buy").alias("last_buy_time"))


def batch_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("behavior_type").isin(1, 2, 3, 4)).alias("n_valid"))


def add(raw: DataFrame, batch_id: int, out: str) -> None:
    """Clean a batch of a raw log and write its partials under ``out``; the same batch again replaces them."""
    named = raw.withColumn("batch_id", F.lit(batch_id).cast("long"))
    log = whole_hours(valid_behaviours(named).where("time is not null")).persist()
    for name, make in zip(PARTS, (pair_partials, day_partials, item_partials, category_partials)):
        make(log).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    batch_counts(named).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
    log.unpersist()


def start(spark: SparkSession, source: DataFrame, out: str, checkpoint: str):
    """A query that cleans each micro-batch of a streaming log and writes its partials under ``out``."""
    return source.writeStream.foreachBatch(lambda batch, batch_id: add(batch, batch_id, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finalize(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The merge of all partials (``pairs``, ``days``, ``items``, ``categories`` and ``users``); an error if there are none."""
    try:
        parts = {n: spark.read.parquet(f"{out}/{n}").drop("batch") for n in PARTS}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError("no batch has been added") from e
        raise
    merges = dict(zip(PARTS, (merged_pairs, merged_days, merged_items, merged_categories)))
    merged = {n: merges[n](df) for n, df in parts.items()}
    return merged | {"users": users_of(merged["days"])}


def wide_table(merged: dict[str, DataFrame], columns: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The wide table that ``features.wide_table`` makes of the whole log, from merged partials alone."""
    pair, days = written(merged["pairs"], "pairs"), written(merged["days"], "user_days")
    return features.wide_of(pair, days, merged["items"], columns, targets, merged["categories"])


def hourly_counts(source: DataFrame, late: str = "2 hours") -> DataFrame:
    """Behaviours by hour on a stream, with a watermark; distinct users only roughly."""
    timed = source.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    own = timed.groupBy(F.window("time", "1 hour")).agg(*behaviour_counts(), F.approx_count_distinct("user_id").alias("unique_users"))
    return own.select(F.col("window.start").alias("hour"), *COUNTS.values(), "unique_users")


def exact_hourly(source: DataFrame, late: str = "2 hours") -> DataFrame:
    """Behaviours, distinct users and distinct items by hour on a stream, exactly, once an hour is over by ``late``.

    Two stateful steps: events are summed by hour and user, and by hour and item, and the rows of an hour are counted when the
    watermark closes them. State is one row a user and item of the hours that are open.
    """
    timed = source.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    both = F.explode(F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("item").alias("kind"), F.col("item_id").alias("id"))))
    each = timed.select("time", "behavior_type", both.alias("x")).groupBy(F.window("time", "1 hour").alias("hour"), "x.kind", "x.id").agg(*behaviour_counts())
    total = lambda c: F.sum(F.when(F.col("kind") == "user", F.col(c)).otherwise(0)).alias(c)
    own = each.groupBy(F.window(F.window_time("hour"), "1 hour").alias("w")).agg(*map(total, COUNTS.values()), F.count_if(F.col("kind") == "user").alias("unique_users"), F.count_if(F.col("kind") == "item").alias("unique_items"))
    return own.select(F.col("w.start").alias("start"), *COUNTS.values(), "unique_users", "unique_items")


def stream_hours(source: DataFrame, out: str, checkpoint: str, late: str = "2 hours") -> int:
    """Append the hours that are over to ``out`` until the source has no more; how many sums of late events were left out."""
    query = exact_hourly(source, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
