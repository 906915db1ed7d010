"""Cleaning of a behaviour log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.logs import REQUIRED
from .ranges import neighbours, quantile_row

TUPLE = ["user_id", "item_id", "behavior_type", "time"]
VALID = (1, 2, 3, 4)


def category_conflicts(log: DataFrame) -> DataFrame:
    """Items with more than one category."""
    return log.groupBy("item_id").agg(F.count_distinct("item_category").alias("n_categories")).where("n_categories > 1")


def check_categories(log: DataFrame) -> DataFrame:
    """``log``, or an error that counts the items in conflict and names ten."""
    bad = [r["item_id"] for r in category_conflicts(log).orderBy("item_id").limit(11).collect()]
    if bad:
        raise ValueError(f"items with several categories, first {bad[:10]}" + " and more" * (len(bad) > 10))
    return log


def essential_fields(log: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(required) - set(log.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return log.select(*required)


def dropped_fields(log: DataFrame, required: list[str] = REQUIRED) -> list[str]:
    return sorted(set(log.columns) - set(required))


def duplicate_stats(log: DataFrame) -> DataFrame:
    """Rows that repeat (user, item, behaviour, time). They are counted; the log keeps them."""
    groups = log.groupBy(*TUPLE).agg(F.count("*").alias("n"))
    return groups.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(n) for n, x in (("total_rows", F.sum("n")), ("distinct_rows", F.count("*")), ("duplicate_rows", F.sum(F.col("n") - 1)), ("max_multiplicity", F.max("n")))))


def valid_behaviours(log: DataFrame) -> DataFrame:
    return log.where(F.col("behavior_type").isin(*VALID))


def parsed_time(text: Column) -> Column:
    """An hour as ``yyyy-MM-dd HH``; what doesn't parse is null."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz")


def standard_time(log: DataFrame, text_col: str = "time") -> DataFrame:
    return log.withColumn("time", parsed_time(F.col(text_col))).where("time is not null")


def outlier_fence(log: DataFrame, method: str = "iqr") -> DataFrame:
    """One row: users, the fence of events a user. ``iqr``: q3 + 1.5 (q3 - q1); ``3sigma``: mean + 3 std."""
    counts = log.groupBy("user_id").agg(F.count("*").alias("n"))
    if method == "iqr":
        q = counts.agg(F.count("*").alias("users")).join(F.broadcast(quantile_row(counts, {"q1": ("n", 0.25), "q3": ("n", 0.75)})))
        return q.select("users", "q1", "q3", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("fence"))
    if method == "3sigma":
        return counts.agg(F.count("*").alias("users"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std")).select("users", "mean", "std", (F.col("mean") + 3 * F.col("std")).alias("fence"))
    raise ValueError(f"unknown method: {method}")


def outlier_users(log: DataFrame, method: str = "iqr") -> DataFrame:
    """Users with strictly more events than the fence."""
    counts = log.groupBy("user_id").agg(F.count("*").alias("n_events"))
    return counts.join(F.broadcast(outlier_fence(log, method).select("fence")), F.col("n_events") > F.col("fence")).select("user_id", "n_events")


def without_outliers(log: DataFrame, method: str = "iqr") -> DataFrame:
    return log.join(outlier_users(log, method), "user_id", "left_anti")


def gap_profile(log: DataFrame, users: DataFrame) -> DataFrame:
    """Per candidate: only views, events, mean and std of the gaps in seconds, distinct hours of the day. Candidates are the
    users of most events: their events are cut into ranges of time, so none of them is one task."""
    own = log.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "behavior_type", "time")
    own = neighbours(own, ["time"], before={"earlier": "time"}, keys=("user_id",))
    gap = F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.col("earlier").cast("timestamp"))
    return own.withColumn("gap", gap).groupBy("user_id").agg((F.max("behavior_type") == 1).alias("only_views"), F.count("*").alias("n_events"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("std_gap"), F.count_distinct(F.hour("time")).alias("n_hours"))


def crawlers(log: DataFrame, users: DataFrame, cv: float = 0.5, hours: int = 20) -> DataFrame:
    """Candidates that only view, at even gaps, all round the clock. With two events the spread is unknown and
    doesn't speak against it."""
    even = F.coalesce(F.col("std_gap") / F.col("mean_gap") < cv, F.lit(True))
    rule = F.col("only_views") & (F.col("n_events") >= 2) & (F.col("mean_gap") > 0) & (F.col("n_hours") >= hours)
    return gap_profile(log, users).where(rule).where(even).select("user_id")


def flagged_outliers(log: DataFrame, method: str = "iqr") -> DataFrame:
    """The log without crawlers; other outliers are ``is_power_user``."""
    out = outlier_users(log, method)
    kept = log.join(crawlers(log, out), "user_id", "left_anti")
    return kept.join(out.select("user_id", F.lit(True).alias("is_power_user")), "user_id", "left").withColumn("is_power_user", F.coalesce("is_power_user", F.lit(False)))


def cleaning_stats(raw: DataFrame, time_text: str = "time_text") -> DataFrame:
    """Counts after each step, in one pass (duplicates are kept)."""
    ok = F.coalesce(F.col("behavior_type").isin(*VALID), F.lit(False))
    timed = parsed_time(F.col(time_text)).isNotNull()
    return raw.agg(F.count("*").alias("original_count"), F.count("*").alias("after_dedup"), F.count_if(ok).alias("after_behavior"), F.count_if(ok & timed).alias("after_time"), F.count_if(ok & timed).alias("final_count"))
