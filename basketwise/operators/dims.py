"""Dimension tables. What concerns users, items and categories is summed from pairs, one row per (user, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = {1: "pv_count", 2: "fav_count", 3: "cart_count", 4: "buy_count"}


def behaviour_counts() -> list[Column]:
    return [F.count_if(F.col("behavior_type") == k).alias(n) for k, n in COUNTS.items()]


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def pairs(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "item_id").agg(F.min("item_category").alias("item_category"), *behaviour_counts())


def _has(name: str) -> Column:
    return F.col(f"{name}_count") > 0


def _sums() -> list[Column]:
    return [F.sum(n).cast("long").alias(n) for n in COUNTS.values()]


def user_days(log: DataFrame) -> DataFrame:
    """A row for each user and day: counts by part of the day, first, last and distinct times, last buy. All that is known
    of users over time is summed from it."""
    hour = F.hour("time")
    flag = F.bool_or("is_power_user") if "is_power_user" in log.columns else F.lit(False)
    buy = F.max(F.when(F.col("behavior_type") == 4, F.col("time")))
    # times are put together first: counts of distinct ones are then plain counts
    times = log.groupBy("user_id", "time").agg(F.count("*").alias("n"), flag.alias("is_power_user"), buy.alias("last_buy"))
    total = lambda a, b: F.sum(F.when(hour.between(a, b), F.col("n")).otherwise(0))
    return times.groupBy("user_id", F.to_date("time").alias("d")).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_times"), F.min("time").alias("first"), F.max("time").alias("last"), F.max("last_buy").alias("last_buy"),
        total(6, 17).alias("n_day"), total(18, 23).alias("n_evening"), total(0, 5).alias("n_night"), F.bool_or("is_power_user").alias("is_power_user"),
    )


def activity_of(days: DataFrame) -> DataFrame:
    share = lambda part: F.sum(part) / F.sum("n")
    return days.groupBy("user_id").agg(
        F.count("*").alias("active_days"), F.min("first").alias("first_active_time"), F.max("last").alias("last_active_time"),
        share("n_day").alias("day_pct"), share("n_evening").alias("evening_pct"), share("n_night").alias("night_pct"), F.bool_or("is_power_user").alias("is_power_user"),
    )


def user_activity(log: DataFrame) -> DataFrame:
    return activity_of(user_days(log))


def user_funnel(pair: DataFrame) -> DataFrame:
    to_buy = lambda up: rate(F.count_if(_has(up) & _has("buy")), F.count_if(_has(up)))
    return pair.groupBy("user_id").agg(*_sums(), F.count_if(_has("buy")).alias("buy_item_count"), F.count_if(F.col("buy_count") >= 2).alias("repurchase_item_count"), to_buy("pv").alias("view_to_buy_rate"), to_buy("fav").alias("fav_to_buy_rate"), to_buy("cart").alias("cart_to_buy_rate"))


def user_dim(log: DataFrame) -> DataFrame:
    """17 columns a user."""
    return user_funnel(pairs(log)).join(user_activity(log), "user_id")


def item_dim(pair: DataFrame) -> DataFrame:
    """11 columns an item; rates over distinct users."""
    to_buy = lambda up: rate(F.count_if(_has(up) & _has("buy")), F.count_if(_has(up)))
    return pair.groupBy("item_id").agg(F.min("item_category").alias("item_category"), *_sums(), F.count_if(_has("pv")).alias("view_user_count"), F.count_if(_has("buy")).alias("buy_user_count"), F.count_if(F.col("buy_count") >= 2).alias("repurchase_user_count"), to_buy("pv").alias("view_to_buy_rate"), to_buy("cart").alias("cart_to_buy_rate"))


def category_dim(pair: DataFrame) -> DataFrame:
    """11 columns a category; here rates are over items, bought by anyone."""
    items = pair.groupBy("item_category", "item_id").agg(*_sums())
    users = pair.groupBy("item_category", "user_id").agg(F.bool_or(_has("pv")).alias("v"), F.bool_or(_has("buy")).alias("b"))
    by_item = items.groupBy("item_category").agg(F.count("*").alias("item_count"), F.count_if(_has("buy")).alias("buy_item_count"), *_sums(), rate(F.count_if(_has("pv") & _has("buy")), F.count_if(_has("pv"))).alias("pv_to_buy_rate"), rate(F.count_if(_has("buy")), F.count("*")).alias("buy_item_pct"))
    by_user = users.groupBy("item_category").agg(F.count_if("v").alias("view_user_count"), F.count_if("b").alias("buy_user_count"))
    return by_item.join(by_user, "item_category")


def time_dim(log: DataFrame, grain: str) -> DataFrame:
    """Counts and distinct users and items by ``hourly``, ``daily`` or ``weekday_hour`` (Monday is 0)."""
    day, hour = F.to_date("time").alias("date"), F.hour("time").alias("hour")
    keys = {"hourly": [day, hour], "daily": [day], "weekday_hour": [F.weekday("time").alias("weekday"), hour]}[grain]
    return log.groupBy(*keys).agg(*behaviour_counts(), F.count_distinct("user_id").alias("unique_users"), F.count_distinct("item_id").alias("unique_items"))
