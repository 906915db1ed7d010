"""Labels, time strata and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import ranked


def window_labels(log: DataFrame, days: int = 7) -> DataFrame:
    """Pairs with a view, favourite or cart; label: a buy after the last of these, at most ``days`` later.

    Interval join by key: each pair's buys are aggregated with the range as a condition.
    """
    last = log.where("behavior_type <= 3").groupBy("user_id", "item_id").agg(F.min("item_category").alias("item_category"), F.max("time").alias("last_time"))
    buys = log.where("behavior_type = 4").select("user_id", "item_id", F.col("time").alias("buy_time"))
    hit = (F.col("buy_time") > F.col("last_time")) & (F.col("buy_time") <= F.col("last_time") + F.make_dt_interval(days=F.lit(days)))
    return last.join(buys, ["user_id", "item_id"], "left").groupBy("user_id", "item_id").agg(F.first("item_category").alias("item_category"), F.first("last_time").alias("last_time"), F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("label"))


def colocated_labels(log: DataFrame, days: int = 7) -> DataFrame:
    """As ``window_labels``, for a log in buckets of users: a join on pairs would deal out the buckets again, a window over a
    pair's last time and its times of buys doesn't."""
    kind, pair = F.col("behavior_type"), ("user_id", "item_id")
    seen = kind <= 3
    times = log.where(kind <= 4).groupBy(*pair, F.when(kind == 4, F.col("time")).alias("buy_time")).agg(F.min(F.when(seen, F.col("item_category"))).alias("c"), F.max(F.when(seen, F.col("time"))).alias("t"), F.bool_or(seen).alias("s"))
    own = W.partitionBy(*pair)
    known = times.select(*pair, "buy_time", F.max("c").over(own).alias("item_category"), F.max("t").over(own).alias("last_time"), F.bool_or("s").over(own).alias("s")).where("s")
    hit = (F.col("buy_time") > F.col("last_time")) & (F.col("buy_time") <= F.col("last_time") + F.make_dt_interval(days=F.lit(days)))
    return known.groupBy(*pair).agg(F.first("item_category").alias("item_category"), F.first("last_time").alias("last_time"), F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("label"))


def legacy_labels(pair_paths: DataFrame, log: DataFrame, fallback: str = "2025-12-18") -> DataFrame:
    """Bought at all; last time of any behaviour, a fixed one where there is none."""
    last = log.groupBy("user_id", "item_id").agg(F.max("time").alias("last_time"))
    joined = pair_paths.join(last, ["user_id", "item_id"], "left")
    return joined.select("user_id", "item_id", (F.col("buy_path_type") != 0).cast("int").alias("label"), F.coalesce("last_time", F.lit(fallback).cast("timestamp_ntz")).alias("last_time"))


def with_stratum(df: DataFrame, special: list[str]) -> DataFrame:
    """``date|special, weekend or weekday|night, morning, afternoon or evening``."""
    day, hour = F.to_date("last_time").cast("string"), F.hour("last_time")
    kind = F.when(day.isin(*special) if special else F.lit(False), "special").when(F.weekday("last_time") >= 5, "weekend").otherwise("weekday")
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    return df.withColumn("stratum", F.concat_ws("|", day, kind, part))


def stratified_split(df: DataFrame) -> DataFrame:
    """7:2:1 by time within each stratum. Of one row train, of two train and val; else test and val get a rounded
    tenth and two tenths, at least one row each, train the earliest rest. A stratum of any size is ranked by ranges."""
    df = ranked(df, ["last_time", "user_id", "item_id"], "__i", ("stratum",), "__n")
    test, val = F.greatest(F.lit(1.0), F.rint(F.col("__n") * 0.1)), F.greatest(F.lit(1.0), F.rint(F.col("__n") * 0.2))
    full = test + val >= F.col("__n")
    df = df.withColumns({"__t": F.when(full, 1.0).otherwise(test), "__v": F.when(full, 1.0).otherwise(val)})
    rest = F.col("__n") - F.col("__t") - F.col("__v")
    first = F.when(F.col("__n") == 1, "train").when(F.col("__n") == 2, F.when(F.col("__i") == 1, "train").otherwise("val"))
    split = first.when(F.col("__i") <= rest, "train").when(F.col("__i") <= rest + F.col("__v"), "val").otherwise("test")
    return df.withColumn("split", split).drop("__i", "__n", "__t", "__v")


def global_split(df: DataFrame, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """By time over all rows, at the truncated shares."""
    at = ranked(df, ["last_time", "user_id", "item_id"], size="__n")
    cut = lambda x: F.floor(F.col("__n") * F.lit(x))
    split = F.when(F.col("position") <= cut(train), "train").when(F.col("position") <= cut(train + val), "val").otherwise("test")
    return at.withColumn("split", split).drop("__n", "position")


def tune_split(df: DataFrame, val_share: float = 0.2) -> DataFrame:
    """Within each stratum the latest rounded share is val, at least a row of each; single rows are train."""
    df = ranked(df, ["last_time", "user_id", "item_id"], "__i", ("stratum",), "__n")
    n = F.col("__n")
    cut = F.least(F.greatest(F.rint(n * (1 - val_share)), F.lit(1.0)), n - 1.0)
    return df.withColumn("split", F.when((n < 2) | (F.col("__i") <= cut), "train").otherwise("val")).drop("__i", "__n")
