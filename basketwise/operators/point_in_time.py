"""Features of pairs as of a day, from events of earlier days only, and target rates that leave out a row's own fold.

What a sample may know are sums up to a day. Counts are sums of daily counts; a count of different items or users is a sum too, as
each pair is counted on the day on which it is first seen. So everything is one table of running sums by key and day, and a
sample finds the last row before its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dims import COUNTS, behaviour_counts, rate


def pair_days(log: DataFrame) -> DataFrame:
    """``(user_id, item_id, d)`` with counts by behaviour and the day's last time: all that follows is summed from it."""
    return log.groupBy("user_id", "item_id", F.to_date("time").alias("d")).agg(*behaviour_counts(), F.max("time").alias("last"))


def first_days(days: DataFrame) -> DataFrame:
    """Per pair the first day of a view, and that from which it is both viewed and bought."""
    first = lambda c: F.min(F.when(F.col(c) > 0, F.col("d")))
    own = days.groupBy("user_id", "item_id").agg(first("pv_count").alias("viewed"), first("buy_count").alias("bought"))
    both = F.when(F.col("viewed").isNotNull() & F.col("bought").isNotNull(), F.greatest("viewed", "bought"))
    return own.select("user_id", "item_id", "viewed", both.alias("both"))


def daily(days: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """Sums of a user's or item's day: counts, one for the day, its last time, pairs seen first, pairs bought first."""
    counts = days.groupBy(key, "d").agg(*(F.sum(c).alias(c) for c in COUNTS.values()), F.max("last").alias("last")).withColumn("active_days", F.lit(1).cast("long"))
    seen = firsts.select(key, F.explode(F.array(F.struct(F.col("viewed").alias("d"), F.lit(1).alias("v"), F.lit(0).alias("b")), F.struct(F.col("both").alias("d"), F.lit(0).alias("v"), F.lit(1).alias("b")))).alias("x")).select(key, "x.*").where("d is not null")
    seen = seen.groupBy(key, "d").agg(F.sum("v").alias("n_viewed"), F.sum("b").alias("n_bought"))
    return counts.join(seen, [key, "d"], "full")


def cumulative(table: DataFrame, keys: list[str], sums: list[str], latest: list[str] = ()) -> DataFrame:
    """Sums and latest values of each key up to each of its days, the day included. A key has a row a day at most."""
    w = W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return table.select(*keys, "d", *(F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(c) for c in sums), *(F.max(c).over(w).alias(c) for c in latest))


def before(points: DataFrame, sums: DataFrame, keys: list[str], day: str = "as_of") -> DataFrame:
    """``points`` with the columns of the last row of ``sums`` on an earlier day of the same key, null where there is none.

    Keys and days of the points are made distinct first and merged with the sums by day, so what meets in a window are days
    of a key, however many points share it; the points then join them by key and day.
    """
    values = [c for c in sums.columns if c not in (*keys, "d")]
    asked = points.select(*keys, F.col(day).alias("d")).distinct()
    marks = asked.withColumn("is_sum", F.lit(0)).unionByName(sums.withColumn("is_sum", F.lit(1)), allowMissingColumns=True)
    # on the same day points stand before sums: that day isn't known yet
    w = W.partitionBy(*keys).orderBy("d", "is_sum").rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(F.col("is_sum") == 1, F.struct(*values)), ignorenulls=True).over(w)
    found = marks.withColumn("x", held).where("is_sum = 0").select(*keys, F.col("d").alias(day), *(F.col(f"x.{c}").alias(c) for c in values))
    return points.join(found, [*keys, day], "left")


def as_of_features(log: DataFrame, samples: DataFrame) -> DataFrame:
    """``samples`` (user_id, item_id, as_of, a day, and more) with features of the user, the item and the pair from events before
    that day. Users, items and pairs without any have zeros, and no hours since their last event."""
    days = written(pair_days(log), "pair_days")
    firsts = written(first_days(days), "first_days")
    counts = list(COUNTS.values())
    out = samples
    for key, name in (("user_id", "user"), ("item_id", "item")):
        sums = cumulative(daily(days, firsts, key), [key], [*counts, "active_days", "n_viewed", "n_bought"], ["last"])
        sums = sums.select(key, "d", *(F.col(c).alias(f"{name}_{c}") for c in sums.columns if c not in (key, "d")))
        out = before(out, sums, [key])
        zero = {f"{name}_{c}": F.coalesce(f"{name}_{c}", F.lit(0)) for c in (*counts, "active_days", "n_viewed", "n_bought")}
        out = out.withColumns(zero)
        out = out.withColumn(f"{name}_view_to_buy_rate", rate(F.col(f"{name}_n_bought"), F.col(f"{name}_n_viewed")))
    pair = cumulative(days, ["user_id", "item_id"], counts)
    out = before(out, pair.withColumnsRenamed({c: f"pair_{c}" for c in counts}), ["user_id", "item_id"])
    hours = (F.unix_seconds(F.col("as_of").cast("timestamp")) - F.unix_seconds(F.col("user_last").cast("timestamp"))) / 3600.0
    return out.withColumns({f"pair_{c}": F.coalesce(f"pair_{c}", F.lit(0)) for c in counts}).withColumn("user_hours_since_last", hours).drop("user_last", "item_last")


def samples_at(log: DataFrame, cuts: list[str]) -> DataFrame:
    """The pairs seen before each of a few days, with that day as ``as_of``."""
    own = log.groupBy("user_id", "item_id").agg(F.min(F.to_date("time")).alias("first"))
    at = F.explode(F.array(*(F.lit(c).cast("date") for c in cuts)))
    return own.select("user_id", "item_id", "first", at.alias("as_of")).where("first < as_of").drop("first")


def fold_encoded(df: DataFrame, keys: dict[str, str], y: Column, fold: str = "fold") -> DataFrame:
    """``df`` with the mean of ``y`` by key (columns by result name), over rows of all folds but the row's own; a key that
    stands in no other fold gets the mean of all rows of other folds. So a row's own outcome is never in its features."""
    own = df.withColumn("__y", y.cast("double"))
    sums = lambda by, n: own.groupBy(*by).agg(F.sum("__y").alias(f"__s{n}"), F.count("__y").alias(f"__n{n}"))
    whole = own.groupBy(fold).agg(F.sum("__y").alias("__sf"), F.count("__y").alias("__nf"))
    every = whole.agg(F.sum("__sf").alias("__sa"), F.sum("__nf").alias("__na"))
    rest = whole.join(F.broadcast(every)).select(fold, F.try_divide(F.col("__sa") - F.col("__sf"), F.col("__na") - F.col("__nf")).alias("__rest"))
    out = df.join(F.broadcast(rest), fold)
    for name, key in keys.items():
        table = sums([key, fold], 1).join(sums([key], 2), key)
        mean = F.try_divide(F.col("__s2") - F.col("__s1"), F.col("__n2") - F.col("__n1"))
        out = out.join(table.select(key, fold, mean.alias(name)), [key, fold], "left").withColumn(name, F.coalesce(name, "__rest"))
    return out.select(*df.columns, *keys)
