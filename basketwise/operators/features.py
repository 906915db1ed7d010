"""Features of (user, item) pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import dims, joins

WEIGHTS = {1: 1, 2: 2, 3: 3, 4: 5}


def target_pairs(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "item_id").agg(F.min("item_category").alias("item_category"))


def streaks_of(days: DataFrame) -> DataFrame:
    """The longest run of days in a row, from one row a user and day d: days less their rank are alike within a run."""
    run = F.date_sub("d", F.row_number().over(W.partitionBy("user_id").orderBy("d")))
    return days.select("user_id", "d").withColumn("run", run).groupBy("user_id", "run").count().groupBy("user_id").agg(F.max("count").alias("user_streak_days"))


def streak_days(log: DataFrame) -> DataFrame:
    return streaks_of(log.select("user_id", F.to_date("time").alias("d")).distinct())


def heat() -> Column:
    kind = F.col("behavior_type")
    return F.when(kind == 1, 1).when(kind == 2, 2).when(kind == 3, 3).when(kind == 4, 5).otherwise(0)


def daily_heat(log: DataFrame) -> DataFrame:
    return log.groupBy("item_id", F.to_date("time").alias("date")).agg(F.sum(heat()).alias("heat"))


def decay_slope(log: DataFrame) -> DataFrame:
    """The slope of daily heat over the rank of the active day; null under three days."""
    return slope_of(daily_heat(log))


def slope_of(heat_days: DataFrame) -> DataFrame:
    placed = heat_days.withColumn("x", F.row_number().over(W.partitionBy("item_id").orderBy("date")) - 1)
    slope = F.regr_slope(F.col("heat").cast("double"), F.col("x").cast("double"))
    return placed.groupBy("item_id").agg(F.when(F.count("*") >= 3, slope).alias("item_decay_slope"))


def intervals_of(days: DataFrame) -> DataFrame:
    span = (F.unix_seconds(F.max("last").cast("timestamp")) - F.unix_seconds(F.min("first").cast("timestamp"))) / 3600.0
    return days.groupBy("user_id").agg(F.try_divide(span, F.nullif(F.sum("n_times") - 1, F.lit(0))).alias("user_avg_interval_hours"))


def interval_hours(log: DataFrame) -> DataFrame:
    """Mean hours between a user's distinct times: the span over their number less one."""
    seconds = F.unix_seconds(F.col("time").cast("timestamp"))
    return log.groupBy("user_id").agg(F.try_divide((F.max(seconds) - F.min(seconds)) / 3600.0, F.nullif(F.count_distinct("time") - 1, F.lit(0))).alias("user_avg_interval_hours"))


def buy_path(pair: DataFrame) -> DataFrame:
    """0 no buy, 1 direct, 2 favourite only, 3 cart only, 4 both."""
    fav, cart = F.col("fav_count") > 0, F.col("cart_count") > 0
    kind = F.when(F.col("buy_count") == 0, 0).when(fav & cart, 4).when(cart, 3).when(fav, 2).otherwise(1)
    return pair.select("user_id", "item_id", kind.alias("buy_path_type"))


def rfm_of(pair: DataFrame, last: DataFrame, day: DataFrame) -> DataFrame:
    """Scores of 1 to 5, from pairs, each user's last buy, and one row with the day that all is seen from."""
    users = pair.groupBy("user_id").agg(F.sum("buy_count").alias("f"), F.count_if(F.col("buy_count") > 0).alias("m"))
    df = users.join(last, "user_id", "left").join(F.broadcast(day))
    days = F.floor((F.unix_seconds(F.col("seen").cast("timestamp")) - F.unix_seconds(F.col("last_buy").cast("timestamp"))) / 86400)
    step = lambda x, edges: F.when(x <= edges[0], 1).when(x <= edges[1], 2).when(x <= edges[2], 3).when(x <= edges[3], 4).otherwise(5)
    recency = F.when(days.isNull(), 1).when(days <= 7, 5).when(days <= 14, 4).when(days <= 21, 3).when(days <= 28, 2).otherwise(1)
    return df.select("user_id", recency.alias("rfm_r_score"), step(F.col("f"), (2, 5, 10, 20)).alias("rfm_f_score"), step(F.col("m"), (1, 3, 6, 10)).alias("rfm_m_score"))


def rfm(log: DataFrame, pair: DataFrame, observed: str | None = None) -> DataFrame:
    """``observed`` is the day seen from; by default the day after the log ends."""
    last = log.where("behavior_type = 4").groupBy("user_id").agg(F.max("time").alias("last_buy"))
    ends = log.agg((F.date_add(F.max(F.to_date("time")), 1)).cast("timestamp_ntz").alias("seen"))
    return rfm_of(pair, last, ends if observed is None else log.sparkSession.range(1).select(F.lit(observed).cast("timestamp_ntz").alias("seen")))


def category_preference(pair: DataFrame) -> DataFrame:
    """A user's buys in a category over all buys, of those who bought."""
    return preference_of(pair.groupBy("user_id", "item_category").agg(F.sum("buy_count").alias("n")))


def preference_of(bought: DataFrame) -> DataFrame:
    """As ``category_preference``, from n buys a user and category."""
    return bought.where("n > 0").select("user_id", "item_category", (F.col("n") / F.sum("n").over(W.partitionBy("user_id"))).alias("user_category_pref"))


def wide_table(log: DataFrame, columns: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All features but the latent score of the log's pairs, or of ``targets`` (user_id, item_id, item_category): what the
    log doesn't know of a target is null. ``columns`` narrows the table, and Spark what is computed.

    The log is read three times: for pairs, for users' days and for items' days. The first two are written, as
    several dimensions are summed from each.
    """
    pair, days = written(dims.pairs(log), "pairs"), written(dims.user_days(log), "user_days")
    return wide_of(pair, days, daily_heat(log), columns, targets)


def wide_of(pair: DataFrame, days: DataFrame, heat_days: DataFrame, columns: list[str] | None = None, targets: DataFrame | None = None, bought: DataFrame | None = None) -> DataFrame:
    """The wide table from what it is summed from: pairs, users' days, items' days and, if they are known apart from pairs, buys
    by user and category."""
    users = dims.user_funnel(pair).join(dims.activity_of(days), "user_id")
    last = days.groupBy("user_id").agg(F.max("last_buy").alias("last_buy"))
    ends = days.agg(F.date_add(F.max("d"), 1).cast("timestamp_ntz").alias("seen"))
    df = joins.enriched(pair if targets is None else targets, dims.item_dim(pair), dims.category_dim(pair), users)
    parts = (
        (streaks_of(days), ["user_id"]), (slope_of(heat_days), ["item_id"]), (intervals_of(days), ["user_id"]), (buy_path(pair), ["user_id", "item_id"]),
        (rfm_of(pair, last, ends), ["user_id"]), (category_preference(pair) if bought is None else preference_of(bought), ["user_id", "item_category"]),
    )
    for part, key in parts:
        df = df.join(part, key, "left")
    df = df.withColumn("user_category_pref", F.coalesce("user_category_pref", F.lit(0.0)))
    return df if columns is None else df.select(*columns)


def latent_scores(pair: DataFrame, k: int = 10, rounds: int = 6, extra: int = 4, seed: int = 42) -> DataFrame:
    """``(user_id, item_id, svd_score)``: the heat of each pair by a truncated SVD of the heat matrix of rank ``k``.

    Subspace iteration: vectors of users are multiplied by the matrix and its transpose in turn, each a join and sums by
    key, and made orthonormal by their products with one another, a square of ``k + extra`` numbers. Neither
    an item's users nor the vectors of all users are gathered.
    """
    heat_of = written(pair.select("user_id", "item_id", sum(F.col(n) * WEIGHTS[b] for b, n in dims.COUNTS.items()).cast("double").alias("heat")), "heat")
    n_users, n_items = heat_of.agg(F.count_distinct("user_id"), F.count_distinct("item_id")).first()
    size = min(k + extra, max(min(n_users, n_items), 1))
    k = min(k, max(size - 1, 1))
    names = [f"v{i}" for i in range(size)]

    def times(vectors: DataFrame, by: str, to: str) -> DataFrame:
        return heat_of.join(vectors, by).groupBy(to).agg(*(F.sum(F.col("heat") * F.col(n)).alias(n) for n in names))

    def orthonormal(vectors: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
        """The vectors times a small matrix that makes them orthonormal, the most important first, and their lengths."""
        vectors = written(vectors, "vectors")
        products = vectors.agg(*(F.sum(F.col(names[i]) * F.col(names[j])) for i in range(size) for j in range(i, size))).first()
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = [x or 0.0 for x in products]
        value, basis = np.linalg.eigh(gram + np.triu(gram, 1).T)
        value, basis = value[::-1], basis[:, ::-1]
        real = value > max(value[0], 0) * 1e-12
        basis = np.where(real, basis / np.sqrt(np.where(real, value, 1)), 0)
        rotated = (sum((F.col(n) * F.lit(float(basis[i, j])) for i, n in enumerate(names)), F.lit(0.0)).alias(m) for j, m in enumerate(names))
        return vectors.select(key, *rotated), np.sqrt(np.maximum(value, 0))

    users = heat_of.select("user_id").distinct()
    gauss = lambda i: F.pmod(F.xxhash64("user_id", F.lit(seed * 1000 + i)), F.lit(1 << 20)) / float(1 << 19) - 1.0
    vectors, _ = orthonormal(users.select("user_id", *(gauss(i).alias(n) for i, n in enumerate(names))), "user_id")
    for _ in range(rounds):
        items, _ = orthonormal(times(vectors, "user_id", "item_id"), "item_id")
        vectors, _ = orthonormal(times(items, "item_id", "user_id"), "user_id")
    # with orthonormal items U, the most important first, the matrix is near U U' A, of which k parts stay
    product = written(times(vectors, "user_id", "item_id"), "product")
    turned, _ = orthonormal(product, "item_id")
    own = turned.select("item_id", *(F.col(n).alias(f"i{j}") for j, n in enumerate(names[:k])))
    back = times(turned, "item_id", "user_id")
    both = pair.select("user_id", "item_id").join(back, "user_id", "left").join(own, "item_id", "left")
    return both.select("user_id", "item_id", sum((F.col(n) * F.col(f"i{j}") for j, n in enumerate(names[:k])), F.lit(0.0)).alias("svd_score"))
