"""Joins that the pipelines need. Sizes decide how each is run; none carries a hint but for one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched(pair: DataFrame, items: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    """(user, item, category) with prefixed columns of the three dimensions."""
    named = lambda df, key, prefix: df.select(key, *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key))
    users = users.withColumnsRenamed({c: f"user_{c}" for c in ("pv_count", "fav_count", "cart_count", "buy_count")})
    return pair.select("user_id", "item_id", "item_category").join(named(items.drop("item_category"), "item_id", "item"), "item_id", "left").join(named(categories, "item_category", "category"), "item_category", "left").join(users, "user_id", "left")


def views_and_buys(log: DataFrame) -> DataFrame:
    """Views and buys of each hour of the day that has either: one aggregation for the outer join."""
    kind = F.col("behavior_type")
    return log.where(kind.isin(1, 4)).groupBy(F.hour("time").alias("hour")).agg(F.count_if(kind == 1).alias("views"), F.count_if(kind == 4).alias("buys"))


def buyers(log: DataFrame) -> DataFrame:
    return log.where("behavior_type = 4").select("user_id").distinct()


def buyers_events(log: DataFrame) -> DataFrame:
    return log.join(buyers(log), "user_id", "left_semi")


def non_buyers_events(log: DataFrame) -> DataFrame:
    return log.join(buyers(log), "user_id", "left_anti")


def keys(log: DataFrame, behaviour: int) -> DataFrame:
    return log.where(F.col("behavior_type") == behaviour).select("user_id", "item_id").distinct()


def resolved_candidates(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates with the log's category and ``ok``, ``conflict`` (another one is given) or ``unmatched``."""
    known = log.groupBy("item_id").agg(F.min("item_category").alias("known"))
    joined = candidates.dropDuplicates(["user_id", "item_id"]).join(known, "item_id", "left")
    status = F.when(F.col("known").isNull(), "unmatched").when(F.col("item_category") != F.col("known"), "conflict").otherwise("ok")
    return joined.select("user_id", "item_id", F.col("known").alias("item_category"), status.alias("status"))


def target_pairs(candidates: DataFrame, log: DataFrame, failure_policy: str = "error") -> tuple[DataFrame, DataFrame]:
    """``(pairs, rejects)``. Conflicts are an error; unmatched items are one too, or with ``reject`` rows apart."""
    told = resolved_candidates(candidates, log)
    counts = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
    if counts.get("conflict"):
        raise ValueError(f"{counts['conflict']} candidates contradict the known category")
    if counts.get("unmatched") and failure_policy == "error":
        raise ValueError(f"{counts['unmatched']} candidates have unknown items")
    return told.where("status = 'ok'").drop("status"), told.where("status = 'unmatched'").drop("status")


def alignment(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of what keeps predictions from matching samples one to one on (user, item)."""
    own = predictions.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    both = samples.join(own, ["user_id", "item_id"], "left")
    return both.agg(F.count("*").alias("n_samples"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count_if(F.col("n").isNull()).alias("unmatched"), F.count_if((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label"))).alias("label_mismatches"))


def aligned(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples with their predictions, or an error that says what doesn't match."""
    bad = {k: v for k, v in alignment(samples, predictions).first().asDict().items() if k != "n_samples" and v}
    if bad:
        raise ValueError(f"predictions don't match the samples: {bad}")
    return samples.join(predictions.drop("label"), ["user_id", "item_id"], "left")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    return df.join(table.select(key, value), key, "left")


def with_column_by_key(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Another table's column by key; row order means nothing here."""
    return df.join(table, on, "left")
