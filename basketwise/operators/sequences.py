"""User histories as sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import running


def item_hash(item: Column, size: int = 500_000) -> Column:
    """1 to size; 0 is padding."""
    return F.pmod(item, F.lit(size)) + 1


def category_index(category: Column) -> Column:
    return F.when(category.isNull() | (category < 0), 0).otherwise(category + 1)


def user_history(log: DataFrame, size: int = 500_000) -> DataFrame:
    """Per user all events in time order, as one array. A user's events are bounded by what one person does;
    crawlers are cleaned away before."""
    event = F.struct("time", "event_id", item_hash(F.col("item_id"), size).alias("item"), category_index(F.col("item_category")).alias("category"), F.col("behavior_type").alias("behavior"))
    return log.groupBy("user_id").agg(F.sort_array(F.collect_list(event)).alias("history"))


def sequences(samples: DataFrame, log: DataFrame, length: int = 50, size: int = 500_000) -> DataFrame:
    """Per sample the last ``length`` events strictly before ``last_time``, ascending, zero-padded on the right; gaps
    in days, at most 30, over 30.

    Events and samples of a user stand in one order of time, cut into ranges, so that no user is one task. How many events come
    before tells an event's number and a sample's place among them; a sample then finds its events by their numbers: rows
    grow with samples times ``length``, not with a user's samples times events.
    """
    none = lambda kind: F.lit(None).cast(kind)
    events = log.select("user_id", "time", F.lit(1).alias("is_event"), "event_id", item_hash(F.col("item_id"), size).alias("item"), category_index(F.col("item_category")).alias("category"), F.col("behavior_type").alias("behavior"), none("long").alias("item_id"))
    own = samples.select("user_id", F.col("last_time").alias("time"), F.lit(0).alias("is_event"), none("long").alias("event_id"), none("long").alias("item"), none("int").alias("category"), none("int").alias("behavior"), "item_id")
    # at equal times samples stand before events, so that only earlier events count
    every = written(running(own.unionByName(events), ["time", "is_event", "event_id"], {"n": "is_event"}, keys=("user_id",)), "timeline")
    numbered = every.where("is_event = 1").select("user_id", F.col("n").alias("nth"), "time", "item", "category", "behavior")
    placed = every.where("is_event = 0").select("user_id", "item_id", F.col("time").alias("last_time"), "n")
    wanted = placed.withColumn("nth", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.greatest(F.lit(1), F.col("n") - length + 1), F.col("n")))))
    last = wanted.join(numbered, ["user_id", "nth"], "left")
    days = (F.unix_seconds(F.col("last_time").cast("timestamp")) - F.unix_seconds(F.col("time").cast("timestamp"))) / 86400.0
    event = F.when(F.col("nth").isNotNull(), F.struct("nth", "item", "category", "behavior", (F.least(days, F.lit(30.0)) / 30.0).alias("gap")))
    out = last.groupBy("user_id", "item_id", "last_time").agg(F.sort_array(F.collect_list(event)).alias("e"))
    pad = lambda c, zero: F.slice(F.concat(F.col("e").getField(c), F.array_repeat(zero, length)), 1, length)
    return out.select("user_id", "item_id", "last_time", pad("item", F.lit(0).cast("long")).alias("items"), pad("category", F.lit(0)).alias("categories"), pad("behavior", F.lit(0)).alias("behaviors"), pad("gap", F.lit(0.0)).alias("gaps"), F.size("e").alias("seq_len"))


def flattened(seqs: DataFrame) -> DataFrame:
    """One row a used position, for comparison with other engines."""
    zipped = F.slice(F.arrays_zip("items", "categories", "behaviors", "gaps"), 1, F.greatest("seq_len", F.lit(1)))
    return seqs.select("user_id", "item_id", "seq_len", F.posexplode(zipped).alias("position", "x")).select("user_id", "item_id", "seq_len", "position", "x.items", "x.categories", "x.behaviors", "x.gaps")


def vocabulary_sizes(log: DataFrame, size: int = 500_000) -> DataFrame:
    return log.agg((F.max(item_hash(F.col("item_id"), size)) + 1).alias("n_items"), (F.max(category_index(F.col("item_category"))) + 1).cast("long").alias("n_categories"), (F.max("behavior_type") + 1).cast("long").alias("n_behaviors"))


def with_category(samples: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    out = samples.drop("item_category").join(items.select("item_id", "item_category"), "item_id", "left").withColumn("category_index", category_index(F.col("item_category")))
    return out if limit is None else out.limit(limit)
