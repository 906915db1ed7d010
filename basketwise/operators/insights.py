"""Insight queries over a (filtered) log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dims import behaviour_counts, rate
from .ranges import neighbours
from .selection import correlation

#: The edges of the activity bins.
EDGES = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)


def _is(k: int):
    return F.col("behavior_type") == k


def overview(log: DataFrame) -> DataFrame:
    users = log.groupBy("user_id").agg(F.count_distinct("item_id").alias("items"), F.count_if(_is(4)).alias("buys"), F.count_if(_is(1)).alias("views"), F.count("*").alias("n"))
    one = users.agg(F.count("*").alias("n_users"), F.sum("n").alias("n_rows"), F.avg("items").alias("items_per_user"), F.count_if(F.col("buys") > 0).alias("buyers"), F.sum("buys").alias("buys"), F.sum("views").alias("views"))
    span = log.agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("item_category").alias("n_categories"), (F.datediff(F.max(F.to_date("time")), F.min(F.to_date("time"))) + 1).cast("long").alias("span_days"))
    c = F.col
    return one.join(F.broadcast(span)).select("n_users", "n_items", "n_categories", "n_rows", "span_days", rate(c("n_rows"), c("n_users")).alias("actions_per_user"), F.coalesce("items_per_user", F.lit(0.0)).alias("items_per_user"), rate(c("buyers"), c("n_users")).alias("buyer_share"), rate(c("buys"), c("views")).alias("buy_per_view"), rate(c("n_rows") - c("buys"), c("buys")).alias("negative_ratio"), rate(c("buys"), c("n_users")).alias("buys_per_user"))


def weekday_hours(log: DataFrame, behaviour: int) -> DataFrame:
    """One row a weekday, a column an hour."""
    own = log.where(_is(behaviour)).select(F.weekday("time").alias("weekday"), F.hour("time").alias("hour"))
    return own.groupBy("weekday").agg(*(F.count_if(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)))


def conversion(log: DataFrame, *keys) -> DataFrame:
    own = log.groupBy(*keys).agg(F.count_if(_is(1)).alias("views"), F.count_if(_is(4)).alias("buys"))
    return own.withColumn("conversion", rate(F.col("buys"), F.col("views")))


def daily_trend(log: DataFrame) -> DataFrame:
    own = log.groupBy(F.to_date("time").alias("date")).agg(*behaviour_counts())
    return own.withColumns({"conversion": rate(F.col("buy_count"), F.col("pv_count")), "is_weekend": F.weekday("date") >= 5})


def log_bins(counts: DataFrame, column: str) -> DataFrame:
    """``(low, high)``: left-closed bins that end at twice the largest count."""
    top = counts.agg(F.max(column).alias("m"))
    kept = F.filter(F.array(*map(F.lit, EDGES)), lambda e: e < F.col("m") * 1.2)
    edges = F.array_distinct(F.concat(kept, F.array((F.col("m") * 2).cast("int"))))
    return top.where("m > 0").select(edges.alias("e")).select(F.posexplode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("low"), F.slice("e", 2, F.size("e") - 1).alias("high"))).alias("i", "b"), (F.size("e") - 2).alias("last")).select("i", "b.low", "b.high", F.when(F.col("i") == F.col("last"), F.concat(F.col("b.low"), F.lit("+"))).otherwise(F.concat_ws("-", "b.low", (F.col("b.high") - 1).cast("string"))).alias("label"))


def binned(counts: DataFrame, column: str) -> DataFrame:
    """Counts with the bin each falls into (a table of a dozen rows, matched by range)."""
    bins = log_bins(counts, column)
    return counts.join(F.broadcast(bins), (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")))


def activity(log: DataFrame) -> DataFrame:
    users = log.groupBy("user_id").agg(F.count("*").cast("int").alias("n"), (F.count_if(_is(4)) / F.count("*")).alias("buy_ratio"))
    return binned(users, "n").groupBy("i", "label").agg(F.count("*").alias("n_users"), F.avg("buy_ratio").alias("mean_buy_ratio"))


def purchase_counts(log: DataFrame, most: int = 20) -> DataFrame:
    own = log.where(_is(4)).groupBy("user_id").agg(F.count("*").alias("buys"))
    all_ = own.agg(F.count("*").alias("buyers"), F.avg((F.col("buys") >= 2).cast("double")).alias("repeat_share"))
    return own.where(F.col("buys") <= most).groupBy("buys").agg(F.count("*").alias("n_users")).join(F.broadcast(all_))


def totals(log: DataFrame, key: str) -> DataFrame:
    own = log.groupBy(key).agg(*behaviour_counts(), F.count("*").alias("interactions"))
    return own.withColumn("conversion", rate(F.col("buy_count"), F.col("pv_count")))


def top(df: DataFrame, by: str, key: str, n: int, least: tuple[str, int] | None = None) -> DataFrame:
    df = df if least is None else df.where(F.col(least[0]) >= least[1])
    return df.orderBy(F.desc(by), key).limit(n)


def cumulative_share(log: DataFrame) -> DataFrame:
    """Categories by interactions with running shares: a window over the table of categories."""
    own = totals(log, "item_category").select("item_category", "interactions", "buy_count")
    w = W.orderBy(F.desc("interactions"), "item_category").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    share = lambda c: F.sum(c).over(w) / F.sum(c).over(every) * 100
    return own.withColumns({"rank": F.row_number().over(W.orderBy(F.desc("interactions"), "item_category")), "interaction_share": share("interactions"), "buy_share": share("buy_count"), "n": F.count("*").over(every)})


def pareto(log: DataFrame, part: float = 0.2) -> DataFrame:
    at = F.greatest(F.lit(1), F.floor(F.col("n") * part))
    return cumulative_share(log).where(F.col("rank") == at).select(F.col("rank").alias("n_top"), F.col("n").alias("n_categories"), "interaction_share", "buy_share")


def quadrants(log: DataFrame, n: int = 15) -> DataFrame:
    items = top(totals(log, "item_id"), "pv_count", "item_id", n)
    mid = items.agg(F.median("pv_count").alias("mv"), F.median("conversion").alias("mc"))
    side = lambda c, m, a: F.when(F.col(c) >= F.col(m), f"high {a}").otherwise(f"low {a}")
    named = items.join(F.broadcast(mid)).withColumn("quadrant", F.concat_ws(", ", side("pv_count", "mv", "exposure"), side("conversion", "mc", "conversion")))
    own = named.groupBy("quadrant").agg(F.count("*").alias("n_items"), F.sum("pv_count").alias("views"), F.sum("buy_count").alias("buys"), F.avg("conversion").alias("mean_conversion"))
    return own.join(F.broadcast(own.agg(F.sum("n_items").alias("t")))).withColumn("share", F.col("n_items") / F.col("t")).drop("t")


def reach_funnel(log: DataFrame) -> DataFrame:
    """Users at view, cart, favourite and buy, with shares of the entry and of the step before."""
    users = log.groupBy("user_id").agg(*(F.bool_or(_is(k)).alias(n) for k, n in ((1, "view"), (3, "cart"), (2, "fav"), (4, "buy"))))
    one = users.agg(*(F.count_if(n).alias(n) for n in ("view", "cart", "fav", "buy")))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n_users"), F.col("view").alias("entry"), (F.col(b) if b else F.lit(None).cast("long")).alias("before")) for i, (n, b) in enumerate((("view", None), ("cart", "view"), ("fav", "cart"), ("buy", "fav")))))).alias("x")).select("x.*")
    step = F.when(F.col("before").isNotNull(), rate(F.col("n_users"), F.col("before")))
    return rows.select("step", "stage", "n_users", rate(F.col("n_users"), F.col("entry")).alias("entry_share"), step.alias("step_conversion"), (F.lit(1.0) - step).alias("drop"))


def transitions(log: DataFrame) -> DataFrame:
    """Each event's next behaviour of the same user, 0 at the end. A user's events are cut into ranges of time."""
    own = log.select("event_id", "user_id", "behavior_type", "time")
    own = neighbours(own, ["time", "event_id"], after={"next": "behavior_type"}, keys=("user_id",))
    return own.select("event_id", "user_id", "behavior_type", F.coalesce("next", F.lit(0)).alias("next_behavior"))


def transition_matrix(log: DataFrame) -> DataFrame:
    own = transitions(log).groupBy("behavior_type").agg(*(F.count_if(F.col("next_behavior") == k).alias(f"to_{k}") for k in range(5)), F.count("*").alias("n"))
    return own.select("behavior_type", *(f"to_{k}" for k in range(5)), *((F.col(f"to_{k}") / F.col("n") * 100).alias(f"pct_{k}") for k in range(5)))


def top_transitions(log: DataFrame, n: int = 3) -> DataFrame:
    return transitions(log).where("next_behavior != 0").groupBy("behavior_type", "next_behavior").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "behavior_type", "next_behavior").limit(n)


def depth(log: DataFrame, behaviour: int) -> DataFrame:
    """Buy rate by how often users did ``behaviour``, in bins; the whole rate; the correlation with the bin."""
    users = log.groupBy("user_id").agg(F.count_if(_is(behaviour)).cast("int").alias("n"), F.max(_is(4).cast("int")).alias("bought"))
    own = binned(users, "n").groupBy("i", "label").agg(F.count("*").alias("n_users"), F.sum("bought").alias("buyers"), F.avg("bought").alias("buy_rate"))
    trend = own.agg(correlation(F.col("i"), F.col("buy_rate")).alias("r"), F.max("buy_rate").alias("peak"))
    whole = users.agg(F.avg("bought").alias("overall_rate"))
    word = F.when(F.col("r") > 0.3, "rising").when(F.col("r") < -0.3, "falling").otherwise("flat")
    return own.join(F.broadcast(trend)).join(F.broadcast(whole)).select("i", "label", "n_users", "buyers", "buy_rate", (F.col("buy_rate") == F.col("peak")).alias("is_peak"), word.alias("trend"), "overall_rate")


def gaps(log: DataFrame) -> DataFrame:
    own = neighbours(log.select("event_id", "user_id", "time"), ["time", "event_id"], before={"earlier": "time"}, keys=("user_id",))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return own.select("event_id", "user_id", (seconds("time") - seconds("earlier")).alias("gap_seconds"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
