"""Quality profiles; each is a small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .clean import TUPLE

NAMES = {1: "pv", 2: "fav", 3: "cart", 4: "buy"}


def _percent(part, whole):
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole), F.lit(0.0)), 6)


def missing_values(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns)))
    return one.select("n", rows.alias("x")).select("x.column_name", "x.null_count", _percent(F.col("x.null_count"), F.col("n")).alias("null_percent"), F.when(F.col("x.null_count") == 0, "OK").otherwise("WARN").alias("status"))


def ranges(log: DataFrame) -> DataFrame:
    cols = ("user_id", "item_id", "item_category")
    sums = [f(c) for c in cols for f in (lambda c: F.min(c).cast("long").alias(f"min_{c}"), lambda c: F.max(c).cast("long").alias(f"max_{c}"), lambda c: F.count_if(F.col(c) < 0).alias(f"negative_{c}"))]
    return log.agg(*sums, F.count_if(~F.col("behavior_type").isin(1, 2, 3, 4)).alias("illegal_behaviors"))


def behaviour_distribution(log: DataFrame) -> DataFrame:
    counts = log.groupBy("behavior_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    name = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return counts.join(F.broadcast(total)).select("behavior_type", name[F.col("behavior_type")].alias("name"), "n", _percent(F.col("n"), F.col("total")).alias("percent"))


def cardinalities(log: DataFrame) -> DataFrame:
    return log.agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("item_category").alias("n_categories"))


def cleaning_summary(stats: DataFrame) -> DataFrame:
    return stats.select("original_count", (F.col("original_count") - F.col("after_dedup")).alias("removed_dedup"), (F.col("after_dedup") - F.col("after_behavior")).alias("removed_behavior"), (F.col("after_behavior") - F.col("after_time")).alias("removed_time"), "final_count", _percent(F.col("final_count"), F.col("original_count")).alias("retention_percent"))


def duplicate_rates(log: DataFrame) -> DataFrame:
    """All behaviours (0) and each that occurs; the groups are summed once for both."""
    groups = log.groupBy(*TUPLE).agg(F.count("*").alias("n"))
    sums = (F.sum("n").cast("long").alias("total_rows"), F.sum(F.col("n") - 1).cast("long").alias("duplicates"), F.max("n").alias("max_multiplicity"))
    out = groups.rollup("behavior_type").agg(*sums)
    return out.select(F.coalesce("behavior_type", F.lit(0)).alias("behavior_type"), "total_rows", "duplicates", _percent(F.col("duplicates"), F.col("total_rows")).alias("percent"), "max_multiplicity")


def power_users(flagged: DataFrame) -> DataFrame:
    users = flagged.groupBy("user_id").agg(F.bool_or("is_power_user").alias("p"), F.count("*").alias("n"), F.count_if("is_power_user").alias("rows"))
    return users.agg(F.count_if("p").alias("power_users"), F.count_if(~F.col("p")).alias("normal_users"), F.coalesce(F.sum("rows"), F.lit(0)).alias("power_rows"), _percent(F.sum("rows"), F.sum("n")).alias("power_row_percent"))


def missing_dates(log: DataFrame) -> DataFrame:
    days = log.select(F.to_date("time").alias("date")).distinct()
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date")).join(days, "date", "left_anti")


def date_coverage(log: DataFrame) -> DataFrame:
    days = log.select(F.to_date("time").alias("date")).distinct()
    return days.agg((F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("expected_days"), F.count("*").alias("actual_days"))


def primary_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and distinct keys of each table."""
    each = [df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")) for name, (df, keys) in tables.items()]
    return reduce(DataFrame.unionByName, each).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def conservation(log: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The sum of each count column of each table against the log's rows of that behaviour."""
    spread = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("behavior"), F.col(n).alias("n")) for n in NAMES.values()))).alias("x")).select("x.*")
    source = spread(log.agg(*(F.count_if(F.col("behavior_type") == k).alias(n) for k, n in NAMES.items()))).withColumnRenamed("n", "source_rows")
    each = [spread(df.agg(*(F.sum(f"{n}_count").cast("long").alias(n) for n in NAMES.values()))).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each).withColumnRenamed("n", "table_sum").join(F.broadcast(source), "behavior").withColumn("matches", F.col("table_sum") == F.col("source_rows"))


def null_columns(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [missing_values(df).select(F.lit(name).alias("table_name"), "column_name", "null_count") for name, df in tables.items()])


def audit(built: DataFrame, again: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows in which two builds of a table differ, per field: a full outer join on the keys."""
    a = built.select(*keys, *(F.col(f).cast("double").alias(f"a_{f}") for f in fields), F.lit(1).alias("in_a"))
    b = again.select(*keys, *(F.col(f).cast("double").alias(f"b_{f}") for f in fields), F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    off = lambda f: ~F.coalesce(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= tolerance, F.col(f"a_{f}").isNull() & F.col(f"b_{f}").isNull())
    one = both.agg(F.count("*").alias("n_keys"), *(F.count_if(off(f)).alias(f) for f in fields))
    return one.select("n_keys", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_different")) for f in fields))).alias("x")).select("x.field", "n_keys", "x.n_different")


#: Fields of each kind of table that are recomputed.
AUDITED = {
    "user": ("user_id", ["pv_count", "fav_count", "cart_count", "buy_count", "active_days", "buy_item_count", "repurchase_item_count", "view_to_buy_rate"]),
    "item": ("item_id", ["pv_count", "fav_count", "cart_count", "buy_count", "view_user_count", "buy_user_count", "view_to_buy_rate"]),
    "category": ("item_category", ["pv_count", "fav_count", "cart_count", "buy_count", "item_count", "buy_item_count", "buy_item_pct"]),
    "day": ("date", ["pv_count", "fav_count", "cart_count", "buy_count", "unique_users", "unique_items"]),
}


def representatives(tables: dict[str, DataFrame], power: DataFrame) -> DataFrame:
    """``(kind, role, key)`` of a few keys that show each case: power users with all behaviours and one who only views; items and
    categories with all and with views alone; the first, middle and last day. Of each the least keys."""
    some = lambda *names: reduce(lambda a, b: a & b, (F.col(f"{n}_count") > 0 for n in names))
    rest = (F.col("fav_count") == 0) & (F.col("cart_count") == 0) & (F.col("buy_count") == 0)
    users = tables["user"].join(power.select("user_id"), "user_id", "left_semi")
    picks = [
        (users, "user", "power", some("fav", "cart", "buy"), 2), (tables["user"], "user", "only views", rest, 1),
        (tables["item"], "item", "hot", some("fav", "cart", "buy") & (F.col("view_user_count") >= 3), 5), (tables["item"], "item", "cold", rest & (F.col("view_user_count") == 1), 3),
        (tables["category"], "category", "hot", some("pv", "fav", "cart", "buy"), 2), (tables["category"], "category", "cold", rest & some("pv"), 2),
    ]
    named = lambda df, kind, role: df.select(F.lit(kind).alias("kind"), role.alias("role"), F.col(AUDITED[kind][0]).cast("string").alias("key"))
    out = [named(df.where(c).orderBy(AUDITED[kind][0]).limit(n), kind, F.lit(role)) for df, kind, role, c, n in picks]
    days = tables["day"].select("date", F.row_number().over(W.orderBy("date")).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))  # a row a day
    roles = F.array_compact(F.array(F.when(F.col("i") == 1, "first"), F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, "middle"), F.when(F.col("i") == F.col("n"), "last")))
    days = days.select("date", F.explode(roles).alias("role"))
    return reduce(DataFrame.unionByName, [*out, named(days, "day", F.col("role"))])


def recomputed(log: DataFrame) -> dict[str, DataFrame]:
    """The audited fields straight from rows, by distinct counts, not by way of pairs."""
    kind = F.col("behavior_type")
    counts = [F.count_if(kind == k).alias(f"{n}_count") for k, n in NAMES.items()]
    of = lambda c, *ks: F.count_distinct(F.when(kind.isin(*ks), F.col(c)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    seen = lambda by, other: log.groupBy(by, other).agg(F.bool_or(kind == 1).alias("v"), F.bool_or(kind == 4).alias("b"), F.count_if(kind == 4).alias("n")).groupBy(by).agg(ratio(F.count_if(F.col("v") & F.col("b")), F.count_if("v")).alias("view_to_buy_rate"), F.count_if(F.col("n") >= 2).alias("repurchase_item_count"))
    users = log.groupBy("user_id").agg(*counts, F.count_distinct(F.to_date("time")).alias("active_days"), of("item_id", 4).alias("buy_item_count")).join(seen("user_id", "item_id"), "user_id")
    items = log.groupBy("item_id").agg(*counts, of("user_id", 1).alias("view_user_count"), of("user_id", 4).alias("buy_user_count")).join(seen("item_id", "user_id").drop("repurchase_item_count"), "item_id")
    every = F.count_distinct("item_id")
    categories = log.groupBy("item_category").agg(*counts, every.alias("item_count"), of("item_id", 4).alias("buy_item_count"), ratio(of("item_id", 4), every).alias("buy_item_pct"))
    days = log.groupBy(F.to_date("time").alias("date")).agg(*counts, F.count_distinct("user_id").alias("unique_users"), every.alias("unique_items"))
    return {"user": users, "item": items, "category": categories, "day": days}


def sample_audit(log: DataFrame, tables: dict[str, DataFrame], chosen: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``(kind, role, key, field, value, matches)``: each audited field of the chosen keys as a built table has it, and whether its
    recomputation from the log agrees. Only the rows of chosen keys are recomputed."""
    keys = {k: written(chosen.where(F.col("kind") == k).select(F.col("key").cast(dict(tables[k].dtypes)[c]).alias(c), "role"), "chosen") for k, (c, _) in AUDITED.items()}
    parts = []
    for k, (c, fields) in AUDITED.items():
        at = F.to_date("time") if k == "day" else F.col(c)
        own = log.withColumn("__at", at).join(F.broadcast(keys[k].select(F.col(c).alias("__at")).distinct()), "__at", "left_semi").drop("__at")
        again = recomputed(own)[k].select(c, *(F.col(f).alias(f"again_{f}") for f in fields))
        both = keys[k].join(tables[k].select(c, *fields), c, "left").join(again, c, "left")
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.col(f"again_{f}").cast("double").alias("again")) for f in fields)))
        off = F.abs(F.col("x.value") - F.col("x.again")) <= tolerance
        parts.append(both.select(F.lit(k).alias("kind"), "role", F.col(c).cast("string").alias("key"), cells.alias("x")).select("kind", "role", "key", "x.field", "x.value", F.coalesce(off, F.lit(False)).alias("matches")))
    return reduce(DataFrame.unionByName, parts)


def split_quality(samples: DataFrame, special: list[str]) -> DataFrame:
    """Per split: rows, share, positive rate, kinds of day, time range. ``samples`` has split, label, last_time."""
    day, weekday = F.to_date("last_time"), F.weekday("last_time")
    is_special = day.cast("string").isin(*special) if special else F.lit(False)
    own = samples.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg("label"), 6).alias("positive_rate"), F.count_if(~is_special & (weekday < 5)).alias("n_weekday"), F.count_if(~is_special & (weekday >= 5)).alias("n_weekend"), F.count_if(is_special).alias("n_special"), F.min("last_time").alias("min_time"), F.max("last_time").alias("max_time"))
    return own.join(F.broadcast(own.agg(F.sum("n_rows").alias("total")))).withColumn("share", F.round(F.col("n_rows") / F.col("total"), 6)).drop("total")
