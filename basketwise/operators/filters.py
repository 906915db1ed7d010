"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import quantile_row


def by_date_and_behaviour(log: DataFrame, first: str, last: str, behaviours: list[int]) -> DataFrame:
    """Both dates inclusive."""
    return log.where(F.to_date("time").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("behavior_type").isin(*behaviours))


def user_segments(log: DataFrame) -> DataFrame:
    """``low`` below the first quartile of views, ``high`` from the third on, else ``mid``."""
    users = log.groupBy("user_id").agg(F.count_if(F.col("behavior_type") == 1).alias("pv_count"))
    q = quantile_row(users, {"q1": ("pv_count", 0.25), "q3": ("pv_count", 0.75)})
    return users.join(F.broadcast(q)).select("user_id", "pv_count", F.when(F.col("pv_count") < F.col("q1"), "low").when(F.col("pv_count") >= F.col("q3"), "high").otherwise("mid").alias("segment"))


def top_categories(log: DataFrame, n: int = 50) -> DataFrame:
    return log.groupBy("item_category").count().orderBy(F.desc("count"), "item_category").limit(n).select("item_category")


def by_segment(log: DataFrame, segment: str, n_categories: int = 50) -> DataFrame:
    kept = log if segment == "all" else log.join(user_segments(log).where(F.col("segment") == segment).select("user_id"), "user_id", "left_semi")
    return kept.join(top_categories(log, n_categories), "item_category", "left_semi").select(*log.columns)


def scored_users(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(F.count_if(F.col("behavior_type") == 1).alias("user_pv_count"), F.avg("item_category").alias("item_category_te"))


def by_score_segment(scores: DataFrame, users: str = "all", encoding: str = "all") -> DataFrame:
    """Users low (< q25), mid or high (> q75) by views, power or normal; thirds of the target encoding."""
    q = quantile_row(scores, {"q1": ("user_pv_count", 0.25), "q3": ("user_pv_count", 0.75), "t1": ("item_category_te", 1 / 3), "t2": ("item_category_te", 2 / 3)})
    pv, te = F.col("user_pv_count"), F.col("item_category_te")
    by_user = {"all": F.lit(True), "low": pv < F.col("q1"), "mid": pv.between(F.col("q1"), F.col("q3")), "high": pv > F.col("q3")}
    if "is_power_user" in scores.columns:
        by_user |= {"power": F.col("is_power_user"), "normal": ~F.col("is_power_user")}
    by_code = {"all": F.lit(True), "low": te <= F.col("t1"), "middle": (te > F.col("t1")) & (te <= F.col("t2")), "high": te > F.col("t2")}
    return scores.join(F.broadcast(q)).where(by_user[users] & by_code[encoding]).select(*scores.columns)


def time_columns(log: DataFrame) -> DataFrame:
    return log.withColumns({"date": F.to_date("time"), "hour": F.hour("time"), "weekday": F.weekday("time"), "weekday_name": F.date_format("time", "EEEE")})


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats, for a sink only."""
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def numeric_columns(*frames: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that all frames share, in the order of the first; an error if there is none."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    named = [{c for c, t in f.dtypes if t in kinds or t.startswith("decimal")} for f in frames]
    found = [c for c in frames[0].columns if all(c in x for x in named) and c not in exclude]
    if not found:
        raise ValueError("no numeric feature column is common to all frames")
    return found


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, null_count)`` of the required columns; an error if one is missing or not numeric."""
    bad = sorted(set(columns) - set(df.columns)) or [c for c in columns if c not in numeric_columns(df)]
    if bad:
        raise ValueError(f"missing or not numeric: {bad}")
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns))).alias("x")).select("x.*")


def feature_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with a vector of the columns; nulls are an error that counts them."""
    from pyspark.ml.feature import VectorAssembler

    bad = {r["column_name"]: r["null_count"] for r in null_counts(df, columns).where("null_count > 0").collect()}
    if bad:
        raise ValueError(f"null features: {bad}")
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)
