"""Preprocessing of the wide table, in batch and with stored parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import quantile_row

TIMES = ("first_active_time", "last_active_time")
ZERO = ("item_decay_slope", "svd_score")
MEDIAN = ("user_avg_interval_hours",)
UNSCALED = ("user_id", "item_id", "item_category", "buy_path_type", "is_power_user")


def dropped(df: DataFrame, columns=TIMES) -> DataFrame:
    return df.drop(*columns)


def filled(df: DataFrame, zero=ZERO, median=MEDIAN) -> DataFrame:
    own = [c for c in median if c in df.columns]
    df = df.fillna(0, [c for c in zero if c in df.columns])
    if not own:
        return df
    mids = quantile_row(df, {f"__{c}": (c, 0.5) for c in own})
    return df.join(F.broadcast(mids)).withColumns({c: F.coalesce(c, f"__{c}") for c in own}).drop(*(f"__{c}" for c in own))


def target_encoded(df: DataFrame) -> DataFrame:
    """Mean of bought by category and by user, over the same rows."""
    y = (F.col("buy_path_type") > 0).cast("double")
    by_category = df.groupBy("item_category").agg(F.avg(y).alias("item_category_te"))
    by_user = df.groupBy("user_id").agg(F.avg(y).alias("user_id_te"))
    return df.join(by_category, "item_category", "left").join(by_user, "user_id", "left")


def scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, mean, std)``; the standard deviation of the population, 1 where it is 0."""
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    std = lambda c: F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("mean"), std(c).alias("std")) for c in columns))).alias("x")).select("x.*")


def standardised(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c not in UNSCALED]
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = df.join(F.broadcast(one))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return wide.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def preprocessed(wide: DataFrame) -> DataFrame:
    return standardised(target_encoded(filled(dropped(wide))))


def fit_parameters(wide: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Tables for serving: medians, each category's rate and the whole rate, and scales after filling."""
    y = (F.col("buy_path_type") > 0).cast("double")
    rates = wide.groupBy("item_category").agg(F.avg(y).alias("item_category_te"))
    base = wide.agg(F.avg(y).alias("default_te"))
    own = {f"median_{c}": (c, 0.5) for c in MEDIAN if c in columns}
    if own:
        base = base.join(F.broadcast(quantile_row(wide, own)))
    ready = _filled_and_encoded(wide, {"rates": rates, "base": base}, columns)
    return {"rates": rates, "base": base, "scales": scales(ready, columns)}


def _filled_and_encoded(wide: DataFrame, p: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    df = wide.drop("item_category_te").join(p["rates"], "item_category", "left").join(F.broadcast(p["base"]))
    df = df.withColumn("item_category_te", F.coalesce("item_category_te", "default_te"))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), *([F.col(f"median_{c}")] if c in MEDIAN else []), F.lit(0.0)) for c in columns})


def served(wide: DataFrame, p: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Keys and columns, filled, encoded (an unseen category gets the whole rate) and scaled as fitted."""
    pivot = p["scales"].groupBy().pivot("column_name", columns).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    df = _filled_and_encoded(wide, p, columns).join(F.broadcast(pivot))
    return df.select("user_id", "item_id", *(((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in columns))


def cached_parameters(spark, path: str, wide: DataFrame, columns: list[str], rebuild: bool = False) -> dict[str, DataFrame]:
    """Parameters stored under ``path``, fitted and written if there are none; an error if they are for others."""
    names = ("rates", "base", "scales")
    try:
        found = None if rebuild else {n: spark.read.parquet(f"{path}/{n}") for n in names}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is None:
        for n, df in fit_parameters(wide, columns).items():
            df.write.mode("overwrite").parquet(f"{path}/{n}")
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}
    stored = [r["column_name"] for r in found["scales"].select("column_name").collect()]
    if sorted(stored) != sorted(columns):
        raise ValueError("the stored parameters are for other features")
    return found
