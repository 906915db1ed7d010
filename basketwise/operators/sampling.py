"""Samples of exact sizes and class balance."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import first_by, ranked

WIDTH = 1000003
TIES = ["user_id", "item_id"]


def spread(seed: int) -> Column:
    """A fixed pseudo-random order of pairs that any engine can compute."""
    return F.pmod(F.col("user_id") * 7919 + F.col("item_id") * 104729 + seed * 1299709, F.lit(WIDTH))


def allocations(counts: DataFrame, target: int, key: str = "stratum", n: str = "n") -> DataFrame:
    """Largest-remainder shares of ``target`` by ``n``, ties by key. ``counts`` has one row a key."""
    total = counts.agg(F.sum(n).alias("__t"))
    raw = counts.join(F.broadcast(total)).withColumn("__x", F.col(n) * F.lit(float(target)) / F.col("__t")).withColumn("__f", F.floor("__x"))
    left = raw.agg((F.lit(target) - F.sum("__f")).alias("__l"))
    order = F.row_number().over(W.orderBy((F.col("__x") - F.col("__f")).desc(), key))
    return raw.join(F.broadcast(left)).select(key, n, (F.col("__f") + F.when(order <= F.col("__l"), 1).otherwise(0)).cast("long").alias("allocated"))


def checked_allocations(counts: DataFrame, target: int, key: str = "stratum", n: str = "n") -> DataFrame:
    total = counts.agg(F.sum(n)).first()[0] or 0
    if not 0 <= target <= total:
        raise ValueError(f"cannot take {target} of {total}")
    return allocations(counts, target, key, n)


def two_level_sample(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows, shared out to labels and then to the strata of each, by pseudo-random order."""
    sizes = {r["label"]: r["allocated"] for r in checked_allocations(df.groupBy("label").agg(F.count("*").alias("n")), size, "label").collect()}
    counts = df.groupBy("label", "stratum").agg(F.count("*").alias("n"))
    parts = [allocations(counts.where(F.col("label") == k), v).withColumn("label", F.lit(k)) for k, v in sorted(sizes.items())]
    share = reduce(DataFrame.unionByName, parts).select("label", "stratum", F.col("allocated").alias("__take"))
    return first_by(df, spread(seed), WIDTH, share, ("label", "stratum"), TIES)


def class_sample(df: DataFrame, size: int, label: str, seed: int = 42) -> DataFrame:
    """Of each class ``max(1, int(size * n_c / n))`` rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    whole = F.broadcast(counts.agg(F.sum("__c").alias("__n")))  # one row
    take = counts.join(whole).select(label, F.greatest(F.lit(1), F.floor(F.lit(float(size)) * F.col("__c") / F.col("__n"))).alias("__take"))
    return first_by(df, spread(seed), WIDTH, take, (label,), TIES)


def _of_labels(df: DataFrame, n_pos: int, n_neg: int, seed: int) -> DataFrame:
    take = df.sparkSession.createDataFrame([(1, n_pos), (0, n_neg)], f"label {dict(df.dtypes)['label']}, __take long")
    return first_by(df, spread(seed), WIDTH, take, ("label",), TIES)


def positive_sample(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """At most a fifth positives, the rest negatives."""
    n_pos = min(df.where("label = 1").count(), max(1, size // 5))
    return _of_labels(df, n_pos, size - n_pos, seed)


def undersample(df: DataFrame, positive_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """All positives and so many negatives that positives are ``positive_ratio`` of the result."""
    n_pos = df.where("label = 1").count()
    return _of_labels(df, n_pos, math.floor(n_pos * (1 - positive_ratio) / positive_ratio + 1e-9), seed)


def class_weights(df: DataFrame) -> DataFrame:
    """n / (2 n_c), and the ratio of negatives to positives where there are positives."""
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    neg = F.col("n") - F.col("pos")
    return one.select(F.col("pos").alias("n_positive"), neg.alias("n_negative"), F.try_divide(F.col("n").cast("double"), 2 * neg).alias("weight_0"), F.try_divide(F.col("n").cast("double"), 2 * F.col("pos")).alias("weight_1"), F.try_divide(neg.cast("double"), F.col("pos")).alias("pos_weight"))


def weighted(df: DataFrame) -> DataFrame:
    w = class_weights(df).select("weight_0", "weight_1")
    return df.join(F.broadcast(w)).withColumn("weight", F.when(F.col("label") == 1, F.col("weight_1")).otherwise(F.col("weight_0"))).drop("weight_0", "weight_1")


def neighbours(pos: DataFrame, k: int, lines: int, reach: int, seed: int) -> DataFrame:
    """``(nth, r, x, o)``: up to ``k`` near others of each row of ``pos`` (nth, x), r from 1. Rows are put in the order of their
    projections on several random lines; those within ``reach`` places on any of them are compared, so the
    work is in proportion to the rows."""
    rng = random.Random(seed)
    size = len(pos.select("x").first()["x"])
    found = []
    for _ in range(lines):
        line = F.array(*(F.lit(rng.gauss(0, 1)) for _ in range(size)))
        placed = ranked(pos.withColumn("on", F.aggregate(F.zip_with("x", line, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)), ["on", "nth"], "place")
        steps = F.explode(F.array(*(F.lit(d) for d in range(-reach, reach + 1) if d)))
        near = placed.withColumn("step", steps).withColumn("at", F.col("place") + F.col("step")).alias("a").join(placed.alias("b"), F.col("at") == F.col("b.place"))
        found.append(near.select(F.col("a.nth").alias("nth"), F.col("a.x").alias("x"), F.col("b.nth").alias("other"), F.col("b.x").alias("o")))
    every = reduce(DataFrame.unionByName, found).dropDuplicates(["nth", "other"])
    gap = F.aggregate(F.zip_with("x", "o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    rank = F.row_number().over(W.partitionBy("nth").orderBy("gap", "other"))
    return every.withColumn("gap", gap).withColumn("r", rank).where(F.col("r") <= k).select("nth", "r", "x", "o")


def smote(df: DataFrame, columns: list[str], positive_ratio: float = 0.5, k: int = 5, seed: int = 42, lines: int = 4, reach: int = 12) -> DataFrame:
    """Synthetic positives between a positive and one of its ``k`` nearest, up to the ratio; no change if there are under
    two positives or the ratio is reached.

    Each positive makes its share of the synthetic rows, the first ones one more, so no order over all is needed.
    Neighbours are the nearest among those beside it on random ``lines`` (exact where positives are few).
    """
    own = df.where("label = 1").select(F.xxhash64("user_id", "item_id").alias("h"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    n_pos, n = own.count(), df.count()
    need = int((n - n_pos) * positive_ratio / (1 - positive_ratio)) - n_pos
    if n_pos < 2 or need <= 0:
        return df
    pos = written(ranked(own, ["h", "x"], "nth").drop("h"), "positives")
    near = written(neighbours(pos, min(k, n_pos - 1), lines, reach, seed), "neighbours")
    known = near.groupBy("nth").agg(F.count("*").alias("k"))
    share = F.lit(need // n_pos) + (F.col("nth") <= need % n_pos).cast("int")
    copies = known.withColumn("c", F.explode(F.sequence(F.lit(1), share))) if need >= n_pos else known.where(F.col("nth") <= need).withColumn("c", F.lit(1))
    made = copies.withColumn("r", (F.pmod(F.xxhash64("nth", "c", F.lit(seed)), F.col("k")) + 1).cast("int")).join(near, ["nth", "r"])
    u = F.pmod(F.xxhash64("c", "nth", F.lit(seed + 1)), F.lit(1_000_000)) / 1e6
    new = made.withColumn("u", u).withColumn("n", F.zip_with("x", "o", lambda a, b: a + F.col("u") * (b - a)))
    kinds = dict(df.dtypes)
    value = lambda c: F.lit(1) if c == "label" else F.get("n", F.lit(columns.index(c))) if c in columns else F.lit(None)
    rows = new.select(*(value(c).cast("double" if c in columns else kinds[c]).alias(c) for c in df.columns))
    return df.withColumns({c: F.col(c).cast("double") for c in columns}).unionByName(rows)
