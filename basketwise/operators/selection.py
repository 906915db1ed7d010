"""Feature selection; each step is one aggregation over the table and a small table of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import neighbours, quantiles, running
from .sampling import class_sample


def _long(one: DataFrame, columns: list[str], name: str) -> DataFrame:
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in columns))).alias("x")).select("x.*")


def variances(df: DataFrame, columns: list[str], least: float = 0.01) -> DataFrame:
    out = _long(df.agg(*(F.var_samp(F.col(c).cast("double")).alias(c) for c in columns)), columns, "variance")
    return out.withColumn("kept", F.col("variance") >= least)


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column, cut at its quantiles, with the target's classes. All columns
    share one aggregation of (column, bin, class), a table that doesn't grow with the rows."""
    cuts = [q / bins for q in range(1, bins)]
    found = quantiles(df, columns, cuts)
    edges = found.groupBy().agg(*(F.sort_array(F.collect_list(F.when(F.col("column_name") == c, F.col("value")))).alias(f"__{c}") for c in columns))
    wide = df.select(F.col(target).alias("__of_target"), *columns).join(F.broadcast(edges))
    bin_of = lambda c: F.size(F.filter(f"__{c}", lambda e: F.round(F.col(c).cast("double"), 6) > F.round(e, 6)))
    cells = wide.select("__of_target", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), bin_of(c).alias("b")) for c in columns))).alias("x")).groupBy("x.column_name", "x.b", "__of_target").count()
    n = F.sum("count").over(W.partitionBy("column_name"))
    share = cells.select("column_name", (F.col("count") / n).alias("p"), (F.sum("count").over(W.partitionBy("column_name", "b")) / n).alias("pb"), (F.sum("count").over(W.partitionBy("column_name", "__of_target")) / n).alias("py"))
    return share.groupBy("column_name").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pb") * F.col("py")))).alias("mi"))


def digamma(x: Column) -> Column:
    """The digamma function of positive numbers, to twelve digits: moved up by six, where its series is short."""
    y = x + 6
    series = F.ln(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 5 / (660 * y**10)
    return series - sum((1.0 / (x + i) for i in range(1, 6)), 1.0 / x)


#: Values are whole numbers of 2**-48 standard deviations, of which the low 18 bits are noise that tells equal values apart.
GRAIN, NOISE = 30, 18


def coded(df: DataFrame, columns: list[str], target: str, keys: tuple[str, ...]) -> DataFrame:
    """``(column_name, y, id, z)``: each cell as a whole number, so that distances are exact. The noise comes from a hash of the
    row's keys; nulls are left out."""
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = df.join(F.broadcast(one))

    def z(c: str) -> Column:
        unit = (F.col(c).cast("double") - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
        return F.round(unit * 2**GRAIN).cast("long") * 2**NOISE + F.pmod(F.xxhash64(*keys, F.lit(c)), F.lit(2**NOISE))

    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), z(c).alias("z")) for c in columns)))
    return wide.select(F.col(target).alias("y"), F.xxhash64(*keys).alias("id"), cells.alias("x")).select("x.column_name", "y", "id", "x.z").where("z is not null")


def neighbour_information(df: DataFrame, columns: list[str], target: str, keys: tuple[str, ...] = ("user_id", "item_id"), k: int = 3, most: int = 200_000) -> DataFrame:
    """``(column_name, mi)``: mutual information (nats) of each column with a target's classes, by nearest neighbours.

    A cell's ``k``-th neighbour within its class is one of the ``k`` before and after it in order; how many cells of all classes
    lie nearer is the difference of two positions. Both come from ranges of the order, so no task holds a column or
    compares pairs. Classes of one row are left out. Of more than ``most`` rows a sample by class is taken, as the estimate
    needs no more; ``keys`` tell rows apart.
    """
    df = class_sample(df, most, target) if df.count() > most else df
    classes = df.groupBy(F.col(target).alias("y")).agg(F.count("*").alias("of_class")).where("of_class > 1")
    cells = written(coded(df, columns, target, keys).join(F.broadcast(classes), "y"), "cells")
    own, names = cells, []
    for i in range(1, k + 1):
        own = neighbours(own, ["z", "id"], {f"b{i}": f"b{i - 1}" if i > 1 else "z"}, {f"a{i}": f"a{i - 1}" if i > 1 else "z"}, ("column_name", "y"))
        names += [F.col("z") - F.col(f"b{i}"), F.col(f"a{i}") - F.col("z")]
    gaps = F.sort_array(F.filter(F.array(*names), lambda x: x.isNotNull()))
    own = written(own.select("column_name", "y", "id", "z", "of_class", F.get(gaps, F.least(F.lit(k), F.col("of_class") - 1).cast("int") - 1).alias("reach")), "reach")
    # at equal places the upper end stands before cells, the lower one after them: both leave out what lies at the full distance
    mark = lambda place, kind, w: own.select("column_name", "y", "id", place.alias("place"), F.lit(kind).alias("kind"), F.lit(w).cast("long").alias("w"))
    marks = mark(F.col("z"), 1, 1).unionByName(mark(F.col("z") - F.col("reach"), 2, 0)).unionByName(mark(F.col("z") + F.col("reach"), 0, 0))
    placed = running(marks, ["place", "kind"], {"upto": "w"}, keys=("column_name",)).where("kind != 1")
    inside = F.sum(F.when(F.col("kind") == 0, F.col("upto")).otherwise(-F.col("upto")))
    near = placed.groupBy("column_name", "y", "id").agg(F.greatest(inside, F.lit(1)).alias("m")).join(F.broadcast(classes), "y")
    used = F.least(F.lit(k), F.col("of_class") - 1).cast("double")
    one = near.groupBy("column_name").agg(F.count("*").alias("n"), F.avg(digamma(used) - digamma(F.col("of_class").cast("double")) - digamma(F.col("m").cast("double"))).alias("rest"))
    return one.select("column_name", F.greatest(digamma(F.col("n").cast("double")) + F.col("rest"), F.lit(0.0)).alias("mi"))


def correlation(a, b):
    """Pearson's r; null where a side doesn't vary."""
    a, b = a.cast("double"), b.cast("double")
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)`` of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def correlated_drops(table: list[tuple[str, str, float]], mi: dict[str, float], most: float = 0.95) -> list[str]:
    """Columns to drop, in the order of the table: of two that correlate the one with less information (the
    second of equals), unless one is gone already."""
    gone: list[str] = []
    for a, b, r in table:
        if r is not None and abs(r) > most and a not in gone and b not in gone:
            gone.append(a if mi.get(a, 0) < mi.get(b, 0) else b)
    return gone


def interpolated(values: list[float], share: float) -> float:
    """The quantile of a few values, between neighbours where it falls there."""
    values = sorted(values) or [0.0]
    at = share * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def select_features(df: DataFrame, columns: list[str], target: str, information=mutual_information) -> tuple[DataFrame, dict]:
    """The table with the columns that pass all three filters, and a report. ``information`` is ``mutual_information``, by bins, or
    ``neighbour_information``."""
    first = [r["column_name"] for r in variances(df, columns).where("kept").collect()]
    first = [c for c in columns if c in first]
    mi = {r["column_name"]: r["mi"] for r in information(df, first, target).collect()}
    floor = interpolated(list(mi.values()), 0.25)
    second = [c for c in first if mi[c] >= floor]
    drops = correlated_drops([(r["a"], r["b"], r["r"]) for r in correlations(df, second).collect()], mi) if len(second) > 1 else []
    kept = [c for c in second if c not in drops]
    report = {"n_input": len(columns), "low_variance": [c for c in columns if c not in first], "low_information": [c for c in first if c not in second], "correlated": drops, "top_information": sorted(mi, key=lambda c: -mi[c])[:10], "final": kept}
    return df.select("user_id", "item_id", *kept, target), report


def rank_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str, ks: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """How many columns are among the first k of both rankings (tables of one row a column)."""
    ranked = lambda df, by, name: df.select("column_name", F.row_number().over(W.orderBy(F.round(by, 6).desc(), "column_name")).alias(name))
    both = ranked(a, a_col, "ra").join(ranked(b, b_col, "rb"), "column_name")
    return reduce(DataFrame.unionByName, [both.agg(F.lit(k).alias("k"), F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)).alias("n_shared")) for k in ks])


def l1_importance(df: DataFrame, columns: list[str], target: str, reg: float = 0.01) -> DataFrame:
    """|coefficient| of a balanced L1 logistic model on standardised columns (ids are no features)."""
    from ..operators.models import fit_logistic

    model, _ = fit_logistic(df, columns, target, reg, 1.0)
    return df.sparkSession.createDataFrame([(c, float(abs(x)), bool(x == 0)) for c, x in zip(columns, model.coefficients.toArray())], "column_name string, importance double, zeroed boolean")
