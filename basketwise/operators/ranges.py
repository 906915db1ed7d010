"""Positions and running sums in an order over all rows, or all rows of a few large groups, without a task that holds them.

Rows are dealt out by ranges of keys and order, so a group of any size is cut into as many ranges as it needs. The
sorted ranges are written once, with each row's place: what comes before a range is then known from one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def _dealt(df: DataFrame, order: list, keys: tuple[str, ...]) -> DataFrame:
    by = [*map(F.col, keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    # within a range the id counts rows one by one, above that it tells ranges apart
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    return written(placed, "ranges").withColumn("__p", F.shiftright("__m", 33))


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, k: x & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.col("a.__p") == F.col("b.__p"))


def ranked(df: DataFrame, order: list, name: str = "position", keys: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """``df`` with each row's position from 1 in its group's ``order`` and, if named, the group's ``size``."""
    part = _dealt(df, order, keys)
    runs = part.groupBy("__p", *keys).agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"__b": before, "__t": F.sum("__n").over(group)})
    out = part.alias("a").join(runs.alias("b"), _same(part, runs, keys))
    extra = [] if size is None else [F.col("__t").alias(size)]
    return out.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("__m") - F.col("__first") + F.col("__b") + 1).alias(name), *extra)


def running(df: DataFrame, order: list, sums: dict[str, str], totals: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with sums from a group's first row to each, the row included: ``sums`` and ``totals`` of whole groups name
    columns by result."""
    part = _dealt(df, order, keys)
    every = {**sums, **(totals or {})}
    runs = part.groupBy("__p", *keys).agg(*(F.sum(c).alias(f"__s_{n}") for n, c in every.items()))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)) for n in sums} | {f"__t_{n}": F.sum(f"__s_{n}").over(group) for n in totals or {}})
    here = W.partitionBy("__p", *keys).orderBy("__m").rowsBetween(W.unboundedPreceding, 0)
    own = part.withColumns({f"__r_{n}": F.sum(c).over(here) for n, c in sums.items()})
    out = own.alias("a").join(runs.alias("b"), _same(own, runs, keys))
    return out.select(*(F.col(f"a.{c}") for c in df.columns), *((F.col(f"__r_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums), *(F.col(f"__t_{n}").alias(n) for n in totals or {}))


def neighbours(df: DataFrame, order: list, before: dict[str, str] | None = None, after: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with values of the row before and of the row after in the group's ``order``: both name columns by result. They are
    null at a group's ends. A group of any size is cut into ranges, each known to the next by its first and last row."""
    before, after = before or {}, after or {}
    part = _dealt(df, order, keys)
    ends = [F.max_by(c, "__m").alias(f"__l_{n}") for n, c in before.items()] + [F.min_by(c, "__m").alias(f"__f_{n}") for n, c in after.items()]
    runs = part.groupBy("__p", *keys).agg(F.min("__m").alias("__first"), F.max("__m").alias("__last"), *ends)
    along = W.partitionBy(*keys).orderBy("__p")
    runs = runs.withColumns({f"__b_{n}": F.lag(f"__l_{n}").over(along) for n in before} | {f"__a_{n}": F.lead(f"__f_{n}").over(along) for n in after})
    here = W.partitionBy("__p", *keys).orderBy("__m")
    own = part.withColumns({f"__r_{n}": F.lag(c).over(here) for n, c in before.items()} | {f"__s_{n}": F.lead(c).over(here) for n, c in after.items()})
    out = own.alias("a").join(runs.alias("b"), _same(own, runs, keys))
    left = (F.when(F.col("__m") == F.col("__first"), F.col(f"__b_{n}")).otherwise(F.col(f"__r_{n}")).alias(n) for n in before)
    right = (F.when(F.col("__m") == F.col("__last"), F.col(f"__a_{n}")).otherwise(F.col(f"__s_{n}")).alias(n) for n in after)
    return out.select(*(F.col(f"a.{c}") for c in df.columns), *left, *right)


def first_by(df: DataFrame, spread: Column, width: int, take: DataFrame, keys: tuple[str, ...], ties: list[str], buckets: int = 4096) -> DataFrame:
    """Of each group the first ``take`` rows in the order of ``spread`` (0 to ``width``) and ``ties``. ``take`` has the keys and
    ``__take``; groups that it doesn't name give none.

    Counts by bucket of the spread tell where each group is cut. Rows below stay where they lie; only those of the
    bucket that the cut falls into are ranked.
    """
    placed = df.withColumns({"__s": spread, "__k": F.floor(spread * F.lit(buckets) / F.lit(width))})
    counts = placed.groupBy(*keys, "__k").agg(F.count("*").alias("__c"))
    cum = F.sum("__c").over(W.partitionBy(*keys).orderBy("__k").rowsBetween(W.unboundedPreceding, 0))
    reached = counts.withColumn("__cum", cum).join(take, list(keys)).where(F.col("__cum") - F.col("__c") < F.col("__take"))
    cut = written(reached.groupBy(*keys).agg(F.max("__k").alias("__cut"), F.max_by(F.col("__take") - F.col("__cum") + F.col("__c"), "__k").alias("__left")), "cuts")
    met = placed.join(cut, list(keys))
    edge = ranked(met.where("__k = __cut"), ["__s", *ties], "__r", keys).where("__r <= __left")
    return met.where("__k < __cut").select(*df.columns).unionByName(edge.select(*df.columns))


def quantiles(df: DataFrame, columns: list[str], shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, column_name, share, value)``: exact quantiles, interpolated between neighbours, of several columns by group.
    Distinct values are counted and ranked by ranges, so no task holds a column."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns)))
    counts = df.select(*keys, cells.alias("x")).select(*keys, "x.*").where("value is not null").groupBy(*keys, "column_name", "value").agg(F.count("*").alias("c"))
    placed = running(counts, ["value"], {"upto": "c"}, {"n": "c"}, (*keys, "column_name"))
    wanted = placed.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    at = F.col("share") * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda i: (F.col("upto") - F.col("c") <= i) & (i < F.col("upto"))
    ends = wanted.where(holds(low) | holds(high)).groupBy(*keys, "column_name", "share").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.first(at - low).alias("f"))
    return ends.select(*keys, "column_name", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))


def quantile_row(df: DataFrame, named: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles, each ``name`` the ``(column, share)`` that it stands for; null of a column without values."""
    found = quantiles(df, sorted({c for c, _ in named.values()}), sorted({s for _, s in named.values()}))
    return found.agg(*(F.max(F.when((F.col("column_name") == c) & (F.col("share") == float(s)), F.col("value"))).alias(n) for n, (c, s) in named.items()))
