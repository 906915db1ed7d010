"""Contributions of features to the margin of boosted trees.

Within a tree a leaf's part of the expected value, given what is known of a row, is a product over the features on its path: 1 or 0
where a known feature leads there or not, the share of training rows that go there where it isn't known. Shapley values of
a product have a closed form, and a row's features on a path are a few bits: a table of each leaf, one row for each pattern of bits,
holds all contributions, and rows only look them up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import own_dir


@dataclass(frozen=True)
class Leaf:
    """``tests``: for each node on the path its feature, the set of values or the bound that leads left, whether the path goes left,
    and the place of its feature among ``features``. ``table[bits]``: each feature's contribution."""

    value: float
    features: list[int]
    tests: list[tuple[int, object, bool, int]]
    shares: list[float]
    table: np.ndarray


def product_table(value: float, shares: list[float]) -> np.ndarray:
    """Shapley values of ``value`` times a product over m features, each 1 or 0 (the bit) where known and its share where not:
    a row a pattern of bits, a column a feature."""
    m = len(shares)
    bits = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    out = np.zeros((1 << m, m))
    for i in range(m):
        # of the other features: coefficients, by how many are known, of the product of (share + bit t)
        parts = np.zeros((1 << m, m))
        parts[:, 0] = 1.0
        for j in range(m):
            if j != i:
                parts[:, 1:] = parts[:, 1:] * shares[j] + parts[:, :-1] * bits[:, j : j + 1]
                parts[:, 0] *= shares[j]
        weights = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
        out[:, i] = value * (bits[:, i] - shares[i]) * (parts @ weights)
    return out


def leaves_of(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    """The leaves of one tree of ``nodes`` by id, their values times ``weight``."""
    out = []

    def walk(at: int, path: list[tuple[int, object, bool, float]]) -> None:
        node = nodes[at]
        if node["leftChild"] < 0:
            features = sorted({f for f, _, _, _ in path})
            shares = [math.prod(s for f, _, _, s in path if f == g) for g in features]
            value = weight * node["prediction"]
            out.append(Leaf(value, features, [(f, rule, left, features.index(f)) for f, rule, left, _ in path], shares, product_table(value, shares)))
            return
        split = node["split"]
        codes = split["leftCategoriesOrThreshold"]
        rule = float(codes[0]) if split["numCategories"] < 0 else frozenset(map(float, codes))
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            walk(child, [*path, (split["featureIndex"], rule, left, nodes[child]["rawCount"] / node["rawCount"])])

    walk(0, [])
    return out


def leaves(spark: SparkSession, model) -> list[Leaf]:
    """All leaves of a fitted ensemble, read from its stored form: a table of nodes that the number of trees and their depth
    bound."""
    path = f"{own_dir(spark)}/trees-{model.uid}"
    model.write().overwrite().save(path)
    found: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        node = r["nodeData"].asDict(recursive=True)
        found.setdefault(r["treeID"], {})[node["id"]] = node
    return [leaf for t, nodes in sorted(found.items()) for leaf in leaves_of(nodes, model.treeWeights[t])]


def expected(every: list[Leaf]) -> float:
    """The margin where no feature is known."""
    return sum(x.value * math.prod(x.shares) for x in every)


def looked_up(x: np.ndarray, every: list[Leaf]) -> np.ndarray:
    """Contributions of each row and feature."""
    out = np.zeros(x.shape)
    known: dict[tuple, np.ndarray] = {}
    for leaf in every:
        bits = np.full((len(leaf.features), len(x)), True)
        for feature, rule, left, place in leaf.tests:
            if (feature, rule) not in known:
                known[feature, rule] = np.isin(x[:, feature], list(rule)) if isinstance(rule, frozenset) else x[:, feature] <= rule
            bits[place] &= known[feature, rule] == left
        if leaf.features:
            code = (bits * (1 << np.arange(len(leaf.features)))[:, None]).sum(0)
            out[:, leaf.features] += leaf.table[code]
    return out


def tree_contributions(df: DataFrame, model, columns: list[str], keep: tuple[str, ...] = ("user_id", "item_id", "label")) -> DataFrame:
    """A long table of (pair, feature): the part of each feature in the margin of a boosted model, on average over all orders in
    which features become known, each tree's unknown ones by the shares of its training rows. The parts of a pair and
    ``expected`` sum to the model's margin. Rows are independent: nothing shuffles, and tasks get the tables of leaves."""
    every = leaves(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(c), np.float64) for c in columns], 1)
            found = looked_up(x, every)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(columns), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "parts"])

    kinds = dict(df.dtypes)
    source = df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns if c not in keep))
    out = source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", parts array<double>")
    named = F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("parts").alias("contribution"))
    return out.select(*keep, F.explode(named).alias("x")).select(*keep, "x.feature", "x.contribution")
