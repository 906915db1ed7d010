"""Contributions of trees against subset enumeration and the model's margin."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketwise.operators import models, trees

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(3)] + [float(rng.randrange(4))]
        rows.append((i, i % 7, int(x[0] + x[1] * x[2] + (x[3] == 2) + rng.gauss(0, 0.3) > 0), *x))
    return spark.createDataFrame(rows, "user_id long, item_id long, label int, a double, b double, c double, d double")


def value_given(nodes, at, x, known):
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    f, bound = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return value_given(nodes, node["leftChild"] if x[f] <= bound else node["rightChild"], x, known)
    return sum(nodes[c]["rawCount"] / node["rawCount"] * value_given(nodes, c, x, known) for c in (node["leftChild"], node["rightChild"]))


def enumerated(forest, weights, x):
    m = len(x)
    out = np.zeros(m)
    for nodes, w in zip(forest, weights):
        for i in range(m):
            for size in range(m):
                for s in itertools.combinations([j for j in range(m) if j != i], size):
                    share = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    out[i] += w * share * (value_given(nodes, 0, x, {*s, i}) - value_given(nodes, 0, x, set(s)))
    return out


@pytest.mark.parametrize("depth", [3, 5])
def test_sums_are_the_margin_and_parts_equal_enumeration(spark, depth):
    df = table(spark).cache()
    model = models.fit_boosted(df, COLUMNS, "label", rounds=4, depth=depth)
    every = trees.leaves(spark, model)
    got = {}
    for r in trees.tree_contributions(df, model, COLUMNS).collect():
        got.setdefault(r["user_id"], {})[r["feature"]] = r["contribution"]
    # the raw prediction of the positive class is the doubled margin
    raw = model.transform(models.assembled(df, COLUMNS)).select("user_id", *COLUMNS, vector_to_array("rawPrediction")[1].alias("raw")).collect()
    margin = {r["user_id"]: r["raw"] for r in raw}
    scale = 1.0
    total = {u: trees.expected(every) + sum(parts.values()) for u, parts in got.items()}
    ratio = [margin[u] / total[u] for u in total if abs(total[u]) > 1e-3]
    scale = round(float(np.median(ratio)))
    assert scale in (1, 2) and all(abs(scale * total[u] - margin[u]) < 1e-9 for u in total)
    found = {}
    for r in spark.read.parquet(f"{trees.own_dir(spark)}/trees-{model.uid}/data").collect():
        node = r["nodeData"].asDict(recursive=True)
        found.setdefault(r["treeID"], {})[node["id"]] = node
    forest = [found[t] for t in sorted(found)]
    for r in raw[:25]:
        want = enumerated(forest, model.treeWeights, [r[c] for c in COLUMNS])
        assert np.abs(np.array([got[r["user_id"]][c] for c in COLUMNS]) - want).max() < 1e-9


def test_categories_and_single_leaves():
    node = lambda i, left, right, value, n, split=None: {"id": i, "leftChild": left, "rightChild": right, "prediction": value, "rawCount": n, "split": split}
    split = {"featureIndex": 1, "leftCategoriesOrThreshold": [0.0, 2.0], "numCategories": 3}
    every = trees.leaves_of({0: node(0, 1, 2, 0.0, 10, split), 1: node(1, -1, -1, 4.0, 5), 2: node(2, -1, -1, -2.0, 5)}, 0.5)
    assert trees.expected(every) == 0.5
    assert trees.looked_up(np.array([[9.0, 0.0], [9.0, 1.0], [9.0, 2.0]]), every).tolist() == [[0, 1.5], [0, -1.5], [0, 1.5]]
    alone = trees.leaves_of({0: node(0, -1, -1, 3.0, 7)}, 1.0)
    assert trees.expected(alone) == 3 and not trees.looked_up(np.ones((2, 2)), alone).any()
