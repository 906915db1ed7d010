import math

import numpy as np
import pytest

from basketwise.llm import queries
from basketwise.llm.whitening import deviations, whitened


def brute(vectors, once=False, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.unique(x.astype(np.int64), axis=0) if once else x.astype(np.int64)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    w = (x.astype(float) - s / n) @ vector / np.sqrt(value)
    return n, [int(((n * r - s) ** 2).sum()) for r in x], w, value / np.trace(v)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def compare(got, ids, vectors, once=False):
    n, deviation, w, share = brute(vectors, once)
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, w.shape[1] + 1))
    for k, rows in by.items():
        own = np.array([rows[i]["whitened"] for i in ids])
        sign = np.sign(own @ w[:, k - 1])
        assert np.abs(own - sign * w[:, k - 1]).max() < 1e-6
        assert [rows[i]["deviation"] for i in ids] == deviation
        assert {(r["n"], round(r["explained"] / share[k - 1], 6)) for r in rows.values()} == {(n, 1.0)}
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-8


@pytest.mark.parametrize("size", [3, 40])
@pytest.mark.parametrize("weights", ["count", "one"])
def test_equals_brute_force(spark, size, weights):
    rng = np.random.default_rng(size)
    vectors = rng.normal(size=(90, size)).astype(np.float32) * np.linspace(1, 9, size, dtype=np.float32)
    vectors = [*vectors.tolist(), *([vectors[0].tolist()] * 60)]  # one vector has 61 of 150 rows
    ids = list(range(150))
    rows = list(zip(ids, vectors)) + [(200, None), (201, [None] + [1.0] * (size - 1)), (202, [float("nan")] * size), (203, [float("-inf")] * size)]
    compare(whitened(table(spark, rows), weights=weights).collect(), ids, vectors, weights == "one")


def test_odd_tables(spark):
    assert whitened(table(spark, [])).count() == 0
    assert whitened(table(spark, [(1, None)])).count() == 0
    assert whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    flat = whitened(table(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (None, [2.0, 5.0])])).collect()  # one of two dimensions
    assert [r["component"] for r in flat] == [1] * 4 and len({abs(r["whitened"]) for r in flat}) == 2
    odd = table(spark, [(1, [1.0, 5.0]), (2, [2.0, 1.0])]).selectExpr("*", "1 AS id", "2 AS x", "3 AS n", "4 AS component", "5 AS w")
    assert whitened(odd).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError, match="several lengths"):
        whitened(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        whitened(table(spark, []), weights="other")


def test_deviations_are_exact_or_null():
    x = np.array([[1_000_000, 1_000_001]])
    assert deviations(x, [0, 0], 10**3) == [(10**9) ** 2 + (1_000_001_000) ** 2]
    assert deviations(x, [0, 0], 10**6) == [None]
    assert deviations(x, [10**15, 10**15], 10**9) == [10**18]
    assert deviations(np.array([[2**58]]), [2**60 - 3], 4) == [9]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    compare(queries.op13_whitening(spark, path).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
