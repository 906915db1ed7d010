"""Mutual information by neighbours, successive halving, exact hours on a stream."""

import datetime
import math
import random

from pyspark.sql import functions as F

from basketwise.operators import dims, models, selection
from basketwise.streaming import partials

from .test_behaviour import T0, log, values


def digamma(x):
    out = 0.0
    while x < 30:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def brute_information(z, y, k=3):
    """Every pair of cells."""
    held = [c for c in set(y) if y.count(c) > 1]
    z, y = zip(*((a, b) for a, b in zip(z, y) if b in held))
    total = []
    for i in range(len(z)):
        own = sorted(abs(z[j] - z[i]) for j in range(len(z)) if j != i and y[j] == y[i])
        used = min(k, len(own))
        m = max(1, sum(abs(z[j] - z[i]) < own[used - 1] for j in range(len(z))))
        total.append(digamma(used) - digamma(len(own) + 1) - digamma(m))
    return max(0.0, digamma(len(z)) + sum(total) / len(total))


def test_neighbour_information_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        y = rng.choice([0] * 6 + [1] * 3 + [2])
        rows.append((i, i % 13, y, rng.gauss(y, 1), float(rng.randrange(4)), rng.gauss(0, 1) * 1e6, 7.0))
    rows += [(500, 1, 3, 0.5, 1.0, 2.0, 7.0), (501, 1, 4, 0.1, 1.0, 2.0, 7.0), (502, 1, 4, 0.3, 1.0, 2.0, 7.0)]  # a class of one row, one of two
    df = spark.createDataFrame(rows, "user_id long, item_id long, y int, a double, b double, c double, d double").repartition(5)
    columns = ["a", "b", "c", "d"]
    cells = selection.coded(df, columns, "y", ("user_id", "item_id")).collect()
    got = {r["column_name"]: r["mi"] for r in selection.neighbour_information(df, columns, "y").collect()}
    for c in columns:
        own = [(r["z"], r["y"]) for r in cells if r["column_name"] == c]
        assert abs(got[c] - brute_information(*map(list, zip(*own)))) < 1e-9, c
    assert got["a"] > 0.1 > got["c"]
    psi = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 7.0, 500.0)], "x double").select("x", selection.digamma(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - digamma(r["x"])) < 1e-11 for r in psi)


def test_halving_spends_rounds_on_good_settings(spark):
    rng = random.Random(5)
    rows = [(i, int(a + 0.3 * b > 0.2), a, b) for i, (a, b) in enumerate((rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300))]
    df = spark.createDataFrame(rows, "user_id long, label int, a double, b double").cache()
    train, val = df.where("user_id < 200"), df.where("user_id >= 200")
    grid = [{"depth": d, "step_size": s, "min_instances": m, "subsample": 1.0} for d, s, m in ((1, 0.05, 60), (3, 0.2, 1), (1, 0.1, 60), (4, 0.2, 1))]
    out = models.successive_halving(train, val, ["a", "b"], "label", grid, rounds=2, eta=2)
    assert [(r["rung"], r["rounds"]) for r in out] == [(0, 2)] * 4 + [(1, 4)] * 2 + [(2, 8)]
    assert {r["trial"] for r in out if r["rung"] == 1} == {r["trial"] for r in out[:2]}
    every = [models.successive_halving(train, val, ["a", "b"], "label", [g], rounds=8)[0]["average_precision"] for g in grid]
    assert out[-1]["average_precision"] >= max(every) - 1e-9
    assert len(models.drawn_settings(27)) == 27 and models.drawn_settings(3) == models.drawn_settings(27)[:3]


def test_hours_are_exact_and_late_events_counted(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((rng.randrange(5), rng.randrange(4), rng.randrange(1, 5), rng.randrange(60)) for _ in range(300)), key=lambda r: r[3])
    for i in range(3):
        log(spark, rows[i * 100 : (i + 1) * 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = log(spark, [(9, 9, 1, 0), (9, 9, 1, 1)])  # the watermark is past their hours
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    dropped = partials.stream_hours(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "3 hours")
    assert dropped >= 2
    got = spark.read.parquet(f"{tmp_path}/out")
    last = T0 + datetime.timedelta(hours=rows[-1][3])
    want = [r for r in dims.time_dim(log(spark, rows), "hourly").collect() if datetime.datetime.combine(r["date"], datetime.time(r["hour"])) + datetime.timedelta(hours=1) <= last - datetime.timedelta(hours=3)]
    columns = [*dims.COUNTS.values(), "unique_users", "unique_items"]
    named = got.select(F.to_date("start").alias("date"), F.hour("start").alias("hour"), *columns)
    assert values(named, "date", "hour", *columns) == sorted(tuple(r[c] for c in ("date", "hour", *columns)) for r in want)
