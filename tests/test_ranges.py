"""Positions, running sums, samples and quantiles by ranges, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.operators import features, filters, inference, labels, models, preprocess, ranges, sampling, selection
from basketwise.sources import files, scratch

from .test_behaviour import log, scored, values


def table(spark, n=500, seed=1):
    """Groups of very different sizes, one of them null, values full of ties."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a"] * 20 + ["b", None]), rng.randrange(40), i, rng.randrange(3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v int, id long, w long").repartition(6)


def test_positions_in_groups_and_in_all(spark):
    rows, df = table(spark)
    for keys in ((), ("g",)):
        want, sizes = {}, {}
        for g, v, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
            k = g if keys else 0
            want[i] = sizes[k] = sizes.get(k, 0) + 1
        got = ranges.ranked(df, ["v", "id"], "at", keys, "n").collect()
        assert {r["id"]: r["at"] for r in got} == want
        assert all(r["n"] == sizes[r["g"] if keys else 0] for r in got)
    assert ranges.ranked(df.limit(0), ["v"], "at", ("g",)).count() == 0


def test_running_sums_from_the_highest(spark):
    rows, df = table(spark)
    got = {r["id"]: (r["upto"], r["whole"]) for r in ranges.running(df, [F.desc("v"), "id"], {"upto": "w"}, {"whole": "w"}, ("g",)).collect()}
    sums: dict = {}
    want = {}
    for g, v, i, w in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[i] = sums[g] = sums.get(g, 0) + w
    assert got == {i: (want[i], sums[g]) for g, _, i, _ in rows}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_first_of_each_group(spark, buckets):
    rows, df = table(spark)
    take = spark.createDataFrame([("a", 100), ("b", 10_000)], "g string, __take long")
    got = sorted(r["id"] for r in ranges.first_by(df, F.col("v"), 40, take, ("g",), ["id"], buckets).collect())
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == sorted([r[2] for r in order if r[0] == "a"][:100] + [r[2] for r in order if r[0] == "b"])


def test_quantiles_are_exact(spark):
    rows, df = table(spark)
    shares = [0.0, 0.1, 0.25, 0.5, 2 / 3, 1.0]
    got = {(r["g"], r["column_name"], r["share"]): r["value"] for r in ranges.quantiles(df, ["v", "w"], shares, ("g",)).collect()}
    for g in ("a", "b", None):
        for c, at in (("v", 1), ("w", 3)):
            for s in shares:
                assert abs(got[g, c, s] - np.quantile([r[at] for r in rows if r[0] == g], s)) < 1e-9
    one = ranges.quantile_row(df, {"mid": ("v", 0.5), "low": ("w", 0.25)}).first()
    assert abs(one["mid"] - np.median([r[1] for r in rows])) < 1e-9
    assert ranges.quantile_row(df.limit(0), {"mid": ("v", 0.5)}).first()["mid"] is None


def test_plans_have_no_single_task(spark):
    """Neither scores, entities nor large strata go to one task; what does has a row a range."""
    df = scored(spark)
    placed = ranges.ranked(df, ["score", "user_id"], "at")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    big = [x for x in plan.split("\n") if "Window" in x and "__m" in x and "sum(__n" not in x]
    assert not big


def test_neighbours_are_near(spark):
    rng = random.Random(2)
    points = [(i + 1, [rng.random(), rng.random()]) for i in range(60)]
    pos = spark.createDataFrame(points, "nth long, x array<double>")
    got = sampling.neighbours(pos, 3, 6, 12, 1).collect()
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    exact = {i: sorted(gap(x, y) for j, y in points if j != i)[:3] for i, x in points}
    hits = sum(gap(r["x"], r["o"]) <= exact[r["nth"]][-1] + 1e-12 for r in got)
    assert len(got) == 180 and hits / 180 > 0.9
    few = sampling.neighbours(pos.where("nth <= 8"), 3, 2, 12, 1).collect()
    assert len(few) == 24  # few enough for all to meet


def test_batch_inference_of_unseen_pairs(spark):
    rows = [(u, i, 1 + (u * i) % 4, (u * 7 + i * 3) % 200) for u in range(14) for i in range(9) if (u + i) % 3]
    df = log(spark, rows)
    columns = ["user_pv_count", "item_pv_count", "item_decay_slope", "user_avg_interval_hours", "item_category_te"]
    parameters, model = inference.fitted(features.wide_table(df), labels.window_labels(df).withColumn("label", F.pmod("item_id", F.lit(2)).cast("int")), columns)
    raw = df.unionByName(df.withColumn("behavior_type", F.lit(5)))
    candidates = spark.createDataFrame([(0, 0, None), (1, 1, None), (99, 2, None), (3, 777, None), (1, 1, None)], "user_id long, item_id long, item_category int")
    got, lost = inference.inferred(raw, candidates, parameters, model, columns, 0.5)
    assert values(got, "user_id", "item_id") == [(0, 0), (1, 1), (99, 2)] and values(lost, "user_id", "item_id") == [(3, 777)]
    assert all(0 <= r["purchase_probability"] <= 1 and r["predicted_label"] == (r["purchase_probability"] >= 0.5) for r in got.collect())
    # a seen pair has the features that it was fitted with
    wide = preprocess.served(features.wide_table(df), parameters, columns).where("user_id = 1 and item_id = 1").first()
    again = preprocess.served(features.wide_table(df, targets=candidates.where("user_id = 1").withColumn("item_category", F.lit(1)).distinct()), parameters, columns).first()
    assert all(abs(wide[c] - again[c]) < 1e-9 for c in columns)
    with pytest.raises(ValueError):
        inference.inferred(raw, candidates.withColumn("item_category", F.lit(55)), parameters, model, columns, 0.5)


def test_selection_and_projection(spark):
    df = scored(spark).withColumns({"flat": F.lit(1.0), "twin": F.col("x") * 2 + 1, "noise": F.rand(3)})
    table_, report = selection.select_features(df, ["x", "y", "flat", "twin", "score"], "label")
    assert report["low_variance"] == ["flat"] and len(set(report["correlated"]) & {"x", "twin"}) <= 1
    assert not {"x", "twin"} <= set(report["final"]) and table_.columns == ["user_id", "item_id", *report["final"], "label"]
    assert selection.correlated_drops([("a", "b", 0.99), ("a", "c", -0.97), ("b", "c", 0.2)], {"a": 1.0, "b": 2.0, "c": 0.5}) == ["a"]
    told = {r["column_name"]: r["importance"] for r in selection.l1_importance(df.withColumn("told", F.col("label") * 2.0 + F.col("noise")), ["told", "noise"], "label").collect()}
    assert told["told"] > told["noise"]
    assert filters.numeric_columns(df, df.select("x", "label"), exclude=("label",)) == ["x"]
    assert dict(filters.downcast(df).dtypes)["x"] == "float"
    assert files.iter_batches(df, ["x"], 7).count() == 7


def test_models_prefer_what_tells(spark):
    df = scored(spark).withColumn("told", F.col("label") + F.col("x") / 20)
    counts = models.with_folds(df, "label", 4).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in counts)
    assert models.grid_search(df, ["told"], "label", (0.001, 10.0), 3)[0]["f1"] > 0.9
    best = models.tune(df, df, ["told"], "label", ((3, 2), (1, 1)))
    assert best[0]["average_precision"] >= best[1]["average_precision"] > 0.9


def test_scratch_is_cleared(spark):
    df = scratch.written(spark.range(3), "x")
    assert df.count() == 3 and scratch.own_dir(spark).startswith(scratch.shared_dir(spark))


def test_neighbours_in_groups_and_in_all(spark):
    rows, df = table(spark)
    for keys in ((), ("g",)):
        got = {r["id"]: (r["earlier"], r["later"]) for r in ranges.neighbours(df, ["v", "id"], {"earlier": "w"}, {"later": "id"}, keys).collect()}
        groups: dict = {}
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            groups.setdefault(r[0] if keys else 0, []).append(r)
        want = {}
        for own in groups.values():
            for i, r in enumerate(own):
                want[r[2]] = (own[i - 1][3] if i else None, own[i + 1][2] if i + 1 < len(own) else None)
        assert got == want
    assert ranges.neighbours(df.limit(0), ["v"], {"x": "w"}).count() == 0


def test_a_hot_user_is_no_single_task(spark):
    """Half of all events are one user's: no task of the windows holds more than a few ranges of them."""
    from basketwise.operators import clean, insights

    n = 40_000
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500 + 100).alias("user_id"), (F.col("id") % 20).alias("item_id"),
        (F.col("id") % 5).cast("int").alias("item_category"), (F.col("id") % 4 + 1).cast("int").alias("behavior_type"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 900).cast("timestamp_ntz").alias("time"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranges._dealt(df, ["time", "event_id"], ("user_id",))
        assert placed.groupBy("__p").count().agg(F.max("count")).first()[0] < n / 6
        got = insights.gaps(df).where("user_id = 7").agg(F.count("gap_seconds").alias("n"), F.min("gap_seconds").alias("low"), F.max("gap_seconds").alias("high")).first()
        assert tuple(got) == (n // 2 - 1, 1800, 1800)
        own = clean.gap_profile(df, df.where("user_id = 7").select("user_id").distinct()).first()
        assert (own["n_events"], own["mean_gap"], round(own["std_gap"], 6), own["n_hours"]) == (n // 2, 1800.0, 0.0, 24)
        assert insights.transitions(df).where("user_id = 7 and next_behavior = 0").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_threshold_of_information_lies_between_neighbours():
    values = [float(i) for i in range(24)]
    assert selection.interpolated(values, 0.25) == np.percentile(values, 25) == 5.75  # six of 24 lie below
    assert selection.interpolated([], 0.25) == 0 and selection.interpolated([3.0], 0.25) == 3.0
