"""Partials of any division of a log, stored models, and what a served run writes."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketwise.operators import dims, features, inference, labels
from basketwise.streaming import partials

from .test_behaviour import log

COLUMNS = ["user_pv_count", "item_pv_count", "user_streak_days", "item_decay_slope", "user_avg_interval_hours", "item_category_te"]


def own_log(spark, n=600, seed=4):
    rng = random.Random(seed)
    return log(spark, [(rng.randrange(20), rng.randrange(12), rng.choice([1, 1, 1, 2, 3, 4]), rng.randrange(24 * 20)) for _ in range(n)])


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rounded = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=repr)
    assert rounded(a) == rounded(b)


def test_any_division_gives_the_same_wide_table(spark, tmp_path):
    df = own_log(spark).cache()
    whole = features.wide_table(df)
    for turn, part in enumerate((F.lit(0), F.pmod(F.xxhash64("event_id"), F.lit(3)), F.pmod("user_id", F.lit(2)))):
        out = f"{tmp_path}/{turn}"
        for b in reversed(range(3)):  # in any order, and one batch twice
            partials.add(df.where(part == b), b, out)
        partials.add(df.where(part == 0), 0, out)
        merged = partials.finalize(spark, out)
        same(merged["days"], dims.user_days(df))
        same(partials.wide_table(merged), whole)
        targets = spark.createDataFrame([(1, 2, 2), (99, 3, 0), (4, 77, None)], "user_id long, item_id long, item_category int")
        same(partials.wide_table(merged, COLUMNS[:-1], targets), features.wide_table(df, COLUMNS[:-1], targets))


def test_partials_need_whole_hours(spark, tmp_path):
    odd = own_log(spark, 5).withColumn("time", F.col("time") + F.expr("interval 7 minutes"))
    with pytest.raises(Exception, match="whole hours"):
        partials.add(odd, 0, f"{tmp_path}/odd")
    dirty = own_log(spark, 50).withColumn("behavior_type", F.when(F.col("event_id") < 10, 9).otherwise(F.col("behavior_type"))).withColumn("time", F.when(F.col("event_id") >= 12, F.col("time")))
    partials.add(dirty, 0, f"{tmp_path}/dirty")
    assert partials.finalize(spark, f"{tmp_path}/dirty")["users"].agg(F.sum("n_events")).first()[0] == 38


def test_stored_model_and_run(spark, tmp_path):
    df = own_log(spark).cache()
    partials.add(df, 0, f"{tmp_path}/parts")
    merged = partials.finalize(spark, f"{tmp_path}/parts")
    path, fits = f"{tmp_path}/model", []

    def wide():
        fits.append(1)
        return partials.wide_table(merged)

    truth = lambda: labels.window_labels(df).withColumn("label", F.pmod("item_id", F.lit(2)).cast("int"))
    with pytest.raises(FileNotFoundError):
        inference.stored(spark, path)
    first = inference.stored_or_fitted(spark, path, COLUMNS, wide, truth, 0.4)
    again = inference.stored_or_fitted(spark, path, COLUMNS, wide, truth)
    assert fits == [1] and again.threshold == 0.4
    parameters, model = inference.fitted(partials.wide_table(merged), truth(), COLUMNS)
    candidates = df.select("user_id", "item_id").distinct().withColumn("item_category", F.lit(None).cast("int"))
    pairs, _, counts = inference.resolved(candidates, df)
    ready = partials.wide_table(merged, targets=pairs)
    same(inference.predicted(ready, again), inference.predicted(ready, inference.Stored(COLUMNS, parameters, model, 0.4)))
    same(inference.predicted(ready, first), inference.predicted(ready, again))
    assert counts["n_candidates"] == candidates.count() == counts["n_pairs"]
    for other in (COLUMNS[:-1], COLUMNS[::-1]):
        with pytest.raises(ValueError, match="other features"):
            inference.stored(spark, path, other)
    unknown = spark.createDataFrame([(1, 500, None), (2, 501, 3)], "user_id long, item_id long, item_category int")
    row = inference.run(merged, candidates.unionByName(unknown), again, f"{tmp_path}/out").first()
    assert (row["n_rejects"], row["n_predictions"], row["n_candidates"]) == (2, counts["n_pairs"], counts["n_pairs"] + 2)
    assert spark.read.csv(f"{tmp_path}/out/predictions.csv", header=True).count() == counts["n_pairs"]
    assert spark.read.csv(f"{tmp_path}/out/rejects.csv", header=True).count() == 2
    text = "".join(p.read_text() for p in Path(f"{tmp_path}/out/metadata.json").glob("part-*"))
    assert json.loads(text)["n_positive"] == row["n_positive"] <= row["n_predictions"]
    with pytest.raises(ValueError, match="unknown items"):
        inference.run(merged, unknown, again, f"{tmp_path}/none", "error")
    assert not Path(f"{tmp_path}/none").exists()
