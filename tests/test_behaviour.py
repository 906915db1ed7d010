"""Edge cases and properties of the behaviour-log operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.operators import clean, dims, features, filters, joins, labels, metrics, models, preprocess, sampling, selection, sequences
from basketwise.sources import files
from basketwise.streaming import partials

SCHEMA = "event_id long, user_id long, item_id long, item_category int, behavior_type int, time timestamp_ntz"
T0 = datetime.datetime(2025, 11, 18)


def log(spark, rows):
    """Rows of (user, item, behaviour, hours after the start)."""
    return spark.createDataFrame([(i, u, it, it % 3, b, T0 + datetime.timedelta(hours=h)) for i, (u, it, b, h) in enumerate(rows)], SCHEMA)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def crawler_rows():
    rows = [(100 + u, u % 5, 1 + u % 4, h) for u in range(40) for h in range(3)]
    rows += [(1, h % 5, 1, h) for h in range(48)]  # even, all hours
    rows += [(2, h % 5, 4 if h == 7 else 1, h) for h in range(48)]  # buys once
    rows += [(3, h % 5, 1, h + (100 * (h // 12))) for h in range(48)]  # uneven
    rows += [(4, h % 5, 1, 2 * h) for h in range(48)]  # twelve hours only
    return rows


def test_crawlers(spark):
    df = log(spark, crawler_rows())
    assert values(clean.outlier_users(df), "user_id") == [(1,), (2,), (3,), (4,)]
    assert values(clean.crawlers(df, clean.outlier_users(df)), "user_id") == [(1,)]
    flagged = clean.flagged_outliers(df)
    assert values(flagged.where("is_power_user").select("user_id").distinct(), "user_id") == [(2,), (3,), (4,)]


def test_category_conflict_and_missing_column(spark):
    df = log(spark, [(1, 1, 1, 0)])
    assert clean.check_categories(df) is df
    with pytest.raises(ValueError):
        clean.check_categories(df.unionByName(df.withColumn("item_category", F.lit(9))))
    with pytest.raises(ValueError):
        clean.essential_fields(df.drop("time"))
    assert clean.dropped_fields(df) == ["event_id"]


def test_label_window_edges(spark):
    rows = [(1, 1, 1, 0), (1, 1, 4, 0), (2, 1, 1, 0), (2, 1, 4, 1), (3, 1, 1, 0), (3, 1, 4, 168), (4, 1, 1, 0), (4, 1, 4, 169), (5, 1, 4, 0)]
    assert values(labels.window_labels(log(spark, rows)), "user_id", "label") == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_split_sizes(spark):
    for n, want in ((1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (5, (3, 1, 1)), (15, (10, 3, 2)), (25, (18, 5, 2))):
        df = spark.createDataFrame([("s", T0 + datetime.timedelta(hours=i), i, 0) for i in range(n)], "stratum string, last_time timestamp_ntz, user_id long, item_id long")
        got = {r["split"]: r["count"] for r in labels.stratified_split(df).groupBy("split").count().collect()}
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_streak_slope_and_rates(spark):
    df = log(spark, [(1, 1, 1, 24 * d) for d in (1, 2, 3, 7, 8)] + [(2, 2, 4, 0), (2, 3, 1, 0)])
    assert values(features.streak_days(df), "user_id", "user_streak_days") == [(1, 3), (2, 1)]
    assert {r["item_id"]: r["item_decay_slope"] for r in features.decay_slope(df).collect()}[2] is None
    assert values(dims.user_funnel(dims.pairs(df)), "user_id", "view_to_buy_rate") == [(1, 0.0), (2, 0.0)]


def test_svd_of_full_rank_is_the_heat(spark):
    rows = [(u, i, 1 + (u + i) % 4, 0) for u in range(4) for i in range(9) if (u * i) % 3 != 1]
    pair = dims.pairs(log(spark, rows))
    heat = pair.select("user_id", "item_id", sum(F.col(n) * features.WEIGHTS[b] for b, n in dims.COUNTS.items()).alias("heat"))
    cells = {(r["user_id"], r["item_id"]): float(r["heat"]) for r in heat.collect()}
    users, items = (sorted({k[i] for k in cells}) for i in (0, 1))
    matrix = np.array([[cells.get((u, i), 0.0) for i in items] for u in users])
    left, length, right = np.linalg.svd(matrix, full_matrices=False)
    for k, rounds in ((3, 30), (len(items), 2)):  # with all ranks the heat itself
        want = (left[:, :k] * length[:k]) @ right[:k]
        got = {(r["user_id"], r["item_id"]): r["svd_score"] for r in features.latent_scores(pair, k, rounds).collect()}
        assert got.keys() == cells.keys()
        top = max(abs(matrix).max(), 1.0)
        if k < len(items):
            assert all(abs(got[u, i] - want[users.index(u), items.index(i)]) < 1e-3 * top for u, i in got)
        else:
            assert sum((got[c] - cells[c]) ** 2 for c in cells) < 0.05 * sum(x * x for x in cells.values())


def scored(spark, n=400):
    rows = [(i, i % 7, int((i * 37) % 11 == 0), ((i * 31) % 97) / 97.0, float(i % 13), float((i * 5) % 17)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, item_id long, label int, score double, x double, y double")


def test_auc_and_precision_equal_brute_force(spark):
    df = scored(spark)
    rows = [(r["score"], r["label"]) for r in df.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    got = metrics.ranking(df).first()
    assert abs(got["roc_auc"] - auc) < 1e-9
    one = metrics.ranking(df.withColumn("label", F.lit(0))).first()
    assert one["roc_auc"] is None and one["average_precision"] is None


def test_smote_lies_between_neighbours(spark):
    df = scored(spark).select("user_id", "item_id", "label", "x", "y")
    out = sampling.smote(df, ["x", "y"], 0.4)
    n, pos = df.count(), df.where("label = 1").count()
    new = out.where("user_id is null").collect()
    assert len(new) == int((n - pos) * 0.4 / 0.6) - pos
    assert all(0 <= r["x"] <= 12 and 0 <= r["y"] <= 16 and r["label"] == 1 for r in new)
    assert sampling.smote(df.where("label = 0"), ["x", "y"]).count() == n - pos


def test_models_and_protocols(spark):
    df = scored(spark).withColumn("last_time", F.lit("2025-11-18").cast("timestamp_ntz")).withColumn("stratum", F.lit("s"))
    assert models.grid_search(df, ["x", "y"], "label", (0.1, 0.01), 2)[0]["f1"] >= 0
    oof = models.out_of_fold(df, ["x", "y"], "label", 2)
    assert oof.count() == df.count()
    assert len(models.stacked(oof, "label")[0].coefficients) == 2
    assert [m["method"] for m in models.compare_sampling(df, df, ["x", "y"], (1,))]
    assert 0 <= models.baseline_protocol(df, ["x", "y"], 200)["threshold"] <= 1
    assert models.tune(df, df, ["x", "y"], "label", ((2, 2),))[0]["rounds"] == 2
    assert selection.l1_importance(df, ["x", "y"], "label").count() == 2


def test_errors(spark):
    df = scored(spark)
    for bad in ([], [1.5]):
        with pytest.raises(ValueError):
            metrics.validated_thresholds(bad)
    assert metrics.chosen_threshold(None, None) == 0.5 and metrics.chosen_threshold(0.1, 0.2) == 0.1
    with pytest.raises(ValueError):
        sampling.two_level_sample(df.withColumn("stratum", F.lit("a")), 10_000)
    with pytest.raises(ValueError):
        filters.feature_matrix(df.withColumn("x", F.when(F.col("x") > 1, F.col("x"))), ["x"])
    with pytest.raises(ValueError):
        filters.numeric_columns(df, df.select("label"), exclude=("label",))
    with pytest.raises(ValueError):
        joins.aligned(df.select("user_id", "item_id", "label"), df.unionByName(df).select("user_id", "item_id", "label"))
    log_ = log(spark, [(1, 1, 1, 0)])
    with pytest.raises(ValueError):
        joins.target_pairs(spark.createDataFrame([(1, 5, None)], "user_id long, item_id long, item_category int"), log_)
    kept, lost = joins.target_pairs(spark.createDataFrame([(1, 5, None), (1, 1, None)], "user_id long, item_id long, item_category int"), log_, "reject")
    assert kept.count() == 1 and lost.count() == 1


def test_files(spark, tmp_path):
    df = log(spark, [(u, 1, 1, u) for u in range(30)])
    files.key_sorted_parquet(df, f"{tmp_path}/k.parquet", "user_id")
    assert files.read_table(spark, f"{tmp_path}/k.parquet", 5).count() == 5
    raw = df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH")).select("user_id", "item_id", "item_category", "behavior_type", "time")
    files.write_csv(raw, f"{tmp_path}/l.csv")
    back = files.read_log_csv(spark, f"{tmp_path}/l.csv")
    assert values(back, "user_id", "time") == values(df, "user_id", "time")
    files.run_metadata(spark, rows=3, threshold=0.5).write.json(f"{tmp_path}/m")
    with pytest.raises(ValueError):
        files.read_table(spark, "x.txt")
    wide = features.wide_table(df)
    first = preprocess.cached_parameters(spark, f"{tmp_path}/p", wide, ["user_pv_count"])
    assert first["scales"].count() == 1
    with pytest.raises(ValueError):
        preprocess.cached_parameters(spark, f"{tmp_path}/p", wide, ["item_pv_count"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, 1 + (u * i) % 5, u + i) for u in range(12) for i in range(8)]
    df = log(spark, rows)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        partials.finalize(spark, f"{tmp_path}/none")
    partials.start(spark, stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    merged = partials.finalize(spark, f"{tmp_path}/out")
    want = dims.pairs(clean.valid_behaviours(df))
    assert values(merged["pairs"], *want.columns) == values(want, *want.columns)
    assert spark.read.parquet(f"{tmp_path}/out/counts").agg(F.sum("n_rows")).first()[0] == len(rows)
    hourly = partials.hourly_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    hourly.awaitTermination()
    assert spark.table("hourly").agg(F.sum("pv_count")).first()[0] == sum(b == 1 for _, _, b, _ in rows)


def test_sequence_lengths(spark):
    rows = [(1, 1, 1, h) for h in range(60)] + [(2, 1, 1, h) for h in range(3)]
    samples = spark.createDataFrame([(1, 1, T0 + datetime.timedelta(hours=51)), (2, 1, T0), (3, 1, T0)], "user_id long, item_id long, last_time timestamp_ntz")
    got = {r["user_id"]: r for r in sequences.sequences(samples, log(spark, rows)).collect()}
    assert [got[u]["seq_len"] for u in (1, 2, 3)] == [50, 0, 0]
    assert len(got[3]["items"]) == 50 and set(got[3]["items"]) == {0}
