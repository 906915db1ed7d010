"""Row caps without a task that holds the rows, and tables laid out for their joins."""

import re

import pytest
from pyspark.sql import functions as F

from basketwise.operators import dims, labels, quality, ranges
from basketwise.plans import ORACLE_SQL, QUERIES, cleaning, evaluation
from basketwise.sources import files, logs
from basketwise.sources.scratch import written

from .oracle import assert_same, connect
from .test_serving import own_log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_exact_and_no_single_partition(spark, tmp_path):
    spark.range(0, 1_200_000, 1, 12).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for n in (0, 1, 99_999, 100_000, 1_000_000, 1_200_000, 5_000_000):
        got = files.first_rows(df, n)
        assert got.agg(F.count("*"), F.count_distinct("id")).first()[0] == min(n, 1_200_000)
    capped = files.first_rows(df, 1_000_000)
    assert "SinglePartition" not in plan(capped) and "Limit" not in plan(capped) and capped.columns == ["id"]
    assert {r["id"] for r in files.first_rows(df, 300_000).collect()} <= {r["id"] for r in files.first_rows(df, 300_001).collect()}
    df.write.parquet(f"{tmp_path}/u.parquet")
    assert files.read_table(spark, f"{tmp_path}/u.parquet", 77).count() == 77
    assert files.first_rows(df.where("id < 0"), 5).count() == 0


def test_buckets_of_users_join_where_they_lie(spark, tmp_path):
    log = own_log(spark, 300)
    own = files.bucketed(log, "user_id", 4, f"{tmp_path}/log")
    other = files.bucketed(own.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", 4, f"{tmp_path}/users")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users = dims.user_funnel(dims.pairs(own)).join(other, "user_id")
        assert "Exchange" not in plan(users) and "Join" in plan(users)
        assert users.count() == log.select("user_id").distinct().count()
        assert "Exchange" in plan(dims.user_funnel(dims.pairs(log)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_buckets_grow_with_the_log(spark):
    """a bucket is one task of what is computed by user, so there are more of them in a larger log, not larger ones."""
    assert files.buckets_for(1) == 8 and files.buckets_for(4_000_001) == 9 and files.buckets_for(216_000_000) == 432
    log = logs.log_o_by_user(spark, "/root/testdata/sf0.001", rows=250)
    users = dims.user_dim(log)
    n = log.count()
    held = log.groupBy(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1).alias("bucket")).count().collect()
    assert len(held) > 8 and max(r["count"] for r in held) < n / 8
    assert "Exchange" not in plan(dims.user_funnel(dims.pairs(log)))
    assert users.count() == logs.log_o(spark, "/root/testdata/sf0.001").select("user_id").distinct().count()


def test_the_audited_log_is_joined_once(spark):
    """nothing of the audit reads order lines again; what it reads is written."""
    text = cleaning._sample_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in text and "o_custkey" not in text and "user_id" in text


def test_labels_in_buckets_are_the_same(spark, tmp_path):
    """labels of a log in buckets of users need no exchange; rows with nulls are labelled alike."""
    log = own_log(spark, 600)
    n = F.col("user_id") * 7 + F.col("item_id")
    log = log.withColumns({"time": F.when(n % 11 != 3, F.col("time")), "behavior_type": F.when(n % 13 != 5, F.col("behavior_type")), "item_category": F.when(n % 5 != 2, F.col("item_category"))})
    own = labels.colocated_labels(files.bucketed(log, "user_id", 8, f"{tmp_path}/log"))
    assert "Exchange" not in plan(own)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(labels.window_labels(log))
    assert rows(own) == want and rows(labels.colocated_labels(log)) == want and len({r["label"] for r in own.collect()}) == 2


@pytest.mark.parametrize("name", ["EV17_error_profile_orders", "EV20_contributions_orders", "EV5_threshold_sweep_orders", "EV2_EV3_ranking_orders"])
def test_scores_of_orders_are_made_in_buckets(spark, monkeypatch, name):
    """F3 to F6: pairs and users of the order log meet where they lie, and pairs aren't sorted to meet items."""
    monkeypatch.setattr(ranges, "written", lambda df, _: df)  # the whole plan, not what follows a written table
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(user_id" not in text and "SortMergeJoin [item_id" not in text and "bucketed_" in text


def test_lines_meet_items_in_as_many_partitions(spark):
    """items too large to broadcast meet lines in as many partitions as there are buckets, not in the session's few."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = logs.log_o(spark, "/root/testdata/sf0.001", 20)
        dealt = re.findall(r"hashpartitioning\((\w+?)#\d+L?, (\d+)\)", plan(log))
        assert set(dealt) == {(key, "20") for key in ("l_orderkey", "o_orderkey", "l_partkey", "p_partkey")}
        assert log.exceptAll(logs.log_o(spark, "/root/testdata/sf0.001")).count() == 0 and log.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["EV5_threshold_sweep_orders", "EV2_EV3_ranking_orders", "EV20_contributions_orders"])
def test_items_of_orders_are_counted_bucket_by_bucket(spark, monkeypatch, name):
    """items are counted once, from a bucket's pairs a task; by splits of files a task would hold all items that a split has."""
    monkeypatch.setattr(files, "buckets_for", lambda n, rows: 20)
    counted = []
    monkeypatch.setattr(evaluation, "written", lambda df, to: counted.append(df) or written(df, to), raising=False)
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(counted) == 1 and "Bucketed: true" in plan(counted[0])
    assert "Bucketed: false" not in plan(df)
    assert_same(df, connect("/root/testdata/sf0.001"), ORACLE_SQL[name])


def test_sample_audit_finds_a_wrong_field(spark):
    log = own_log(spark, 400).cache()
    pair = dims.pairs(log)
    tables = {"user": dims.user_dim(log), "item": dims.item_dim(pair), "category": dims.category_dim(pair), "day": dims.time_dim(log, "daily")}
    power = log.where("user_id < 9").select("user_id").distinct()
    chosen = quality.representatives(tables, power)
    told = {(r["kind"], r["role"]) for r in chosen.collect()}
    assert {("user", "power"), ("item", "hot"), ("category", "hot"), ("day", "first"), ("day", "middle"), ("day", "last")} <= told
    assert quality.sample_audit(log, tables, chosen).where("not matches").count() == 0
    tables["item"] = tables["item"].withColumn("buy_user_count", F.col("buy_user_count") + 1)
    wrong = quality.sample_audit(log, tables, chosen).where("not matches").collect()
    assert wrong and {(r["kind"], r["field"]) for r in wrong} == {("item", "buy_user_count")}
