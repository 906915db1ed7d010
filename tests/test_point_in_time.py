"""Features as of a day know nothing of it or later; rates leave a row's own fold out."""

import datetime
import random

from pyspark.sql import functions as F

from basketwise.operators import dims, point_in_time

from .test_behaviour import T0, log
from .test_serving import own_log


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_equals_the_log_cut_off(spark):
    df = own_log(spark, 500).cache()
    for day in (3, 11, 25):
        cut = (T0 + datetime.timedelta(days=day)).date()
        known = df.where(F.to_date("time") < F.lit(cut))
        samples = df.select("user_id", "item_id").distinct().withColumn("as_of", F.lit(cut))
        got = {(r["user_id"], r["item_id"]): r for r in point_in_time.as_of_features(df, samples).collect()}
        users = {r["user_id"]: r for r in dims.user_dim(known).collect()}
        items = {r["item_id"]: r for r in dims.item_dim(dims.pairs(known)).collect()}
        pairs = {(r["user_id"], r["item_id"]): r for r in dims.pairs(known).collect()}
        assert len(got) == samples.count()
        for (u, i), r in got.items():
            for c in dims.COUNTS.values():
                assert r[f"user_{c}"] == (users[u][c] if u in users else 0)
                assert r[f"item_{c}"] == (items[i][c] if i in items else 0)
                assert r[f"pair_{c}"] == (pairs[u, i][c] if (u, i) in pairs else 0)
            assert r["user_active_days"] == (users[u]["active_days"] if u in users else 0)
            assert abs(r["user_view_to_buy_rate"] - (users[u]["view_to_buy_rate"] if u in users else 0)) < 1e-12
            assert abs(r["item_view_to_buy_rate"] - (items[i]["view_to_buy_rate"] if i in items else 0)) < 1e-12
            assert (r["user_hours_since_last"] is None) == (u not in users)


def test_later_events_leak_nothing(spark):
    df = own_log(spark, 300).cache()
    cut = (T0 + datetime.timedelta(days=9)).date()
    samples = df.select("user_id", "item_id").distinct().withColumn("as_of", F.lit(cut))
    late = F.to_date("time") >= F.lit(cut)
    other = df.withColumn("behavior_type", F.when(late, 4).otherwise(F.col("behavior_type"))).where(~late | (F.col("event_id") % 3 != 0))
    more = log(spark, [(u, i, 4, 24 * 9 + 1) for u in range(20) for i in range(12)])
    assert rows(point_in_time.as_of_features(df, samples)) == rows(point_in_time.as_of_features(other.unionByName(more), samples))
    assert point_in_time.as_of_features(df.limit(0), samples).where("user_pv_count > 0 or user_hours_since_last is not null").count() == 0


def test_own_fold_is_left_out(spark):
    rng = random.Random(8)
    data = [(i, rng.randrange(6), rng.randrange(3), rng.randrange(2)) for i in range(200)] + [(999, 77, 0, 1)]
    make = lambda d: spark.createDataFrame(d, "id long, k long, fold int, y int")
    got = {r["id"]: r["te"] for r in point_in_time.fold_encoded(make(data), {"te": "k"}, F.col("y")).collect()}
    for i, k, f, _ in data:
        own = [y for _, k2, f2, y in data if k2 == k and f2 != f] or [y for _, _, f2, y in data if f2 != f]
        assert abs(got[i] - sum(own) / len(own)) < 1e-12
    flipped = [(i, k, f, 1 - y if f == 1 else y) for i, k, f, y in data]
    again = {r["id"]: r["te"] for r in point_in_time.fold_encoded(make(flipped), {"te": "k"}, F.col("y")).collect()}
    assert all(again[i] == got[i] for i, _, f, _ in data if f == 1) and any(again[i] != got[i] for i, _, f, _ in data if f != 1)
