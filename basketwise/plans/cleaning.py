"""Cleaning, filters, sources and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean, dims, filters, quality
from ..sources import files, logs
from ..sources.scratch import own_dir, written
from .base import DAILY, DIM_CATEGORY, DIM_ITEM, DIM_USER, LOG_C, LOG_D, LOG_H, LOG_O, PAIR, RAW, events, over, rounded

TIMED = f"SELECT *, CASE WHEN event_id % 10 = 0 THEN 'x' WHEN event_id % 10 = 1 THEN strftime(ts, '%Y-%m-%d %H:30') ELSE strftime(ts, '%Y-%m-%d %H') END AS time_text FROM ({RAW.replace('SELECT event_id', 'SELECT ts, event_id')})"


def _timed(spark, d):
    """A raw log whose hours are text, some of them bad."""
    hour = F.date_format("time", "yyyy-MM-dd HH")
    n = F.col("event_id") % 10
    return logs.log_raw(spark, d).withColumn("time_text", F.when(n == 0, "x").when(n == 1, F.concat(hour, F.lit(":30"))).otherwise(hour))


def _crawler_log(spark, d):
    """The log and, for every event of the first hundred, an hourly run of views by one more user."""
    log = logs.log_h(spark, d)
    more = logs.log_raw(spark, d).where("event_id < 100").select("event_id", F.lit(-1).cast("long").alias("user_id"), "item_id", "item_category", F.lit(1).alias("behavior_type"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("event_id").cast("int"))).alias("time"))
    return log.unionByName(more)


CRAWLER_LOG = f"({LOG_H}) UNION ALL BY NAME (SELECT event_id, CAST(-1 AS BIGINT) AS user_id, item_id, item_category, 1 AS behavior_type, TIMESTAMP '2024-01-01' + to_hours(CAST(event_id AS INTEGER)) AS time FROM ({RAW}) WHERE event_id < 100)"
FENCE = "SELECT count(*) AS users, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS fence FROM (SELECT user_id, count(*) AS n FROM log GROUP BY user_id)"
SIGMA = "SELECT count(*) AS users, avg(n) AS mean, stddev_samp(n) AS std, avg(n) + 3 * stddev_samp(n) AS fence FROM (SELECT user_id, count(*) AS n FROM log GROUP BY user_id)"
OUTLIERS = "SELECT user_id, count(*) AS n_events FROM log GROUP BY user_id HAVING count(*) > (SELECT fence FROM fence)"
GAPS = """SELECT user_id, max(behavior_type) = 1 AS only_views, count(*) AS n_events, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, count(DISTINCT hour(time)) AS n_hours
    FROM (SELECT *, epoch(time) - epoch(lag(time) OVER (PARTITION BY user_id ORDER BY time)) AS gap FROM log WHERE user_id IN (SELECT user_id FROM out)) GROUP BY user_id"""
CRAWLERS = "SELECT user_id FROM gaps WHERE only_views AND n_events >= 2 AND mean_gap > 0 AND n_hours >= 20 AND coalesce(std_gap / mean_gap < 0.5, true)"
FLAGGED = "SELECT log.*, out.user_id IS NOT NULL AS is_power_user FROM log LEFT JOIN out ON log.user_id = out.user_id"


def _dims(spark, d):
    log = logs.log_h(spark, d)
    pair = dims.pairs(log)
    return {"user": dims.user_dim(log), "item": dims.item_dim(pair), "category": dims.category_dim(pair), "daily": dims.time_dim(log, "daily")}


def _keys(spark, d):
    log, t = logs.log_h(spark, d), _dims(spark, d)
    hourly, weekday = dims.time_dim(log, "hourly"), dims.time_dim(log, "weekday_hour")
    return quality.primary_keys({"dim_user": (t["user"], ["user_id"]), "dim_item": (t["item"], ["item_id"]), "dim_category": (t["category"], ["item_category"]), "dim_time_daily": (t["daily"], ["date"]), "dim_time_hourly": (hourly, ["date", "hour"]), "dim_time_weekday_hour": (weekday, ["weekday", "hour"])})


def _sample_audit(spark, d):
    """Representative users, items, categories and days of the order log, each field recomputed from rows. All read one log in
    buckets of users: its joins run once, and pairs, users and categories' users meet where they lie."""
    log = logs.log_o_by_user(spark, d, "event_id")
    pair = dims.pairs(log)
    tables = {"user": dims.user_funnel(pair).join(dims.user_activity(log), "user_id"), "item": dims.item_dim(pair), "category": dims.category_dim(pair), "day": dims.time_dim(log, "daily")}
    tables = {k: written(df, k) for k, df in tables.items()}
    return quality.sample_audit(log, tables, quality.representatives(tables, clean.outlier_users(log)))


def _colocated(spark, d):
    """The user dimension of a log in buckets of users: no exchange below its joins."""
    return dims.user_dim(logs.log_o_by_user(spark, d))


def _audit(spark, d):
    """The user table against one built from filtered groups of the log, field by field."""
    log = logs.log_h(spark, d)
    one = lambda k, n: log.where(F.col("behavior_type") == k).groupBy("user_id").agg(F.count("*").alias(n))
    again = log.select("user_id").distinct()
    for k, n in dims.COUNTS.items():
        again = again.join(one(k, n), "user_id", "left")
    bought = log.where("behavior_type = 4").groupBy("user_id", "item_id").count()
    again = again.join(bought.groupBy("user_id").agg(F.count("*").alias("buy_item_count"), F.count_if(F.col("count") >= 2).alias("repurchase_item_count")), "user_id", "left").fillna(0)
    return quality.audit(dims.user_dim(log), again, ["user_id"], [*dims.COUNTS.values(), "buy_item_count", "repurchase_item_count"])


def _missing(spark, d):
    return quality.missing_values(logs.log_raw(spark, d).withColumn("item_category", F.when(F.col("event_id") % 7 != 0, F.col("item_category"))))


COLUMNS = ("event_id", "user_id", "item_id", "item_category", "behavior_type", "time")

def _csv(spark, d) -> str:
    """The raw log as a CSV file with hours as text."""
    path = f"{own_dir(spark)}/log-{uuid.uuid4().hex}.csv"
    files.write_csv(logs.log_h(spark, d).select("user_id", "item_id", "item_category", "behavior_type", F.date_format("time", "yyyy-MM-dd HH").alias("time")), path)
    return path


def _sorted_parquet(spark, d) -> str:
    path = f"{own_dir(spark)}/pairs-{uuid.uuid4().hex}.parquet"
    files.key_sorted_parquet(dims.pairs(logs.log_h(spark, d)), path, "user_id", "item_id")
    return path


def _stored(spark, d):
    path = f"{own_dir(spark)}/daily-{uuid.uuid4().hex}.parquet"
    files.write_parquet(dims.time_dim(logs.log_h(spark, d), "daily"), path)
    return files.read_parquet(spark, path)


QUERIES = {
    "SRC1_SNK3_csv_scan": lambda s, d: files.read_log_csv(s, _csv(s, d)),
    "SRC2_whole_csv": lambda s, d: files.read_table(s, _csv(s, d), schema="user_id long, item_id long, item_category int, behavior_type int, time string"),
    "SNK1_parquet": _stored,
    "SNK2_key_sorted": lambda s, d: files.read_table(s, _sorted_parquet(s, d)).select("user_id", "item_id", "buy_count"),
    "PRJ2_downcast": lambda s, d: filters.downcast(rounded(dims.user_dim(logs.log_h(s, d)).select("user_id", "pv_count", "day_pct"), 3)),
    "SRC3_parquet_scan": lambda s, d: files.read_parquet(s, f"{d}/events.parquet").select("event_id", "user_id", "event_type"),
    "SRC4_suffix_scan": lambda s, d: files.read_table(s, f"{d}/orders.parquet").select("o_orderkey", "o_custkey"),
    "SRC5_batched_scan": lambda s, d: files.iter_batches(files.read_parquet(s, f"{d}/lineitem.parquet"), ["l_orderkey", "l_partkey", "l_quantity"]),
    "CLN1_category_conflicts": lambda s, d: clean.category_conflicts(logs.log_c(s, d)),
    "CLN2_essential_fields": lambda s, d: clean.essential_fields(logs.log_h(s, d)),
    "CLN3_duplicates": lambda s, d: clean.duplicate_stats(logs.log_d(s, d)),
    "CLN4_valid_behaviours": lambda s, d: clean.valid_behaviours(logs.log_raw(s, d)),
    "CLN5_standard_time": lambda s, d: clean.standard_time(_timed(s, d), "time_text").select("event_id", "time"),
    "CLN6_iqr_fence": lambda s, d: rounded(clean.outlier_fence(logs.log_h(s, d))),
    "CLN6_iqr_outliers": lambda s, d: clean.outlier_users(logs.log_h(s, d)),
    "CLN7_sigma_fence": lambda s, d: rounded(clean.outlier_fence(logs.log_h(s, d), "3sigma")),
    "CLN7_sigma_outliers": lambda s, d: clean.outlier_users(logs.log_h(s, d), "3sigma"),
    "CLN8_without_outliers": lambda s, d: clean.without_outliers(logs.log_h(s, d)),
    "CLN9_gap_profile": lambda s, d: rounded(clean.gap_profile(logs.log_h(s, d), clean.outlier_users(logs.log_h(s, d)))),
    "CLN9_crawlers": lambda s, d: clean.crawlers(_crawler_log(s, d), _crawler_log(s, d).select("user_id").distinct()),
    "CLN10_flagged": lambda s, d: clean.flagged_outliers(logs.log_h(s, d)),
    "DU8_power_users": lambda s, d: rounded(dims.user_dim(clean.flagged_outliers(logs.log_h(s, d)))),
    "CLN11_cleaning_stats": lambda s, d: clean.cleaning_stats(_timed(s, d)),
    "FLT1_dates_and_behaviours": lambda s, d: filters.by_date_and_behaviour(logs.log_h(s, d), "2024-01-05", "2024-01-15", [1, 4]),
    "FLT2_segment_and_categories": lambda s, d: filters.by_segment(logs.log_h(s, d), "mid", 3),
    "FLT3_predictions": lambda s, d: rounded(filters.by_score_segment(filters.scored_users(logs.log_h(s, d)), "high", "middle")),
    "PRJ1_time_columns": lambda s, d: filters.time_columns(logs.log_h(s, d)).select("event_id", "date", "hour", "weekday", "weekday_name"),
    "PRJ4_matrix_contract": lambda s, d: filters.null_counts(dims.user_dim(logs.log_h(s, d)), ["pv_count", "buy_count", "view_to_buy_rate"]),
    "QLT1_missing_values": _missing,
    "QLT2_ranges": lambda s, d: quality.ranges(logs.log_raw(s, d)),
    "QLT3_distribution": lambda s, d: quality.behaviour_distribution(logs.log_h(s, d)),
    "QLT4_cardinalities": lambda s, d: quality.cardinalities(logs.log_h(s, d)),
    "QLT5_cleaning_summary": lambda s, d: quality.cleaning_summary(clean.cleaning_stats(_timed(s, d))),
    "QLT6_duplicate_rates": lambda s, d: quality.duplicate_rates(logs.log_d(s, d)),
    "QLT7_power_users": lambda s, d: quality.power_users(clean.flagged_outliers(logs.log_h(s, d))),
    "QLT8_missing_dates": lambda s, d: quality.missing_dates(logs.log_h(s, d)),
    "QLT8_date_coverage": lambda s, d: quality.date_coverage(logs.log_h(s, d)),
    "QLT9_primary_keys": _keys,
    "QLT10_conservation": lambda s, d: quality.conservation(logs.log_h(s, d), _dims(s, d)),
    "QLT11_null_columns": lambda s, d: quality.null_columns(_dims(s, d)),
    "QLT12_audit": _audit,
    "QLT12_sample_audit": lambda s, d: rounded(_sample_audit(s, d)),
    "SNK2_colocated_users": lambda s, d: rounded(_colocated(s, d)),
    "SRC5_first_rows": lambda s, d: files.first_rows(s.read.parquet(f"{d}/lineitem.parquet"), 5_000).agg(F.count("*").alias("n_rows")),
}

_SEG = "SELECT user_id, count(*) FILTER (WHERE behavior_type = 1) AS pv FROM log GROUP BY user_id"
_STATS = "SELECT count(*) AS original_count, count(*) AS after_dedup, count(*) FILTER (WHERE behavior_type <= 4) AS after_behavior, count(*) FILTER (WHERE behavior_type <= 4 AND event_id % 10 > 1) AS after_time, count(*) FILTER (WHERE behavior_type <= 4 AND event_id % 10 > 1) AS final_count FROM log"
_DUP = "SELECT user_id, item_id, behavior_type, time, count(*) AS n FROM log GROUP BY ALL"
_PK = lambda name, table, keys: f"SELECT '{name}' AS table_name, count(*) AS n_rows, count(DISTINCT ({keys})) AS n_keys, count(*) = count(DISTINCT ({keys})) AS is_unique FROM {table}"
_TABLES = {"u": DIM_USER, "i": DIM_ITEM, "c": DIM_CATEGORY, "dy": DAILY}
_CONS = " UNION ALL ".join(f"SELECT '{b}' AS behavior, CAST(sum({b}_count) AS BIGINT) AS table_sum, '{name}' AS table_name, (SELECT count(*) FROM log WHERE behavior_type = {k}) AS source_rows, sum({b}_count) = (SELECT count(*) FROM log WHERE behavior_type = {k}) AS matches FROM {t}" for name, t in (("user", "u"), ("item", "i"), ("category", "c"), ("daily", "dy")) for k, b in ((1, "pv"), (2, "fav"), (3, "cart"), (4, "buy")))
_NULLS = {
    "user": ("u", ["user_id", "pv_count", "fav_count", "cart_count", "buy_count", "buy_item_count", "repurchase_item_count", "view_to_buy_rate", "fav_to_buy_rate", "cart_to_buy_rate", "active_days", "first_active_time", "last_active_time", "day_pct", "evening_pct", "night_pct", "is_power_user"]),
    "item": ("i", ["item_id", "item_category", "pv_count", "fav_count", "cart_count", "buy_count", "view_user_count", "buy_user_count", "repurchase_user_count", "view_to_buy_rate", "cart_to_buy_rate"]),
    "category": ("c", ["item_category", "item_count", "buy_item_count", "pv_count", "fav_count", "cart_count", "buy_count", "pv_to_buy_rate", "buy_item_pct", "view_user_count", "buy_user_count"]),
    "daily": ("dy", ["date", "pv_count", "fav_count", "cart_count", "buy_count", "unique_users", "unique_items"]),
}
_NULLSQL = " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {t}" for name, (t, cols) in _NULLS.items() for c in cols)
_REST = "fav_count = 0 AND cart_count = 0 AND buy_count = 0"
_USED = "fav_count > 0 AND cart_count > 0 AND buy_count > 0"
_PICKS = (
    ("user", "power", "u", f"{_USED} AND user_id IN (SELECT user_id FROM out)", 2), ("user", "only views", "u", _REST, 1), ("item", "hot", "i", f"{_USED} AND view_user_count >= 3", 5),
    ("item", "cold", "i", f"{_REST} AND view_user_count = 1", 3), ("category", "hot", "c", f"{_USED} AND pv_count > 0", 2), ("category", "cold", "c", f"{_REST} AND pv_count > 0", 2),
)
_CHOSEN = " UNION ALL ".join(f"(SELECT '{k}' AS kind, '{r}' AS role, CAST({quality.AUDITED[k][0]} AS VARCHAR) AS key FROM {t} WHERE {w} ORDER BY {quality.AUDITED[k][0]} LIMIT {n})" for k, r, t, w, n in _PICKS) + """
    UNION ALL SELECT 'day', role, CAST(date AS VARCHAR) FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM d), (SELECT unnest(['first', 'middle', 'last']) AS role)
    WHERE i = CASE role WHEN 'first' THEN 1 WHEN 'middle' THEN n // 2 + 1 ELSE n END"""
_REPRESENTED = " UNION ALL ".join(f"SELECT kind, role, key, '{f}' AS field, round(CAST(t.{f} AS DOUBLE), 6) AS value, true AS matches FROM chosen JOIN {k[0]} t ON kind = '{k}' AND CAST(t.{c} AS VARCHAR) = key" for k, (c, fs) in quality.AUDITED.items() for f in fs)

SQL = {
    "SRC3_parquet_scan": "SELECT event_id, user_id, event_type FROM events",
    "SRC4_suffix_scan": "SELECT o_orderkey, o_custkey FROM orders",
    "SRC5_batched_scan": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem",
    "CLN1_category_conflicts": over(LOG_C, "SELECT item_id, count(DISTINCT item_category) AS n_categories FROM log GROUP BY item_id HAVING n_categories > 1"),
    "CLN2_essential_fields": over(LOG_H, "SELECT user_id, item_id, item_category, behavior_type, time FROM log"),
    "CLN3_duplicates": over(LOG_D, "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, max(n) AS max_multiplicity FROM g", g=_DUP),
    "CLN4_valid_behaviours": over(RAW, "SELECT * FROM log WHERE behavior_type IN (1, 2, 3, 4)"),
    "CLN5_standard_time": f"SELECT event_id, try_strptime(time_text, '%Y-%m-%d %H') AS time FROM ({TIMED}) WHERE try_strptime(time_text, '%Y-%m-%d %H') IS NOT NULL",
    "CLN6_iqr_fence": over(LOG_H, "SELECT users, round(q1, 6) AS q1, round(q3, 6) AS q3, round(fence, 6) AS fence FROM fence", fence=FENCE),
    "CLN6_iqr_outliers": over(LOG_H, OUTLIERS, fence=FENCE),
    "CLN7_sigma_fence": over(LOG_H, "SELECT users, round(mean, 6) AS mean, round(std, 6) AS std, round(fence, 6) AS fence FROM fence", fence=SIGMA),
    "CLN7_sigma_outliers": over(LOG_H, OUTLIERS, fence=SIGMA),
    "CLN8_without_outliers": over(LOG_H, "SELECT * FROM log WHERE user_id NOT IN (SELECT user_id FROM out)", fence=FENCE, out=OUTLIERS),
    "CLN9_gap_profile": over(LOG_H, "SELECT user_id, only_views, n_events, round(mean_gap, 6) AS mean_gap, round(std_gap, 6) AS std_gap, n_hours FROM gaps", fence=FENCE, out=OUTLIERS, gaps=GAPS),
    "CLN9_crawlers": over(CRAWLER_LOG, CRAWLERS, out="SELECT DISTINCT user_id FROM log", gaps=GAPS),
    "SRC1_SNK3_csv_scan": over(LOG_H, "SELECT * EXCLUDE (event_id) FROM log"),
    "SRC2_whole_csv": over(LOG_H, "SELECT * EXCLUDE (event_id) REPLACE (strftime(time, '%Y-%m-%d %H') AS time) FROM log"),
    "SNK1_parquet": over(LOG_H, DAILY),
    "SNK2_key_sorted": over(LOG_H, "SELECT user_id, item_id, buy_count FROM pair"),
    "PRJ2_downcast": over(LOG_H, "SELECT user_id, pv_count, CAST(round(day_pct, 3) AS FLOAT) AS day_pct FROM u", u=DIM_USER.replace(f"BETWEEN 6 AND 17) / count(*), 6)", "BETWEEN 6 AND 17) / count(*), 9)")),
    "DU8_power_users": over(
        LOG_H, DIM_USER.replace("(SELECT *, false AS is_power_user FROM log)", "fl").replace("FROM pair GROUP BY user_id", "FROM pf GROUP BY user_id"), fence=FENCE, out=OUTLIERS, gaps=GAPS, crawlers=CRAWLERS,
        fl=f"{FLAGGED} WHERE log.user_id NOT IN (SELECT user_id FROM crawlers)", pf=PAIR.replace("FROM log", "FROM fl"),
    ),
    "CLN10_flagged": over(LOG_H, f"{FLAGGED} WHERE log.user_id NOT IN (SELECT user_id FROM crawlers)", fence=FENCE, out=OUTLIERS, gaps=GAPS, crawlers=CRAWLERS),
    "CLN11_cleaning_stats": over(RAW, _STATS),
    "FLT1_dates_and_behaviours": over(LOG_H, "SELECT * FROM log WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND behavior_type IN (1, 4)"),
    "FLT2_segment_and_categories": over(LOG_H, "SELECT * FROM log WHERE user_id IN (SELECT user_id FROM seg, q WHERE pv >= q1 AND pv < q3) AND item_category IN (SELECT item_category FROM top)", seg=_SEG, q="SELECT quantile_cont(pv, 0.25) AS q1, quantile_cont(pv, 0.75) AS q3 FROM seg", top="SELECT item_category FROM log GROUP BY item_category ORDER BY count(*) DESC, item_category LIMIT 3"),
    "FLT3_predictions": over(LOG_H, "SELECT user_id, user_pv_count, round(item_category_te, 6) AS item_category_te FROM s, q WHERE user_pv_count > q3 AND item_category_te > t1 AND item_category_te <= t2", s="SELECT user_id, count(*) FILTER (WHERE behavior_type = 1) AS user_pv_count, avg(item_category) AS item_category_te FROM log GROUP BY user_id", q="SELECT quantile_cont(user_pv_count, 0.75) AS q3, quantile_cont(item_category_te, 1/3) AS t1, quantile_cont(item_category_te, 2/3) AS t2 FROM s"),
    "PRJ1_time_columns": over(LOG_H, "SELECT event_id, CAST(time AS DATE) AS date, CAST(hour(time) AS INTEGER) AS hour, CAST((dayofweek(time) + 6) % 7 AS INTEGER) AS weekday, dayname(time) AS weekday_name FROM log"),
    "PRJ4_matrix_contract": over(LOG_H, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM u" for c in ("pv_count", "buy_count", "view_to_buy_rate")), u=DIM_USER),
    "QLT1_missing_values": over(f"SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN item_category END AS item_category) FROM ({RAW})", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_percent, CASE WHEN count(*) = count({c}) THEN 'OK' ELSE 'WARN' END AS status FROM log" for c in COLUMNS)).replace("* 100.0 /", "* CAST(100 AS DOUBLE) /"),
    "QLT2_ranges": over(RAW, "SELECT " + ", ".join(f"CAST(min({c}) AS BIGINT) AS min_{c}, CAST(max({c}) AS BIGINT) AS max_{c}, count(*) FILTER (WHERE {c} < 0) AS negative_{c}" for c in ("user_id", "item_id", "item_category")) + ", count(*) FILTER (WHERE behavior_type NOT IN (1, 2, 3, 4)) AS illegal_behaviors FROM log"),
    "QLT3_distribution": over(LOG_H, "SELECT behavior_type, CASE behavior_type WHEN 1 THEN 'pv' WHEN 2 THEN 'fav' WHEN 3 THEN 'cart' ELSE 'buy' END AS name, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM log), 6) AS percent FROM log GROUP BY behavior_type"),
    "QLT4_cardinalities": over(LOG_H, "SELECT min(time) AS min_time, max(time) AS max_time, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT item_category) AS n_categories FROM log"),
    "QLT5_cleaning_summary": over(RAW, "SELECT original_count, original_count - after_dedup AS removed_dedup, after_dedup - after_behavior AS removed_behavior, after_behavior - after_time AS removed_time, final_count, round(CAST(final_count AS DOUBLE) * 100 / original_count, 6) AS retention_percent FROM st", st=_STATS),
    "QLT6_duplicate_rates": over(LOG_D, "SELECT coalesce(behavior_type, 0) AS behavior_type, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(CAST(sum(n - 1) AS DOUBLE) * 100 / sum(n), 6) AS percent, max(n) AS max_multiplicity FROM g GROUP BY ROLLUP (behavior_type)", g=_DUP),
    "QLT7_power_users": over(LOG_H, "SELECT count(DISTINCT user_id) FILTER (WHERE is_power_user) AS power_users, count(DISTINCT user_id) FILTER (WHERE NOT is_power_user) AS normal_users, count(*) FILTER (WHERE is_power_user) AS power_rows, round(CAST(count(*) FILTER (WHERE is_power_user) AS DOUBLE) * 100 / count(*), 6) AS power_row_percent FROM fl", fence=FENCE, out=OUTLIERS, gaps=GAPS, crawlers=CRAWLERS, fl=f"{FLAGGED} WHERE log.user_id NOT IN (SELECT user_id FROM crawlers)"),
    "QLT8_missing_dates": over(LOG_H, "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM days) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM days)", days="SELECT DISTINCT CAST(time AS DATE) AS date FROM log"),
    "QLT8_date_coverage": over(LOG_H, "SELECT CAST(max(CAST(time AS DATE)) - min(CAST(time AS DATE)) + 1 AS BIGINT) AS expected_days, count(DISTINCT CAST(time AS DATE)) AS actual_days FROM log"),
    "QLT9_primary_keys": over(LOG_H, " UNION ALL ".join([_PK("dim_user", "u", "user_id"), _PK("dim_item", "i", "item_id"), _PK("dim_category", "c", "item_category"), _PK("dim_time_daily", "dy", "date"), _PK("dim_time_hourly", "h", "date, hour"), _PK("dim_time_weekday_hour", "w", "weekday, hour")]), **_TABLES, h="SELECT CAST(time AS DATE) AS date, hour(time) AS hour FROM log GROUP BY ALL", w="SELECT dayofweek(time) AS weekday, hour(time) AS hour FROM log GROUP BY ALL"),
    "QLT10_conservation": over(LOG_H, _CONS, **_TABLES),
    "QLT11_null_columns": over(LOG_H, _NULLSQL, **_TABLES),
    "QLT12_sample_audit": over(LOG_O, _REPRESENTED, fence=FENCE, out=OUTLIERS, u=DIM_USER, i=DIM_ITEM, c=DIM_CATEGORY, d=DAILY, chosen=_CHOSEN),
    "SNK2_colocated_users": over(LOG_O, DIM_USER),
    "SRC5_first_rows": "SELECT least(5000, count(*)) AS n_rows FROM lineitem",
    "QLT12_audit": over(LOG_H, " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_different FROM (SELECT DISTINCT user_id FROM log)" for f in ("pv_count", "fav_count", "cart_count", "buy_count", "buy_item_count", "repurchase_item_count"))),
}
