"""Dimension tables, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dims, joins
from ..sources import logs
from .base import COUNTS, DAILY, DIM_CATEGORY, DIM_ITEM, DIM_USER, HOURLY, LOG_C, LOG_H, LOG_O, LOG_U, PAIR, WEEKDAY, over, rounded


def _pairs(s, d):
    return dims.pairs(logs.log_h(s, d))


def candidates(s, d):
    """Candidate pairs, some unknown, some with a category of their own, some repeated."""
    log = logs.log_h(s, d)
    own = log.select("user_id", (F.col("item_id") + F.when(F.col("event_id") % 9 == 0, 100).otherwise(0)).alias("item_id"), F.when(F.col("event_id") % 2 == 0, F.col("item_category") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("int").alias("item_category"))
    return own.groupBy("user_id", "item_id").agg(F.max("item_category").alias("item_category"))


CAND = """SELECT user_id, item_id, max(item_category) AS item_category FROM (
    SELECT user_id, item_id + CASE WHEN event_id % 9 = 0 THEN 100 ELSE 0 END AS item_id, CASE WHEN event_id % 2 = 0 THEN item_category + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END END AS item_category FROM log) GROUP BY user_id, item_id"""
RESOLVED = "SELECT c.user_id, c.item_id, m.item_category, CASE WHEN m.item_category IS NULL THEN 'unmatched' WHEN c.item_category <> m.item_category THEN 'conflict' ELSE 'ok' END AS status FROM cand c LEFT JOIN (SELECT item_id, min(item_category) AS item_category FROM log GROUP BY item_id) m ON c.item_id = m.item_id"

QUERIES = {
    "DU_dim_user": lambda s, d: rounded(dims.user_dim(logs.log_h(s, d))),
    "DU_dim_user_even": lambda s, d: rounded(dims.user_dim(logs.log_u(s, d))),
    "DU_dim_user_orders": lambda s, d: rounded(dims.user_dim(logs.log_o(s, d))),
    "DI_dim_item": lambda s, d: rounded(dims.item_dim(_pairs(s, d))),
    "DI_dim_item_orders": lambda s, d: rounded(dims.item_dim(dims.pairs(logs.log_o(s, d)))),
    "DC_dim_category": lambda s, d: rounded(dims.category_dim(_pairs(s, d))),
    "DT1_hourly": lambda s, d: dims.time_dim(logs.log_h(s, d), "hourly"),
    "DT2_daily": lambda s, d: dims.time_dim(logs.log_h(s, d), "daily"),
    "DT3_weekday_hour": lambda s, d: dims.time_dim(logs.log_h(s, d), "weekday_hour"),
    "DU1_pair_counts": _pairs,
    "JN1_enriched_pairs": lambda s, d: rounded(joins.enriched(_pairs(s, d), dims.item_dim(_pairs(s, d)), dims.category_dim(_pairs(s, d)), dims.user_dim(logs.log_h(s, d)))),
    "JN6_outer_zero": lambda s, d: joins.views_and_buys(logs.log_h(s, d)),
    "JN7_semi": lambda s, d: joins.buyers_events(logs.log_h(s, d)),
    "JN8_anti": lambda s, d: joins.non_buyers_events(logs.log_h(s, d)),
    "JN9_candidates": lambda s, d: joins.resolved_candidates(candidates(s, d), logs.log_h(s, d)),
    "JN10_alignment": lambda s, d: joins.alignment(_pairs(s, d).select("user_id", "item_id", F.lit(1).alias("label")), logs.log_h(s, d).select("user_id", "item_id", (F.col("event_id") % 2).cast("int").alias("label"))),
    "JN11_lookup": lambda s, d: joins.lookup(_pairs(s, d).select("user_id", "item_id"), dims.item_dim(_pairs(s, d)), "item_id", "buy_user_count"),
    "JN12_by_key": lambda s, d: joins.with_column_by_key(_pairs(s, d).select("user_id", "item_id"), logs.log_h(s, d).groupBy("user_id", "item_id").agg(F.max("time").alias("last_time")), ["user_id", "item_id"]),
    "SO1_union": lambda s, d: logs.log_h(s, d).unionByName(logs.log_c(s, d)),
    "SO2_intersect": lambda s, d: joins.keys(logs.log_h(s, d), 1).intersect(joins.keys(logs.log_h(s, d), 4)),
    "SO2_difference": lambda s, d: joins.keys(logs.log_h(s, d), 1).exceptAll(joins.keys(logs.log_h(s, d), 4)),
    "SO3_distinct": lambda s, d: logs.log_h(s, d).select("user_id", "item_category").distinct(),
}

_PREFIXED = "SELECT p.*, " + ", ".join(f"i.{c} AS item_{c}" for c in ("pv_count", "fav_count", "cart_count", "buy_count", "view_user_count", "buy_user_count", "repurchase_user_count", "view_to_buy_rate", "cart_to_buy_rate")) + ", " + ", ".join(f"c.{c} AS category_{c}" for c in ("item_count", "buy_item_count", "pv_count", "fav_count", "cart_count", "buy_count", "pv_to_buy_rate", "buy_item_pct", "view_user_count", "buy_user_count")) + ", " + ", ".join(f"u.{c} AS user_{c}" for c in ("pv_count", "fav_count", "cart_count", "buy_count")) + ", u.* EXCLUDE (user_id, pv_count, fav_count, cart_count, buy_count)"
JOINED = _PREFIXED + " FROM (SELECT user_id, item_id, item_category FROM pair) p LEFT JOIN i ON p.item_id = i.item_id LEFT JOIN c ON p.item_category = c.item_category LEFT JOIN u ON p.user_id = u.user_id"

SQL = {
    "DU_dim_user": over(LOG_H, DIM_USER),
    "DU_dim_user_even": over(LOG_U, DIM_USER),
    "DU_dim_user_orders": over(LOG_O, DIM_USER),
    "DI_dim_item": over(LOG_H, DIM_ITEM),
    "DI_dim_item_orders": over(LOG_O, DIM_ITEM),
    "DC_dim_category": over(LOG_H, DIM_CATEGORY),
    "DT1_hourly": over(LOG_H, HOURLY),
    "DT2_daily": over(LOG_H, DAILY),
    "DT3_weekday_hour": over(LOG_H, WEEKDAY),
    "DU1_pair_counts": over(LOG_H, "SELECT * FROM pair"),
    "JN1_enriched_pairs": over(LOG_H, JOINED, i=DIM_ITEM, c=DIM_CATEGORY, u=DIM_USER),
    "JN6_outer_zero": over(LOG_H, "SELECT coalesce(v.hour, b.hour) AS hour, coalesce(v.n, 0) AS views, coalesce(b.n, 0) AS buys FROM v FULL JOIN b ON v.hour = b.hour", v="SELECT CAST(hour(time) AS INTEGER) AS hour, count(*) AS n FROM log WHERE behavior_type = 1 GROUP BY ALL", b="SELECT CAST(hour(time) AS INTEGER) AS hour, count(*) AS n FROM log WHERE behavior_type = 4 GROUP BY ALL"),
    "JN7_semi": over(LOG_H, "SELECT * FROM log WHERE user_id IN (SELECT user_id FROM log WHERE behavior_type = 4)"),
    "JN8_anti": over(LOG_H, "SELECT * FROM log WHERE user_id NOT IN (SELECT user_id FROM log WHERE behavior_type = 4)"),
    "JN9_candidates": over(LOG_H, RESOLVED, cand=CAND),
    "JN10_alignment": over(LOG_H, "SELECT (SELECT count(*) FROM pair) AS n_samples, (SELECT count(*) FROM n WHERE c > 1) AS duplicate_keys, (SELECT count(*) FROM pair WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM n)) AS unmatched, (SELECT count(*) FROM n WHERE bad > 0) AS label_mismatches", n="SELECT user_id, item_id, count(*) AS c, count(*) FILTER (WHERE event_id % 2 <> 1) AS bad FROM log GROUP BY ALL"),
    "JN11_lookup": over(LOG_H, "SELECT p.user_id, p.item_id, i.buy_user_count FROM pair p LEFT JOIN i ON p.item_id = i.item_id", i=DIM_ITEM),
    "JN12_by_key": over(LOG_H, "SELECT user_id, item_id, max(time) AS last_time FROM log GROUP BY ALL"),
    "SO1_union": f"({LOG_H}) UNION ALL BY NAME ({LOG_C})",
    "SO2_intersect": over(LOG_H, "SELECT user_id, item_id FROM log WHERE behavior_type = 1 INTERSECT SELECT user_id, item_id FROM log WHERE behavior_type = 4"),
    "SO2_difference": over(LOG_H, "SELECT DISTINCT user_id, item_id FROM log WHERE behavior_type = 1 EXCEPT SELECT user_id, item_id FROM log WHERE behavior_type = 4"),
    "SO3_distinct": over(LOG_H, "SELECT DISTINCT user_id, item_category FROM log"),
}
