"""Insight, window, top-k and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dims, insights, labels, sequences
from ..sources import logs
from .base import COUNTS, DIM_ITEM, LOG_H, LOG_O, LOG_U, over, ratio, rounded
from .sampling import LABELS

_log = logs.log_h
E_ = "list_value(" + ", ".join(map(str, insights.EDGES)) + ")"


def _samples(s, d):
    return labels.window_labels(logs.log_u(s, d))


QUERIES = {
    "IN1_overview": lambda s, d: rounded(insights.overview(_log(s, d))),
    "IN2_weekday_hours": lambda s, d: insights.weekday_hours(_log(s, d), 1),
    "IN3_weekday_conversion": lambda s, d: rounded(insights.conversion(_log(s, d), F.weekday("time").alias("weekday"), F.hour("time").alias("hour"))),
    "IN4_daily_trend": lambda s, d: rounded(insights.daily_trend(_log(s, d))),
    "IN5_activity": lambda s, d: rounded(insights.activity(_log(s, d))),
    "IN6_purchase_counts": lambda s, d: rounded(insights.purchase_counts(_log(s, d))),
    "IN7_category_totals": lambda s, d: rounded(insights.totals(_log(s, d), "item_category")),
    "IN7_item_totals_orders": lambda s, d: rounded(insights.totals(logs.log_o(s, d), "item_id")),
    "IN8_pareto": lambda s, d: rounded(insights.pareto(logs.log_o(s, d))),
    "IN9_quadrants": lambda s, d: rounded(insights.quadrants(logs.log_u(s, d))),
    "IN10_reach_funnel": lambda s, d: rounded(insights.reach_funnel(_log(s, d))),
    "IN11_transition_matrix": lambda s, d: rounded(insights.transition_matrix(_log(s, d))),
    "IN12_depth": lambda s, d: rounded(insights.depth(_log(s, d), 1)),
    "WN3_gaps": lambda s, d: insights.gaps(_log(s, d)),
    "WN4_transitions": lambda s, d: insights.transitions(_log(s, d)),
    "WN5_cumulative_share": lambda s, d: rounded(insights.cumulative_share(logs.log_o(s, d))),
    "TK1_top_items": lambda s, d: rounded(insights.top(insights.totals(logs.log_o(s, d), "item_id"), "interactions", "item_id", 20)),
    "TK1_top_converting": lambda s, d: rounded(insights.top(insights.totals(logs.log_u(s, d), "item_id").withColumn("conversion", F.round("conversion", 6)), "conversion", "item_id", 15, ("pv_count", 15))),
    "TK2_top_transitions": lambda s, d: insights.top_transitions(_log(s, d)),
    "SQ1_SQ2_indices": lambda s, d: logs.log_o(s, d).select("event_id", sequences.item_hash(F.col("item_id"), 500).alias("item"), sequences.category_index(F.col("item_category")).alias("category")),
    "SQ3_history": lambda s, d: sequences.user_history(_log(s, d)).select("user_id", F.size("history").alias("n"), F.transform("history", lambda e: e["event_id"]).alias("event_ids")).select("user_id", "n", F.posexplode("event_ids").alias("position", "event_id")),
    "SQ4_sequences": lambda s, d: rounded(sequences.flattened(sequences.sequences(_samples(s, d), logs.log_u(s, d)))),
    "JN5_prefix_join": lambda s, d: sequences.sequences(_samples(s, d), logs.log_u(s, d), 10).select("user_id", "item_id", "seq_len"),
    "SQ5_vocabulary": lambda s, d: sequences.vocabulary_sizes(_log(s, d)),
    "SQ6_sample_category": lambda s, d: sequences.with_category(_samples(s, d).select("user_id", "item_id"), dims.item_dim(dims.pairs(_log(s, d)))),
}

_CONV = ratio("buy_count", "pv_count")
_TOTAL = lambda k: f"SELECT *, {_CONV} AS conversion FROM (SELECT {k}, {COUNTS}, count(*) AS interactions FROM log GROUP BY {k})"
_NEXT = "SELECT event_id, user_id, behavior_type, coalesce(lead(behavior_type) OVER (PARTITION BY user_id ORDER BY time, event_id), 0) AS next_behavior FROM log"
_CUM = "SELECT item_category, interactions, buy_count, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(interactions) OVER w / sum(interactions) OVER () * 100, 6) AS interaction_share, round(sum(buy_count) OVER w / sum(buy_count) OVER () * 100, 6) AS buy_share, count(*) OVER () AS n FROM t WINDOW w AS (ORDER BY interactions DESC, item_category ROWS UNBOUNDED PRECEDING)"
_BINS = f"""SELECT CAST(i - 1 AS INTEGER) AS i, e[i] AS low, e[i + 1] AS high, CASE WHEN i = len(e) - 1 THEN e[i] || '+' ELSE e[i] || '-' || (e[i + 1] - 1) END AS label
    FROM (SELECT e, unnest(generate_series(1, CAST(len(e) - 1 AS BIGINT))) AS i FROM (SELECT list_append(list_filter({E_}, lambda x: x < m * CAST(1.2 AS DOUBLE)), CAST(m * 2 AS INTEGER)) AS e FROM (SELECT max(n) AS m FROM us)))"""
_EV = "SELECT s.user_id, s.item_id, s.last_time, e.event_id, e.time, e.item_id % 500000 + 1 AS items, e.item_category + 1 AS categories, e.behavior_type AS behaviors, row_number() OVER (PARTITION BY s.user_id, s.item_id ORDER BY e.time DESC, e.event_id DESC) AS r FROM sm s LEFT JOIN log e ON s.user_id = e.user_id AND e.time < s.last_time"
_SM = LABELS

SQL = {
    "IN1_overview": over(LOG_H, "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT item_category) AS n_categories, count(*) AS n_rows, CAST(max(CAST(time AS DATE)) - min(CAST(time AS DATE)) + 1 AS BIGINT) AS span_days, round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS actions_per_user, (SELECT round(avg(n), 6) FROM (SELECT count(DISTINCT item_id) AS n FROM log GROUP BY user_id)) AS items_per_user, round(count(DISTINCT user_id) FILTER (WHERE behavior_type = 4) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS buyer_share, " + ratio("count(*) FILTER (WHERE behavior_type = 4)", "count(*) FILTER (WHERE behavior_type = 1)") + " AS buy_per_view, " + ratio("count(*) FILTER (WHERE behavior_type <> 4)", "count(*) FILTER (WHERE behavior_type = 4)") + " AS negative_ratio, " + ratio("count(*) FILTER (WHERE behavior_type = 4)", "count(DISTINCT user_id)") + " AS buys_per_user FROM log"),
    "IN2_weekday_hours": over(LOG_H, "SELECT CAST((dayofweek(time) + 6) % 7 AS INTEGER) AS weekday, " + ", ".join(f"count(*) FILTER (WHERE hour(time) = {h}) AS h{h:02d}" for h in range(24)) + " FROM log WHERE behavior_type = 1 GROUP BY ALL"),
    "IN3_weekday_conversion": over(LOG_H, "SELECT CAST((dayofweek(time) + 6) % 7 AS INTEGER) AS weekday, CAST(hour(time) AS INTEGER) AS hour, count(*) FILTER (WHERE behavior_type = 1) AS views, count(*) FILTER (WHERE behavior_type = 4) AS buys, " + ratio("count(*) FILTER (WHERE behavior_type = 4)", "count(*) FILTER (WHERE behavior_type = 1)") + " AS conversion FROM log GROUP BY 1, 2"),
    "IN4_daily_trend": over(LOG_H, f"SELECT *, {_CONV} AS conversion, dayofweek(date) IN (0, 6) AS is_weekend FROM (SELECT CAST(time AS DATE) AS date, {COUNTS} FROM log GROUP BY 1)"),
    "IN5_activity": over(LOG_H, "SELECT b.i, b.label, count(*) AS n_users, round(avg(q), 6) AS mean_buy_ratio FROM us JOIN b ON n >= low AND n < high GROUP BY ALL", us="SELECT user_id, count(*) AS n, count(*) FILTER (WHERE behavior_type = 4) / CAST(count(*) AS DOUBLE) AS q FROM log GROUP BY user_id", b=_BINS),
    "IN6_purchase_counts": over(LOG_H, "SELECT buys, count(*) AS n_users, (SELECT count(*) FROM o) AS buyers, (SELECT round(avg(CAST(buys >= 2 AS DOUBLE)), 6) FROM o) AS repeat_share FROM o WHERE buys <= 20 GROUP BY buys", o="SELECT user_id, count(*) AS buys FROM log WHERE behavior_type = 4 GROUP BY user_id"),
    "IN7_category_totals": over(LOG_H, _TOTAL("item_category")),
    "IN7_item_totals_orders": over(LOG_O, _TOTAL("item_id")),
    "IN8_pareto": over(LOG_O, "SELECT rank AS n_top, n AS n_categories, interaction_share, buy_share FROM cum WHERE rank = greatest(1, floor(n * CAST(0.2 AS DOUBLE)))", t=_TOTAL("item_category"), cum=_CUM),
    "IN9_quadrants": over(
        LOG_U,
        "SELECT CASE WHEN pv_count >= (SELECT median(pv_count) FROM t) THEN 'high' ELSE 'low' END || ' exposure, ' || CASE WHEN c >= (SELECT median(c) FROM t) THEN 'high' ELSE 'low' END || ' conversion' AS quadrant, count(*) AS n_items, CAST(sum(pv_count) AS BIGINT) AS views, CAST(sum(buy_count) AS BIGINT) AS buys, round(avg(c), 6) AS mean_conversion, round(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS share FROM t GROUP BY 1",
        t=f"SELECT *, coalesce(buy_count / nullif(CAST(pv_count AS DOUBLE), 0), 0) AS c FROM ({_TOTAL('item_id')}) ORDER BY pv_count DESC, item_id LIMIT 15",
    ),
    "IN10_reach_funnel": over(LOG_H, "SELECT CAST(step AS INTEGER) AS step, stage, n AS n_users, round(n / CAST((SELECT n FROM f WHERE step = 0) AS DOUBLE), 6) AS entry_share, round(n / CAST(lag(n) OVER (ORDER BY step) AS DOUBLE), 6) AS step_conversion, round(1 - n / CAST(lag(n) OVER (ORDER BY step) AS DOUBLE), 6) AS drop FROM f", f=" UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS stage, count(DISTINCT user_id) AS n FROM log WHERE behavior_type = {k}" for i, (n, k) in enumerate((("view", 1), ("cart", 3), ("fav", 2), ("buy", 4))))),
    "IN11_transition_matrix": over(LOG_H, "SELECT behavior_type, " + ", ".join(f"count(*) FILTER (WHERE next_behavior = {k}) AS to_{k}, round(count(*) FILTER (WHERE next_behavior = {k}) / CAST(count(*) AS DOUBLE) * 100, 6) AS pct_{k}" for k in range(5)) + " FROM nx GROUP BY behavior_type", nx=_NEXT),
    "IN12_depth": over(
        LOG_H,
        "SELECT i, label, n_users, buyers, round(r, 6) AS buy_rate, r = max(r) OVER () AS is_peak, CASE WHEN (SELECT corr(i, r) FROM o) > 0.3 THEN 'rising' WHEN (SELECT corr(i, r) FROM o) < -0.3 THEN 'falling' ELSE 'flat' END AS trend, (SELECT round(avg(bought), 6) FROM us) AS overall_rate FROM o",
        us="SELECT user_id, count(*) FILTER (WHERE behavior_type = 1) AS n, max(CAST(behavior_type = 4 AS INTEGER)) AS bought FROM log GROUP BY user_id", b=_BINS,
        o="SELECT b.i, b.label, count(*) AS n_users, CAST(sum(bought) AS BIGINT) AS buyers, avg(bought) AS r FROM us JOIN b ON n >= low AND n < high GROUP BY ALL",
    ),
    "WN3_gaps": over(LOG_H, "SELECT event_id, user_id, CAST(epoch(time) - epoch(lag(time) OVER (PARTITION BY user_id ORDER BY time, event_id)) AS BIGINT) AS gap_seconds FROM log"),
    "WN4_transitions": over(LOG_H, _NEXT),
    "WN5_cumulative_share": over(LOG_O, _CUM, t=_TOTAL("item_category")),
    "TK1_top_items": over(LOG_O, f"{_TOTAL('item_id')} ORDER BY interactions DESC, item_id LIMIT 20"),
    "TK1_top_converting": over(LOG_U, f"SELECT * FROM ({_TOTAL('item_id')}) WHERE pv_count >= 15 ORDER BY conversion DESC, item_id LIMIT 15"),
    "TK2_top_transitions": over(LOG_H, "SELECT behavior_type, next_behavior, count(*) AS n FROM nx WHERE next_behavior <> 0 GROUP BY ALL ORDER BY n DESC, behavior_type, next_behavior LIMIT 3", nx=_NEXT),
    "SQ1_SQ2_indices": over(LOG_O, "SELECT event_id, item_id % 500 + 1 AS item, CASE WHEN item_category IS NULL OR item_category < 0 THEN 0 ELSE item_category + 1 END AS category FROM log"),
    "SQ3_history": over(LOG_H, "SELECT user_id, CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) - 1 AS INTEGER) AS position, event_id FROM log"),
    "SQ4_sequences": over(
        LOG_U,
        "SELECT user_id, item_id, CAST(count(event_id) OVER (PARTITION BY user_id, item_id) AS INTEGER) AS seq_len, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY time, event_id) - 1 AS INTEGER) AS position, coalesce(items, 0) AS items, coalesce(categories, 0) AS categories, coalesce(behaviors, 0) AS behaviors, CASE WHEN event_id IS NULL THEN 0 ELSE round(least((epoch(last_time) - epoch(time)) / 86400, 30) / 30, 6) END AS gaps FROM ev WHERE r <= 50",
        sm=_SM, ev=_EV,
    ),
    "JN5_prefix_join": over(LOG_U, "SELECT user_id, item_id, CAST(count(event_id) AS INTEGER) AS seq_len FROM ev WHERE r <= 10 GROUP BY ALL", sm=_SM, ev=_EV),
    "SQ5_vocabulary": over(LOG_H, "SELECT max(item_id % 500000 + 1) + 1 AS n_items, CAST(max(item_category + 1) + 1 AS BIGINT) AS n_categories, CAST(max(behavior_type) + 1 AS BIGINT) AS n_behaviors FROM log"),
    "SQ6_sample_category": f"WITH items AS ({over(LOG_H, DIM_ITEM)}), sm AS ({over(LOG_U, _SM)}) SELECT sm.user_id, sm.item_id, i.item_category, coalesce(i.item_category + 1, 0) AS category_index FROM sm LEFT JOIN items i ON sm.item_id = i.item_id",
}
