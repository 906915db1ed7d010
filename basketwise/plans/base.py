"""Shared parts of the registered queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to six digits: sums of doubles depend on their order in either engine."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def events(items: int = 20, categories: int = 5, unit: str = "hour", user: str = "floor(value)", category_add: str = "0") -> str:
    return f"""SELECT event_id, CAST({user} AS BIGINT) AS user_id, CAST(k % {items} AS BIGINT) AS item_id,
        CAST(k % {items} % {categories} + {category_add} AS INTEGER) AS item_category,
        CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS INTEGER) AS behavior_type,
        date_trunc('{unit}', ts) AS time
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


RAW = events()
LOG_H = f"SELECT * FROM ({RAW}) WHERE behavior_type <= 4"
LOG_D = f"SELECT * FROM ({events(unit='day')}) WHERE behavior_type <= 4"
LOG_U = f"SELECT * FROM ({events(items=100, user='user_id')}) WHERE behavior_type <= 4"
LOG_C = f"SELECT * FROM ({events(category_add='CAST(floor(value) AS BIGINT) % 2')}) WHERE behavior_type <= 4"
LOG_O = """SELECT l_orderkey * 10 + l_linenumber AS event_id, o_custkey AS user_id, l_partkey AS item_id,
    CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS item_category, (l_linenumber - 1) % 4 + 1 AS behavior_type, l_shipdate AS time
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

COUNTS = ", ".join(f"count(*) FILTER (WHERE behavior_type = {k}) AS {n}_count" for k, n in ((1, "pv"), (2, "fav"), (3, "cart"), (4, "buy")))
SUMS = ", ".join(f"CAST(sum({n}_count) AS BIGINT) AS {n}_count" for n in ("pv", "fav", "cart", "buy"))
PAIR = f"SELECT user_id, item_id, min(item_category) AS item_category, {COUNTS} FROM log GROUP BY user_id, item_id"


def over(log: str, body: str, **named: str) -> str:
    """``body`` with the tables ``log`` and ``pair`` and others by name."""
    parts = [f"log AS ({log})", f"pair AS ({PAIR})", *(f"{k} AS ({v})" for k, v in named.items())]
    return f"WITH {', '.join(parts)} {body}"


def ratio(part: str, whole: str) -> str:
    return f"round(coalesce({part} / nullif(CAST({whole} AS DOUBLE), 0), 0), 6)"


DIM_USER = f"""SELECT f.*, a.* EXCLUDE (user_id) FROM (
        SELECT user_id, {SUMS}, count(*) FILTER (WHERE buy_count > 0) AS buy_item_count, count(*) FILTER (WHERE buy_count >= 2) AS repurchase_item_count,
            {", ".join(f"{ratio(f'count(*) FILTER (WHERE {c}_count > 0 AND buy_count > 0)', f'count(*) FILTER (WHERE {c}_count > 0)')} AS {n}_to_buy_rate" for c, n in (("pv", "view"), ("fav", "fav"), ("cart", "cart")))}
        FROM pair GROUP BY user_id) f JOIN (
        SELECT user_id, count(DISTINCT CAST(time AS DATE)) AS active_days, min(time) AS first_active_time, max(time) AS last_active_time,
            {", ".join(f"round(count(*) FILTER (WHERE hour(time) BETWEEN {a} AND {b}) / count(*), 6) AS {n}_pct" for n, a, b in (("day", 6, 17), ("evening", 18, 23), ("night", 0, 5)))},
            bool_or(is_power_user) AS is_power_user
        FROM (SELECT *, false AS is_power_user FROM log) GROUP BY user_id) a ON f.user_id = a.user_id"""
DIM_ITEM = f"""SELECT item_id, min(item_category) AS item_category, {SUMS},
    count(*) FILTER (WHERE pv_count > 0) AS view_user_count, count(*) FILTER (WHERE buy_count > 0) AS buy_user_count, count(*) FILTER (WHERE buy_count >= 2) AS repurchase_user_count,
    {", ".join(f"{ratio(f'count(*) FILTER (WHERE {c}_count > 0 AND buy_count > 0)', f'count(*) FILTER (WHERE {c}_count > 0)')} AS {n}_to_buy_rate" for c, n in (("pv", "view"), ("cart", "cart")))}
    FROM pair GROUP BY item_id"""
DIM_CATEGORY = f"""SELECT i.*, u.view_user_count, u.buy_user_count FROM (
        SELECT item_category, count(*) AS item_count, count(*) FILTER (WHERE buy_count > 0) AS buy_item_count, {SUMS},
            {ratio("count(*) FILTER (WHERE pv_count > 0 AND buy_count > 0)", "count(*) FILTER (WHERE pv_count > 0)")} AS pv_to_buy_rate,
            {ratio("count(*) FILTER (WHERE buy_count > 0)", "count(*)")} AS buy_item_pct
        FROM (SELECT item_category, item_id, {SUMS} FROM pair GROUP BY item_category, item_id) GROUP BY item_category) i
    JOIN (SELECT item_category, count(DISTINCT user_id) FILTER (WHERE pv_count > 0) AS view_user_count, count(DISTINCT user_id) FILTER (WHERE buy_count > 0) AS buy_user_count FROM pair GROUP BY item_category) u
    ON i.item_category = u.item_category"""


def dim_time(keys: str) -> str:
    return f"SELECT {keys}, {COUNTS}, count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items FROM log GROUP BY ALL"


HOURLY, DAILY, WEEKDAY = (dim_time(k) for k in ("CAST(time AS DATE) AS date, CAST(hour(time) AS INTEGER) AS hour", "CAST(time AS DATE) AS date", "CAST((dayofweek(time) + 6) % 7 AS INTEGER) AS weekday, CAST(hour(time) AS INTEGER) AS hour"))
