"""Label, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dims, features, labels, quality, ranges, sampling
from ..sources import logs
from .base import LOG_H, LOG_U, over, rounded
from .features import PATH

SPECIAL = ["2024-01-12", "2024-01-18"]
LABELS = """SELECT l.user_id, l.item_id, l.item_category, l.last_time, CAST(coalesce(max(CASE WHEN b.time > l.last_time AND b.time <= l.last_time + INTERVAL 7 DAY THEN 1 ELSE 0 END), 0) AS INTEGER) AS label
    FROM (SELECT user_id, item_id, min(item_category) AS item_category, max(time) AS last_time FROM log WHERE behavior_type <= 3 GROUP BY ALL) l
    LEFT JOIN (SELECT user_id, item_id, time FROM log WHERE behavior_type = 4) b ON l.user_id = b.user_id AND l.item_id = b.item_id GROUP BY ALL"""
STRATA = f"""SELECT *, strftime(last_time, '%Y-%m-%d') || '|' || CASE WHEN strftime(last_time, '%Y-%m-%d') IN ({", ".join(f"'{x}'" for x in SPECIAL)}) THEN 'special' WHEN dayofweek(last_time) IN (0, 6) THEN 'weekend' ELSE 'weekday' END
    || '|' || CASE WHEN hour(last_time) < 6 THEN 'night' WHEN hour(last_time) < 12 THEN 'morning' WHEN hour(last_time) < 18 THEN 'afternoon' ELSE 'evening' END AS stratum FROM labels"""
SPLIT = """SELECT * EXCLUDE (i, n, t, v), CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN i = 1 THEN 'train' ELSE 'val' END WHEN i <= n - t - v THEN 'train' WHEN i <= n - t THEN 'val' ELSE 'test' END AS split FROM (
    SELECT * EXCLUDE (t, v), CASE WHEN t + v >= n THEN 1 ELSE t END AS t, CASE WHEN t + v >= n THEN 1 ELSE v END AS v FROM (
    SELECT *, greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) AS t, greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY last_time, user_id, item_id) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM strata)))"""
HASH = "(user_id * 7919 + item_id * 104729 + 42 * 1299709) % 1000003"


def _alloc(source: str, target: str, key: str) -> str:
    return f"""SELECT {key}, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, {key}) <= {target} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocated
        FROM (SELECT *, floor(x) AS f FROM (SELECT {key}, n, n * CAST({target} AS DOUBLE) / (SELECT sum(n) FROM {source}) AS x FROM {source}))"""


def _labels(s, d):
    return labels.window_labels(logs.log_h(s, d))


def _strata(s, d):
    return labels.with_stratum(_labels(s, d), SPECIAL)


def _by_stratum(s, d):
    return _strata(s, d).groupBy("stratum").agg(F.count("*").alias("n"))


BASE = {"labels": LABELS, "strata": STRATA}
TWO = """SELECT s.* EXCLUDE (r, a) FROM (SELECT s.*, row_number() OVER (PARTITION BY s.label, s.stratum ORDER BY """ + HASH.replace("user_id", "s.user_id").replace("item_id", "s.item_id") + """, s.user_id, s.item_id) AS r, a.allocated AS a
    FROM strata s JOIN (SELECT 0 AS label, stratum, allocated FROM a0 UNION ALL SELECT 1, stratum, allocated FROM a1) a ON s.label = a.label AND s.stratum = a.stratum) s WHERE r <= a"""

QUERIES = {
    "LB1_window_labels": _labels,
    "LB1_window_labels_even": lambda s, d: labels.window_labels(logs.log_u(s, d)),
    "JN4_interval_join": lambda s, d: labels.window_labels(logs.log_h(s, d), 3),
    "LB2_legacy_labels": lambda s, d: labels.legacy_labels(features.buy_path(dims.pairs(logs.log_h(s, d))), logs.log_h(s, d)),
    "JN2_features_and_labels": lambda s, d: dims.pairs(logs.log_h(s, d)).join(_labels(s, d).select("user_id", "item_id", "label"), ["user_id", "item_id"]),
    "SP1_time_strata": _strata,
    "SP2_stratified_split": lambda s, d: labels.stratified_split(_strata(s, d)),
    "SP3_global_split": lambda s, d: labels.global_split(_labels(s, d)),
    "SP4_tune_split": lambda s, d: labels.tune_split(_strata(s, d)),
    "QLT13_split_quality": lambda s, d: rounded(quality.split_quality(labels.stratified_split(_strata(s, d)), SPECIAL)),
    "SM1_allocations": lambda s, d: sampling.allocations(_by_stratum(s, d), 150),
    "SM2_two_level_sample": lambda s, d: sampling.two_level_sample(_strata(s, d), 150),
    "SM3_class_sample": lambda s, d: sampling.class_sample(_labels(s, d), 200, "label"),
    "SM4_positive_sample": lambda s, d: sampling.positive_sample(_labels(s, d), 200),
    "IM1_undersample": lambda s, d: sampling.undersample(_labels(s, d)),
    "IM1_undersample_quarter": lambda s, d: sampling.undersample(_labels(s, d), 0.25),
    "IM2_smote_counts": lambda s, d: sampling.smote(dims.pairs(logs.log_h(s, d)).join(_labels(s, d).select("user_id", "item_id", "label"), ["user_id", "item_id"]), ["pv_count", "fav_count", "cart_count"], 0.25).groupBy("label").agg(F.count("*").alias("n")),
    "IM3_class_weights": lambda s, d: rounded(sampling.class_weights(_labels(s, d))),
    "WN7_shuffle": lambda s, d: ranges.ranked(_labels(s, d), [sampling.spread(42), "user_id", "item_id"]),
}

_NEED = "CAST(floor((SELECT count(*) FROM labels WHERE label = 1) * CAST({x} AS DOUBLE) + 1e-9) AS BIGINT)"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, user_id, item_id) AS r FROM labels"
SQL = {
    "LB1_window_labels": over(LOG_H, LABELS),
    "LB1_window_labels_even": over(LOG_U, LABELS),
    "JN4_interval_join": over(LOG_H, LABELS.replace("7 DAY", "3 DAY")),
    "LB2_legacy_labels": over(LOG_H, f"SELECT p.user_id, p.item_id, CAST(buy_path_type <> 0 AS INTEGER) AS label, coalesce(t.last_time, TIMESTAMP '2025-12-18') AS last_time FROM ({PATH}) p LEFT JOIN (SELECT user_id, item_id, max(time) AS last_time FROM log GROUP BY ALL) t ON p.user_id = t.user_id AND p.item_id = t.item_id"),
    "JN2_features_and_labels": over(LOG_H, "SELECT p.*, l.label FROM pair p JOIN labels l ON p.user_id = l.user_id AND p.item_id = l.item_id", labels=LABELS),
    "SP1_time_strata": over(LOG_H, STRATA, labels=LABELS),
    "SP2_stratified_split": over(LOG_H, SPLIT, **BASE),
    "SP3_global_split": over(LOG_H, "SELECT * EXCLUDE (i, n), CASE WHEN i <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY last_time, user_id, item_id) AS i, count(*) OVER () AS n FROM labels)", labels=LABELS),
    "SP4_tune_split": over(LOG_H, "SELECT * EXCLUDE (i, n), CASE WHEN n < 2 OR i <= least(greatest(round_even(n * CAST(0.8 AS DOUBLE), 0), 1), n - 1) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY last_time, user_id, item_id) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM strata)", **BASE),
    "QLT13_split_quality": over(
        LOG_H,
        """SELECT split, count(*) AS n_rows, round(avg(label), 6) AS positive_rate, count(*) FILTER (WHERE kind = 'weekday') AS n_weekday, count(*) FILTER (WHERE kind = 'weekend') AS n_weekend,
        count(*) FILTER (WHERE kind = 'special') AS n_special, min(last_time) AS min_time, max(last_time) AS max_time, round(count(*) / CAST((SELECT count(*) FROM sp) AS DOUBLE), 6) AS share
        FROM (SELECT *, split_part(stratum, '|', 2) AS kind FROM sp) GROUP BY split""",
        **BASE, sp=SPLIT,
    ),
    "SM1_allocations": over(LOG_H, _alloc("c", "150", "stratum"), **BASE, c="SELECT stratum, count(*) AS n FROM strata GROUP BY ALL"),
    "SM2_two_level_sample": over(
        LOG_H, TWO, **BASE, c="SELECT label, count(*) AS n FROM strata GROUP BY ALL", al=_alloc("c", "150", "label"),
        c0="SELECT stratum, count(*) AS n FROM strata WHERE label = 0 GROUP BY ALL", c1="SELECT stratum, count(*) AS n FROM strata WHERE label = 1 GROUP BY ALL",
        a0=_alloc("c0", "(SELECT allocated FROM al WHERE label = 0)", "stratum"), a1=_alloc("c1", "(SELECT allocated FROM al WHERE label = 1)", "stratum"),
    ),
    "SM3_class_sample": over(LOG_H, f"SELECT * EXCLUDE (r, n) FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ({_RANKED})) WHERE r <= greatest(1, floor(CAST(200 AS DOUBLE) * n / (SELECT count(*) FROM labels)))", labels=LABELS),
    "SM4_positive_sample": over(LOG_H, f"SELECT * EXCLUDE (r) FROM ({_RANKED}) WHERE CASE WHEN label = 1 THEN r <= least(40, (SELECT count(*) FROM labels WHERE label = 1)) ELSE r <= 200 - least(40, (SELECT count(*) FROM labels WHERE label = 1)) END", labels=LABELS),
    "IM1_undersample": over(LOG_H, f"SELECT * EXCLUDE (r) FROM ({_RANKED}) WHERE label = 1 OR r <= {_NEED.format(x=1)}", labels=LABELS),
    "IM1_undersample_quarter": over(LOG_H, f"SELECT * EXCLUDE (r) FROM ({_RANKED}) WHERE label = 1 OR r <= {_NEED.format(x=3)}", labels=LABELS),
    "IM2_smote_counts": over(LOG_H, "SELECT label, CASE WHEN label = 0 THEN count(*) ELSE greatest(count(*), CAST(floor((SELECT count(*) FROM labels WHERE label = 0) * CAST(0.25 AS DOUBLE) / 0.75) AS BIGINT)) END AS n FROM labels GROUP BY label", labels=LABELS),
    "IM3_class_weights": over(LOG_H, "SELECT p AS n_positive, n - p AS n_negative, round(n / (2.0 * (n - p)), 6) AS weight_0, round(n / (2.0 * p), 6) AS weight_1, round((n - p) / CAST(p AS DOUBLE), 6) AS pos_weight FROM (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM labels)".replace("2.0", "CAST(2 AS DOUBLE)"), labels=LABELS),
    "WN7_shuffle": over(LOG_H, f"SELECT *, row_number() OVER (ORDER BY {HASH}, user_id, item_id) AS position FROM labels", labels=LABELS),
}
