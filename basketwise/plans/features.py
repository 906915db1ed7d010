"""Feature, preprocessing and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dims, features, joins, point_in_time, preprocess, selection
from ..sources import logs
from .base import COUNTS, DIM_CATEGORY, DIM_ITEM, DIM_USER, LOG_H, LOG_O, SUMS, over, ratio, rounded
from .dimensions import CAND, JOINED, RESOLVED, candidates

STREAK = "SELECT user_id, max(n) AS user_streak_days FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS run FROM (SELECT DISTINCT user_id, CAST(time AS DATE) AS d FROM log)) GROUP BY user_id, run) GROUP BY user_id"
HEAT = "SELECT item_id, CAST(time AS DATE) AS date, CAST(sum(CASE behavior_type WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 5 END) AS BIGINT) AS heat FROM log GROUP BY ALL"
SLOPE = "SELECT item_id, CASE WHEN count(*) >= 3 THEN regr_slope(heat, x) END AS item_decay_slope FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date) - 1 AS x FROM heat) GROUP BY item_id"
GAP = "SELECT user_id, CASE WHEN count(*) > 1 THEN avg(g) / 3600.0 END AS user_avg_interval_hours FROM (SELECT user_id, epoch(time) - epoch(lag(time) OVER (PARTITION BY user_id ORDER BY time)) AS g FROM (SELECT DISTINCT user_id, time FROM log)) GROUP BY user_id"
PATH = "SELECT user_id, item_id, CAST(CASE WHEN buy_count = 0 THEN 0 WHEN fav_count > 0 AND cart_count > 0 THEN 4 WHEN cart_count > 0 THEN 3 WHEN fav_count > 0 THEN 2 ELSE 1 END AS INTEGER) AS buy_path_type FROM pair"
RFM = """SELECT u.user_id,
    CAST(CASE WHEN days IS NULL THEN 1 WHEN days <= 7 THEN 5 WHEN days <= 14 THEN 4 WHEN days <= 21 THEN 3 WHEN days <= 28 THEN 2 ELSE 1 END AS INTEGER) AS rfm_r_score,
    CAST(CASE WHEN f <= 2 THEN 1 WHEN f <= 5 THEN 2 WHEN f <= 10 THEN 3 WHEN f <= 20 THEN 4 ELSE 5 END AS INTEGER) AS rfm_f_score,
    CAST(CASE WHEN m <= 1 THEN 1 WHEN m <= 3 THEN 2 WHEN m <= 6 THEN 3 WHEN m <= 10 THEN 4 ELSE 5 END AS INTEGER) AS rfm_m_score
    FROM (SELECT user_id, sum(buy_count) AS f, count(*) FILTER (WHERE buy_count > 0) AS m FROM pair GROUP BY user_id) u LEFT JOIN (
        SELECT user_id, floor((epoch((SELECT CAST(max(CAST(time AS DATE)) + 1 AS TIMESTAMP) FROM log)) - epoch(max(time))) / 86400) AS days FROM log WHERE behavior_type = 4 GROUP BY user_id) l ON u.user_id = l.user_id"""
PREF = "SELECT user_id, item_category, n / sum(n) OVER (PARTITION BY user_id) AS user_category_pref FROM (SELECT user_id, item_category, sum(buy_count) AS n FROM pair GROUP BY ALL) WHERE n > 0"
WIDE = """SELECT j.*, st.user_streak_days, sl.item_decay_slope, g.user_avg_interval_hours, b.buy_path_type, r.* EXCLUDE (user_id), coalesce(pr.user_category_pref, 0) AS user_category_pref
    FROM joined j LEFT JOIN st ON j.user_id = st.user_id LEFT JOIN sl ON j.item_id = sl.item_id LEFT JOIN g ON j.user_id = g.user_id
    LEFT JOIN b ON j.user_id = b.user_id AND j.item_id = b.item_id LEFT JOIN r ON j.user_id = r.user_id LEFT JOIN pr ON j.user_id = pr.user_id AND j.item_category = pr.item_category"""
PARTS = {"i": DIM_ITEM, "c": DIM_CATEGORY, "u": DIM_USER, "joined": JOINED, "st": STREAK, "heat": HEAT, "sl": SLOPE, "g": GAP, "b": PATH, "r": RFM, "pr": PREF, "wide": WIDE}
NARROW = ("user_pv_count", "item_pv_count", "category_item_count", "user_streak_days", "item_decay_slope", "user_avg_interval_hours", "user_category_pref")
R = lambda names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
ENCODED = """SELECT w.*, t.item_category_te, v.user_id_te FROM wide w
    JOIN (SELECT item_category, avg(CAST(buy_path_type > 0 AS DOUBLE)) AS item_category_te FROM wide GROUP BY item_category) t ON w.item_category = t.item_category
    JOIN (SELECT user_id, avg(CAST(buy_path_type > 0 AS DOUBLE)) AS user_id_te FROM wide GROUP BY user_id) v ON w.user_id = v.user_id"""
FILLED = "SELECT * REPLACE (coalesce(item_decay_slope, 0) AS item_decay_slope, coalesce(user_avg_interval_hours, (SELECT median(user_avg_interval_hours) FROM wide)) AS user_avg_interval_hours) FROM wide"
SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in (*NARROW, "item_category_te", "user_id_te"))
SERVED = ("user_pv_count", "user_avg_interval_hours", "item_category_te")


CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]
_AS_OF = {
    "cuts": "SELECT CAST(unnest([" + ", ".join(f"'{c}'" for c in CUTS) + "]) AS DATE) AS as_of",
    "seen": "SELECT c.as_of, l.* FROM log l JOIN cuts c ON CAST(l.time AS DATE) < c.as_of",
    "p": f"SELECT as_of, user_id, item_id, {COUNTS} FROM seen GROUP BY ALL",
    "ud": "SELECT as_of, user_id, count(DISTINCT CAST(time AS DATE)) AS active_days, max(time) AS last FROM seen GROUP BY ALL",
    "idd": "SELECT as_of, item_id, count(DISTINCT CAST(time AS DATE)) AS active_days FROM seen GROUP BY ALL",
} | {n: f"SELECT as_of, {k}, {SUMS}, count(*) FILTER (WHERE pv_count > 0) AS n_viewed, count(*) FILTER (WHERE pv_count > 0 AND buy_count > 0) AS n_bought FROM p GROUP BY ALL" for n, k in (("u", "user_id"), ("i", "item_id"))}
_SIDE = lambda t, days, name: f"{', '.join(f'{t}.{c}_count AS {name}_{c}_count' for c in ('pv', 'fav', 'cart', 'buy'))}, {days}.active_days AS {name}_active_days, {t}.n_viewed AS {name}_n_viewed, {t}.n_bought AS {name}_n_bought, {ratio(f'{t}.n_bought', f'{t}.n_viewed')} AS {name}_view_to_buy_rate"
AS_OF = f"""SELECT p.user_id, p.item_id, p.as_of, {_SIDE('u', 'ud', 'user')}, {_SIDE('i', 'idd', 'item')}, {', '.join(f'p.{c}_count AS pair_{c}_count' for c in ('pv', 'fav', 'cart', 'buy'))},
    round((epoch(CAST(p.as_of AS TIMESTAMP)) - epoch(ud.last)) / 3600.0e0, 6) AS user_hours_since_last
    FROM p JOIN u USING (as_of, user_id) JOIN ud USING (as_of, user_id) JOIN i USING (as_of, item_id) JOIN idd USING (as_of, item_id)"""
FOLDS = """SELECT f.user_id, f.item_id, f.buy_path_type, f.fold, round(coalesce((u.s - a.s) / CAST(nullif(u.n - a.n, 0) AS DOUBLE), r.rest), 6) AS user_id_te, round(coalesce((i.s - b.s) / CAST(nullif(i.n - b.n, 0) AS DOUBLE), r.rest), 6) AS item_id_te FROM f
    JOIN (SELECT user_id, sum(y) AS s, count(*) AS n FROM f GROUP BY ALL) u USING (user_id) JOIN (SELECT user_id, fold, sum(y) AS s, count(*) AS n FROM f GROUP BY ALL) a USING (user_id, fold)
    JOIN (SELECT item_id, sum(y) AS s, count(*) AS n FROM f GROUP BY ALL) i USING (item_id) JOIN (SELECT item_id, fold, sum(y) AS s, count(*) AS n FROM f GROUP BY ALL) b USING (item_id, fold)
    JOIN (SELECT fold, (sum(sum(y)) OVER () - sum(y)) / CAST(sum(count(*)) OVER () - count(*) AS DOUBLE) AS rest FROM f GROUP BY fold) r USING (fold)"""


def _wide(s, d):
    return features.wide_table(logs.log_h(s, d))


def _served(s, d):
    wide = _wide(s, d)
    return preprocess.served(wide.withColumn("item_category", F.when(F.col("item_category") == 3, 99).otherwise(F.col("item_category"))), preprocess.fit_parameters(wide, list(SERVED)), list(SERVED))


def _candidates(s, d):
    """The wide table of candidate pairs, many of them never seen, some of items that the log doesn't know."""
    log = logs.log_h(s, d)
    targets = joins.resolved_candidates(candidates(s, d), log).drop("status")
    return features.wide_table(log, ["user_id", "item_id", "buy_path_type", *NARROW], targets)


QUERIES = {
    "FT13_candidate_wide": lambda s, d: rounded(_candidates(s, d)),
    "FT12_as_of": lambda s, d: rounded(point_in_time.as_of_features(logs.log_h(s, d), point_in_time.samples_at(logs.log_h(s, d), CUTS))),
    "PP3_fold_encoded": lambda s, d: rounded(point_in_time.fold_encoded(features.buy_path(dims.pairs(logs.log_h(s, d))).withColumn("fold", F.pmod(F.col("user_id") * 31 + F.col("item_id"), F.lit(5))), {"user_id_te": "user_id", "item_id_te": "item_id"}, F.col("buy_path_type") > 0)),
    "FT1_target_pairs": lambda s, d: features.target_pairs(logs.log_h(s, d)),
    "FT2_streak_days": lambda s, d: features.streak_days(logs.log_h(s, d)),
    "FT3_daily_heat": lambda s, d: features.daily_heat(logs.log_h(s, d)),
    "FT4_decay_slope": lambda s, d: rounded(features.decay_slope(logs.log_h(s, d))),
    "FT5_interval_hours": lambda s, d: rounded(features.interval_hours(logs.log_h(s, d))),
    "FT5_interval_hours_orders": lambda s, d: rounded(features.interval_hours(logs.log_o(s, d))),
    "FT6_buy_path": lambda s, d: features.buy_path(dims.pairs(logs.log_h(s, d))),
    "FT7_FT8_FT9_rfm": lambda s, d: features.rfm(logs.log_h(s, d), dims.pairs(logs.log_h(s, d))),
    "FT10_category_preference": lambda s, d: rounded(features.category_preference(dims.pairs(logs.log_h(s, d)))),
    "FT11_latent_scores": lambda s, d: features.latent_scores(dims.pairs(logs.log_h(s, d))),
    "FT12_wide_table": lambda s, d: rounded(_wide(s, d)),
    "FT13_inference_wide": lambda s, d: rounded(features.wide_table(logs.log_h(s, d), ["user_id", "item_id", *NARROW])),
    "PP1_dropped": lambda s, d: rounded(preprocess.dropped(_wide(s, d)).select("user_id", "item_id", "active_days", "day_pct")),
    "PP2_filled": lambda s, d: rounded(preprocess.filled(_wide(s, d)).select("user_id", "item_id", *NARROW)),
    "PP3_target_encoded": lambda s, d: rounded(preprocess.target_encoded(_wide(s, d)).select("user_id", "item_id", "item_category_te", "user_id_te")),
    "PP4_standardised": lambda s, d: rounded(preprocess.standardised(dims.pairs(logs.log_h(s, d)), ["pv_count", "buy_count"]).select("user_id", "item_id", "pv_count", "buy_count")),
    "PP5_preprocessed": lambda s, d: rounded(preprocess.preprocessed(_wide(s, d)).select("user_id", "item_id", *NARROW, "item_category_te", "user_id_te")),
    "PP6_parameters": lambda s, d: rounded(preprocess.fit_parameters(_wide(s, d), list(SERVED))["scales"]),
    "PP7_served": lambda s, d: rounded(_served(s, d)),
    "FS1_variances": lambda s, d: rounded(selection.variances(_wide(s, d), list(NARROW))),
    "FS2_mutual_information": lambda s, d: rounded(selection.mutual_information(preprocess.filled(_wide(s, d)), list(NARROW), "buy_path_type")),
    "FS3_correlations": lambda s, d: rounded(selection.correlations(preprocess.filled(_wide(s, d)), list(NARROW))),
    "FS6_rank_overlap": lambda s, d: selection.rank_overlap(selection.variances(_wide(s, d), list(NARROW)), "variance", selection.mutual_information(preprocess.filled(_wide(s, d)), list(NARROW), "buy_path_type"), "mi", (2, 4, 6)),
}

_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM f" for i, a in enumerate(NARROW) for b in NARROW[i + 1 :])
_VAR = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(var_samp({c}), 6) AS variance, var_samp({c}) >= 0.01 AS kept FROM wide" for c in NARROW)
_MI = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(sum(p * ln(p / (pb * py))), 6) AS mi FROM (SELECT DISTINCT b, y, count(*) OVER (PARTITION BY b, y) / n AS p, count(*) OVER (PARTITION BY b) / n AS pb, count(*) OVER (PARTITION BY y) / n AS py
    FROM (SELECT buy_path_type AS y, CAST(count(*) OVER () AS DOUBLE) AS n, {' + '.join(f"CAST(round({c}, 6) > (SELECT round(quantile_cont({c}, {q / 10}), 6) FROM f) AS INTEGER)" for q in range(1, 10))} AS b FROM f))"""
    for c in NARROW
)
_ONE = {k: PARTS[k] for k in PARTS}

_TARGETS = {"cand": CAND, "tg": f"SELECT user_id, item_id, item_category FROM ({RESOLVED})"} | PARTS | {"joined": JOINED.replace("(SELECT user_id, item_id, item_category FROM pair)", "tg")}
SQL = {
    "FT13_candidate_wide": over(LOG_H, f"SELECT user_id, item_id, buy_path_type, user_pv_count, item_pv_count, category_item_count, user_streak_days, {R(NARROW[4:])} FROM wide", **_TARGETS),
    "FT1_target_pairs": over(LOG_H, "SELECT user_id, item_id, item_category FROM pair"),
    "FT2_streak_days": over(LOG_H, STREAK),
    "FT3_daily_heat": over(LOG_H, HEAT),
    "FT4_decay_slope": over(LOG_H, "SELECT item_id, round(item_decay_slope, 6) AS item_decay_slope FROM sl", heat=HEAT, sl=SLOPE),
    "FT5_interval_hours": over(LOG_H, "SELECT user_id, round(user_avg_interval_hours, 6) AS user_avg_interval_hours FROM g", g=GAP),
    "FT5_interval_hours_orders": over(LOG_O, "SELECT user_id, round(user_avg_interval_hours, 6) AS user_avg_interval_hours FROM g", g=GAP),
    "FT6_buy_path": over(LOG_H, PATH),
    "FT7_FT8_FT9_rfm": over(LOG_H, RFM),
    "FT10_category_preference": over(LOG_H, "SELECT user_id, item_category, round(user_category_pref, 6) AS user_category_pref FROM p", p=PREF),
    "FT12_wide_table": over(LOG_H, f"SELECT * REPLACE ({R(('item_decay_slope', 'user_avg_interval_hours', 'user_category_pref'))}) FROM wide", **PARTS),
    "FT12_as_of": over(LOG_H, AS_OF, **_AS_OF),
    "PP3_fold_encoded": over(LOG_H, FOLDS, b=PATH, f="SELECT *, (user_id * 31 + item_id) % 5 AS fold, CAST(buy_path_type > 0 AS INTEGER) AS y FROM b"),
    "FT13_inference_wide": over(LOG_H, f"SELECT user_id, item_id, user_pv_count, item_pv_count, category_item_count, user_streak_days, {R(NARROW[4:])} FROM wide", **PARTS),
    "PP1_dropped": over(LOG_H, "SELECT user_id, item_id, active_days, day_pct FROM wide", **PARTS),
    "PP2_filled": over(LOG_H, f"SELECT user_id, item_id, user_pv_count, item_pv_count, category_item_count, user_streak_days, {R(NARROW[4:])} FROM f", **PARTS, f=FILLED),
    "PP3_target_encoded": over(LOG_H, f"SELECT user_id, item_id, {R(('item_category_te', 'user_id_te'))} FROM e", **PARTS, e=ENCODED),
    "PP4_standardised": over(LOG_H, "SELECT user_id, item_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ("pv_count", "buy_count")) + " FROM pair"),
    "PP5_preprocessed": over(LOG_H, f"SELECT user_id, item_id, {SCALED} FROM e", **PARTS, f=FILLED, e=ENCODED.replace("FROM wide w", "FROM f w")),
    "PP6_parameters": over(LOG_H, " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM e" for c in SERVED), **PARTS, f=FILLED, e=ENCODED.replace("FROM wide w", "FROM f w")),
    "PP7_served": over(
        LOG_H,
        "SELECT user_id, item_id, " + ", ".join(f"round(({v} - (SELECT avg({c}) FROM e)) / (SELECT stddev_pop({c}) FROM e), 6) + 0 AS {c}" for c, v in (("user_pv_count", "user_pv_count"), ("user_avg_interval_hours", "user_avg_interval_hours"), ("item_category_te", "CASE WHEN item_category = 3 THEN (SELECT avg(CAST(buy_path_type > 0 AS DOUBLE)) FROM wide) ELSE item_category_te END"))) + " FROM e",
        **PARTS, f=FILLED, e=ENCODED.replace("FROM wide w", "FROM f w"),
    ),
    "FS1_variances": over(LOG_H, _VAR, **PARTS),
    "FS2_mutual_information": over(LOG_H, _MI, **PARTS, f=FILLED),
    "FS3_correlations": over(LOG_H, _CORR, **PARTS, f=FILLED),
    "FS6_rank_overlap": over(LOG_H, " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n_shared FROM va JOIN vb ON va.column_name = vb.column_name WHERE va.r <= {k} AND vb.r <= {k}" for k in (2, 4, 6)), **PARTS, f=FILLED, va=f"SELECT column_name, row_number() OVER (ORDER BY variance DESC, column_name) AS r FROM ({_VAR})", vb=f"SELECT column_name, row_number() OVER (ORDER BY mi DESC, column_name) AS r FROM ({_MI})"),
}
