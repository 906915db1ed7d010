"""Evaluation queries on deterministic pseudo-scores full of ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, labels, metrics
from ..sources import logs
from ..sources.scratch import written
from .base import LOG_H, LOG_O, over, rounded
from .sampling import LABELS

FEATURES = ("user_pv_count", "item_pv_count", "user_buy_count")
WEIGHTS = (0.02, -0.01, 0.05)


def scored(s, d, source=logs.log_h, by_user=False):
    """Labelled pairs with features and pseudo-scores. ``by_user``: the log lies in buckets of users. All up to users' features is
    then made bucket by bucket, and items are counted from pairs, so that no task holds more items than a bucket has pairs. They are
    written, as queries that need no counts would leave the pairs out. Pairs meet items by hash, a share of the items a task, and
    aren't sorted for it."""
    log = source(s, d)
    lab = labels.colocated_labels(log) if by_user else labels.window_labels(log)
    by = lambda k: log.groupBy(k).agg(F.count_if(F.col("behavior_type") == 1).alias(f"{k[:4]}_pv_count"), F.count_if(F.col("behavior_type") == 4).alias(f"{k[:4]}_buy_count"))
    pseudo = lambda a, b, m: F.pmod(F.col("user_id") * a + F.col("item_id") * b + 7, F.lit(m)) / float(m)
    if by_user:
        own = log.groupBy("user_id", "item_id").agg(F.count_if(F.col("behavior_type") == 1).alias("n"))
        items = written(own.groupBy("item_id").agg(F.sum("n").alias("item_pv_count")), "items").hint("shuffle_hash")
    else:
        items = by("item_id").drop("item_buy_count")
    return lab.join(by("user_id"), "user_id").join(items, "item_id").withColumns({"score": pseudo(31, 17, 997), "score_b": pseudo(13, 29, 983)})


SC = f"""SELECT l.*, u.user_pv_count, u.user_buy_count, i.item_pv_count, (l.user_id * 31 + l.item_id * 17 + 7) % 997 / CAST(997 AS DOUBLE) AS score, (l.user_id * 13 + l.item_id * 29 + 7) % 983 / CAST(983 AS DOUBLE) AS score_b FROM ({LABELS}) l
    JOIN (SELECT user_id, count(*) FILTER (WHERE behavior_type = 1) AS user_pv_count, count(*) FILTER (WHERE behavior_type = 4) AS user_buy_count FROM log GROUP BY ALL) u ON l.user_id = u.user_id
    JOIN (SELECT item_id, count(*) FILTER (WHERE behavior_type = 1) AS item_pv_count FROM log GROUP BY ALL) i ON l.item_id = i.item_id"""


def _auc(source: str, keys: str = "", score: str = "score") -> str:
    """Pairs counted by ranks: AUC by mid-ranks and average precision by distinct scores."""
    k, p = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""SELECT {k}CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (max(np) * max(nn)), 6) END AS roc_auc, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(np), 6) END AS average_precision FROM (
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({p}) AS np, sum(neg) OVER ({p}) AS nn FROM (SELECT {k}{score} AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY ALL)
        WINDOW w AS ({p} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)){f' GROUP BY {keys}' if keys else ''}"""


def _conf(source: str, keys: str = "", t: str = "threshold") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}threshold, tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
        round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM (
        SELECT {k}{t} AS threshold, count(*) FILTER (WHERE label = 1 AND score >= {t}) AS tp, count(*) FILTER (WHERE label = 0 AND score >= {t}) AS fp, count(*) FILTER (WHERE label = 0 AND score < {t}) AS tn, count(*) FILTER (WHERE label = 1 AND score < {t}) AS fn FROM {source} GROUP BY ALL)"""


TH = "SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in metrics.THRESHOLDS) + "]) AS threshold"
SWEEP = _conf("sc, th")
SEG = lambda parts: " UNION ALL ".join(f"SELECT '{n}' AS segment, * FROM sc WHERE {c}" for n, c in parts)
SEGMENTED = f"SELECT b.segment, b.n_rows, b.positive_rate, c.* EXCLUDE (segment, threshold), a.roc_auc, a.average_precision FROM (SELECT segment, count(*) AS n_rows, round(avg(label), 6) AS positive_rate FROM sg GROUP BY segment) b JOIN ({_conf('sg', 'segment', 'CAST(0.5 AS DOUBLE)')}) c ON b.segment = c.segment JOIN ({_auc('sg', 'segment')}) a ON b.segment = a.segment"
PCT = "SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS ra, (rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS rb FROM sc"
TYPE = "CASE WHEN label = 1 AND score >= 0.5 THEN 'TP' WHEN label = 0 AND score >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' ELSE 'FN' END"
LONG = " UNION ALL ".join(f"SELECT user_id, item_id, label, '{c}' AS feature, {w} * ({c} - (SELECT avg({c}) FROM sc)) AS contribution FROM sc" for c, w in zip(FEATURES, (f"CAST({x} AS DOUBLE)" for x in WEIGHTS)))


def _contrib(s, d):
    return metrics.contributions(scored(s, d), list(FEATURES), list(WEIGHTS))


def _orders(s, d):
    """Scores of the order log: as many rows as a large test table has."""
    return scored(s, d, lambda s, d: logs.log_o_by_user(s, d, "event_id"), by_user=True)


def _three(s, d):
    return scored(s, d).withColumn("score_c", F.pmod(F.col("user_id") * 7 + F.col("item_id") * 11 + 3, F.lit(991)) / 991.0)


def _with_power(s, d):
    """Scores of users that are outliers of the log, or not."""
    power = clean.outlier_users(logs.log_h(s, d)).select("user_id", F.lit(True).alias("is_power_user"))
    return scored(s, d).join(power, "user_id", "left").withColumn("is_power_user", F.coalesce("is_power_user", F.lit(False)))


QUERIES = {
    "EV2_EV3_ranking_orders": lambda s, d: rounded(metrics.ranking(_orders(s, d))),
    "EV5_threshold_sweep_orders": lambda s, d: rounded(metrics.confusion(_orders(s, d), metrics.THRESHOLDS)),
    "EV8_predictions_orders": lambda s, d: metrics.predictions(_orders(s, d), 0.5),
    "EV17_error_profile_orders": lambda s, d: rounded(metrics.error_profile(_orders(s, d), 0.5, list(FEATURES))),
    "EV20_contributions_orders": lambda s, d: rounded(metrics.contributions(_orders(s, d), list(FEATURES), list(WEIGHTS))),
    "EV1_confusion": lambda s, d: rounded(metrics.confusion(scored(s, d), [0.5])),
    "EV2_EV3_ranking": lambda s, d: rounded(metrics.ranking(scored(s, d))),
    "EV4_log_loss": lambda s, d: rounded(metrics.log_loss(scored(s, d))),
    "EV5_threshold_sweep": lambda s, d: rounded(metrics.confusion(scored(s, d), metrics.THRESHOLDS)),
    "EV6_best_threshold": lambda s, d: rounded(metrics.best_threshold(scored(s, d))),
    "EV8_predictions": lambda s, d: metrics.predictions(scored(s, d), 0.5),
    "EV9_user_groups": lambda s, d: rounded(metrics.segment_metrics(scored(s, d), {f"category {k}": F.col("item_category") == k for k in range(5)}, 0.5)),
    "EV10_cold_and_tail": lambda s, d: rounded(metrics.cold_and_tail(scored(s, d), 0.5)),
    "EV11_quantile_segments": lambda s, d: rounded(metrics.quantile_segments(scored(s, d), 0.5)),
    "EV12_daily_stability": lambda s, d: rounded(metrics.daily_stability(scored(s, d))[0]),
    "EV12_stability_summary": lambda s, d: rounded(metrics.daily_stability(scored(s, d))[1]),
    "EV13_at_k": lambda s, d: rounded(metrics.at_k(scored(s, d))),
    "EV14_calibration": lambda s, d: rounded(metrics.calibration(scored(s, d))),
    "EV15_curve_points": lambda s, d: rounded(metrics.curve_points(scored(s, d))),
    "EV16_normalised_confusion": lambda s, d: rounded(metrics.normalised_confusion(scored(s, d), 0.5)),
    "EV17_error_profile": lambda s, d: rounded(metrics.error_profile(scored(s, d), 0.5, list(FEATURES))),
    "EV18_comparison": lambda s, d: rounded(metrics.comparison({"first": scored(s, d), "second": scored(s, d).drop("score").withColumnRenamed("score_b", "score")}, "first")),
    "EV19_contribution_summary": lambda s, d: rounded(metrics.contribution_summary(_contrib(s, d))),
    "EV20_contributions": lambda s, d: rounded(_contrib(s, d)),
    "EV21_top_contributions": lambda s, d: rounded(metrics.top_contributions(_contrib(s, d), 2)),
    "WN1_rank_in_user": lambda s, d: metrics.predictions(scored(s, d), 0.5).select("user_id", "item_id", "rank_in_user"),
    "WN2_percentile_rank": lambda s, d: rounded(metrics.percentile_rank(scored(s, d), "score", "rank").select("user_id", "item_id", "rank")),
    "WN6_cumulative_hits": lambda s, d: rounded(metrics.at_k(scored(s, d), (1, 3))),
    "TK3_bottom_entities": lambda s, d: metrics.bottom_entities(scored(s, d), "user_id", "user_pv_count"),
    "TK4_error_samples": lambda s, d: metrics.error_samples(scored(s, d), 0.5, 20).select("user_id", "item_id", "error_type"),
    "TK5_exemplars": lambda s, d: rounded(metrics.exemplars(scored(s, d))),
    "BL1_fixed_blends": lambda s, d: rounded(metrics.ranking(scored(s, d).withColumn("score", F.round(metrics.blend({"score": 0.5, "score_b": 0.5}), 12)))),
    "BL1_three_score_blends": lambda s, d: rounded(metrics.fixed_blends(_three(s, d), ["score", "score_b", "score_c"])),
    "EV7_chosen_thresholds": lambda s, d: rounded(metrics.confusion(scored(s, d), metrics.validated_thresholds([0.9, 0.2, 0.2, metrics.chosen_threshold(None, 0.4), metrics.chosen_threshold(0.7, 0.4), metrics.chosen_threshold(None, None)]))),
    "EV11_power_segments": lambda s, d: rounded(metrics.quantile_segments(_with_power(s, d), 0.5)),
    "BL2_blend_sweep": lambda s, d: rounded(metrics.blend_sweep(scored(s, d), "score", "score_b")),
    "BL3_logits": lambda s, d: rounded(metrics.logits(scored(s, d), ["score", "score_b"]).select("user_id", "item_id", "logit_score", "logit_score_b")),
}

_P = "least(greatest(score, 1e-15), 1 - 1e-15)"
_RK = "SELECT *, row_number() OVER w AS r, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, item_id)"


def _at(ks) -> str:
    return " UNION ALL ".join(f"SELECT count(*) AS n_users, CAST({k} AS INTEGER) AS k, round(avg(h / CAST({k} AS DOUBLE)), 6) AS precision, round(avg(coalesce(h / nullif(CAST(t AS DOUBLE), 0), 0)), 6) AS recall, round(avg(coalesce(p / nullif(CAST(h AS DOUBLE), 0), 0)), 6) AS map FROM (SELECT user_id, sum(label) AS t, count(*) FILTER (WHERE label = 1 AND r <= {k}) AS h, sum(h / CAST(r AS DOUBLE)) FILTER (WHERE label = 1 AND r <= {k}) AS p FROM rk GROUP BY user_id)" for k in ks)


_QUARTERS = "SELECT quantile_cont(user_pv_count, 0.25) AS q1, quantile_cont(user_pv_count, 0.75) AS q3, quantile_cont(item_pv_count, 1/3) AS t1, quantile_cont(item_pv_count, 2/3) AS t2 FROM sc"
_BY_VIEWS = [
    (f"{who}s_{n}", f"{who}_pv_count {low}" + (f" AND {who}_pv_count {high}" if high else ""))
    for who, a, b in (("user", "q1", "q3"), ("item", "t1", "t2"))
    for n, low, high in (("low", f"<= (SELECT {a} FROM q)", ""), ("mid", f"> (SELECT {a} FROM q)", f"<= (SELECT {b} FROM q)"), ("high", f"> (SELECT {b} FROM q)", ""))
]
_STAB = _auc("(SELECT *, CAST(last_time AS DATE) AS date FROM sc)", "date")
_LOGIT = lambda c: f"round(ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6))), 6)"
_SWEEP = " UNION ALL ".join(f"SELECT label, '{kind}' AS kind, CAST({w} AS DOUBLE) AS weight, round((1 - CAST({w} AS DOUBLE)) * {x} + CAST({w} AS DOUBLE) * {y}, 12) AS score FROM pct" for kind, x, y in (("score", "score", "score_b"), ("rank", "ra", "rb")) for w in (0.05, 0.1, 0.2, 0.3, 0.5))
_BOTTOM = lambda e, f: f"SELECT {e} FROM (SELECT {e}, row_number() OVER (ORDER BY v, {e}) AS r, count(*) OVER () AS n FROM (SELECT {e}, min({f}) AS v FROM sc GROUP BY {e})) WHERE r <= greatest(1, ceil(n * CAST(0.2 AS DOUBLE)))"

SQL = {
    "EV1_confusion": over(LOG_H, _conf("sc", t="CAST(0.5 AS DOUBLE)"), sc=SC),
    "EV2_EV3_ranking": over(LOG_H, _auc("sc"), sc=SC),
    "EV4_log_loss": over(LOG_H, f"SELECT round(avg(-CASE WHEN label = 1 THEN ln({_P}) ELSE ln(1 - {_P}) END), 6) AS log_loss FROM sc", sc=SC),
    "EV5_threshold_sweep": over(LOG_H, SWEEP, sc=SC, th=TH),
    "EV6_best_threshold": over(LOG_H, f"SELECT * FROM ({SWEEP}) ORDER BY f1 DESC, precision DESC, threshold LIMIT 1", sc=SC, th=TH),
    "EV8_predictions": over(LOG_H, "SELECT user_id, item_id, score AS purchase_probability, CAST(score >= 0.5 AS INTEGER) AS predicted_label, CAST(0.5 AS DOUBLE) AS threshold, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank_in_user FROM sc", sc=SC),
    "EV9_user_groups": over(LOG_H, SEGMENTED, sc=SC, sg=SEG([(f"category {k}", f"item_category = {k}") for k in range(5)])),
    "EV10_cold_and_tail": over(LOG_H, SEGMENTED, sc=SC, sg=SEG([("overall", "true"), ("cold_start_users", f"user_id IN ({_BOTTOM('user_id', 'user_pv_count')})"), ("long_tail_items", f"item_id IN ({_BOTTOM('item_id', 'item_pv_count')})")])),
    "EV11_quantile_segments": over(
        LOG_H, SEGMENTED, sc=SC,
        q=_QUARTERS, sg=SEG(_BY_VIEWS),
    ),
    "EV12_daily_stability": over(LOG_H, f"SELECT * FROM ({_STAB}) WHERE roc_auc IS NOT NULL", sc=SC),
    "EV12_stability_summary": over(LOG_H, f"SELECT count(*) AS n_days, round(avg(roc_auc), 6) AS mean_auc, round(stddev_samp(roc_auc), 6) AS std_auc FROM ({_STAB.replace(', 6) END', ', 15) END')}) WHERE roc_auc IS NOT NULL", sc=SC),
    "EV13_at_k": over(LOG_H, _at((5, 10, 20, 30, 50)), sc=SC, rk=_RK),
    "EV14_calibration": over(LOG_H, "SELECT CAST(b.i AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS true_rate FROM sc JOIN (SELECT unnest([0,1,2,3,4,5,6,7]) AS i, unnest([0,.005,.01,.02,.05,.1,.2,.4]) AS lo, unnest([.005,.01,.02,.05,.1,.2,.4,1]) AS hi) b ON score >= b.lo AND score < b.hi GROUP BY b.i HAVING count(*) >= 30", sc=SC),
    "EV15_curve_points": over(LOG_H, "SELECT round(s, 6) AS threshold, round(sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE), 6) AS fpr, round(sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE), 6) AS tpr, round(sum(pos) OVER w / CAST(sum(pos + neg) OVER w AS DOUBLE), 6) AS precision FROM (SELECT score AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY score) WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)", sc=SC),
    "EV16_normalised_confusion": over(LOG_H, "SELECT label, round(avg(CAST(score < 0.5 AS DOUBLE)) * 100, 6) AS predicted_0, round(avg(CAST(score >= 0.5 AS DOUBLE)) * 100, 6) AS predicted_1 FROM sc GROUP BY label", sc=SC),
    "EV17_error_profile": over(LOG_H, f"SELECT {TYPE} AS error_type, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}" for c in (*FEATURES, "score")) + " FROM sc GROUP BY 1", sc=SC),
    "EV18_comparison": over(LOG_H, f"SELECT model, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(ap - (SELECT ap FROM e WHERE model = 'first'), 6) AS delta, ap > (SELECT ap FROM e WHERE model = 'first') AS better FROM e", sc=SC, e=f"SELECT 'first' AS model, roc_auc, average_precision AS ap FROM ({_auc('sc').replace(', 6) END', ', 15) END')}) UNION ALL SELECT 'second', roc_auc, average_precision FROM ({_auc('sc', score='score_b').replace(', 6) END', ', 15) END')})"),
    "EV19_contribution_summary": over(LOG_H, "SELECT feature, round(mean_abs, 6) AS mean_abs, round(mean, 6) + 0 AS mean, round(p, 6) AS mean_positive, round(n, 6) AS mean_negative, round(coalesce(p - n, 0), 6) AS difference, CASE WHEN p > n THEN 'raises' WHEN p < n THEN 'lowers' ELSE 'none' END AS direction FROM (SELECT feature, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean, avg(contribution) FILTER (WHERE label = 1) AS p, avg(contribution) FILTER (WHERE label = 0) AS n FROM lg GROUP BY feature)", sc=SC, lg=LONG),
    "EV20_contributions": over(LOG_H, "SELECT user_id, item_id, label, feature, round(contribution, 6) AS contribution FROM lg", sc=SC, lg=LONG),
    "EV21_top_contributions": over(LOG_H, "SELECT user_id, item_id, CASE WHEN r <= 2 THEN feature ELSE '(rest)' END AS feature, round(sum(contribution), 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(abs(contribution), 9) DESC, feature) AS r FROM lg) GROUP BY 1, 2, 3", sc=SC, lg=LONG),
    "WN1_rank_in_user": over(LOG_H, "SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank_in_user FROM sc", sc=SC),
    "WN2_percentile_rank": over(LOG_H, "SELECT user_id, item_id, round(ra, 6) AS rank FROM pct", sc=SC, pct=PCT),
    "WN6_cumulative_hits": over(LOG_H, _at((1, 3)), sc=SC, rk=_RK),
    "TK3_bottom_entities": over(LOG_H, _BOTTOM("user_id", "user_pv_count"), sc=SC),
    "TK4_error_samples": over(LOG_H, f"(SELECT user_id, item_id, 'FP' AS error_type FROM sc WHERE {TYPE} = 'FP' ORDER BY score DESC, user_id, item_id LIMIT 20) UNION ALL (SELECT user_id, item_id, 'FN' FROM sc WHERE {TYPE} = 'FN' ORDER BY score, user_id, item_id LIMIT 20)", sc=SC),
    "TK5_exemplars": over(LOG_H, " UNION ALL ".join(f"(SELECT '{n}' AS exemplar, user_id, item_id, round(score, 6) AS score FROM sc WHERE label = {y} ORDER BY score {o}, user_id, item_id LIMIT 1)" for n, y, o in (("surest positive", 1, "DESC"), ("surest negative", 0, "DESC"), ("least sure positive", 1, "ASC"))), sc=SC),
    "BL1_fixed_blends": over(LOG_H, _auc("(SELECT label, round(score * 0.5e0 + score_b * 0.5e0, 12) AS score FROM sc)"), sc=SC),
    "BL1_three_score_blends": over(LOG_H, _auc("bl", "blend"), sc=SC, s3="SELECT *, (user_id * 7 + item_id * 11 + 3) % 991 / CAST(991 AS DOUBLE) AS score_c FROM sc", bl=" UNION ALL ".join(f"SELECT label, '{n}' AS blend, round(score * CAST({a!r} AS DOUBLE) + score_b * CAST({b!r} AS DOUBLE) + score_c * CAST({c!r} AS DOUBLE), 12) AS score FROM s3" for n, (a, b, c) in metrics.BLENDS.items())),
    "EV7_chosen_thresholds": over(LOG_H, _conf("sc, th"), sc=SC, th="SELECT unnest([CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS threshold"),
    "EV11_power_segments": over(
        LOG_H, SEGMENTED, sc=SC,
        fence="SELECT quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS f FROM (SELECT user_id, count(*) AS n FROM log GROUP BY user_id)",
        power="SELECT user_id FROM log GROUP BY user_id HAVING count(*) > (SELECT f FROM fence)",
        q=_QUARTERS, sg=SEG([*_BY_VIEWS, ("users_power", "user_id IN (SELECT user_id FROM power)"), ("users_normal", "user_id NOT IN (SELECT user_id FROM power)")]),
    ),
    "BL2_blend_sweep": over(LOG_H, _auc("sw", "kind, weight"), sc=SC, pct=PCT, sw=_SWEEP),
    "BL3_logits": over(LOG_H, f"SELECT user_id, item_id, {_LOGIT('score')} AS logit_score, {_LOGIT('score_b')} AS logit_score_b FROM sc", sc=SC),
}

for _name in ("EV2_EV3_ranking", "EV5_threshold_sweep", "EV8_predictions", "EV17_error_profile", "EV20_contributions"):
    SQL[f"{_name}_orders"] = SQL[_name].replace(f"log AS ({LOG_H})", f"log AS ({LOG_O})")
