"""Incremental aggregation, models and batch inference."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from ..operators import features, inference, labels, metrics, models, preprocess, selection, trees
from ..operators.ranges import ranked
from ..sources import logs
from ..sources.scratch import own_dir, written
from ..streaming import partials
from .base import HOURLY, LOG_H, PAIR, over, rounded
from .dimensions import CAND, RESOLVED, candidates
from .evaluation import scored
from .features import NARROW
from .features import SERVED as SERVED_FEW
from .features import SQL as FEATURE_SQL
from .sampling import SPECIAL

FEATURES = ["user_pv_count", "item_pv_count", "user_buy_count"]
SERVED = ["user_pv_count", "item_pv_count", "category_item_count", "user_streak_days", "item_decay_slope", "user_avg_interval_hours", "user_category_pref", "item_category_te"]


def _added(s, d):
    """The raw log, chunk by chunk: a stream cleans each and adds its partials, a batch job merges them."""
    folder = f"{own_dir(s)}/chunks-{uuid.uuid4().hex}"
    raw = written(logs.log_raw(s, d).repartition(4), "raw")
    source = s.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(raw.inputFiles()[0].rpartition("/")[0])
    partials.start(s, source, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return partials.finalize(s, f"{folder}/out")


def _merged(s, d):
    """As ``_added``, the log in one batch."""
    folder = f"{own_dir(s)}/batch-{uuid.uuid4().hex}"
    partials.add(logs.log_raw(s, d), 0, folder)
    return partials.finalize(s, folder)


def _model(s, d, merged):
    """The model of these tables, fitted once a session and application and loaded from then on."""
    path = f"{own_dir(s)}/model-{zlib.crc32(d.encode()):08x}"
    return inference.stored_or_fitted(s, path, SERVED, lambda: partials.wide_table(merged), lambda: labels.window_labels(logs.log_h(s, d)))


def _asked(s, d):
    """Candidates that don't contradict the log, seen or not; those of unknown items are rejected."""
    return candidates(s, d).withColumn("item_category", F.lit(None).cast("int"))


def _inferred(s, d):
    """Partials of the log, features of candidates from them, predictions by the stored model."""
    merged = _merged(s, d)
    merged["pairs"] = written(merged["pairs"], "pairs")
    pairs, _, _ = inference.resolved(_asked(s, d), merged["pairs"])
    return inference.predicted(partials.wide_table(merged, targets=pairs), _model(s, d, merged))


def _metadata(s, d):
    """Predictions, rejects and metadata written; of the latter the counts that don't depend on the model."""
    merged = _merged(s, d)
    row = inference.run(merged, _asked(s, d), _model(s, d, merged), f"{own_dir(s)}/served-{uuid.uuid4().hex}")
    return row.select("n_candidates", "n_pairs", "n_rejects", "n_predictions", "threshold", F.col("n_features").cast("long").alias("n_features"))


def _stored_parameters(s, d):
    """Serving parameters, written and read back."""
    own = list(SERVED_FEW)
    path = f"{own_dir(s)}/parameters-{uuid.uuid4().hex}"
    preprocess.cached_parameters(s, path, features.wide_table(logs.log_h(s, d)), own)
    return preprocess.cached_parameters(s, path, None, own)["scales"]


def _scores(s, d):
    ready = written(scored(s, d), "scored")
    return models.score(models.fit_logistic(ready, FEATURES, "label")[0], ready, FEATURES)


def _stacked(s, d):
    """Scores of the meta-model on out-of-fold logits of a logistic model and boosted trees."""
    oof = written(models.out_of_fold(written(scored(s, d), "scored"), FEATURES, "label"), "oof")
    model, own = models.stacked(oof, "label")
    return models.score(model, metrics.logits(oof, ["score_logistic", "score_boosted"]), own)


def _hours(s, d):
    """The raw log as a stream of four files in order of time, its hours counted as they close."""
    folder = f"{own_dir(s)}/hours-{uuid.uuid4().hex}"
    raw = ranked(logs.log_h(s, d), ["time", "event_id"], "nth", size="n").withColumn("quarter", F.floor((F.col("nth") - 1) * 4 / F.col("n")))
    raw = written(raw, "ordered")
    for i in range(4):  # one after the other, so that their times of writing are in order
        raw.where(F.col("quarter") == i).drop("nth", "n", "quarter").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = s.readStream.schema(raw.drop("nth", "n", "quarter").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    partials.stream_hours(source, f"{folder}/out", f"{folder}/checkpoint", "48 hours")
    found = s.read.schema("start timestamp, pv_count long, fav_count long, cart_count long, buy_count long, unique_users long, unique_items long").parquet(f"{folder}/out")
    return found.select(F.to_date("start").alias("date"), F.hour("start").alias("hour"), "pv_count", "fav_count", "cart_count", "buy_count", "unique_users", "unique_items")


def _tree_parts(s, d):
    """What each feature adds to the margin of a boosted model, for each labelled pair."""
    ready = written(scored(s, d), "scored")
    return trees.tree_contributions(ready, models.fit_boosted(ready, FEATURES, "label", rounds=10, depth=4), FEATURES)


def _results(s, rows, kind):
    """A few results of a search as a table."""
    return s.createDataFrame([{k: r[k] for k in kind} for r in rows], ", ".join(f"{k} {t}" for k, t in kind.items()))


def _split(s, d):
    ready = written(labels.tune_split(labels.with_stratum(scored(s, d), SPECIAL)), "split")
    return ready.where("split = 'train'"), ready.where("split = 'val'")


def _protocol(s, d):
    samples = written(labels.with_stratum(scored(s, d), SPECIAL), "samples")
    found = models.baseline_protocol(samples, FEATURES, int(0.8 * samples.count()))
    return _results(s, [found | found["ranking"]], {"threshold": "double", "f1": "double", "roc_auc": "double", "average_precision": "double"})


def _selected(s, d):
    """Columns that pass all filters, long: one row a kept column and pair."""
    table, report = selection.select_features(written(scored(s, d), "scored"), [*FEATURES, "score", "score_b"], "label")
    return table.select("user_id", "item_id", *report["final"])

QUERIES = {
    "ST1_partials": lambda s, d: partials.pair_partials(logs.log_h(s, d).withColumn("batch_id", F.col("event_id") % 4)),
    "ST2_merged_pairs": lambda s, d: partials.merged_pairs(partials.pair_partials(logs.log_h(s, d).withColumn("batch_id", F.col("event_id") % 4))),
    "ST2_merged_users": lambda s, d: partials.merged_users(partials.user_partials(logs.log_h(s, d).withColumn("batch_id", F.col("event_id") % 4))),
    "ST3_clean_and_count": lambda s, d: partials.batch_counts(logs.log_raw(s, d).withColumn("batch_id", F.col("event_id") % 4)),
    "ST3_streamed_pairs": lambda s, d: _added(s, d)["pairs"],
    "ST2_streamed_days": lambda s, d: _added(s, d)["days"],
    "ST2_streamed_wide": lambda s, d: rounded(partials.wide_table(_added(s, d), ["user_id", "item_id", *NARROW])),
    "SNK4_run_metadata": _metadata,
    "PP8_stored_parameters": lambda s, d: rounded(_stored_parameters(s, d)),
    "ML3_grid_search": lambda s, d: _results(s, models.grid_search(written(scored(s, d), "scored"), FEATURES, "label"), {"reg": "double", "f1": "double"}),
    "ML4_tuning": lambda s, d: _results(s, models.tune(*_split(s, d), FEATURES, "label"), {"rounds": "int", "depth": "int", "average_precision": "double"}),
    "ML6_sampling_methods": lambda s, d: _results(s, models.compare_sampling(*_split(s, d), FEATURES), {"method": "string", "precision": "double", "recall": "double", "f1": "double"}),
    "ML7_protocol": _protocol,
    "ML8_batch_scores": _scores,
    "ML9_batch_inference": _inferred,
    "FS4_selected": _selected,
    "FS5_l1_importance": lambda s, d: selection.l1_importance(written(scored(s, d), "scored"), FEATURES, "label"),
    "ML1_logistic_scores": lambda s, d: rounded(models.logistic_scores(scored(s, d), FEATURES, "label"), 4),
    "ML2_boosted_scores": lambda s, d: models.boosted_scores(scored(s, d), FEATURES, "label"),
    "ML5_out_of_fold": lambda s, d: models.out_of_fold(scored(s, d), FEATURES, "label"),
    "ST4_streamed_hours": _hours,
    "ML4_halving": lambda s, d: _results(s, models.successive_halving(*_split(s, d), FEATURES, "label", models.drawn_settings(27)), {"trial": "int", "rung": "int", "rounds": "int", "depth": "int", "step_size": "double", "min_instances": "int", "subsample": "double", "average_precision": "double"}),
    "ML5_stacked_scores": _stacked,
    "FS2_neighbour_information": lambda s, d: rounded(selection.neighbour_information(written(scored(s, d), "scored"), [*FEATURES, "score", "score_b"], "label")),
    "EV20_tree_contributions": _tree_parts,
    "EV21_top_tree_contributions": lambda s, d: metrics.top_contributions(_tree_parts(s, d), 2),
    "ML10_coefficients": lambda s, d: models.coefficient_table(*models.fit_logistic(scored(s, d), FEATURES, "label", 0.01, 0.0)),
}

SQL = {
    "ST1_partials": over(LOG_H, PAIR.replace("SELECT user_id", "SELECT event_id % 4 AS batch_id, user_id").replace("GROUP BY user_id", "GROUP BY event_id % 4, user_id")),
    "ST2_merged_pairs": over(LOG_H, "SELECT * FROM pair"),
    "ST2_merged_users": over(LOG_H, "SELECT user_id, count(*) AS n_events, min(time) AS first_time, max(time) AS last_time, max(time) FILTER (WHERE behavior_type = 4) AS last_buy_time FROM log GROUP BY user_id"),
    "ST3_streamed_pairs": over(LOG_H, "SELECT * FROM pair"),
    "ST2_streamed_days": over(LOG_H, """SELECT user_id, CAST(time AS DATE) AS d, count(*) AS n, count(DISTINCT time) AS n_times, min(time) AS first, max(time) AS last, max(time) FILTER (WHERE behavior_type = 4) AS last_buy,
        count(*) FILTER (WHERE hour(time) BETWEEN 6 AND 17) AS n_day, count(*) FILTER (WHERE hour(time) >= 18) AS n_evening, count(*) FILTER (WHERE hour(time) < 6) AS n_night, false AS is_power_user FROM log GROUP BY ALL"""),
    "ST2_streamed_wide": FEATURE_SQL["FT13_inference_wide"],
    "ST4_streamed_hours": over(LOG_H, "SELECT * FROM h WHERE CAST(date AS TIMESTAMP) + to_hours(hour + 1) <= (SELECT max(time) FROM log) - INTERVAL 48 HOURS", h=HOURLY),
    "SNK4_run_metadata": over(LOG_H, f"SELECT count(*) AS n_candidates, count(*) FILTER (WHERE status <> 'unmatched') AS n_pairs, count(*) FILTER (WHERE status = 'unmatched') AS n_rejects, count(*) FILTER (WHERE status <> 'unmatched') AS n_predictions, CAST(0.5 AS DOUBLE) AS threshold, CAST({len(SERVED)} AS BIGINT) AS n_features FROM res", cand=CAND, res=RESOLVED),
    "PP8_stored_parameters": FEATURE_SQL["PP6_parameters"],
    "ST3_clean_and_count": f"SELECT event_id % 4 AS batch_id, count(*) AS n_rows, count(*) FILTER (WHERE behavior_type <= 4) AS n_valid FROM ({LOG_H.replace(' WHERE behavior_type <= 4', '')}) GROUP BY ALL",
}
