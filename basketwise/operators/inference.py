"""Batch inference from a raw log and candidate pairs to predictions, with stored parameters and a stored model."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import written
from . import clean, features, joins, metrics, models, preprocess


@dataclass(frozen=True)
class Stored:
    """What serving needs: the features in the order of the model's weights, their parameters, the model, a threshold."""

    columns: list[str]
    parameters: dict[str, DataFrame]
    model: LogisticRegressionModel
    threshold: float


def fitted(wide: DataFrame, labels: DataFrame, columns: list[str]):
    """``(parameters, model)``: serving parameters of a wide table and a logistic model on its labelled pairs."""
    wide = written(wide, "wide")
    parameters = {n: written(df, n) for n, df in preprocess.fit_parameters(wide, columns).items()}
    ready = preprocess.served(wide, parameters, columns).join(labels.select("user_id", "item_id", "label"), ["user_id", "item_id"])
    return parameters, models.fit_logistic(written(ready, "ready"), columns, "label")[0]


def store(path: str, parameters: dict[str, DataFrame], model, columns: list[str], threshold: float) -> None:
    """Write parameters, model and what they are for under ``path``. The description is written last: without it there is
    nothing to load, so a broken run leaves no half of a model behind."""
    for n, df in parameters.items():
        df.write.mode("overwrite").parquet(f"{path}/parameters/{n}")
    model.write().overwrite().save(f"{path}/model")
    about = parameters["base"].sparkSession.range(1).select(F.array(*map(F.lit, columns)).alias("columns"), F.lit(float(threshold)).alias("threshold"), F.lit(type(model).__name__).alias("kind"))
    about.write.mode("overwrite").json(f"{path}/about")


def stored(spark: SparkSession, path: str, columns: list[str] | None = None) -> Stored:
    """What ``store`` has written. Other features than ``columns``, or in another order, are an error, as is a threshold
    outside 0 to 1 or a model with other weights; nothing there is a ``FileNotFoundError``."""
    try:
        about = spark.read.json(f"{path}/about").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        about = None
    if about is None:
        raise FileNotFoundError(f"no model is stored under {path}")
    own = list(about["columns"])
    if columns is not None and own != list(columns):
        raise ValueError(f"the stored model is for other features: {own}")
    metrics.validated_thresholds([about["threshold"]])
    model = LogisticRegressionModel.load(f"{path}/model")
    if model.numFeatures != len(own):
        raise ValueError(f"the stored model has {model.numFeatures} weights for {len(own)} features")
    return Stored(own, {n: spark.read.parquet(f"{path}/parameters/{n}") for n in ("rates", "base", "scales")}, model, about["threshold"])


def stored_or_fitted(spark: SparkSession, path: str, columns: list[str], wide, labels, threshold: float = 0.5, rebuild: bool = False) -> Stored:
    """The stored model, fitted and stored first if there is none; ``wide`` and ``labels`` give the tables to fit and are only
    called then."""
    if not rebuild:
        try:
            return stored(spark, path, columns)
        except FileNotFoundError:
            pass
    store(path, *fitted(wide(), labels(), columns), columns, threshold)
    return stored(spark, path, columns)


def resolved(candidates: DataFrame, known: DataFrame, failure_policy: str = "reject") -> tuple[DataFrame, DataFrame, dict]:
    """``(pairs, rejects, counts)`` of candidates: looked up and written once, and counted from what was written. Conflicts are an
    error, unmatched items one too unless the policy is ``reject``."""
    status = lambda s: F.count_if(F.col("status") == s)
    told = written(joins.resolved_candidates(candidates, known), "candidates")
    counts = told.agg(F.count(F.lit(1)).alias("n_candidates"), status("ok").alias("n_pairs"), status("unmatched").alias("n_rejects"), status("conflict").alias("n_conflicts")).first().asDict()
    if counts["n_conflicts"]:
        raise ValueError(f"{counts['n_conflicts']} candidates contradict the known category")
    if counts["n_rejects"] and failure_policy == "error":
        raise ValueError(f"{counts['n_rejects']} candidates have unknown items")
    return told.where("status = 'ok'").drop("status"), told.where("status = 'unmatched'").drop("status"), counts


def inferred(raw: DataFrame, candidates: DataFrame, parameters: dict[str, DataFrame], model, columns: list[str], threshold: float, failure_policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """``(predictions, rejects)`` of candidate pairs: the log is cleaned, candidates get their category from it (or are
    rejected), their features are built from it whether the pair was seen or not, filled and scaled as fitted, and scored."""
    log = clean.valid_behaviours(raw).where("time is not null")
    pairs, rejects, _ = resolved(candidates, log, failure_policy)
    return predicted(features.wide_table(log, targets=pairs), Stored(columns, parameters, model, threshold)), rejects


def predicted(wide: DataFrame, with_model: Stored) -> DataFrame:
    ready = preprocess.served(wide, with_model.parameters, with_model.columns)
    return metrics.predictions(models.score(with_model.model, ready, with_model.columns), with_model.threshold)


def run(merged: dict[str, DataFrame], candidates: DataFrame, with_model: Stored, out: str, failure_policy: str = "reject") -> DataFrame:
    """Serve candidates from merged partials: predictions and rejects as CSV and one row of metadata as JSON under ``out``.
    Features and scores are computed once, and every count is taken of what was written. Returns the row of metadata.

    (``Observation`` would count during the write, but once a Spark 4.1 session has used one, its freshly fitted MLlib models can't be sent to
    tasks any more.)
    """
    from ..streaming import partials

    began = time.time()
    pair = written(merged["pairs"], "pairs")
    pairs, rejects, counts = resolved(candidates, pair, failure_policy)
    wide = partials.wide_table(merged | {"pairs": pair}, targets=pairs)
    own = written(predicted(wide, with_model), "predictions")
    files.write_csv(own, f"{out}/predictions.csv")
    files.write_csv(rejects, f"{out}/rejects.csv")
    seen = own.agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(F.col("predicted_label") == 1).alias("n_positive"), F.max("purchase_probability").alias("max_probability")).first().asDict()
    values = counts | seen | {"threshold": with_model.threshold, "n_features": len(with_model.columns), "elapsed_seconds": round(time.time() - began, 3)}
    values.pop("n_conflicts")
    metadata = files.run_metadata(candidates.sparkSession, **values)
    metadata.write.mode("overwrite").json(f"{out}/metadata.json")
    return metadata
