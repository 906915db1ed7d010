"""Models by MLlib: logistic regression, boosted trees, tuning, stacking and scoring."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import metrics, sampling
from .ranges import ranked


def score_column():
    return vector_to_array("probability")[1].alias("score")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)


def fit_logistic(df: DataFrame, columns: list[str], label: str, reg: float = 0.01, l1: float = 0.0, balanced: bool = True):
    """A logistic model, L2 by default, L1 with ``l1=1``; classes weighted to balance."""
    own = sampling.weighted(df.withColumn("label", F.col(label))) if balanced else df.withColumn("weight", F.lit(1.0))
    model = LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, elasticNetParam=l1, maxIter=50).fit(assembled(own, columns))
    return model, columns


def logistic_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    model, _ = fit_logistic(df, columns, label)
    return model.transform(assembled(df, columns)).select("user_id", "item_id", label, score_column())


def fit_boosted(df: DataFrame, columns: list[str], label: str, rounds: int = 20, depth: int = 5):
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=42).fit(assembled(df, columns))


def boosted_scores(df: DataFrame, columns: list[str], label: str, rounds: int = 20) -> DataFrame:
    return fit_boosted(df, columns, label, rounds).transform(assembled(df, columns)).select("user_id", "item_id", label, score_column())


def score(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """Batch scoring of rows without nulls."""
    return model.transform(assembled(df, columns)).select("user_id", "item_id", score_column())


def with_folds(df: DataFrame, label: str, folds: int) -> DataFrame:
    """Stratified folds by rank within each class."""
    placed = ranked(df, [sampling.spread(7), "user_id", "item_id"], "__r", (label,))
    return placed.withColumn("fold", F.pmod("__r", F.lit(folds)).cast("int")).drop("__r")


def grid_search(df: DataFrame, columns: list[str], label: str, regs=(1.0, 0.1, 0.01, 0.001), folds: int = 3) -> list[dict]:
    """Mean F1 of each regularisation over stratified folds, best first."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs)).build()
    ready = assembled(with_folds(sampling.weighted(df), label, folds), columns)
    found = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0), numFolds=folds, foldCol="fold").fit(ready)
    return sorted(({"reg": float(r), "f1": float(f)} for r, f in zip(regs, found.avgMetrics)), key=lambda x: -x["f1"])


def tune(train: DataFrame, val: DataFrame, columns: list[str], label: str, trials=((20, 3), (20, 5), (50, 3))) -> list[dict]:
    """Boosted trees of each (rounds, depth), by average precision on the validation rows, best first."""
    out = []
    for rounds, depth in trials:
        own = fit_boosted(train, columns, label, rounds, depth).transform(assembled(val, columns)).select(F.col(label).alias("label"), score_column())
        out.append({"rounds": rounds, "depth": depth, "average_precision": metrics.ranking(own).first()["average_precision"]})
    return sorted(out, key=lambda x: -(x["average_precision"] or 0))


def drawn_settings(n: int, seed: int = 42) -> list[dict]:
    """``n`` settings of boosted trees, drawn alike each time."""
    rng = random.Random(seed)
    return [{"depth": rng.randint(2, 5), "step_size": round(10 ** rng.uniform(-1.5, -0.3), 4), "min_instances": rng.choice([1, 5, 20]), "subsample": rng.choice([0.6, 0.8, 1.0])} for _ in range(n)]


def successive_halving(train: DataFrame, val: DataFrame, columns: list[str], label: str, settings: list[dict], rounds: int = 1, eta: int = 3, parallel: int = 4) -> list[dict]:
    """All trials, a row each rung: settings are fitted with ``rounds`` rounds, the best part in ``eta`` by average precision on
    the validation rows goes on with ``eta`` times as many, until one is left. So most rounds are spent on settings that
    deserve them: bad ones stop early.

    Both tables are assembled and written once. The trials of a rung are fitted ``parallel`` at a time and ranked together in one
    plan. Ties go to the earlier setting.
    """
    ready = written(assembled(train.withColumn("label", F.col(label).cast("double")), columns).select("features", "label"), "train")
    held = written(assembled(val.withColumn("label", F.col(label).cast("double")), columns).select("features", "label"), "val")
    alive, out, rung = list(range(len(settings))), [], 0

    def fit(trial: int) -> DataFrame:
        s = settings[trial]
        model = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=s["depth"], stepSize=s["step_size"], minInstancesPerNode=s["min_instances"], subsamplingRate=s["subsample"], seed=42).fit(ready)
        return model.transform(held).select(F.lit(trial).alias("trial"), F.col("label").cast("int").alias("label"), score_column())

    with ThreadPoolExecutor(parallel) as pool:
        while alive:
            scores = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), alive))
            found = {r["trial"]: r["average_precision"] or 0.0 for r in metrics.ranking(reduce(DataFrame.unionByName, scores), keys=("trial",)).collect()}
            alive.sort(key=lambda t: (-round(found[t], 12), t))
            out += [{"trial": t, "rung": rung, "rounds": rounds, **settings[t], "average_precision": found[t]} for t in alive]
            if len(alive) == 1:
                break
            alive = alive[: math.ceil(len(alive) / eta)]
            rung, rounds = rung + 1, rounds * eta
    return out


def out_of_fold(df: DataFrame, columns: list[str], label: str, folds: int = 3, ratio: float = 0.25, rounds: int = 20, depth: int = 5) -> DataFrame:
    """Scores of a logistic and a boosted model, each row by models that have not seen its fold; negatives are
    thinned inside the fitted folds only."""
    own = with_folds(df, label, folds)
    parts = []
    for k in range(folds):
        fit, rest = own.where(F.col("fold") != k), assembled(own.where(F.col("fold") == k), columns)
        thin = sampling.undersample(fit.withColumn("label", F.col(label)), ratio)
        line, _ = fit_logistic(thin, columns, label)
        trees = fit_boosted(thin, columns, label, rounds, depth)
        first = line.transform(rest).select("user_id", "item_id", label, "fold", vector_to_array("probability")[1].alias("score_logistic"))
        second = trees.transform(rest).select("user_id", "item_id", vector_to_array("probability")[1].alias("score_boosted"))
        parts.append(first.join(second, ["user_id", "item_id"]))
    return reduce(DataFrame.unionByName, parts)


def stacked(oof: DataFrame, label: str):
    """A logistic model on the logits of out-of-fold scores."""
    ready = metrics.logits(oof, ["score_logistic", "score_boosted"])
    return fit_logistic(ready, ["logit_score_logistic", "logit_score_boosted"], label, balanced=False)


def compare_sampling(train: DataFrame, val: DataFrame, columns: list[str], seeds=(1, 2, 3), ratio: float = 0.5) -> list[dict]:
    """Undersampling (mean and population std over seeds), synthetic positives and class weights, by F1."""
    def one(fit: DataFrame, balanced: bool = False) -> dict:
        model, _ = fit_logistic(fit, columns, "label", balanced=balanced)
        own = model.transform(assembled(val, columns)).select("label", score_column())
        return metrics.confusion(own, [0.5]).first().asDict() | metrics.ranking(own).first().asDict()

    several = [one(sampling.undersample(train, ratio, s)) for s in seeds]
    mean = {k: sum(x[k] for x in several) / len(several) for k in ("precision", "recall", "f1")}
    std = {f"{k}_std": (sum((x[k] - mean[k]) ** 2 for x in several) / len(several)) ** 0.5 for k in mean}
    out = [{"method": "undersample", **mean, **std}, {"method": "smote", **one(sampling.smote(train, columns, ratio))}, {"method": "class_weight", **one(train, True)}]
    return sorted(out, key=lambda x: -x["f1"])


def baseline_protocol(samples: DataFrame, columns: list[str], size: int, val_share: float = 0.2, ratio: float = 0.25) -> dict:
    """Sample, split within strata, balance the part to fit, choose the threshold on the rest."""
    from . import labels

    chosen = sampling.two_level_sample(samples, size)
    split = labels.tune_split(chosen)
    fit = sampling.smote(split.where("split = 'train'"), columns, ratio)
    model, _ = fit_logistic(fit, columns, "label", balanced=False)
    own = model.transform(assembled(split.where("split = 'val'"), columns)).select("label", score_column())
    best = metrics.best_threshold(own).first()
    return {"model": model, "threshold": best["threshold"], "f1": best["f1"], "ranking": metrics.ranking(own).first().asDict()}


def coefficient_table(model, columns: list[str]) -> DataFrame:
    """Signed and absolute effects, largest first."""
    from pyspark.sql import SparkSession

    rows = [(c, float(x), float(abs(x))) for c, x in zip(columns, model.coefficients.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(F.desc("importance"), "feature")


def importance_table(model, columns: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")
