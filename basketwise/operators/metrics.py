"""Evaluation of scores: tables with label (0 or 1) and a score column. Curves work on distinct scores, so what
meets in a window has one row a score, and each segment its own windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dims import rate
from .ranges import quantile_row, quantiles, ranked, running

#: The thresholds of the sweep and the edges of the calibration bins.
THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
CALIBRATION = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 1.0)


def validated_thresholds(thresholds) -> list[float]:
    out = sorted(set(map(float, thresholds)))
    if not out or out[0] < 0 or out[-1] > 1:
        raise ValueError(f"thresholds must lie in 0 to 1: {out}")
    return out


def chosen_threshold(override: float | None, stored: float | None) -> float:
    return override if override is not None else stored if stored is not None else 0.5


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return {"accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def confusion(df: DataFrame, thresholds, score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at each threshold: one pass, the thresholds side by side in each row's sums."""
    y, p = F.col("label") == 1, F.col(score)
    cells = [F.count_if(c).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in (("tp", y & (p >= t)), ("fp", ~y & (p >= t)), ("tn", ~y & (p < t)), ("fn", y & (p < t)))]
    one = df.groupBy(*keys).agg(*cells)
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn"))) for i, t in enumerate(thresholds))))
    out = one.select(*keys, rows.alias("x")).select(*keys, "x.*")
    return out.withColumns(rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def best_threshold(df: DataFrame, thresholds=THRESHOLDS, score: str = "score") -> DataFrame:
    return confusion(df, validated_thresholds(thresholds), score).orderBy(F.round("f1", 9).desc(), F.round("precision", 9).desc(), "threshold").limit(1)


def curve(df: DataFrame, score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, s, pos, neg, tp, fp, n_pos, n_neg)``: a row for each distinct score, sums from the highest down."""
    own = df.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return running(own, [F.desc("s")], {"tp": "pos", "fp": "neg"}, {"n_pos": "pos", "n_neg": "neg"}, keys)


def ranking(df: DataFrame, score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision; null with a single class."""
    c = curve(df, score, keys)
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*keys).agg(F.when(both, area / (F.max("n_pos") * F.max("n_neg"))).alias("roc_auc"), F.when(both, ap / F.max("n_pos")).alias("average_precision"))


def log_loss(df: DataFrame, score: str = "score", eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def predictions(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(score), "item_id"))
    return df.select("user_id", "item_id", F.col(score).alias("purchase_probability"), (F.col(score) >= threshold).cast("int").alias("predicted_label"), F.lit(float(threshold)).alias("threshold"), rank.alias("rank_in_user"))


def percentile_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """Average rank over n: from a table of distinct scores, joined back."""
    own = df.groupBy(score).agg(F.count("*").alias("__c"))
    placed = running(own, [score], {"__u": "__c"}, {"__n": "__c"})
    return df.join(placed.select(score, ((F.col("__u") - (F.col("__c") - 1) / 2.0) / F.col("__n")).alias(name)), score)


def segment_metrics(df: DataFrame, segments: dict[str, Column | None], threshold: float, score: str = "score") -> DataFrame:
    """A row a segment. A row of ``df`` is copied to the segments that it is in, then all are one aggregation."""
    names = F.array(*(F.when(c if c is not None else F.lit(True), F.lit(n)) for n, c in segments.items()))
    wide = df.withColumn("segment", F.explode(F.filter(names, lambda x: x.isNotNull())))
    base = wide.groupBy("segment").agg(F.count("*").alias("n_rows"), F.avg("label").alias("positive_rate"))
    return base.join(confusion(wide, [threshold], score, ("segment",)).drop("threshold"), "segment").join(ranking(wide, score, ("segment",)), "segment")


def bottom_entities(df: DataFrame, entity: str, feature: str, fraction: float = 0.2) -> DataFrame:
    """The ``ceil(fraction * n)`` entities of least feature, ties by id; nulls are left out."""
    own = df.where(F.col(entity).isNotNull() & F.col(feature).isNotNull()).groupBy(entity).agg(F.min(feature).alias("v"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction)))
    return ranked(own, ["v", entity], "r", size="n").where(F.col("r") <= least).select(entity)


def cold_and_tail(df: DataFrame, threshold: float, user_col: str = "user_pv_count", item_col: str = "item_pv_count") -> DataFrame:
    cold = bottom_entities(df, "user_id", user_col).withColumn("cold", F.lit(True))
    tail = bottom_entities(df, "item_id", item_col).withColumn("tail", F.lit(True))
    both = df.join(cold, "user_id", "left").join(tail, "item_id", "left")
    return segment_metrics(both, {"overall": None, "cold_start_users": F.col("cold"), "long_tail_items": F.col("tail")}, threshold)


def quantile_segments(df: DataFrame, threshold: float) -> DataFrame:
    """Metrics of users and items by their views; where ``is_power_user`` is known, of power and normal users too."""
    q = quantile_row(df, {"q1": ("user_pv_count", 0.25), "q3": ("user_pv_count", 0.75), "t1": ("item_pv_count", 1 / 3), "t2": ("item_pv_count", 2 / 3)})
    u, i = F.col("user_pv_count"), F.col("item_pv_count")
    parts = {"users_low": u <= F.col("q1"), "users_mid": (u > F.col("q1")) & (u <= F.col("q3")), "users_high": u > F.col("q3"), "items_low": i <= F.col("t1"), "items_mid": (i > F.col("t1")) & (i <= F.col("t2")), "items_high": i > F.col("t2")}
    if "is_power_user" in df.columns:
        parts |= {"users_power": F.col("is_power_user"), "users_normal": ~F.col("is_power_user")}
    return segment_metrics(df.join(F.broadcast(q)), parts, threshold)


def daily_stability(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    days = ranking(df.withColumn("date", F.to_date("last_time")), keys=("date",)).where("roc_auc is not null")
    return days, days.agg(F.count("*").alias("n_days"), F.avg("roc_auc").alias("mean_auc"), F.stddev_samp("roc_auc").alias("std_auc"))


def at_k(df: DataFrame, ks=(5, 10, 20, 30, 50), score: str = "score") -> DataFrame:
    """Precision, recall and MAP at each k, means over users; AP is over the hits inside the first k."""
    w = W.partitionBy("user_id").orderBy(F.desc(score), "item_id")
    own = df.withColumns({"r": F.row_number().over(w), "h": F.sum("label").over(w.rowsBetween(W.unboundedPreceding, 0)), "t": F.sum("label").over(W.partitionBy("user_id"))})
    hit = F.col("label") == 1
    users = own.groupBy("user_id").agg(F.max("t").alias("t"), *(x for k in ks for x in (F.count_if(hit & (F.col("r") <= k)).alias(f"h{k}"), F.sum(F.when(hit & (F.col("r") <= k), F.col("h") / F.col("r"))).alias(f"p{k}"))))
    one = users.agg(F.count("*").alias("n_users"), *(x for k in ks for x in (F.avg(F.col(f"h{k}") / k).alias(f"precision{k}"), F.avg(rate(F.col(f"h{k}"), F.col("t"))).alias(f"recall{k}"), F.avg(F.coalesce(F.col(f"p{k}") / F.nullif(f"h{k}", F.lit(0)), F.lit(0.0))).alias(f"map{k}"))))
    return one.select("n_users", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}{k}").alias(n) for n in ("precision", "recall", "map"))) for k in ks))).alias("x")).select("n_users", "x.*")


def calibration(df: DataFrame, least: int = 30, score: str = "score") -> DataFrame:
    """Mean score and true rate by left-closed bins; a score of exactly 1 is in none."""
    p = F.col(score)
    bin_ = reduce(lambda acc, i: acc.when((p >= CALIBRATION[i]) & (p < CALIBRATION[i + 1]), i), range(1, len(CALIBRATION) - 1), F.when((p >= CALIBRATION[0]) & (p < CALIBRATION[1]), 0))
    own = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg("label").alias("true_rate"))
    return own.where(F.col("bin").isNotNull() & (F.col("n") >= least))


def curve_points(df: DataFrame, score: str = "score") -> DataFrame:
    c = curve(df, score)
    return c.select(F.col("s").alias("threshold"), rate(F.col("fp"), F.col("n_neg")).alias("fpr"), rate(F.col("tp"), F.col("n_pos")).alias("tpr"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def normalised_confusion(df: DataFrame, threshold: float) -> DataFrame:
    own = df.groupBy("label").agg(F.avg((F.col("score") < threshold).cast("double")).alias("predicted_0"), F.avg((F.col("score") >= threshold).cast("double")).alias("predicted_1"))
    return own.select("label", (F.col("predicted_0") * 100).alias("predicted_0"), (F.col("predicted_1") * 100).alias("predicted_1"))


def error_type(threshold: float) -> Column:
    y, hit = F.col("label") == 1, F.col("score") >= threshold
    return F.when(y & hit, "TP").when(~y & hit, "FP").when(~y, "TN").otherwise("FN")


def error_profile(df: DataFrame, threshold: float, features: list[str]) -> DataFrame:
    names = (*features, "score")
    typed = df.withColumn("error_type", error_type(threshold))
    own = typed.groupBy("error_type").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in names))
    mids = quantiles(typed, list(names), [0.5], ("error_type",)).groupBy("error_type").agg(*(F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"median_{c}") for c in names))
    return own.join(mids, "error_type", "left")


def error_samples(df: DataFrame, threshold: float, n: int = 200) -> DataFrame:
    """The surest false positives and the least sure false negatives."""
    typed = df.withColumn("error_type", error_type(threshold))
    pick = lambda t, order: typed.where(F.col("error_type") == t).orderBy(order, "user_id", "item_id").limit(n)
    return pick("FP", F.desc("score")).unionByName(pick("FN", F.asc("score")))


def exemplars(df: DataFrame) -> DataFrame:
    pick = lambda name, y, order: df.where(F.col("label") == y).orderBy(order, "user_id", "item_id").limit(1).select(F.lit(name).alias("exemplar"), "user_id", "item_id", "score")
    return pick("surest positive", 1, F.desc("score")).unionByName(pick("surest negative", 0, F.desc("score"))).unionByName(pick("least sure positive", 1, F.asc("score")))


def comparison(tables: dict[str, DataFrame], baseline: str, digits: int = 9) -> DataFrame:
    """Ranking metrics of several score tables, with the difference to a baseline. All are one evaluation, and differences are
    taken of figures rounded to ``digits``: sums of doubles come in another order each time, and the baseline is never better
    than itself."""
    own = [df.select(F.lit(n).alias("model"), "label", "score") for n, df in tables.items()]
    every = written(ranking(reduce(DataFrame.unionByName, own), keys=("model",)), "comparison")
    base = every.where(F.col("model") == baseline).select(F.round("average_precision", digits).alias("base"))
    delta = F.round("average_precision", digits) - F.col("base")
    return every.join(F.broadcast(base)).withColumns({"delta": delta, "better": (F.col("model") != baseline) & (delta > 0)}).drop("base")


def contributions(df: DataFrame, features: list[str], coefficients: list[float]) -> DataFrame:
    """Exact contributions of a linear model, ``coefficient * (x - mean)``: a long table of (pair, feature)."""
    means = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.col(f"m_{c}"))).alias("contribution")) for c, w in zip(features, coefficients)))
    return df.join(F.broadcast(means)).select("user_id", "item_id", "label", F.explode(cells).alias("x")).select("user_id", "item_id", "label", "x.*")


def contribution_summary(long: DataFrame) -> DataFrame:
    c = F.col("contribution")
    own = long.groupBy("feature").agg(F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean"), F.avg(F.when(F.col("label") == 1, c)).alias("mean_positive"), F.avg(F.when(F.col("label") != 1, c)).alias("mean_negative"))
    gap = F.coalesce(F.col("mean_positive") - F.col("mean_negative"), F.lit(0.0))
    return own.withColumns({"difference": gap, "direction": F.when(gap > 0, "raises").when(gap < 0, "lowers").otherwise("none")})


def top_contributions(long: DataFrame, n: int = 8) -> DataFrame:
    """The largest of each pair with their signs, and the sum of the rest."""
    w = W.partitionBy("user_id", "item_id").orderBy(F.round(F.abs("contribution"), 9).desc(), "feature")
    named = long.withColumn("r", F.row_number().over(w)).withColumn("feature", F.when(F.col("r") <= n, F.col("feature")).otherwise("(rest)"))
    return named.groupBy("user_id", "item_id", "feature").agg(F.sum("contribution").alias("contribution"))


def clipped(c: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))


def blend(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


#: The weights of the fixed blends, by name, for two tree models and a sequence model.
BLENDS = {"tree_equal": (0.5, 0.5, 0.0), "tree_plus_sequence_equal": (1 / 3, 1 / 3, 1 / 3), "tree_plus_sequence_20pct": (0.4, 0.4, 0.2), "tree_plus_sequence_40pct": (0.3, 0.3, 0.4)}


def fixed_blends(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ranking metrics of each fixed blend of three scores, in one plan."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("blend"), F.round(blend(dict(zip(columns, w))), 12).alias("score")) for n, w in BLENDS.items())))
    return ranking(df.select("label", cells.alias("x")).select("label", "x.*"), keys=("blend",))


def logits(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"logit_{c}": F.ln(clipped(F.col(c)) / (1 - clipped(F.col(c)))) for c in columns})


def blend_sweep(df: DataFrame, a: str, b: str, weights=(0.05, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Ranking of ``(1 - w) a + w b`` for each weight, of scores and of their percentile ranks, in one plan."""
    both = percentile_rank(percentile_rank(df, a, "ra"), b, "rb")
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(float(w)).alias("weight"), F.round((1 - w) * F.col(x) + w * F.col(y), 12).alias("score")) for kind, x, y in (("score", a, b), ("rank", "ra", "rb")) for w in weights]
    long = both.select("label", F.explode(F.array(*cells)).alias("x")).select("label", "x.*")
    return ranking(long, keys=("kind", "weight"))
