"""Quality rules of documents and of the hosts they come from, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: White space between words, symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 8
RULES = ("short", "repetitive", "symbols", "lines")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated windows are found inside a row: window hashes (64 bits) that are all distinct, as in most
    texts, end it; others are sorted with their places, so a text of n words costs n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__w", F.filter(F.split(text, SPACE), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__lines": lines, "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    windows = F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))))
    df = df.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__h": windows}).drop("__lines", "__w")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed)).drop("__h")
    same = F.zip_with(F.slice("__s", 1, F.size("__s") - 1), F.slice("__s", 2, F.size("__s") - 1), lambda a, b: a["h"] == b["h"])
    df = df.withColumn("__e", F.when(F.col("__s").isNotNull(), F.concat(F.array(F.lit(False)), same, F.array(F.lit(False)))))
    marked = F.zip_with(F.zip_with("__s", F.slice("__e", 1, F.size("__s")), lambda s, e: F.struct(s["i"].alias("i"), e.alias("e"))), F.slice("__e", 2, F.size("__s")), lambda s, e: F.when(s["e"] | e, s["i"]))
    df = df.withColumn("__p", F.sort_array(F.filter(marked, lambda i: i.isNotNull()))).drop("__s", "__e")
    steps = F.zip_with(F.slice("__p", 1, F.size("__p") - 1), F.slice("__p", 2, F.size("__p") - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.when(F.size("__p") > 0, covered).otherwise(0).cast("long")).drop("__p")


def failures() -> dict:
    """Each rule as a condition on the measures."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repetitive": F.col("n_repeat_words") * 100 > n * 30,
        "symbols": F.col("n_symbols") * 10 > n * 3,
        "lines": F.col("n_dup_lines") * 10 > n * 3,
    }


def base_failed():
    told = failures()
    return told["short"] | told["repetitive"]


def host_rates(features: DataFrame, host_col: str = "source") -> tuple[DataFrame, dict]:
    """``(host, n, f_<rule>..., rate_<rule>...)``, and each rule's prior.

    Failures are summed by host before the shuffle, so a host with most of all rows is one row of each task.
    A rate is shrunk to that of all hosts, ``(failures + mean * weight) / (n + weight)``: the mean of a beta
    posterior whose prior has the mean and the spread of the hosts' own rates (by moments; where the spread
    tells nothing the weight is at its bounds of 2 and 1000 documents).
    """
    counts = [F.count_if(c).alias(f"f_{r}") for r, c in failures().items()]
    hosts = features.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *counts)
    total = hosts.agg(*(F.sum(f"f_{r}").alias(f"s_{r}") for r in RULES), *(F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES), F.sum("n").alias("n")).first()
    priors, out = {}, hosts
    for r in RULES:
        mean = (total[f"s_{r}"] or 0) / (total["n"] or 1)
        spread = total[f"v_{r}"] or 0.0
        weight = min(1000.0, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
        priors[r] = (mean, weight)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))
    return out, priors


def rejected_hosts(features: DataFrame, most: float = 0.5, host_col: str = "source") -> DataFrame:
    rates, _ = host_rates(features, host_col)
    return rates.where(" or ".join(f"rate_{r} > {most}" for r in RULES)).select("host")


def verdicts(docs: DataFrame, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: ``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, host_failed)``.

    A document is kept if it passes the base rules (at least 20 words, at most 30 in a hundred of them in
    repeated windows) and its host passes: none of the host's shrunk failure rates (the base rules, many
    symbols, many repeated lines) may exceed ``most``. A null text has no words and fails; a document
    without a host is judged by itself; repeated rows each count and each give a row; an empty table gives
    none; a very long text is measured whole, inside its row; other columns play no part. A rate equal to ``most`` passes. The
    measures, a few numbers a document, are written once and read for hosts and documents.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    features = written(measured(source).drop("text").withColumn("base_failed", base_failed()), "features")
    bad = rejected_hosts(features, most).withColumn("host_failed", F.lit(True))
    out = features.join(bad, features["source"] == bad["host"], "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed")


def passing(docs: DataFrame, most: float = 0.5, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, whole, that ``verdicts`` keeps. Texts are measured once and don't shuffle: rows are written with
    their measures, those that fail without their text, and only the few rejected hosts are joined."""
    names = [f"__c_{i}" for i in range(len(docs.columns))]
    mine = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names)), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    told = measured(mine).withColumn("__failed", base_failed())
    text = names[docs.columns.index(text_col)]
    rows = (F.when(~F.col("__failed"), F.col(n)).alias(n) if n == text else F.col(n) for n in names)
    told = written(told.select(*rows, "source", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "__failed"), "measured")
    bad = written(rejected_hosts(told, most).toDF("__host"), "hosts")
    good = told.where("not __failed").join(bad, F.col("source") == F.col("__host"), "left_anti")
    return good.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
