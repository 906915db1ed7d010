import math
from collections import Counter

from basketwise.llm.lm_scoring import cross_entropy_difference

from .helpers import documents, prose, words


def brute(texts, target, prior=64.0):
    """With a vocabulary in which every word is frequent."""
    split = [[w.lower() for w in words(t)] for t in texts]

    def model(docs, scale=1.0):
        pair, before = Counter(), Counter()
        for w in docs:
            for a, b in zip(["<", *w], w):
                pair[a, b] += 1
                before[a] += 1
        single = Counter(x for w in docs for x in w)
        total = scale * sum(single.values()) + 512
        return lambda a, b: -math.log2((scale * pair[a, b] + prior * (scale * single[b] + 1) / total) / (scale * before[a] + prior))

    t, g = model([w for i, w in enumerate(split) if i in target]), model(split, sum(len(split[i]) for i in target) / sum(map(len, split)))
    out = []
    for w in split:
        x = [(t(a, b), g(a, b)) for a, b in zip(["<", *w], w)]
        out.append((len(w), *(sum(c) / len(w) for c in zip(*x))) if w else (0, None, None))
    return out


def test_equals_brute_force_and_prefers_the_target(spark):
    texts = [prose(i, 80, 60) for i in range(12)] + [prose(50 + i, 80, 60).replace("w", "V") for i in range(12)] + ["", None, "W1 w1\tw1"]
    target = set(range(6))
    df = documents(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in cross_entropy_difference(df, spark.createDataFrame([(i,) for i in target] + [(None,), (999,)], "x long")).collect()}
    for i, (n, t, g) in enumerate(brute(texts, target)):
        assert got[i]["n_tokens"] == n
        if n:
            assert abs(got[i]["target_bits"] - t) < 1e-4 and abs(got[i]["background_bits"] - g) < 1e-4 and abs(got[i]["score"] - (t - g)) < 1e-4
        else:
            assert got[i]["score"] is None
    assert max(got[i]["score"] for i in range(6, 12)) < min(got[i]["score"] for i in range(12, 24))


def test_no_target_no_rows_repeated_rows(spark):
    none = spark.createDataFrame([], "x long")
    assert cross_entropy_difference(documents(spark, []), none).count() == 0
    df = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 AS id", "2 AS target", "'x' AS tokens")
    assert [r["score"] for r in cross_entropy_difference(df, none).collect()] == [0.0, 0.0, 0.0]


def test_thousands_of_rare_words_keep_their_own_counts(spark):
    texts = [" ".join(f"rare{(i // 2 * 200 + j) % 4000} common" for j in range(200)) for i in range(40)] + [prose(i, 200, 3000) for i in range(20)] + [None]
    split = [[w.lower() for w in words(t)] for t in texts]
    target = set(range(0, 60, 3))
    pair, before, single = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for i, w in enumerate(split):
        for m in (0, 1) if i in target else (0,):
            single[m].update(w)
            pair[m].update(zip(["<", *w], w))
            before[m].update(["<", *w][: len(w)])
    size = len(single[0])
    assert size > 4000
    scale = [sum(single[1].values()) / sum(single[0].values()), 1.0]

    def loss(m, a, b):
        own = (scale[m] * single[m][b] + 1) / (scale[m] * sum(single[m].values()) + size)
        return -math.log2((scale[m] * pair[m][a, b] + 64 * own) / (scale[m] * before[m][a] + 64))

    ids = spark.createDataFrame([(i,) for i in target], "x long")
    for options in ({}, {"block_tokens": 500, "part_cells": 100, "broadcast_ids": 3}):
        got = {r["doc_id"]: r for r in cross_entropy_difference(documents(spark, texts).repartition(3), ids, **options).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(split):
            if w:
                bits = [sum(loss(m, a, b) for a, b in zip(["<", *w], w)) / len(w) for m in (1, 0)]
                assert abs(got[i]["target_bits"] - bits[0]) < 1e-6 and abs(got[i]["background_bits"] - bits[1]) < 1e-6
            else:
                assert got[i]["score"] is None
