import random

import pytest
from pyspark.sql import functions as F

from basketwise.llm.components import components
from basketwise.llm.near_dedup import near_duplicates, registers, representatives

from .helpers import documents, prose, rows, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, size):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    at = list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def changed(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def fixture():
    texts = ["", None, " \n", "one", "ONE", "one two", "a b c", "A  b\tC", "a b c d", "a b c e"]
    for base in range(6):
        text = prose(base, [30, 60, 120, 250, 600, 1500][base], 5000)
        texts += [text, text.upper(), text + " tail", *(changed(text, n, base * 10 + n) for n in range(1, 1 + len(text.split()) // 25))]
    chain = prose(90, 200, 5000).split(" ")
    texts += [" ".join(chain[i * 12 : i * 12 + 120]) for i in range(7)]  # each like its neighbours only
    texts += ["é" * 20000, "same " * 500, "same " * 501, *(f"{prose(91, 100, 5000)} {i} {i + 1}" for i in range(40))]
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_equals_brute_force(spark, size):
    texts = fixture()
    got = rows(near_duplicates(documents(spark, texts).repartition(3), size), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(texts, size), key=repr)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """With blocks of four, hardly any star and edits upon edits, the last round does the work."""
    from basketwise.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base, texts = prose(7, 150, 5000), []
    for i in range(12):
        parent = changed(base, 6, i)
        texts += [parent, *(changed(parent, 5 + j, 100 * i + j) for j in range(5))]
    got = rows(near_duplicates(documents(spark, texts), 4, stars=1), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(texts, 4), key=repr)


def test_repeated_and_null_ids(spark):
    a, b, c = prose(1, 80, 5000), prose(2, 80, 5000), prose(3, 80, 5000)
    df = documents(spark, [(5, a), (5, b), (7, b), (3, a), (None, a), (9, c), (9, c)]).selectExpr("*", "1 AS id", "2 AS key", "3 AS node")
    assert rows(near_duplicates(df), "doc_id", "component_id", "kept") == sorted([(5, 3, False), (5, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (9, 9, True), (9, 9, True)], key=repr)
    assert representatives(df).columns == df.columns
    assert [r["doc_id"] for r in representatives(df).orderBy("doc_id").collect()] == [None, 3, 9, 9]


def test_two_texts_under_one_id(spark):
    """Each has a near copy of its own; either row order; an empty text under the same id; ids that are strings."""
    a, b = prose(1, 80, 5000), prose(2, 80, 5000)
    own = [(5, a), (5, b), (3, a + " tail"), (7, b + " tail"), (5, ""), (9, prose(3, 80, 5000))]
    for texts in (own, own[::-1]):
        got = rows(near_duplicates(documents(spark, texts)), "doc_id", "component_id", "kept")
        assert got == sorted([(5, 3, False)] * 3 + [(3, 3, True), (7, 3, False), (9, 9, True)], key=repr)
    named = documents(spark, own).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = rows(near_duplicates(named), "doc_id", "component_id", "kept")
    assert got == sorted([("d5", "d3", False)] * 3 + [("d3", "d3", True), ("d7", "d3", False), ("d9", "d9", True)], key=repr)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert representatives(documents(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert rows(components(edges), "node", "component") == sorted([(i, 0) for i in range(41)] + [(100, 100), (101, 100)], key=repr)


def test_registers_agree_as_often_as_sets_are_similar():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (20, 200, 5000):
        shares = []
        for _ in range(60):
            both = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(both[: int(n * 0.9)]), np.sort(both[int(n * 0.1) :])
            shares.append((registers(a) == registers(b)).mean())
        assert abs(np.mean(shares) - 0.8) < 0.03


def test_structured_words_are_no_links(spark):
    texts = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]
    own = documents(spark, [" ".join([t] * 6) for t in texts] + texts)
    assert rows(near_duplicates(own, 4, 80), "doc_id", "component_id") == [(i, i) for i in range(4)]
