import hashlib
from collections import Counter

import numpy as np
import pytest

from basketwise.llm.substring_dedup import least_of, remove_repeated

from .helpers import documents, prose, rows, words


def brute(texts, width):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fixture():
    passage = prose(1, 60)
    return [
        "",
        None,
        "   \n\t ",
        prose(2, 34),
        prose(3, 35),
        prose(3, 35),
        prose(4, 100) + " " + passage + "\n" + prose(5, 50),
        passage,
        prose(6, 20) + "\t" + passage[: len(passage) // 2 + 60] + " é " + prose(7, 10),
        "a " * 90,
        prose(8, 40) + " " + prose(8, 40) + " " + prose(8, 20),
        prose(9, 200, 3),
        "x" * 5000 + " " + prose(10, 40),
        prose(11, 300),
    ]


@pytest.mark.parametrize("width,base", [(35, 18), (35, 9), (8, 3)])
def test_equals_brute_force(spark, width, base):
    texts = fixture()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeated(documents(spark, texts).repartition(3), width, base).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = prose(20, 50)
    df = documents(spark, [(1, text), (1, text), (None, prose(21, 50)), (2, prose(22, 50)), (2, prose(23, 50))]).selectExpr("*", "1 AS k", "'x' AS hash", "0 AS place")
    got = rows(remove_repeated(df), "doc_id", "n_words", "n_removed")
    assert got == sorted([(1, 50, 50), (1, 50, 50), (None, 50, 0), (2, 50, 0), (2, 50, 0)], key=repr)


def test_blocks_of_any_size_agree(spark, monkeypatch):
    from basketwise.llm import substring_dedup

    texts = fixture()
    for size in (1, 2000):
        monkeypatch.setattr(substring_dedup, "BLOCK", size)
        got = rows(remove_repeated(documents(spark, texts).repartition(2), 35, 9), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(got) == [(i, *x) for i, x in enumerate(brute(texts, 35))]


def test_texts_stay_where_they_lie(spark):
    """Texts meet what they are told without an exchange of their own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = remove_repeated(documents(spark, fixture()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    texts, told = plan.split("SortMergeJoin")[1].split("FileScan")[:2]
    assert "Exchange" not in texts and "Exchange" in told


def test_empty_table_and_text_out(spark):
    assert remove_repeated(documents(spark, [])).count() == 0
    out = remove_repeated(documents(spark, ["q r " + prose(1, 40), prose(1, 40) + " z"]), text_out=True)
    assert rows(out, "doc_id", "kept_text") == [(0, "q r"), (1, "z")]


def test_least_of_takes_the_first_of_equals():
    values = np.array([3, 1, 1, 2, 0, 0, 5], np.uint64)
    assert least_of(values, 3).tolist() == [1, 1, 4, 4, 4]


def parity_words(n=1024):
    """Two words of ``n`` letters that polynomial hashes modulo a power of two can't tell apart."""
    return ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1)]


def test_structured_words_are_told_apart(spark):
    texts = ["w " * 34 + w for w in parity_words()] + ["v " * 34 + w for w in parity_words(4096)]
    assert [r[1] for r in rows(remove_repeated(documents(spark, texts)), "doc_id", "n_removed")] == [0, 0, 0, 0]


def test_structured_windows_are_told_apart():
    from basketwise.llm.words import runs

    a, b = np.uint64(7), np.uint64(99)
    for width in (32, 35, 1024):
        one = np.array([(a, b)[i.bit_count() % 2] for i in range(width)], np.uint64)
        other = np.array([(b, a)[i.bit_count() % 2] for i in range(width)], np.uint64)
        assert runs(one, width, 1)[0] != runs(other, width, 1)[0]
        assert len(runs(np.tile(one, 2), width, 1)) == width + 1
        assert runs(np.tile(one, 2), width, 1)[0] == runs(one, width, 1)[0]
