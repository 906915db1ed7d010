import hashlib
import random

import numpy as np
import pytest

from basketwise.llm import queries
from basketwise.llm.syncmers import anchors, code_points, edited_likeness, fingerprints, likeness, read_back, rising
from basketwise.llm.words import runs

from .helpers import documents, prose

K, S = 32, 8


def brute_positions(text):
    """Every k-mer by itself."""
    out = []
    for i in range(len(text) - K + 1):
        inner = [int(runs(code_points(text[i + j : i + j + S]).astype(np.uint64), S, S)[0]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out if len(text) >= K else [0] * (len(text) > 0)


def brute_edited(rows):
    """Texts with their edited ones and the next, by id and text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    texts = [t or "" for _, t in order]
    out = []
    for j, (i, _) in enumerate(order):
        text, after = texts[j], texts[(j + 1) % len(texts)]
        cut = len(text) // 2
        out.append((i, text, text[: len(text) - cut] + after[:cut], after))
    return out


def test_anchors_equal_brute_force():
    texts = [prose(1, 60), "", "short", "x" * K, "é漢😀" * 20, "a" * 100, prose(2, 9)]
    position, value, first = anchors(texts, K, S)
    for i, text in enumerate(texts):
        assert position[first[i] : first[i + 1]].tolist() == brute_positions(text), text
    # equal k-mers have equal hashes, others don't
    seen = {}
    for i, text in enumerate(texts):
        for p, v in zip(position[first[i] : first[i + 1]], value[first[i] : first[i + 1]]):
            assert seen.setdefault(text[p : p + K], v) == v
    assert len(set(seen.values())) == len(seen)


def test_anchors_depend_on_nothing_around_them():
    a, b = prose(3, 200), prose(4, 200)
    alone, joined = anchors([a], K, S), anchors([b + a], K, S)
    inside = {(p - len(b), v) for p, v in zip(joined[0].tolist(), joined[1].tolist()) if p >= len(b)}
    assert inside == set(zip(alone[0].tolist(), alone[1].tolist()))
    assert np.diff(alone[0]).max() <= K - S + 1 and alone[0][0] <= K - S  # one in so many k-mers at least
    assert len(alone[0]) < 4 * len(a) / (K - S + 1)


def test_likeness():
    assert rising(np.array([3, 1, 2, 5, 4, 6])) == 4 and rising(np.array([], int)) == 0
    a = np.array([5, 6, 7, 7, 8])
    assert likeness(a, a) == 1 and likeness(a[:0], a[:0]) == 1 and likeness(a, a[:0]) == 0
    assert likeness(a, np.array([7, 5, 6, 7])) == 2 * 3 / 9  # the first 7 stands out of order
    assert likeness(a, a[::-1]) == 2 * 2 / 10  # the sevens stay in order
    assert likeness(np.array([1, 2]), np.array([3, 4])) == 0


def docs():
    rng = random.Random(2)
    out = [(i * 3 + 1, prose(i, rng.randrange(1, 300))) for i in range(80)]
    out += [(1000, None), (1001, ""), (1002, "é😀" * 400), (1003, "tiny"), (1004, prose(5, 20_000)), (1005, prose(5, 20_000)), (1005, "same id"), (1005, "same id"), (None, "no id"), (None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 30])
def test_equals_brute_force(spark, bucket_bytes):
    rows = docs()
    got = edited_likeness(documents(spark, rows).repartition(5), bucket_bytes=bucket_bytes).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    want = []
    for i, text, edited, after in brute_edited(rows):
        prints = anchors([text, edited, after], K, S)
        own, new, then = (prints[1][prints[2][j] : prints[2][j + 1]] for j in range(3))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, new), 9), round(likeness(own, then), 9)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        position, value = read_back(r["fingerprint"])
        other = read_back(r["edited_fingerprint"])
        assert abs(likeness(value, other[1]) - r["near_edited"]) < 1e-9
        assert r["n_chars"] < K or (position.max() <= r["n_chars"] - K and (np.diff(position) > 0).all())
    by_text = {}
    for i, text, edited, _ in brute_edited(rows):
        by_text.setdefault(text, set()).update(x["fingerprint"] for x in got if x["doc_id"] == i and x["n_chars"] == len(text))
    assert all(len(x) == 1 for t, x in by_text.items())


def test_without_shuffle_and_odd_tables(spark):
    own = documents(spark, [(1, "one text"), (2, None)])
    assert {tuple(r) for r in fingerprints(own).select("doc_id", "n_chars").collect()} == {(1, 8), (2, 0)}
    assert {r["doc_id"]: len(r["fingerprint"]) for r in fingerprints(own).collect()} == {1: 6, 2: 0}
    assert edited_likeness(documents(spark, [])).count() == 0
    one = edited_likeness(documents(spark, [(7, "abcdef")]).selectExpr("*", "1 AS bucket", "2 AS copy", "3 AS id")).first()
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abcabc").hexdigest())
    with pytest.raises(ValueError):
        fingerprints(own, k=65)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op12_syncmers(spark, path).collect()}
    assert len(got) == len(rows)
    for i, text, edited, _ in brute_edited([tuple(r) for r in rows]):
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.4
