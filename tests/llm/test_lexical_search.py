import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketwise.llm import queries
from basketwise.llm.lexical_search import TERM, Shard, ranked_search, terms
from tests.oracle import assert_same, connect

from .helpers import documents, prose


def own_terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every document's score for every item."""
    known = [(i, Counter(own_terms(t)), len(own_terms(t))) for i, t in docs if own_terms(t)]
    n_docs, n_terms = len(known), sum(n for _, _, n in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in known:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own_terms(text) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **options):
    out = ranked_search(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()))


def test_terms_are_runs_of_letters_digits_and_all_but_ascii():
    texts = ["Ab-c1  É_x;漢字 ", None, "", "a", "b", "--", "é é😀z"]
    every, n = terms(pa.array(texts))
    assert [x.decode() for x in every.to_pylist()] == [t for x in texts for t in own_terms(x)]
    assert n.tolist() == [len(own_terms(x)) for x in texts]


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    docs = [(i, prose(i, rng.randrange(1, 120), 60)) for i in range(300)] + [(300 + i, prose(7, 40, 60)) for i in range(30)]
    docs += [(400, None), (401, ""), (402, "-- ;"), (403, "W1 É w2 É"), (404, "w1 " * 5000 + "rare")]
    items = [(i, prose(900 + i, 12, 60)) for i in range(12)] + [(50, None), (51, ""), (52, "none-of-these"), (53, "RARE w1 w1 w1"), (54, docs[310][1]), (55, "é É")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, shard_docs=17) == want
    assert found(spark, docs, items, block_terms=20) == want  # several blocks of queries
    assert found(spark, docs, items, block_items=5) == want
    assert found(spark, docs, items, k=3) == [x for x in want if x[1] <= 3]


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    docs = [(1, "x y"), (1, "x y"), (2, "x"), (None, "x y")]
    got = found(spark, docs, [(1, "x"), (1, "x"), (2, "y")])
    assert [(x[0], x[1], x[2]) for x in got if x[0] == 2] == [(2, 1, None), (2, 2, 1), (2, 3, 1)]
    assert found(spark, [], [(1, "x")]) == [] and found(spark, docs, []) == []
    odd = documents(spark, docs).selectExpr("*", "1 AS id", "2 AS n", "'s' AS terms", "3 AS item", "4 AS score", "5 AS rank")
    assert ranked_search(odd, spark.createDataFrame([(2, "y", 1)], "item_id long, text string, q long")).count() == 3


def test_search_stops_before_the_ends_of_lists():
    rng = np.random.default_rng(3)
    n, size = np.full(4000, 50), np.full(4000, 2)
    shard = Shard(n, size, np.tile([0, 1], 4000), rng.integers(1, 2000, 8000), np.array([3000, 2000]), 4000, 200_000)
    accessed = []
    docs_of = shard.docs

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            accessed.append(np.size(out))
            return out

    shard.docs = docs_of.view(Counted)
    docs, scores = shard.search(np.array([0, 1]), np.array([1, 2]), 10, 0)
    want = np.sort(np.bincount(shard.doc_of, shard.score_of * np.array([1, 2])[shard.term_of]))[::-1][:10]
    assert np.sort(scores)[::-1][:10].tolist() == want.tolist()
    assert sum(accessed) < 4000  # of 8000
    assert len(shard.search(np.array([0, 1]), np.array([1, 2]), 10, int(want[0]))[0]) >= 1  # a floor keeps what equals it


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert_same(queries.op11_lexical_search(spark, path), connect(path), queries.ORACLE_SQL["op11_lexical_search"])
