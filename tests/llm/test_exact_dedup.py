from collections import Counter

from basketwise.llm.exact_dedup import deduplicated, misra_gries, text_digest, verdicts

from .helpers import documents, prose, rows


def fixture():
    return [(i, "hot text") for i in range(60)] + [(100 + i, prose(i % 7, 20)) for i in range(25)] + [(200, ""), (201, None), (202, " "), (203, "É"), (204, "É"), (205, "a"), (206, "A")]


def test_equals_brute_force(spark):
    data = fixture()
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    want = sorted(((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in data), key=repr)
    for counters in (1, 3, 1024):
        got = verdicts(documents(spark, data).selectExpr("*", "1 AS id", "2 AS n", "3 AS digest").repartition(4), counters)
        assert rows(got, "doc_id", "keep_id", "group_size", "kept") == want


def test_repeated_rows_and_null_ids(spark):
    df = documents(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c")])
    got = rows(verdicts(df), "doc_id", "keep_id", "kept")
    assert got == sorted([(1, 1, True), (1, 1, False), (1, 1, True), (None, 1, False), (None, None, True), (None, None, False)], key=repr)
    out = deduplicated(df)
    assert out.columns == df.columns and rows(out, "doc_id", "text") == sorted([(1, "a"), (1, "b"), (None, "c")], key=repr)


def test_empty_table(spark):
    assert verdicts(documents(spark, [])).count() == 0 and deduplicated(documents(spark, [])).count() == 0


def test_misra_gries_finds_every_frequent_digest(spark):
    df = documents(spark, [x for _, x in fixture()]).repartition(5)
    digests = df.select(text_digest(df["text"]).alias("digest"))
    counts = Counter(bytes(r["digest"]) for r in digests.collect())
    n = sum(counts.values())
    for k in (1, 2, 5):
        found = {bytes(r["digest"]) for r in misra_gries(digests, k).collect()}
        assert len(found) <= k and {d for d, c in counts.items() if c > n / (k + 1)} <= found
