import corpus_pipeline
from basketwise.llm.storage import table, written

from .helpers import documents, prose, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_hold_their_promises(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = written(stage(spark, docs, SF), "stage")
        if i < 4:
            assert new.dtypes == docs.dtypes, name
        sizes.append(new.count())
        docs, before = new, docs
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.groupBy("doc_id").sum("length").count() == sizes[4] and before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_small_corpus_by_hand(spark):
    a, b = prose(1, 200, 5000), prose(2, 200, 5000)
    texts = [a, a, a + " end", b + " mail me@here.org now", "too short", None, "spam " * 100]
    docs = documents(spark, texts)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, ""), "stage")
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == {1, 3} and got[1] == a and "<EMAIL>" in got[3] and len(words(got[3])) == 203
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").groupBy("doc_id").count().count() == 2


def run_stages(spark, docs):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.dtypes
        docs = written(stage(spark, docs, ""), "stage")
        assert i == 4 or docs.dtypes == columns
    return docs


def test_empty_table(spark):
    assert run_stages(spark, documents(spark, [])).count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows, a very long text, and columns named like those inside the operators."""
    long = prose(9, 30_000, 20_000) + " call +49 30 1234567"
    rows = [(1, prose(1, 60, 5000)), (1, prose(1, 60, 5000)), (None, prose(2, 60, 5000)), (None, None), (4, None), (5, ""), (6, long), (6, prose(3, 60, 5000)), (7, long + " tail")]
    docs = documents(spark, rows).unionByName(documents(spark, [(8, prose(4, 60, 5000))], lang=None, source=None)).repartition(3)
    names = ["id", "k", "key", "node", "component", "hash", "n_words", "route", "ids", "kept", "digest", "base", "chunks", "term", "host", "rep", "start"]
    got = run_stages(spark, docs.selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(names)))).collect()
    assert {r["doc_id"] for r in got} == {1, None, 6, 8}
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert all(sum(n for _, n in x) == of for (_, of), x in whole.items()) and max(of for _, of in whole) > 30_000
