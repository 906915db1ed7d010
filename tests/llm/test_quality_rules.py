from basketwise.llm.quality_rules import host_rates, measured, passing, verdicts

from .helpers import documents, prose, rows, words


def brute(text):
    w = words(text)
    seen, repeat = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeat |= {i + j for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def fixture():
    return [None, "", " \n\n\t", "a", "é🙂 b\x0bc\x1cd", prose(1, 7), prose(2, 8), prose(2, 8) + " " + prose(2, 8), "a " * 100, "x\n" * 50 + " \n \n", prose(3, 40) + "\n" + prose(3, 40) + "\nz\nz", prose(4, 300, 4), "#$% <b> & " * 30, prose(5, 5000) + " " + prose(6, 30) + " q " + prose(6, 30), " nbsp  one"]


def test_measures_equal_brute_force(spark):
    texts = fixture()
    got = {r["doc_id"]: tuple(r)[1:] for r in measured(documents(spark, texts).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)


def test_host_verdicts_shrink(spark):
    good, bad = prose(1, 50), "a " * 60
    df = documents(spark, [(i, good) for i in range(60)], source="fine").unionByName(documents(spark, [(100 + i, bad) for i in range(60)] + [(199, good)], source="junk"))
    df = df.unionByName(documents(spark, [(200, bad)], source="tiny")).unionByName(documents(spark, [(201, good)], source="tiny")).unionByName(documents(spark, [(300, good), (300, good), (None, "x")], source=None))
    df = df.selectExpr("*", "1 AS host", "2 AS n_words", "3 AS id")
    got = rows(verdicts(df), "doc_id", "base_failed", "kept")
    assert [r for r in got if r[0] == 199] == [(199, False, False)]
    assert [r for r in got if r[0] == 201] == [(201, False, True)]
    assert [r for r in got if r[0] == 300] == [(300, False, True)] * 2
    assert [r for r in got if r[0] is None] == [(None, True, False)]
    assert sum(r[2] for r in got) == 60 + 1 + 2
    kept = passing(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in got if r[2])


def test_empty_table(spark):
    df = documents(spark, [])
    assert verdicts(df).count() == 0 and passing(df).count() == 0
    assert host_rates(measured(df))[1]["short"] == (0, 1000.0)
