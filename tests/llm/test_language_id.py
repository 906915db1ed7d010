import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from basketwise.llm.language_id import ContextTrees, Rows, predict
from basketwise.llm.queries import op10_language_id
from basketwise.llm.storage import table

from .helpers import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op10_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_and_no_model(spark):
    train = documents(spark, ["the cat sat on the mat " * 20, "a dog ran off with it " * 20], lang="en").unionByName(documents(spark, ["der hund und die katze " * 20, "ein haus am see ist schön " * 20], lang="de")).unionByName(documents(spark, ["x", None], lang=None))
    df = documents(spark, [None, "", "123 !?", "the cat", "die katze ist schön", "é" * 50000, (None, "the mat"), (3, "the cat")]).selectExpr("*", "1 AS id")
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in predict(df, train).collect()), key=repr)
    assert got == sorted([(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (5, "de"), (None, "en"), (3, "en")], key=repr)
    assert {r["lang_pred"] for r in predict(df, train.where(F.lit(False))).collect()} == {"und"}
    assert predict(df.where(F.lit(False)), train).count() == 0


def ppm(texts, data):
    """Bits of some bytes by PPM-C of order three over the counts of ``texts``."""
    seen = {k: Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)) for k in range(1, 5)}
    after: dict = {}
    for k, grams in seen.items():
        for g, n in grams.items():
            after.setdefault(g[:-1], {})[g[-1]] = n

    def cost(context, byte):
        own = after.get(context)
        shorter = lambda: cost(context[1:], byte) if context else 8.0
        if not own:
            return shorter()
        total = sum(own.values()) + len(own)
        return -math.log2(own[byte] / total) if byte in own else -math.log2(len(own) / total) + shorter()

    return sum(cost(data[max(0, i - 3) : i], data[i]) for i in range(len(data)))


def test_code_lengths_equal_brute_force():
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choices(letters, k=n))
    learned = {"a": [make("abc d", 300), "x"], "b": [make("abé🙂", 200)], "c": ["b"], "d": [make("cd ", 50), make("xyz", 40)], "e": ["日本語テキスト" * 3]}
    rows_ = [(lang, k, int.from_bytes(g, "big"), n) for lang, ts in learned.items() for k in range(1, 5) for g, n in Counter(t.encode()[i : i + k] for t in ts for i in range(len(t.encode()) - k + 1)).items()]
    counts = pd.DataFrame(rows_, columns=["lang", "size", "gram", "n"])
    texts = ["", "a", "ab", "b\x00b", *(make("abcd é🙂xyz日", n) for n in (3, 4, 50, 400)), make("abc ", 300_000)]
    got = ContextTrees(counts).bits(pa.array(texts[:-1] + [None] + texts[-1:]))
    for i, t in enumerate(texts[:-1]):
        for j, (lang, own) in enumerate(sorted(learned.items())):
            assert abs(got[i, j] - ppm([x.encode() for x in own], t.encode())) < 1e-2, (t, lang)
    assert (got[-2] == 0).all()
    assert abs(got[-1, 0] - ppm([x.encode() for x in learned["a"]], texts[-1].encode())) < 2


def test_rows_of_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 5000).astype(np.uint32)
    keys = np.unique(np.concatenate((keys, np.arange(0, 64, dtype=np.uint32) << np.uint32(26))))
    rows_ = Rows(keys)
    assert (rows_.of(keys) == np.arange(len(keys))).all()
    assert (rows_.of(np.setdiff1d(np.arange(1000, dtype=np.uint32), keys)) == -1).all()


def test_many_languages(spark):
    """More languages than one group of trees, and than any cap; equal texts of two: the first by name."""
    letters = [chr(0x3B1 + i) + chr(0x430 + i) for i in range(24)]
    train = documents(spark, [(0, "")]).limit(0)
    for i in range(24):
        train = train.unionByName(documents(spark, [(i, letters[i] * 40)], lang=f"l{i:02d}"))
    train = train.unionByName(documents(spark, [(99, letters[3] * 40)], lang="zz"))
    got = {r["doc_id"]: r["lang_pred"] for r in predict(documents(spark, [x * 5 for x in letters]), train).collect()}
    assert got == {i: f"l{i:02d}" for i in range(24)}


def test_the_model_is_the_same_however_the_table_is_split(spark):
    from basketwise.llm.language_id import sample_documents

    docs = documents(spark, [(i % 150, f"{chr(97 + i % 20)} word {i % 150}") for i in range(300)] + [(999, "often")] * 400).select("doc_id", "text", "lang")
    drawn = [sorted(r["text"] for r in sample_documents(docs.repartition(n), 200).collect()) for n in (1, 3, 8)]
    assert drawn[0] == drawn[1] == drawn[2] and drawn[0].count("often") <= 1 and 30 < len(drawn[0]) < 200
