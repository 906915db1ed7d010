import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basketwise.llm.packing import Index, WordEncoder, inverse_frequencies, pack, wide_ids

from .helpers import documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def fixture():
    texts = [prose(i, 30 + 37 * i) for i in range(40)]
    return [*texts, None, "", " \n\t ", "x" * 9000, prose(77, 6000), "É́ ΑΣ <|endoftext|>a 's don't 12\x1c3  b", *texts[:3]]


@pytest.mark.parametrize("a_shard", [8, 512])
def test_each_id_once_in_full_windows(spark, a_shard):
    texts = fixture()
    got = pack(documents(spark, texts).repartition(3), PATH, docs_a_shard=a_shard, keep_ids=True).collect()
    model = Tokenizer.from_file(PATH)
    whole = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(of) == set(whole)
    for i, own in of.items():
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            part = whole[i][at : at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(whole[i])
            assert bytes(r["ids"]) == part.tobytes() and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(whole[i])
    room = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        room += at < 2048
    assert room <= -(-len(texts) // a_shard)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 AS key", "'x' AS ids", "2 AS shard")
    got = sorted(((r["doc_id"], r["length"]) for r in pack(df, PATH).collect()), key=repr)
    assert got == sorted([(1, 3), (1, 3), (None, 2)], key=repr)
    assert pack(documents(spark, []), PATH).count() == 0


def test_index_ranks_like_bm25():
    tails = [np.array(x, np.uint32) for x in ([5, 6, 7, 1], [5, 6, 8, 1], [9, 9, 8, 1], [5, 1])]
    idf = inverse_frequencies([(t, sum(t in x for x in tails)) for t in (5, 6, 7, 8, 9)], 4)
    scores = Index(tails, 1, idf, 3.5).scores(0)
    n, avg = 4, np.mean([4, 4, 4, 2])
    want = np.zeros(4)
    for t in (5, 6, 7):
        df = sum(t in x for x in tails)
        for i, x in enumerate(tails):
            tf = (x == t).sum()
            want[i] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    assert np.allclose(scores, want)


def test_ids_equal_the_library(spark):
    """Letters that change under normalisation beside marks, special strings in either case, odd white space."""
    model, rng = Tokenizer.from_file(PATH), random.Random(3)
    odd = ["İ,", "İzmir Tİ.", "\u0958.", "\u09dc,", "\ufb1d.", "\ufb2a.", "<|ENDOFTEXT|>", "<|endoftext|>.", "A\tb.", "É,", "ﬁ.", "\u212b,", " \n ", "", None]
    alphabet = ["a", "B", "É", "ÿ", "ß", "İ", "e\u0301", "\u0958", "\ufb2a", ".", ",", "'s", "-", "7", " ", "\n", "\t", "<|endoftext|>", "<|EndOfText|>", "🙂", "ΑΣ"]
    odd += ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(600)]
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        encoder, model = WordEncoder(path, 1), Tokenizer.from_file(path)
        assert encoder.parted == (path == PATH)
        for _ in range(2):  # the second time from the table
            ids, first = encoder.encode(pa.array(odd))
            for i, t in enumerate(odd):
                assert ids[first[i] : first[i + 1]].tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 1], t


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(documents(spark, ["a  b, c", None, prose(3, 3000)]), path, keep_ids=True).collect()
    model = Tokenizer.from_file(path)
    for i, t in enumerate(["a  b, c", "", prose(3, 3000)]):
        own = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(own, "<u4").tolist() == [*model.encode(t, add_special_tokens=False).ids, 1]


def test_neighbours_share_windows(spark):
    """Documents of one subject go together, although rows of other subjects lie between them; hundreds of copies too."""
    texts = [" ".join(f"s{i % 12}x{random.Random(i).randrange(30)}" for _ in range(1)) + " " + " ".join(f"{chr(97 + i % 12) * 3}{random.Random(97 * i + j).randrange(40)}" for j in range(150)) for i in range(240)]
    got = pack(documents(spark, texts).repartition(3), PATH, docs_a_shard=64).collect()
    of = defaultdict(set)
    for r in got:
        of[r["sequence_id"]].add(r["doc_id"] % 12)
    assert np.mean([len(x) for x in of.values()]) < 2.5
    copies = pack(documents(spark, [prose(1, 200)] * 300 + [prose(2, 50)]), PATH, docs_a_shard=16, part_tokens=4000)
    assert copies.groupBy("doc_id").sum("length").count() == 301


def test_wide_ids(spark):
    df = spark.createDataFrame([(bytes([1, 2, 3, 4]), 2), (bytes([1, 2, 0, 0]), 1)], "ids binary, length long")
    assert [bytes(r[0]) for r in df.select(wide_ids("ids", "length")).collect()] == [bytes([1, 2, 0, 0, 3, 4, 0, 0]), bytes([1, 2, 0, 0])]
