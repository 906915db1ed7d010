import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketwise.llm.bpe import PairIndexBPE, decode, encode, round_trip_digests
from basketwise.llm.pieces import parts, string
from basketwise.llm.token_counts import LibraryCounter, balanced, token_counts

from .helpers import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "  a  b \n c\n d  ", " lead", "trail ", "a\n b", "aaaaaaaaaa " * 3 + "a" * 4001, "it's we'll I'M 'tis", "x<|endoftext|>y <|endoftext|> <|endof", "é🙂日本 ½²Ⅳ\x1c\x85　z", "\r\n\t \x0b", "12345 6", "__init__ _a_ !!!??? ...", prose(1, 3000)]


def ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids


def test_encode_decode_and_counts_equal_the_library(spark):
    df = documents(spark, ODD + ODD[:4]).selectExpr("*", "1 AS id", "'x' AS ids").repartition(3)
    made = encode(df, PATH)
    assert {r["doc_id"]: r["ids"] for r in made.collect()} == {i: ids(t) for i, t in enumerate(ODD + ODD[:4])}
    assert {r["doc_id"]: r["text"] for r in decode(made, PATH).collect()} == {i: t or "" for i, t in enumerate(ODD + ODD[:4])}
    got = {r["doc_id"]: r for r in round_trip_digests(df, PATH, block_bytes=64).collect()}
    counts = {r["doc_id"]: r for r in token_counts(df, PATH, limit=20, block_bytes=64).collect()}
    for i, t in enumerate(ODD + ODD[:4]):
        own = ids(t)
        assert got[i]["n_tokens"] == counts[i]["n_tokens"] == len(own)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(MODEL.decode(own, skip_special_tokens=False).encode()).hexdigest()
        assert counts[i]["n_bytes"] == len((t or "").encode()) and counts[i]["over_limit"] == (len(own) > 20)


def test_empty_tables(spark):
    df = documents(spark, [])
    assert round_trip_digests(df, PATH).count() == 0 and token_counts(df, PATH).count() == 0


BPE, COUNTER = PairIndexBPE(PATH), LibraryCounter(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'saelr.0é½日🙂\x1c <|endoftext|>"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_any_text(texts):
    found, first = BPE.encode(texts)
    assert [found[a:b].tolist() for a, b in zip(first, first[1:])] == [ids(t) for t in texts]
    assert COUNTER.count(texts).tolist() == [len(ids(t)) for t in texts]
    assert all("".join(map(string, parts(t))) == t for t in texts if t)


def test_tables_start_anew_when_full():
    small = PairIndexBPE(PATH, most_bytes=200)
    for i in range(5):
        text = prose(i, 50)
        assert small.encode([text])[0].tolist() == ids(text)
    with pytest.raises(KeyError):
        PairIndexBPE(public_tokenizers.path("word_bpe_49k.json")).special["none"]


def test_other_vocabularies(spark):
    """SentencePiece files and vocabularies that can't be split get whole texts; the pair index refuses them."""
    import sentencepiece

    df = documents(spark, ODD)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, public_tokenizers.path("piece_bpe_32k.model"), block_bytes=64).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(ODD)}
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert not LibraryCounter(path).split
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, path).collect()} == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    with pytest.raises(ValueError):
        PairIndexBPE(path).encode(["a"])


def test_batches_are_balanced_by_bytes():
    strings = ["a" * 40, "é" * 40, "日" * 40, "b" * 500, "c"] * 4
    got = list(balanced(strings, 200))
    assert [s for batch in got for s in batch] == strings
    assert all(len(batch) == 1 or sum(len(s.encode()) + 8 for s in batch) <= 200 for batch in got)
