"""Byte-level BPE by a pair occurrence index: encoding, decoding and a digest of both."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Numbered, PartTable, gathered
from .words import blocks

#: Fixed value: how a byte-level vocabulary of this kind divides a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << 40


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE with these words: else its ids can't be found this way."""
    model, way = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way.get("add_prefix_space") and not spec.get("normalizer")
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "normalized", "single_word"))
    )


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encodes many words at once. ``path`` is a tokenizer file with byte-level BPE.

    The words that a block of a partition brings new stand in one row of symbols with links to their
    neighbours. An index maps each pair's rank to all positions where the pair stands. A heap yields the
    active ranks in ascending order; all positions of a rank merge at once, and only the lists of the pairs
    beside them change. A merge makes pairs of higher ranks only, so this order gives each word the
    merges that it gets alone.
    """

    def __init__(self, path: str, most_bytes: int = 24 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = byte_level(spec)
        vocab = spec["model"]["vocab"]
        to_byte = byte_characters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        ending = spec["model"].get("end_of_word_suffix") or ""
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        self.last_id = np.array([vocab[c + ending] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64) if ending else None
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.word = regex.compile(WORDS)
        size = 1 + max([*vocab.values(), *special.values()])
        self.token = [b""] * size
        for text, i in vocab.items():
            stem = text.removesuffix(ending) if ending else text
            self.token[i] = bytes(to_byte[c] for c in stem) + b" " * (stem != text)
        for text, i in special.items():
            self.token[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self.table = PartTable(most_bytes)
        self.forget()

    def forget(self) -> None:
        self.table.forget()
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin (one more at the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        some = sizes > 0
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.byte_id[data]
        if self.last_id is not None:
            symbol[ends[some] - 1] = self.last_id[data[ends[some] - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[some] - 1] = -1
        before[(ends - sizes)[some]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            real = ranks < _NONE
            positions, ranks = positions[real], ranks[real]
            by = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, r in zip(np.split(positions, cuts), ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else []):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        inner = np.flatnonzero(after >= 0)
        note(inner, self.rank(symbol[inner], symbol[inner + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            real = alive[at] & (nxt >= 0) & (symbol[at] == a) & (symbol[nxt] == b)
            at, nxt = at[real], nxt[real]
            if a == b and len(at) > 1:  # of a row of overlapping places every second one
                new = np.concatenate(([True], at[1:] != nxt[:-1]))
                starts = np.flatnonzero(new)
                odd = (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 1
                at, nxt = at[~odd], nxt[~odd]
            if not len(at):
                continue
            far = after[nxt]
            symbol[at] = self.into[r]
            alive[nxt] = False
            after[at] = far
            has = far >= 0
            before[far[has]] = at[has]
            back = before[at]
            led = back >= 0
            places = np.concatenate((at[has], back[led]))
            if len(places):
                note(places, self.rank(np.concatenate((symbol[at[has]], symbol[back[led]])), np.concatenate((symbol[far[has]], symbol[at[led]]))))
        return symbol[alive].astype(np.int32), np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]

    def words(self, text: str) -> list:
        """The words of a text; a special string is ``("", string)``."""
        if self.cut is None or not self.cut.search(text):
            return self.word.findall(text)
        out = []
        for part in self.cut.split(text):
            out.extend([("", part)] if part in self.special else self.word.findall(part))
        return out

    def new_words(self, parts: list) -> tuple[Numbered, np.ndarray, np.ndarray]:
        """The distinct words of some parts, the number of each part's words in a row, each part's count.

        Parts that begin with a space are divided together: there a word begins whatever stands before.
        """
        words = Numbered()
        alone = np.array([isinstance(x, tuple) for x in parts])
        sizes = np.zeros(len(parts), np.int64)
        joined = [" " + x for x in parts if not isinstance(x, tuple)]
        own = self.words("".join(joined))
        ends = np.cumsum(np.fromiter((len(w[1]) if isinstance(w, tuple) else len(w) for w in own) if self.cut and tuple in set(map(type, own)) else map(len, own), np.int64, len(own)))
        of = np.searchsorted(np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), ends)
        sizes[~alone] = np.bincount(of, minlength=len(joined)) if joined else 0
        numbers = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
        apart = [self.words(x[1]) for x in parts if isinstance(x, tuple)]
        sizes[alone] = [len(x) for x in apart]
        every = np.empty(int(sizes.sum()), np.int64)
        where = np.repeat(alone, sizes)
        every[~where] = numbers
        every[where] = [words[w] for x in apart for w in x]
        return words, every, sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end)."""
        if not self.byte_level:
            raise ValueError("not a byte-level BPE vocabulary with the usual words")
        if self.table.full():
            self.forget()
        at, counts, new = self.table.numbers(texts)
        if new:
            words, of_parts, sizes = self.new_words(new)
            ids, first = self.encode_words([b"" if isinstance(w, tuple) else w.encode() for w in words])
            special = [(i, self.special[w[1]]) for i, w in enumerate(words) if isinstance(w, tuple)]
            if special:
                where = np.array([i for i, _ in special])
                ids = np.insert(ids, first[where], np.array([x for _, x in special], np.int32))
                first = first + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(words)), where))))
            ids, ends = gathered(ids, first, of_parts)
            ends = np.concatenate(([0], ends))[np.cumsum(sizes)]
            self.first = np.concatenate((self.first, self.first[-1] + ends))
            self.ids = np.concatenate((self.ids, ids))
        ids, ends = gathered(self.ids, self.first, at)
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of some ids; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.token.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``(id, ids array<int>)`` of each row's whole text; null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            for part in blocks(batch, "text", block_bytes):
                ids, first = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], ["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of each row's ids; a null array gives a null text, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Encode and decode each whole text and return ``(id, n_tokens, ids_sha256, decoded_sha256)``.

    Ids and texts stay in the task that made them, so no shuffle and a few blocks of memory are needed.
    A null text counts as empty; special strings in a text become their single id; repeated rows stay; very long texts
    are a block of their own; an empty table gives no rows; a vocabulary of another kind is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            for part in blocks(batch, "text", block_bytes):
                ids, first = bpe.encode(part.column("text").to_pylist())
                of_ids, of_text = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = ids[a:b].tolist()
                    of_ids.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, own)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(of_ids), pa.array(of_text)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
