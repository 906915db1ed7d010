"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import blocks, text_bytes

_LETTER = regex.compile(r"\p{L}")


def sample_documents(docs: DataFrame, per_language: int, broadcast_langs: int = 100_000) -> DataFrame:
    """About ``per_language`` rows of each language, drawn by a hash of id and text, so the same ones however the table is split,
    and without ranking all rows of a language in one task. Equal rows are drawn once, so the set has its bound however often a document
    is repeated (the more often, the fewer others are drawn). The share of each language is broadcast if there are at most
    ``broadcast_langs``."""
    share = docs.groupBy("lang").count().select(F.col("lang").alias("__lang"), (F.lit(float(per_language)) / F.col("count")).alias("__share"))
    share = written(share, "shares")
    if share.count() <= broadcast_langs:
        share = F.broadcast(share)
    spread = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_000)) / F.lit(1e6)
    drawn = docs.select("lang", "doc_id", "text", spread.alias("__spread")).join(share, F.col("lang") == F.col("__lang"))
    return drawn.where("__spread < __share").dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text")


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """``(lang, size, gram, n)``: how often each byte string of up to ``order + 1`` bytes (as a number, most
    significant byte first) occurs in the sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            buf, at = text_bytes(batch.column("text"))
            for lang in sorted(set(langs)):
                rows = np.flatnonzero(langs == lang)
                for size in range(1, order + 2):
                    grams = []
                    for r in rows:
                        own = buf[at[r] : at[r + 1]].astype(np.int64)
                        if len(own) >= size:
                            grams.append(sum(own[i : len(own) - size + 1 + i] << (8 * (size - 1 - i)) for i in range(size)))
                    if grams:
                        g, n = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(np.full(len(g), size, np.int32)), pa.array(g), pa.array(n, pa.int64())], ["lang", "size", "gram", "n"])

    kind = "lang string, size int, gram long, n long"
    return sample.mapInArrow(run, kind).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Rows:
    """The row of each key in an array of distinct numbers, or -1: an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slots = np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(keys)), self.first(self.keys)
        while len(left):
            free = self.slots[at] == 0
            _, one = np.unique(at[free], return_index=True)  # of keys that want the same slot one gets it
            put = np.flatnonzero(free)[one]
            self.slots[at[put]] = left[put] + 1
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.first(keys)
        row = self.slots[at] - 1
        if not len(self.keys):
            return row
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            row[open_] = self.slots[at[open_]] - 1
            open_ = open_[(row[open_] >= 0) & (self.keys[row[open_]] != keys[open_])]
        return row


class ContextTrees:
    """Code lengths in bits of a byte after up to three others, for each of a few languages.

    A context that was seen gives its bytes the share ``count / (total + distinct)`` and the rest to an
    escape of ``distinct / (total + distinct)`` (method C), from where the context one byte shorter decides;
    at the end all 256 bytes are alike. Counts are frozen, so a code length depends on four bytes only. Only
    strings that a language has seen are held: for each of up to four bytes a row with its last byte's code length after the
    others, and with what an escape from it as a context costs, in each language.
    """

    ORDER = 3

    def __init__(self, counts):
        """``counts``: rows of lang, size, gram, n."""
        self.langs = sorted(set(counts["lang"]))
        many = len(self.langs)
        self.rows: list[Rows] = [Rows(np.zeros(1, np.int64))]  # the empty string
        self.cost, self.escape = [np.full((1, many), 8.0)], []
        for size in range(1, self.ORDER + 2):
            own = counts[counts["size"] == size]
            gram, n = own["gram"].to_numpy(), own["n"].to_numpy().astype(float)
            lang = np.searchsorted(self.langs, own["lang"].to_numpy()) if len(own) else np.zeros(0, np.int64)
            keys = np.unique(gram)
            # sums of a context, which is a row of the size before
            context = self.rows[-1].of((gram >> 8).astype(np.uint32))
            total, kinds = (np.zeros((len(self.rows[-1].keys), many)) for _ in range(2))
            np.add.at(total, (context, lang), n)
            np.add.at(kinds, (context, lang), 1)
            share = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
            self.escape.append(-np.log2(share).astype(np.float32))
            rows = Rows(keys)
            # what a language has not seen it codes by the string without its first byte
            cost = self.escape[-1][self.rows[-1].of((keys >> 8).astype(np.uint32))] + self.shorter(keys, size)
            cost[rows.of(gram.astype(np.uint32)), lang] = -np.log2(n / (total + kinds)[context, lang])
            self.rows.append(rows)
            self.cost.append(cost.astype(np.float32))

    def shorter(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Of strings of ``size`` bytes (as numbers) the code length of the last after all but the first."""
        if size == 1:
            return np.tile(self.cost[0], (len(keys), 1))
        row = self.rows[size - 1].of((keys & ((1 << 8 * (size - 1)) - 1)).astype(np.uint32))
        return self.cost[size - 1][row]  # part of a string that was seen has been seen

    def codes(self, back: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Of each byte the code length after up to three others; ``back`` has it and those before it as one number,
        ``room`` says how many bytes of its text stand before it."""
        out = np.zeros((len(back), len(self.langs)), np.float32)
        left = np.arange(len(back))
        for size in range(self.ORDER + 1, 0, -1):
            fits = room[left] >= size - 1
            key = back[left] if size == 4 else back[left] & np.uint32((1 << 8 * size) - 1)
            row = np.where(fits, self.rows[size].of(key), -1)
            hit = row >= 0
            out[left[hit]] += self.cost[size][row[hit]]
            left, key, fits = left[~hit], key[~hit], fits[~hit]
            # an escape from the context, where a language has seen it
            context = np.where(fits, self.rows[size - 1].of(key >> np.uint32(8)), -1)
            known = context >= 0
            out[left[known]] += self.escape[size - 1][context[known]]
        out[left] += np.float32(8)
        return out

    def bits(self, texts: pa.Array) -> np.ndarray:
        """The code length of each text in each language."""
        buf, at = text_bytes(texts)
        n, many = len(at) - 1, len(self.langs)
        out = np.zeros((n, many))
        step = 1 << 18
        for low in range(0, len(buf), step):
            high = min(low + step, len(buf))
            own = np.concatenate((np.zeros(max(0, 3 - low), np.uint8), buf[max(0, low - 3) : high])).astype(np.uint32)
            back = own[3:] | own[2:-1] << np.uint32(8) | own[1:-2] << np.uint32(16) | own[:-3] << np.uint32(24)
            first, last = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")
            edges = np.clip(at[first : last + 1] - low, 0, high - low)
            room = np.arange(low, high) - np.repeat(at[first:last], np.diff(edges))
            sums = np.concatenate((np.zeros((1, many)), np.cumsum(self.codes(back, room), axis=0, dtype=np.float64)))
            out[first:last] += sums[edges[1:]] - sums[edges[:-1]]
        return out


def predict(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_language: int = 1500, group: int = 4, block_bytes: int = 2 << 20) -> DataFrame:
    """``(id, lang_pred, score)`` of each whole text of ``docs``, however long.

    ``train`` has ``doc_id, text, lang``; rows with a null in text or lang teach nothing. The model is fitted on
    about ``per_language`` whole documents of each language, all languages, so what it holds of one has a bound;
    the trees of each ``group`` languages are built and broadcast apart. The language with the shortest code wins (of equal
    ones the first by name); the score is its share of probability under equal priors. A null text, one
    without letters, or an empty model gives ``und`` and score 0. Repeated rows each give a row, an empty table none;
    other columns of ``docs`` play no part.
    """
    usable = train.where("lang is not null and text is not null and text != ''").select("doc_id", "text", "lang")
    counts = written(gram_counts(sample_documents(usable, per_language), ContextTrees.ORDER), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(ContextTrees(counts.where(F.col("lang").isin(langs[i : i + group])).toPandas())) for i in range(0, len(langs), group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", block_bytes):
                texts = part.column("text")
                has = np.array([bool(x and _LETTER.search(x)) for x in texts.to_pylist()], bool)
                if shared:
                    bits = np.concatenate([trees.value.bits(texts) for trees in shared], 1)
                    score = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                    names = np.array(langs, object)[bits.argmin(1)]
                else:
                    has[:] = False
                    names, score = np.array(["und"] * len(has), object), np.zeros(len(has))
                names = np.where(has, names, "und")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names.tolist(), pa.string()), pa.array(np.where(has, score, 0.0))], ["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
