"""Language-model scoring by cross-entropy difference of two matched bigram models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import Words, blocks, full, mix, small

START = np.uint64(0xA0761D6478BD642F)  # stands before a text
WORD, CELL = 0, 1  # what counts are of


def text_blocks(docs: DataFrame, most_tokens: int) -> DataFrame:
    """Blocks of about ``most_tokens`` words of whole documents: ``(block, ids, target, n, words, tokens, cells)``
    with the distinct words of the block (sorted hashes of their letters, A-Z in lower case), the documents' words as
    places among these (from 1 on; 0 stands before a text), and the number of distinct word pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, serial = TaskContext.get().partitionId(), 0
        held, size, rows = [], 0, 0

        def joined() -> pa.RecordBatch:
            words, ranks = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            n = np.concatenate([x[2] for x in held])
            tokens = (ranks + 1).astype("<u4")
            cells = len(pairs(tokens, n, len(words) + 1)[0])
            ids, target = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), values)
            data = [pa.array([small(x)], pa.binary()) for x in (ascending(words), planes(tokens))]
            return pa.RecordBatch.from_arrays([pa.array([part_id << 32 | serial]), one(ids), one(target), one(pa.array(n, pa.int64())), *data, pa.array([cells], pa.int64())], ["block", "ids", "target", "n", "words", "tokens", "cells"])

        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                words = Words(part.column("text"), lower=True)
                held.append((part.column("id"), part.column("target"), words.counts, words.hashes()[0]))
                size, rows = size + len(words.starts), rows + len(part)
                if size >= most_tokens or rows >= 100_000:
                    yield joined()
                    held, size, rows, serial = [], 0, 0, serial + 1
        if held:
            yield joined()

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, target array<boolean>, n array<long>, words binary, tokens binary, cells long")


def pairs(tokens: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells (``size`` times the word before, plus the word) of a block, the cell of each
    token, and the word before each."""
    own = tokens.astype(np.int64)
    before = np.zeros(len(own), np.int64)
    before[1:] = own[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    cells, of = np.unique(before * size + own, return_inverse=True)
    return cells, of, before


def keys_of(cells: np.ndarray, words: np.ndarray) -> np.ndarray:
    before, word = np.divmod(cells, len(words))
    return mix(mix(words[before], 1) + words[word], 2)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where each part of their range begins in it (one more at the end)."""
    order = np.argsort(keys)
    return order, np.searchsorted((keys[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones and so on: those of small ones compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def ascending(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def ascended(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, "<u8"), dtype=np.uint64)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, tokens and counts of a block."""
    words = np.concatenate(([START], ascended(full(row["words"]))))
    return words, numbers(full(row["tokens"]), "<u4"), np.array(row["n"], np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts by column, in as few bytes each as the largest needs; of most only the first isn't 0."""
    return planes(counts.T.astype(np.min_scalar_type(int(counts.max(initial=0)))).reshape(-1))


def unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    return numbers(data, f"<u{len(data) // max(rows * width, 1) or 1}").reshape(width, rows).T.astype(np.int64)


def asked(table: DataFrame, parts: int, kind: int) -> DataFrame:
    """``(part, block, keys, counts)``: what each block counts, dealt out by hash. Words count as words and as words
    before, pairs once; each in all documents and in those of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                words, tokens, n = opened(row)
                chosen = np.repeat(np.array(row["target"], bool), n)
                cells, of, before = pairs(tokens, n, len(words))
                count = lambda x, size: [np.bincount(x, minlength=size), np.bincount(x[chosen], minlength=size)]
                if kind == WORD:
                    keys, counts = words, np.stack(count(tokens.astype(np.int64), len(words)) + count(before, len(words)), 1)
                else:
                    keys, counts = keys_of(cells, words), np.stack(count(of, len(cells)), 1)
                order, first = dealt(keys, parts)
                keys, counts = keys[order], counts[order]
                used = np.flatnonzero(np.diff(first))
                data = [[ascending(keys[first[p] : first[p + 1]]) for p in used], [packed(counts[first[p] : first[p + 1]]) for p in used]]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), row["block"]), pa.int64()), *(pa.array(x, pa.binary()) for x in data)], ["part", "block", "keys", "counts"])

    return table.select("block", "target", "n", "words", "tokens").mapInArrow(run, "part int, block long, keys binary, counts binary")


def answered(asks: DataFrame, kind: int) -> DataFrame:
    """``(block, kind, part, counts, kinds)``: the sums over the corpus, in the order of each block's keys; one row
    of a part says how many different keys it has. A part holds all counts of its keys: a block has each key once,
    so that a frequent one makes no part large."""
    width = 4 if kind == WORD else 2

    def run(table: pa.Table) -> pa.Table:
        keys = [ascended(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x, len(k), width) for x, k in zip(table.column("counts").to_pylist(), keys)])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(at, counts[:, i], len(found)).astype(np.int64) for i in range(width)], 1)
        ends = np.cumsum([len(k) for k in keys])
        data = [packed(sums[at[e - len(k) : e]]) for e, k in zip(ends, keys)]
        kinds = np.zeros(len(keys), np.int64)
        kinds[0] = len(found)
        return pa.table({"block": table.column("block"), "kind": pa.array(np.full(len(keys), kind, np.int32)), "part": table.column("part"), "counts": pa.array(data, pa.binary()), "kinds": pa.array(kinds)})

    return asks.groupBy("part").applyInArrow(run, "block long, kind int, part int, counts binary, kinds long")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, prior: float = 64.0, broadcast_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20, part_cells: int = 500_000, least_words: int = 512) -> DataFrame:
    """One row per input row: ``(id, n_tokens, target_bits, background_bits, score)``.

    ``target_ids`` has one column, the ids of the documents that the target model learns from; the background
    model learns from all documents. Both share one vocabulary (all words of the corpus), order, prior and
    counting, and the background's counts are scaled to the target's number of tokens, so that both lean on their
    priors alike and only the text they saw differs: bigram counts backed by ``prior`` tokens of the unigram model,
    which has one more of each word; a vocabulary counts as ``least_words`` words at least, so that small corpora are smoothed too. Bits are means over a document's tokens; the score is target less background: the
    lower, the more a document is like the target.

    Documents are gathered in blocks of about ``block_tokens`` words. Each block asks once for each of its
    words and pairs, what all blocks count is summed in parts of about ``part_cells`` keys, and the answers go
    back to the blocks; nothing but sums reaches the driver. Words and pairs are told apart by 64-bit hashes. Target ids
    are broadcast if at most ``broadcast_ids``, else texts and ids shuffle. Documents without words (null, empty)
    have null bits and score; without a target document both models are alike and scores 0. Null and unknown ids in
    ``target_ids`` have no effect; repeated rows each count and each give a row; very long texts are whole, in a
    block of their own; an empty table gives no rows; other columns of ``docs`` play no part.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = written(target_ids.toDF("__target").where("__target is not null").distinct(), "target")
    if chosen.count() <= broadcast_ids:
        chosen = F.broadcast(chosen)
    marked = source.join(chosen, F.col("id") == F.col("__target"), "left").select("id", "text", F.col("__target").isNotNull().alias("target"))
    table = written(text_blocks(marked, block_tokens), "blocks")
    every = F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    seen = F.aggregate(F.arrays_zip("n", "target"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["target"], x["n"]).otherwise(0))
    total = table.select(F.sum("cells").alias("cells"), F.sum(every).alias("tokens"), F.sum(seen).alias("target")).first()
    parts = max(32, math.ceil((total["cells"] or 0) / part_cells))
    of_words = written(answered(asked(table, parts, WORD), WORD), "words")
    vocabulary = max(least_words, (of_words.select(F.sum("kinds")).first()[0] or 0) - 1)
    tokens = (total["tokens"] or 0, total["target"] or 0)
    replies = of_words.drop("kinds").unionByName(answered(asked(table, parts, CELL), CELL).drop("kinds"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["n", "words", "tokens"]).to_pylist()[0]
        words, own, n = opened(row)
        cells, of, _ = pairs(own, n, len(words))
        kinds, part, data = right.column("kind").to_numpy(), right.column("part").to_numpy(), right.column("counts").to_pylist()
        counts = []
        for kind, keys, width in ((WORD, words, 4), (CELL, keys_of(cells, words), 2)):
            order, first = dealt(keys, parts)
            back = np.empty((len(keys), width), np.int64)
            for i in np.flatnonzero(kinds == kind):
                at = order[first[part[i]] : first[part[i] + 1]]
                back[at] = unpacked(data[i], len(at), width)
            counts.append(back)
        before, word = np.divmod(cells, len(words))
        ends = np.cumsum(n)
        cols = []
        for m, scale in ((1 if tokens[1] else 0, 1.0), (0, tokens[1] / tokens[0] if tokens[1] else 1.0)):
            single = (scale * counts[0][word, m] + 1) / (scale * tokens[m] + vocabulary)
            losses = -np.log2((scale * counts[1][:, m] + prior * single) / (scale * counts[0][before, 2 + m] + prior))
            added = np.concatenate(([0.0], np.cumsum(losses[of])))
            cols.append((added[ends] - added[ends - n]) / np.maximum(n, 1))
        empty = n == 0
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(n), *(pa.array(c, mask=empty) for c in (*cols, cols[0] - cols[1]))], ["id", "n_tokens", "target_bits", "background_bits", "score"])

    kept = table.select("block", "ids", "n", "words", "tokens")
    out = kept.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, f"id {dict(source.dtypes)['id']}, n_tokens long, target_bits double, background_bits double, score double")
    return out.withColumnRenamed("id", id_col)
