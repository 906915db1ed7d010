"""Removal of repeated passages by level-wise doubling of repeated windows of words.

A window of ``width`` words that stands anywhere else holds shorter windows that do so too. The first level
looks at short windows only; where one is repeated, windows of twice the length (at most ``width``) are
looked at, and so on until the width is reached or nothing survives. Below the last level a window of
``width`` words is represented by one of the short windows in it, the one with the least hash: equal
windows choose alike, so nothing is lost, and a small share of all positions shuffles.

Texts are written once, compressed, in blocks of some megabytes, bucketed by block. A level reads them where they lie: each block asks
once for each of its hashes, and the places of those that are repeated go back to the block. Texts move no more, whatever
share of them holds something repeated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import bucketed
from ..sources.scratch import own_dir
from .storage import written
from .words import Words, blocks, full, runs, small, text_bytes

BLOCK = 2 << 20
MOST_BUCKETS = 65536


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` values in a row stands, the first of equal ones."""
    at, best, held = np.arange(len(values)), values, 1
    while held < span:
        step = min(held, span - held)
        n = len(best) - step
        later = best[step:] < best[:n]
        at = np.where(later, at[step:], at[:n])
        best = np.where(later, best[step:], best[:n])
        held += step
    return at


def levels(width: int, base: int) -> list[int]:
    out = [min(base, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def within(words: Words, width: int) -> np.ndarray:
    """For each word whether a window of ``width`` words of its text begins there."""
    n = len(words.row) - width + 1
    return words.row[:n] == words.row[width - 1 :] if n > 0 else np.zeros(0, bool)


def anchors(words: Words, hashes: np.ndarray, length: int, width: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The short windows that represent the windows of ``width`` words at ``begin`` (a flag for each word):
    all hashes of that length, the place of each window's representative, and the places used."""
    short = runs(hashes, length, length)
    if not len(begin) or not begin.any():
        return short, np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = least_of(short, width - length + 1)[np.flatnonzero(begin)]
    used = np.zeros(len(short), bool)
    used[chosen] = True
    return short, chosen, np.flatnonzero(used)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` bytes of whole texts: ``(block, ids, sizes, texts)`` with the bytes of each text (null: none) and all
    texts in a row, compressed. A longer text is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                data, at = text_bytes(part.column("text"))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([block]), one(part.column("id")), one(pa.array(np.diff(at))), pa.array([small(data.tobytes())], pa.binary())], ["block", "ids", "sizes", "texts"])
                block += 1

    return docs.mapInArrow(run, f"block long, ids array<{dict(docs.dtypes)['id']}>, sizes array<long>, texts binary")


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows one by one; after each, what Arrow keeps of memory in this worker is given back."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1)
            pa.default_memory_pool().release_unused()


def texts_of(row: pa.RecordBatch) -> pa.Array:
    """The texts of one block."""
    sizes = np.asarray(row.column("sizes").flatten(), np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = pa.py_buffer(full(row.column("texts")[0].as_py()))
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(at), data])


def packed(places: np.ndarray) -> bytes:
    """Ascending places as compressed steps."""
    return small(np.diff(places, prepend=0).astype("<u4").tobytes())


def places_of(row: pa.RecordBatch) -> np.ndarray:
    """The places that a block was told."""
    data = row.column("alive")[0].as_py()
    return np.zeros(0, np.int64) if data is None else np.cumsum(np.frombuffer(full(data), "<u4").astype(np.int64))


def surviving(words: Words, hashes: np.ndarray, before: int, width: int, alive: np.ndarray) -> np.ndarray:
    """For each word whether a window of ``width`` words begins there whose representative is at a place in ``alive``."""
    begin = within(words, width)
    short, chosen, _ = anchors(words, hashes, before, width, begin)
    out = np.zeros(len(begin), bool)
    if len(chosen):
        known = np.zeros(len(short), bool)
        known[alive] = True
        out[np.flatnonzero(begin)] = known[chosen]
    return out


def told_apart(at: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each different key of a block once: where it stands in ``keys``, its first place, and a list of its other places (null: none)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(order))) - 1
    ends = pa.array(np.concatenate(([0], np.cumsum(more))), pa.int32(), mask=np.append(more == 0, False))
    return order[first], at[order[first]], pa.ListArray.from_arrays(ends, pa.array(at[order[~new]], pa.int32()))


def asked(held: DataFrame, before: int, length: int, width: int) -> DataFrame:
    """``(hash, other, block, place, more)``: the hashes that a block asks for, each once, and the words of the block where they begin. So
    a line that stands everywhere leaves a block once, and makes no key large. Below the last level they are the representatives
    of ``length`` words of windows that survive the level ``before`` (0: of all windows); at the last, ``length`` 0, the
    windows themselves, told apart by 96 bits from two independent hashes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            words = Words(texts_of(row))
            hashes = words.hashes()
            begin = surviving(words, hashes[0], before, width, places_of(row)) if before else within(words, width)
            if length:
                short, _, at = anchors(words, hashes[0], length, width, begin)
                keys = [short[at]]
            else:
                at = np.flatnonzero(begin)
                keys = [runs(own, width, width)[at] for own in hashes]
                keys[1] = (keys[1] >> np.uint64(32)).astype(np.uint32)
            which, place, more = told_apart(at, keys)
            hash_, *other = (k[which] for k in keys)
            cols = [pa.array(hash_.view(np.int64)), pa.array(other[0].view(np.int32)) if other else pa.nulls(len(which), pa.int32()), pa.array(np.full(len(which), row.column("block")[0].as_py(), np.int64)), pa.array(place, pa.int32()), more]
            yield pa.RecordBatch.from_arrays(cols, ["hash", "other", "block", "place", "more"])

    return held.mapInArrow(run, "hash long, other int, block long, place int, more array<int>")


def answered(asks: DataFrame) -> DataFrame:
    """``(block, alive)``: the places of each block whose hash stands anywhere else, in it or in another."""

    def run(table: pa.Table) -> pa.Table:
        more = table.column("more").combine_chunks().flatten().to_numpy()
        return pa.table({"block": table.column("block").slice(0, 1), "alive": pa.array([packed(np.sort(np.concatenate((table.column("place").to_numpy(), more))))], pa.binary())})

    times = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)).over(W.partitionBy("hash", "other"))
    asks = asks.withColumn("n", times).where("n > 1")
    return asks.select("block", "place", "more").groupBy("block").applyInArrow(run, "block long, alive binary")


def cut(held: DataFrame, width: int, text_out: bool) -> DataFrame:
    """One row per text, without the words that the windows at ``alive`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single(batches):
            texts = [x.split() for x in texts_of(row).cast(pa.large_binary()).to_pylist()]
            counts = np.array([len(x) for x in texts], np.int64)
            first = np.concatenate(([0], np.cumsum(counts)))
            alive = places_of(row)
            edge = np.zeros(first[-1] + 1, np.int64)
            edge[alive] += 1
            edge[alive + width] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate(([0], np.cumsum(keep)))
            removed = counts - np.diff(kept[first])
            left = [b" ".join(compress(own, keep[a:b].tolist()) if gone else own) for own, gone, (a, b) in zip(texts, removed.tolist(), pairwise(first.tolist()))]
            cols = [row.column("ids").flatten(), pa.array(counts), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if text_out:
                cols.append(pa.array([x.decode() if gone else None for x, gone in zip(left, removed.tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * text_out)

    kind = dict(held.dtypes)["ids"][len("array<") : -1]
    return held.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text_out)


def remove_repeated(docs: DataFrame, width: int = 35, base: int = 18, id_col: str = "doc_id", text_col: str = "text", text_out: bool = False) -> DataFrame:
    """One row per input row: ``(id, n_words, n_removed, kept_sha256)``, with ``text_out`` also ``kept_text``
    where words went (null where none did).

    A word is removed if a window of ``width`` words over it also begins anywhere else in the input, in the
    same document or another; windows are judged on the input. Null texts have no words. Rows that repeat
    both id and text count as two occurrences. Texts shorter than ``width`` words stay whole; very long texts are
    read whole, in blocks of their own. Null ids are ids like others, and so are ids that repeat with other texts; an empty table
    gives no rows; other columns of ``docs`` play no part.

    All texts shuffle once, compressed, into as many buckets as the input has splits (``MOST_BUCKETS`` at most); after that only
    hashes and places do.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = min(max(source.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), MOST_BUCKETS)
    table = bucketed(text_blocks(source), "block", buckets, f"{own_dir(spark)}/texts-{uuid.uuid4().hex}")
    steps = levels(width, base)
    if len(steps) == 1:
        steps = [max(1, width // 2), width]
    told, before = None, 0
    for length in [*steps[:-1], 0]:
        held = table if told is None else table.join(told, "block")
        told = written(answered(asked(held, before, length, width)), "alive")
        before = length
    return cut(table.join(told, "block", "left"), width, text_out).withColumnRenamed("id", id_col)
