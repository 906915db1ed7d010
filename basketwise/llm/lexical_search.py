"""Ranked lexical search by the Best Position Algorithm over impact lists.

All counts and scores are integers but for one logarithm a term, so results are exact and ties are real ties.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import gathered
from .storage import written
from .words import blocks, text_bytes

#: A term is a run of digits, letters A to Z and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, A-Z in lower case, as binary values, and the number of terms of each text."""
    buf, at = text_bytes(texts)
    solid = _IN_TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1]))[: len(buf)]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    letters = np.ascontiguousarray(_LOWER[buf[solid]])
    # what isn't part of a term is left out, so terms lie side by side
    places = np.append(np.cumsum(solid)[starts] - 1, len(letters)) if len(starts) else np.zeros(1, np.int64)
    kind, width = (pa.large_binary(), np.int64) if len(letters) > 2**31 - 1 else (pa.binary(), np.int32)
    out = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(places.astype(width)), pa.py_buffer(letters)])
    return out, np.diff(np.searchsorted(starts, at))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, id, term, q)``: how often each different item (id and text) holds each term, and a row without a term for each."""
    own = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    own = own.select(F.xxhash64("id", "text").alias("item"), "id", F.explode_outer(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return own.groupBy("item", "id", "term").agg(F.count("*").alias("q"))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(id, n, terms, tfs)`` of each document with a term: how many it has, and which of the vocabulary how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {pa.binary(): pa.array(vocabulary, pa.binary()), pa.large_binary(): pa.array(vocabulary, pa.large_binary())}
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                every, n = terms(part.column("text"))
                at = pc.index_in(every, known[every.type])
                found = np.asarray(at.is_valid())
                row = np.repeat(np.arange(len(n)), n)[found]
                cells, tf = np.unique(row * len(vocabulary) + np.asarray(at.drop_null(), np.int64), return_counts=True)
                row, term = np.divmod(cells, max(len(vocabulary), 1))
                sizes = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))), pa.int32())
                lists = [pa.ListArray.from_arrays(sizes, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, terms array<int>, tfs array<int>")


def statistics(table: DataFrame, size: int) -> DataFrame:
    """``(term, df)`` for each term of the vocabulary, and with term -1 the number of documents, with -2 that of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
            n_docs, n_terms = n_docs + len(batch), n_terms + (pc.sum(batch.column("n")).as_py() or 0)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [n_docs, n_terms]))], ["term", "df"])

    return table.select("n", "terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of some documents: for each term its postings from the highest score down, and for direct accesses
    each document's postings with their positions in the lists."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 25 + 75 * n.astype(np.int64) * n_docs // n_terms
        score = weights[term] * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m[doc]))
        kept = score > 0
        self.doc_of, self.term_of, self.score_of = doc[kept], term[kept], score[kept]
        self.size, self.every = len(n), np.arange(len(self.doc_of))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.doc_of, minlength=len(n)))))
        order = np.lexsort((-self.score_of, self.term_of))
        self.docs, self.scores = self.doc_of[order], self.score_of[order]
        self.place_of = np.empty(len(order), np.int64)
        self.place_of[order] = np.arange(len(order))
        self.lists = np.searchsorted(self.term_of[order], np.arange(len(weights) + 1))

    def search(self, query: np.ndarray, times: np.ndarray, k: int, floor: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The documents that can be among the best k, and their scores: all that score above ``floor``, or as high as the
        k-th here, are among them.

        Sorted accesses go down all lists side by side, in steps that double. What they find is accessed directly in the
        other lists as well, and marks its positions there. A list's best position is the last of those seen without a
        gap from its top: no document that wasn't seen has a better one in it. The sum of scores at best positions bounds
        them all; the search ends when it lies strictly below the k-th score, so that ties are all seen.
        """
        low, high = self.lists[query], self.lists[query + 1]
        here = low < high
        query, times, low, high = query[here], times[here], low[here], high[here]
        wanted = np.zeros(len(self.lists), np.int64)
        wanted[query] = times
        unseen = np.ones(len(self.docs), bool)
        met = np.zeros(self.size, bool)
        best = low.copy()
        docs, scores, kth, depth = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], floor, 0
        while len(query):
            reach = depth + step
            found = np.unique(np.concatenate([self.docs[a + depth : min(a + reach, b)] for a, b in zip(low, high)]))
            depth, step = reach, 2 * step
            found = found[~met[found]]
            if len(found):
                met[found] = True
                at, ends = gathered(self.every, self.first, found)
                term = self.term_of[at]
                part = self.score_of[at] * wanted[term]
                unseen[self.place_of[at[wanted[term] > 0]]] = False
                sums = np.concatenate(([0], np.cumsum(part)))
                sizes = self.first[found + 1] - self.first[found]
                docs.append(found)
                scores.append(sums[ends] - sums[ends - sizes])
                every = np.concatenate(scores)
                if len(every) >= k:
                    kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
            bound = 0
            for i in range(len(query)):
                rest = unseen[best[i] : high[i]]
                ahead = int(rest.argmax()) if len(rest) else 0
                best[i] = best[i] + ahead if len(rest) and rest[ahead] else high[i]
                if best[i] < high[i]:  # the best position is the one before
                    bound += int(self.scores[best[i] - 1]) * int(times[i])
            if bound < kth or bound == 0:
                break
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        # more than k only where scores are equal
        if len(scores) > k:
            kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[kept], scores[kept]
        kept = scores >= max(floor, 1)
        return docs[kept], scores[kept]


def best_of(table: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_docs: int) -> DataFrame:
    """``(item, id, score)``: of each task's documents the best k for each item. A task goes through its documents shard by
    shard; the k-th score so far is where the search in the next one may stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {item: [] for item in queries}
        id_type = None
        for whole in batches:
            id_type = whole.column("id").type
            for start in range(0, len(whole), shard_docs):
                batch = whole.slice(start, shard_docs)
                ids, lists = batch.column("id").to_pylist(), batch.column("terms")
                shard = Shard(np.asarray(batch.column("n")), np.asarray(pc.list_value_length(lists), np.int64), np.asarray(lists.flatten(), np.int64), np.asarray(batch.column("tfs").flatten(), np.int64), weights, n_docs, n_terms)
                for item, (query, times) in queries.items():
                    own = held[item]
                    docs, scores = shard.search(query, times, k, own[-1][0] if len(own) == k else 0)
                    if len(docs):
                        own += [(int(s), ids[d]) for d, s in zip(docs, scores)]
                        held[item] = heapq.nsmallest(k, own, key=lambda x: (-x[0], x[1] is not None, *x[1:] * (x[1] is not None)))
        rows = [(item, i, s) for item, own in held.items() for s, i in own]
        if rows:
            item, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(i, id_type), pa.array(s, pa.int64())], ["item", "id", "score"])

    return table.mapInArrow(run, f"item long, id {dict(table.dtypes)['id']}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 100_000, block_items: int = 10_000, shard_docs: int = 8192, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item, from rank 1.

    A document's score sums over an item's terms, repeats included, the term's weight times its saturated count, in integers
    (see ``Shard``). Equal scores are ranked by ascending ``doc_id``, a null id first. The corpus is read once for the
    postings of query terms, which are written; counts come from there, and so do the searches: each task makes impact lists
    of ``shard_docs`` documents at a time, searches them for all items by best positions, and returns k rows an item. Texts
    never shuffle, and memory is bounded by a shard's postings.

    Queries go in blocks of about ``block_terms`` different terms and ``block_items`` items; where there are more, the corpus is
    read once for each block. Null and empty texts have no terms: as documents they are not counted, as items they get no rows. Very long texts
    are whole. Equal rows of ``items`` are one item; rows that share an id but not the text are ranked apart, each from 1;
    repeated rows of ``docs`` are documents of their own. Empty tables give no rows; other columns play no part.
    """
    asked = written(query_terms(items, item_id, item_text).where("term is not null"), "queries")
    sizes = asked.agg(F.count_distinct("term").alias("terms"), F.count_distinct("item").alias("items")).first()
    blocks_needed = max(1, math.ceil(sizes["terms"] / block_terms), math.ceil(sizes["items"] / block_items))
    source = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    found = None
    for b in range(blocks_needed):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks_needed)) == b)
        vocabulary = sorted(r["term"] for r in own.select("term").distinct().collect())
        number = {t: i for i, t in enumerate(vocabulary)}
        table = written(postings(source, [t.encode() for t in vocabulary]), "postings")
        known = {r["term"]: r["df"] for r in statistics(table, len(vocabulary)).collect()}
        n_docs, n_terms = known.get(-1, 0), known.get(-2, 0)
        if not n_terms:
            continue
        weights = np.array([weight(n_docs, known.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        queries: dict[int, tuple[list, list]] = {}
        for r in own.select("item", "term", "q").collect():
            for values, x in zip(queries.setdefault(r["item"], ([], [])), (number[r["term"]], r["q"])):
                values.append(x)
        part = best_of(table, {i: (np.array(t), np.array(q, np.int64)) for i, (t, q) in queries.items()}, weights, n_docs, n_terms, k, shard_docs)
        found = part if found is None else found.unionByName(part)
    names = asked.select("item", F.col("id").alias("__item")).distinct()
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    if found is None:
        return asked.sparkSession.createDataFrame([], f"{item_id} {kinds[0]}, rank int, {doc_id} {kinds[1]}, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(names, "item").select(F.col("__item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
