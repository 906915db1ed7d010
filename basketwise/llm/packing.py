"""Lexical retrieval packing: a sharded BM25 index fills each seed's window with unused neighbours."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairIndexBPE
from .pieces import Numbered, gathered
from .storage import written
from .token_counts import balanced
from .words import blocks

WINDOW = 2048
#: Letters whose lower case is one letter of this range as well, and that are composed.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: How a vocabulary of this kind normalises a text and divides it into words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind whose texts may be encoded by parts: BPE of lower-case words that
    white space divides, special strings without white space that take nothing else along."""
    model, way, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = way.get("pretokenizers") or [{}, {}]
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and norm.get("normalizers") == NORMALIZERS
        and way.get("type") == "Sequence" and len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and bool(steps[0].get("invert")) and steps[0].get("behavior") == "Removed"
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        and all(t["content"].split() == [t["content"]] and not any(t.get(k) for k in ("lstrip", "rstrip", "normalized", "single_word")) for t in spec.get("added_tokens", []))
    )


class WordEncoder:
    """Ids of whole texts, equal to those of the ``tokenizers`` library. Where the vocabulary drops white space and
    case (``by_words``), a text's ids are those of its parts between spaces and line ends, so each distinct part of a
    task is encoded once: words of plain Latin letters, nearly all, go through the pair index, the library
    encodes the rest. With any other tokenizer the library gets whole texts."""

    def __init__(self, path: str, end_id: int, batch_bytes: int = 256 << 10, most_bytes: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.end_id, self.batch_bytes, self.most_bytes = end_id, batch_bytes, most_bytes
        with open(path, encoding="utf-8") as f:
            self.parted = by_words(json.load(f))
        self.index = PairIndexBPE(path) if self.parted else None
        self.size = self.model.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.words, self.bytes = Numbered(), 0
        self.word_ids, self.word_first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, by the library, and how many each has."""
        lists = [x.ids for batch in balanced(texts, self.batch_bytes) for x in self.model.encode_batch_fast(batch, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)

    def learn(self, new: list[str]) -> None:
        """Add the ids of new words to the table."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, new)), bool, len(new))
        ids, first = self.index.encode_words([w.encode() for w, p in zip(new, plain.tolist()) if p])
        counts, every = np.empty(len(new), np.int64), np.empty(0, np.uint32)
        counts[plain] = np.diff(first)
        rest, counts[~plain] = self.whole([w for w, p in zip(new, plain.tolist()) if not p])
        every = np.empty(int(counts.sum()), np.uint32)
        where = np.repeat(plain, counts)
        every[where], every[~where] = ids, rest
        self.word_ids = np.concatenate((self.word_ids, every))
        self.word_first = np.concatenate((self.word_first, self.word_first[-1] + np.cumsum(counts)))
        self.bytes += sum(map(len, new)) + 16 * len(new)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of words in the table; equal ones of a block are looked up once."""
        old, own = len(self.words), words.dictionary_encode()
        names = own.dictionary.to_pylist()
        found = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        if len(self.words) > old:
            self.learn(list(islice(self.words, old, None)))
        return found[np.asarray(own.indices)]

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and where each text's end. Plain letters and a full stop or comma after
        them are words of their own, and their case has no effect, so fewer words than parts are encoded."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        own = split.flatten().dictionary_encode()
        part = own.dictionary
        marked = pc.match_substring_regex(part, f"^{_PLAIN.pattern}[.,]$")
        stem = pc.if_else(marked, pc.utf8_slice_codeunits(part, 0, -1), part)
        stem = pc.if_else(pc.match_substring_regex(stem, f"^{_PLAIN.pattern}$"), pc.utf8_lower(stem), stem)
        sizes = 1 + np.asarray(marked.cast(pa.int64()))
        at = np.cumsum(sizes) - sizes
        of = np.empty(int(sizes.sum()), np.int64)
        of[at] = self.numbers(stem)
        of[at[sizes == 2] + 1] = self.numbers(pc.utf8_slice_codeunits(part.filter(marked), -1))
        ids, ends = gathered(self.word_ids, self.word_first, of)
        ids, ends = gathered(ids, np.concatenate(([0], ends))[np.concatenate((at, [len(of)]))], np.asarray(own.indices))
        return ids, np.concatenate(([0], ends))[np.cumsum(np.asarray(pc.list_value_length(split), np.int64))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id, and where each begins (one more at the end)."""
        if self.bytes > self.most_bytes:
            self.forget()
        if self.parted:
            ids, ends = self.parts(texts)
        else:
            ids, counts = self.whole([x or "" for x in texts.to_pylist()])
            ends = np.cumsum(counts)
        begin = np.concatenate(([0], ends[:-1] + np.arange(1, len(ends)))) if len(ends) else np.zeros(0, np.int64)
        last = ends + np.arange(len(ends))
        out = np.empty(len(ids) + len(ends), np.uint32)
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = ids
        out[last] = self.end_id
        return out, np.append(begin, len(out))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def route_ranks(size: int) -> np.ndarray:
    """Three fixed random orders of a vocabulary's ids."""
    rng = np.random.default_rng(29)
    return np.stack([rng.permutation(size) for _ in range(3)]).astype(np.int32)


def pieces(docs: DataFrame, path: str, end_id: int, window: int, keep_ids: bool) -> DataFrame:
    """Whole windows of long documents, and the tail of each document with its ids and route: the ids that come
    first in three random orders. Two tails agree in one with the probability of their similarity, so tails in
    the order of their routes have lexical neighbours around them."""

    # a worker process receives the encoder once and keeps its table of words from task to task
    shared = docs.sparkSession.sparkContext.broadcast(WordEncoder(path, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        ranks = route_ranks(encoder.size)
        for batch in batches:
            for part in blocks(batch, "text", 6 << 20):
                ids, first = encoder.encode(part.column("text"))
                row, start, length, check, held = [], [], [], [], []
                narrow = encoder.size <= 65536
                begin = []
                for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    for s in range(a, b, window):
                        own = ids[s : min(s + window, b)]
                        row.append(r)
                        begin.append(s)
                        start.append(s - a)
                        length.append(len(own))
                        check.append(crc(own))
                        held.append(own.astype("<u2" if narrow else "<u4").tobytes() if keep_ids or len(own) < window else None)
                route = np.zeros(len(row), np.int64)
                if row:
                    for rank in ranks:
                        placed = rank[ids]
                        placed[first[1:] - 1] = encoder.size  # the end id tells nothing
                        route = route << 21 | np.minimum.reduceat(placed, begin)
                row = np.array(row, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(np.diff(first)[row]), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64()), pa.array(held, pa.binary()), pa.array(route)], ["id", "doc_tokens", "start", "length", "crc", "ids", "route"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, doc_tokens long, start long, length long, crc long, ids binary, route long")


def ids_of(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * length else "<u2")


def postings(tails: list[np.ndarray], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, frequency)`` of tails, by document and term, without the end id."""
    key = np.concatenate(tails).astype(np.int64) | np.repeat(np.arange(len(tails)), [len(x) for x in tails]) << 32
    key = np.sort(key[key & 0xFFFFFFFF != end_id])
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[head] >> 32, key[head] & 0xFFFFFFFF, np.diff(np.append(head, len(key)))


def document_frequencies(tails: DataFrame, end_id: int) -> DataFrame:
    """``(term, n)``: in how many tails of the corpus each term stands, summed in each task before the shuffle. It
    has at most as many rows as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for part in blocks(batch, "ids", 8 << 20):
                _, term, _ = postings([ids_of(d, k) for d, k in zip(part.column("ids").to_pylist(), part.column("length").to_pylist())], end_id)
                own = np.bincount(term, minlength=len(n))
                own[: len(n)] += n
                n = own
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n[term])], ["term", "n"])

    return tails.select("ids", "length").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Index:
    """BM25 weights of a shard's tails, with the corpus' document frequencies (by term) and mean size: for each
    term the documents that hold it."""

    def __init__(self, tails: list[np.ndarray], end_id: int, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        n = self.n = len(tails)
        doc, term, tf = postings(tails, end_id)
        size = np.array([len(x) for x in tails], float)
        _, at, df = np.unique(term, return_inverse=True, return_counts=True)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / mean))
        order = np.argsort(at, kind="stable")
        self.doc, self.weight, self.term = doc[order], weight[order], at[order]
        self.first = np.concatenate(([0], np.cumsum(df)))
        self.terms, self.of = at, np.searchsorted(doc, np.arange(n + 1))
        self.range = np.arange(len(doc))

    def leave(self, used: np.ndarray) -> None:
        """Forget the postings of used documents."""
        kept = ~used[self.doc]
        self.doc, self.weight, self.term = self.doc[kept], self.weight[kept], self.term[kept]
        self.first = np.searchsorted(self.term, np.arange(len(self.first)))

    def scores(self, seed: int) -> np.ndarray:
        """Of each tail for all terms of the seed."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        begin = self.first[terms]
        sizes = self.first[terms + 1] - begin
        ends = np.cumsum(sizes)
        posts = np.repeat(begin - ends + sizes, sizes)
        posts += self.range[: len(posts)]
        return np.bincount(self.doc[posts], self.weight[posts], self.n)


def inverse_frequencies(counts: list[tuple[int, int]], n: int) -> np.ndarray:
    """BM25's idf by term, from ``(term, documents)``."""
    out = np.zeros(1 + max((t for t, _ in counts), default=0))
    for t, df in counts:
        out[t] = math.log1p((n - df + 0.5) / (df + 0.5))
    return out


def fill(tails: list[np.ndarray], end_id: int, window: int, idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """``(tail, from, length, sequence, offset)``: windows filled from a seed's best unused neighbours, the last
    of them cut where the window ends; its rest is the next seed. Where no neighbour is left, the next unused
    tail follows. Only the last window of a shard can have room left."""
    out: list[tuple[int, int, int, int, int]] = []
    if not tails:
        return out
    index = Index(tails, end_id, idf, mean)
    sizes = [len(x) for x in tails]
    used, held = np.zeros(len(tails), bool), len(tails)
    fresh, sequence = 0, 0
    rest: tuple[int, int] | None = None

    def unused() -> int | None:
        nonlocal fresh
        while fresh < len(tails) and used[fresh]:
            fresh += 1
        return fresh if fresh < len(tails) else None

    while rest or unused() is not None:
        seed, begin = rest or (unused(), 0)
        used[seed] = True
        room, offset, rest = window, 0, None
        takes, ranked = [(seed, begin)], None
        while takes:
            doc, begin = takes.pop()
            n = min(sizes[doc] - begin, room)
            out.append((doc, begin, n, sequence, offset))
            room, offset = room - n, offset + n
            if begin + n < sizes[doc]:
                rest = (doc, begin + n)
            if not room:
                break
            if ranked is None:
                if 2 * np.count_nonzero(~used) < held:
                    held = np.count_nonzero(~used)
                    index.leave(used)
                score = index.scores(seed)
                score[used] = 0
                best = np.flatnonzero(score)
                ranked = iter(best[np.argsort(-score[best], kind="stable")].tolist())
            nxt = next(ranked, None)
            if nxt is None:
                nxt = unused()
            if nxt is not None:
                used[nxt] = True
                takes.append((nxt, 0))
        sequence += 1
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, docs_a_shard: int = 512, part_tokens: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, with
    ``keep_ids`` also ``ids`` (little-endian unsigned 32-bit numbers).

    Each document is its ids and the end id; a null text counts as empty and gives one piece, the end id.
    Whole windows of a long document, of any length, stand alone; what is left of it, under ``window`` ids, is a
    tail. Tails are dealt to tasks of about ``part_tokens`` ids by ranges of their routes, so tails that share
    rare and common terms lie together and a large group of copies is cut into several ranges; each ``docs_a_shard``
    in a row are a shard, a BM25 index with the frequencies of the whole corpus. A task holds one shard whatever the input.
    All terms of a seed are its query. A shard fills its windows completely but for the last. Rows that repeat, or
    have no id, are packed each for itself; an empty table gives no rows; other columns of ``docs`` play no part.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = written(pieces(source, path, end_id, window, keep_ids), "pieces")
    tails = made.where(F.col("length") < window)
    total = tails.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    n, tokens = total["n"], total["tokens"] or 0
    counts = [tuple(r) for r in document_frequencies(tails, end_id).collect()]  # at most one row for each id of the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(counts, n))
    mean = max(1.0, tokens / max(n, 1))
    parts = max(1, min(math.ceil(tokens / part_tokens), max(2048, math.ceil(tokens / (32 * part_tokens)))))

    def shard(rows: list[dict], sequence: int) -> tuple[pa.RecordBatch, int]:
        arrays = [ids_of(r["ids"], r["length"]) for r in rows]
        out = [(rows[i], begin, arrays[i][begin : begin + k], sequence + s, offset) for i, begin, k, s, offset in fill(arrays, end_id, window, shared.value, mean)]
        ids = [own.astype("<u4") for _, _, own, _, _ in out]
        cols = [
            pa.array([r["id"] for r, *_ in out], kind_of["id"]), pa.array([r["start"] + begin for r, begin, *_ in out], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array(map(crc, ids), pa.int64()), pa.array([r["doc_tokens"] for r, *_ in out], pa.int64()), pa.array([s for *_, s, _ in out], pa.int64()), pa.array([o for *_, o in out], pa.int64()),
        ]
        if keep_ids:
            cols.append(pa.array([x.tobytes() for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names), out[-1][3] + 1

    kind_of: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            kind_of["id"] = batch.schema.field("id").type
            for i in range(0, len(batch), docs_a_shard):
                held.extend(batch.slice(i, docs_a_shard).to_pylist())
                while len(held) >= docs_a_shard:
                    out, sequence = shard(held[:docs_a_shard], sequence)
                    held = held[docs_a_shard:]
                    yield out
        if held:
            yield shard(held, sequence)[0]

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = f"id {dict(source.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    # equal routes are told apart by the row, so that no group of copies makes a range large
    dealt = tails.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, "route", "nth").sortWithinPartitions("route", "nth")
    packed = dealt.select("id", "doc_tokens", "start", "length", "ids").mapInArrow(run, schema).withColumn("sequence_id", F.col("sequence_id") * 2)
    alone = made.where(F.col("length") == window).select("id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
    if keep_ids:
        alone = alone.withColumn("ids", wide_ids("ids", "length"))
    return packed.unionByName(alone).withColumnRenamed("id", id_col)


def wide_ids(ids: str, length: str):
    """Ids of 16 bits as ids of 32; those of 32 as they are."""
    narrow = F.unhex(F.regexp_replace(F.hex(ids), "(.{4})", "$10000"))
    return F.when(F.octet_length(ids) == F.col(length) * 4, F.col(ids)).otherwise(narrow)
