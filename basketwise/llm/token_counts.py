"""Token counts by a tokenizer library, in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PartTable, string
from .words import blocks


def balanced(strings: list[str], limit: int) -> Iterator[list[str]]:
    """Batches of about ``limit`` bytes in UTF-8; a longer string stands alone."""
    held, size = [], 0
    for s in strings:
        own = 8 + (len(s) if s.isascii() else len(s.encode()))
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(s)
        size += own
    if held:
        yield held


class LibraryCounter:
    """Counts with ``tokenizers`` for ``.json`` files and ``sentencepiece`` for ``.model`` files.

    Byte-level vocabularies with the usual word pattern let texts be split at single spaces (see
    ``pieces``), so a long text comes in parts and each distinct part of a task is encoded once. Nowhere else is a split
    known to be safe, so other vocabularies get whole texts.
    """

    def __init__(self, path: str, batch_bytes: int = 256 << 10, most_bytes: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.batch_bytes = batch_bytes
        self.split = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            way = spec.get("pre_tokenizer") or {}
            self.split = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way.get("add_prefix_space") and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
            self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.table = PartTable(most_bytes)
        self.counts = np.zeros(0, np.int64)

    def solve(self, strings: list[str]) -> np.ndarray:
        return np.array([n for batch in balanced(strings, self.batch_bytes) for n in self.lengths(batch)], np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        if not self.split:
            return self.solve([x or "" for x in texts])
        if self.table.full():
            self.table.forget()
            self.counts = np.zeros(0, np.int64)
        at, counts, new = self.table.numbers(texts)
        if new:
            self.counts = np.concatenate((self.counts, self.solve([string(x) for x in new])))
        sums = np.concatenate(([0], np.cumsum(self.counts[at])))
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each whole text, without a shuffle.

    Blocks of rows are balanced by bytes and so are the batches given to the library. A null text counts as
    empty (0 tokens); special strings inside texts are handled as the library does by default; a text of any
    length is counted whole; repeated rows each give a row, an empty table none; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LibraryCounter(path)
        for batch in batches:
            for part in blocks(batch, "text", block_bytes):
                n = counter.count(part.column("text").to_pylist())
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
