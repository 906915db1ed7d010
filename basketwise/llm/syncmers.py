"""Document fingerprints of closed syncmers, and their likeness by positional matching.

A k-mer of code points is an anchor if the least of its inner s-mers lies at one of its edges. That depends on nothing
but the k-mer, so text that moves or is copied keeps its anchors; of ``k - s + 1`` k-mers in a row at least one is an anchor.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks, joined, mix, runs

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[ALPHABET] = np.arange(64)
WIDTH, HASH = 6, 5  # characters of an anchor, of which the last ones are its hash


def least_in(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` values in a row."""
    out, held = values, 1
    while held < span:
        step = min(held, span - held)
        out, held = np.minimum(out[:-step], out[step:]), held + step
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(texts: list[str], k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closed syncmers of several texts in a row: positions in their text, 30-bit hashes, and where each text's begin (one more
    at the end). A text of fewer than ``k`` code points has one anchor, its whole; an empty one has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    points = code_points("".join(texts))
    inner = runs(points.astype(np.uint64), s, s)
    span = k - s + 1
    position, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) >= k:
        least = least_in(inner, span)
        chosen = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
        text = np.searchsorted(at, chosen, "right") - 1
        chosen = chosen[chosen + k <= at[text + 1]]
        value = inner[chosen]
        # an anchor's hash is that of its s-mers side by side, the last of which may overlap
        for step in [*range(s, k - s, s), k - s]:
            value = joined(value, inner[chosen + step], step)
        position = chosen
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in short], np.uint64)
        position, value = np.concatenate((position, at[short])), np.concatenate((value, whole))
        order = np.argsort(position, kind="stable")
        position, value = position[order], value[order]
    first = np.searchsorted(position, at)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    return position - at[of], (mix(value, 1) >> np.uint64(34)).astype(np.int64), first


def written_out(position: np.ndarray, value: np.ndarray, first: np.ndarray) -> pa.Array:
    """Fingerprints as strings: of each anchor the distance from the one before (from the text's start) modulo 64 and its hash, in
    the URL-safe base64 alphabet. Anchors lie less than 64 apart for ``k`` up to 64, so positions can be told from it."""
    gap = np.diff(position, prepend=0)
    heads = first[:-1][np.diff(first) > 0]
    gap[heads] = position[heads]
    digits = np.empty((len(position), WIDTH), np.uint8)
    digits[:, 0] = ALPHABET[gap % 64]
    for i in range(HASH):
        digits[:, 1 + i] = ALPHABET[value >> 6 * (HASH - 1 - i) & 63]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer((first * WIDTH).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(digits))])


def read_back(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The positions and hashes of a fingerprint's anchors."""
    digits = _VALUE[np.frombuffer(fingerprint.encode(), np.uint8)].reshape(-1, WIDTH)
    return np.cumsum(digits[:, 0]), digits[:, 1:] @ (1 << 6 * np.arange(HASH - 1, -1, -1))


def rising(values: np.ndarray) -> int:
    """The length of the longest rising chain."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    ends: list[int] = []
    for x in values.tolist():
        i = bisect.bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends)


def _numbered(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    head = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the anchors of two texts, given in order of position, that match: equal ones pair up by their number, and
    of the pairs the longest chain counts that runs forward in both texts. 1 for equal texts, empty ones too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    keys_a, keys_b = (x << 32 | _numbered(x) for x in (a, b))
    _, at_a, at_b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    return 2 * rising(at_b[np.argsort(at_a)]) / (len(a) + len(b))


def bounds_of(docs: DataFrame, bucket_bytes: int) -> list:
    """Ids that cut ``docs`` (id, text) into ranges of about ``bucket_bytes`` of text; a sample by hash sets where."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = math.ceil((size or 0) / bucket_bytes)
    if buckets < 2:
        return []
    every = max(1, n // (buckets * 32))
    sample = sorted(r["id"] for r in docs.where((F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & F.col("id").isNotNull()).select("id").collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def bucket_of(bounds: list, kind: str) -> Column:
    """How many of the bounds an id has reached, found in two steps so that many bounds cost few comparisons."""
    if not bounds:
        return F.lit(0)
    side = math.isqrt(len(bounds) - 1) + 1
    reached = lambda values: F.size(F.filter(values, lambda b: b <= F.col("id")))
    array = lambda values: F.array(*(F.lit(v).cast(kind) for v in values))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    row = reached(array([r[0] for r in rows]))
    fine = F.get(F.array(*map(array, rows)), row - 1)
    return F.when(F.col("id").isNull() | (row == 0), 0).otherwise((row - 1) * side + reached(fine))


def with_next(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``(bucket, copy, id, text)``, the rows of a bucket together and in order of id and text. The last of each bucket is a copy of
    the row that follows in the next one (of the first row of all after the last), so that each row's next stands below it.
    Texts shuffle once, in ranges of ids."""
    placed = docs.withColumn("bucket", bucket_of(bounds_of(docs, bucket_bytes), dict(docs.dtypes)["id"]))
    # ids only, then the few rows that hold them: no text is compared or sorted to find the first of a bucket
    least = [(r["bucket"], r["id"]) for r in placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("x")).select("bucket", "x.id").orderBy("bucket").collect()]
    if not least:
        return placed.select("bucket", F.lit(False).alias("copy"), "id", "text")
    before = {b: least[i - 1][0] for i, (b, _) in enumerate(least)}
    heads = docs.sparkSession.createDataFrame([(b, i, before[b]) for b, i in least], f"__bucket int, __id {dict(docs.dtypes)['id']}, __to int")
    first = placed.join(F.broadcast(heads), (F.col("bucket") == F.col("__bucket")) & F.col("id").eqNullSafe(F.col("__id")))
    first = first.groupBy(F.col("__to").alias("bucket")).agg(F.lit(True).alias("copy"), F.first("id").alias("id"), F.min(F.struct(F.col("text").isNotNull(), "text")).alias("x")).select("bucket", "copy", "id", "x.text")
    every = placed.select("bucket", F.lit(False).alias("copy"), "id", "text").unionByName(first)
    return every.repartition("bucket").sortWithinPartitions("bucket", "copy", "id", "text")


def fingerprints(docs: DataFrame, k: int = 32, s: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint)`` of each whole text, without a shuffle. Null counts as empty and has an empty fingerprint."""
    _checked(k, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                prints = written_out(*anchors(texts, k, s)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), prints], ["id", "n_chars", "fingerprint"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _checked(k: int, s: int) -> None:
    if not 0 < s <= k <= 64:
        raise ValueError(f"0 < s <= k <= 64 is needed: k {k}, s {s}")


def edited_likeness(docs: DataFrame, k: int = 32, s: int = 8, bucket_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text is a text whose last half (rounded down) is replaced by as many code points, or all, of the start of
    the next document's, by ascending id; after the last comes the first. ``near_edited`` and ``near_next`` are the likeness of a
    text to its edited one and to the next document, from 0 to 1: the share of anchors that match in order.

    Null texts count as empty; a text shorter than ``k`` has one anchor, its whole, an empty one none. Rows without
    an id come first; rows of one id are in order of their texts, null first; repeated rows each give a row; a single row is its own
    next; very long texts are whole; an empty table gives no rows; other columns play no part. Texts shuffle once, in
    ranges of ids of about ``bucket_bytes``; a task holds a batch of rows and the one before.
    """
    _checked(k, s)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None  # a row whose next hasn't come yet
        for batch in batches:
            for part in blocks(batch, "text", 1 << 20):
                rows = part if before is None else pa.Table.from_batches([before, part]).combine_chunks().to_batches()[0]
                texts = [t or "" for t in rows.column("text").to_pylist()]
                copy = np.asarray(rows.column("copy"))
                prints = anchors(texts, k, s)
                strings = written_out(*prints)
                own = np.flatnonzero(~copy[:-1])  # each has its next below it
                edited = []
                for i in own:
                    cut = len(texts[i]) // 2
                    edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
                new = anchors(edited, k, s)
                value = lambda x, i: x[1][x[2][i] : x[2][i + 1]]
                yield pa.RecordBatch.from_arrays([
                    rows.column("id").take(pa.array(own)), pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    strings.take(pa.array(own)).cast(pa.string()), written_out(*new).cast(pa.string()),
                    pa.array([likeness(value(prints, i), value(new, j)) for j, i in enumerate(own)], pa.float64()),
                    pa.array([likeness(value(prints, i), value(prints, i + 1)) for i in own], pa.float64()),
                ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                before = rows.slice(len(rows) - 1)

    kinds = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(source, bucket_bytes).mapInArrow(run, f"id {kind}, {kinds}").withColumnRenamed("id", id_col)
