"""Near duplicates by HyperMinHash: compressed registers, banding, an estimate, and a check on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .words import Words, blocks, joined, mix

BUCKETS, MANTISSA = 128, 10
_PREFERENCE = np.argsort(np.random.default_rng(41).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1)


def register_values(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least hash of a bucket (its low 57 bits): one 16-bit number."""
    value = (least & np.uint64((1 << 57) - 1)) >> np.uint64(5)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = length - (MANTISSA + 1)
    shifted = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    return ((52 - length) << MANTISSA | (shifted.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set, given its sorted hashes. The high 7 bits name a bucket, so the first hash of a
    bucket is its least. An empty bucket borrows from the full one that it prefers by a fixed random order;
    two sets then still agree in a register with the probability of their similarity."""
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    head = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    full = bucket[head]
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = register_values(hashes[head])
    if len(full) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), full, assume_unique=True)
        out[empty] = out[full[_PREFERENCE[np.ix_(empty, full)].argmin(1)]]
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words, A-Z in lower case; a text with
    fewer words has one, all its words; one without words none."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    starts, window = words.windows(hashes, size, size)
    cuts = np.searchsorted(starts, words.first)
    for row in range(len(texts)):
        own = window[cuts[row] : cuts[row + 1]]
        if len(own):
            own = np.sort(own)
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif words.counts[row]:
            part = slice(words.first[row], words.first[row + 1])
            sums = np.array([words.counts[row]], np.uint64)
            for h in np.concatenate((hashes[0][part], hashes[1][part])):
                sums = joined(sums, h, 77)
            yield sums
        else:
            yield np.zeros(0, np.uint64)


def digests(own: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return b"".join(int(mix(own, seed).sum(dtype=np.uint64)).to_bytes(8, "little") for seed in (1, 2)) if len(own) else b""


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(id, n_shingles, node, regs)``: equal sets have equal nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                n, node, regs = [], [], []
                for own in shingle_sets(part.column("text"), size):
                    n.append(len(own))
                    node.append(digests(own))
                    regs.append(registers(own).astype(np.int32) if len(own) else np.zeros(0, np.int32))
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in regs])))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(regs), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), lists], ["id", "n_shingles", "node", "regs"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_shingles long, node binary, regs array<int>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(node, shingles)`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                own = list(shingle_sets(part.column("text"), size))
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                yield pa.RecordBatch.from_arrays([pa.array(map(digests, own), pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))], ["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles array<long>")


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """``(key, node)``: a key for each run of ``rows`` registers."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // rows - 1)), lambda i: F.xxhash64(i, F.slice("regs", i * rows + 1, rows)))
    return reps.select("node", F.explode(keys).alias("key"))


def corrected_similarity(equal, na, nb):
    """The share of equal registers less what two different least hashes share by chance. For sets of a and b
    hashes a bucket that is about 0.72 * a * b / (a + b) ** 2 in 2 ** MANTISSA."""
    chance = 0.7213 * 2.0**-MANTISSA * na * nb / ((na + nb) * (na + nb))
    return (equal / F.lit(float(BUCKETS)) - chance) / (F.lit(1.0) - chance)


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar.

    The estimate only drops pairs that lie ``slack`` (several standard deviations) below the threshold or
    whose sizes rule them out; every other pair is decided on the full sets.
    """
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    equal = F.aggregate(F.zip_with("ra", "rb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = near.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where(corrected_similarity(equal, F.col("na"), F.col("nb")) >= percent / 100 - slack)
    near = written(near.select("a", "b", "na", "nb"), "candidates")
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select("a", "b")


def able(there: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``there`` with n and e: the size of each class' set and of the part that others of ``there`` have as
    well. Classes of which too much is theirs alone are left out: they are similar to no other."""
    nodes = there.select("node").distinct()
    shingle = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    alone = shingle.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.join(nodes, "node", "left_semi").select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("e"))
    return there.join(sizes.where(F.col("e") * 100 >= F.col("n") * percent), "node")


BLOCK = 128


def block_pairs(there: DataFrame) -> DataFrame:
    """``(p, node, component)``: the members of each bucket in blocks of about ``BLOCK``, and for every two blocks
    that hold different components a group p of both. Large components have blocks of their own, small ones
    share blocks, so what is connected already meets no more."""
    sizes = written(there.groupBy("key", "component").agg(F.count("*").alias("c")).withColumn("mixed", F.col("c") <= BLOCK // 4), "sizes")
    loose = written(sizes.where("mixed").groupBy("key").agg(F.sum("c").alias("loose")), "loose")
    placed = there.join(sizes, ["key", "component"]).join(loose, "key", "left")
    part = F.when(F.col("mixed"), F.pmod(F.xxhash64("component"), F.ceil(F.col("loose") / BLOCK))).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)))
    block = F.struct("mixed", F.when(~F.col("mixed"), F.col("component")).alias("of"), part.alias("part"))
    placed = written(placed.select("key", "node", "component", block.alias("block")), "blocks")
    one = placed.select("key", "block").distinct()
    two = one.join(one.withColumnRenamed("block", "other"), "key").where((F.col("block") <= F.col("other")) & (F.col("block.mixed") | F.col("other.mixed") | (F.col("block.of") != F.col("other.of"))))
    sides = two.select("key", F.xxhash64("key", "block", "other").alias("p"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return sides.join(placed, ["key", "block"]).select("p", "node", "component")


def links_in_blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of all similar classes of different components within a group, by their full sets. The pairs
    are compared inside the task; only links leave it."""

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].combine_chunks()
        of = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        column = table["shingles"].combine_chunks()
        size = np.asarray(pc.list_value_length(column), np.int64)
        code = np.unique(np.asarray(column.flatten()), return_inverse=True)[1]
        first = np.concatenate(([0], np.cumsum(size)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        for i in range(len(node)):
            here[code[first[i] : first[i + 1]]] = 1
            shared = np.add.reduceat(here[code], first[:-1])
            here[code[first[i] : first[i + 1]]] = 0
            hit = np.flatnonzero((of != of[i]) & (shared * 100 >= (size + size[i] - shared) * percent))
            hit = hit[hit > i]
            a.append(np.full(len(hit), i))
            b.append(hit)
        return pa.table({x: node.take(pa.array(np.concatenate(at))) for x, at in (("a", a), ("b", b))})

    found = groups.join(sets, "node").groupBy("p").applyInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_links(reps: DataFrame, source: DataFrame, size: int, percent: int, rows: int, slack: float, stars: int) -> DataFrame:
    """``(a, b)``: enough of the links between classes to tell which are connected."""
    keyed = bands(reps, rows)
    # what is summed by bucket is written before it is joined, so that AQE can split a full bucket's rows
    full = written(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "buckets")
    busy = written(keyed.join(full, "key"), "bands")
    weights = written(busy.groupBy("node").agg(F.sum("many").alias("weight")), "weights")
    ids = reps.join(weights, "node", "left_semi").select("id").distinct()
    sets = full_sets(source.join(ids, "id", "left_semi"), size).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = written(sets.join(weights, "node", "left_semi"), "sets")
    busy = written(busy.select("key", "node").join(weights, "node"), "bands")
    links, label = reps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), None
    for turn in range(stars + 1):
        if label is not None:
            labelled = written(busy.join(label, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component")), "labelled")
            open_keys = written(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "open")
            there = written(labelled.join(open_keys, "key", "left_semi"), "there")
            if there.isEmpty():
                break
        else:
            there = busy.withColumn("component", F.col("node"))
        if turn < stars:
            best = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
            star = there.groupBy("key").agg(F.max(F.struct(best.alias("h"), "node", "component")).alias("star"))
            star = written(star.select("key", F.col("star.node").alias("star"), F.col("star.component").alias("of")), "stars")
            pairs = there.join(star, "key").where("component != of").select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
        else:
            there = written(able(there, sets, percent).select("key", "node", "component", "n", "e"), "able")
            many = there.groupBy("key").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            there = written(there.join(written(many.select("key", "many"), "open"), "key"), "able")
            few = there.where(F.col("many") <= BLOCK // 2)
            other = few.select("key", F.col("node").alias("other"), F.col("component").alias("of"), F.col("n").alias("n2"), F.col("e").alias("e2"))
            enough = F.least("e", "e2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
            pairs = few.join(other, "key").where((F.col("component") < F.col("of")) & enough).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
            large = links_in_blocks(block_pairs(there.where(F.col("many") > BLOCK // 2).select("key", "node", "component")), sets, percent)
            links = links.unionByName(large)
        links = written(links.unionByName(confirmed(pairs.distinct(), reps, sets, percent, slack)), "links")
        label = components(links)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 4, slack: float = 0.22, stars: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id, n_shingles, component_id, kept)``.

    Documents whose sets of ``size``-word shingles share ``percent`` in a hundred of their union are linked;
    ``component_id`` is the least id that links reach, and the row with that id is kept. Documents with equal
    sets form one class. Classes meet in ``BUCKETS / rows`` bands of registers
    (at 0.8 a pair misses all of them once in 10 ** 7). In a band's bucket each class is first held
    against one other, the bucket's star: first the class that lies in the fullest buckets, the middle
    of a group of near copies, then others at random, ``stars`` rounds in all. After that only pairs that
    lie in different components still meet, and of these only such as can be similar given what each has
    in common with all others (``able``); in large buckets they meet in blocks inside a task, which returns
    links only. So a large group of near copies costs a few checks a member, and no link that joins two
    components is passed over.

    Texts without words (null, empty, white space) have an empty set and no links; very long texts are whole. Rows that
    share an id are one document with the links of all of them, whatever their order; rows without an id are kept,
    alone. Ids are of any type that has an order; of ties and repeated rows all stay in one component. Empty input gives
    no rows; other columns of ``docs`` play no part.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = written(sketches(source, size), "sketches")
    known = sketched.where("id is not null and n_shingles > 0")
    # one row for each class, that of its least id
    reps = written(known.groupBy("node").agg(F.min_by(F.struct("id", "n_shingles", "regs"), "id").alias("x")).select("node", "x.*"), "classes")
    links = class_links(reps, source, size, percent, rows, slack, stars)
    rows_of = known.select("id", "node")
    least = rows_of.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    same_id = rows_of.join(written(least, "ids"), "id").where("a != node").select("a", F.col("node").alias("b")).distinct()
    label = components(links.unionByName(same_id))
    placed = written(rows_of.join(label, "node", "left").select("id", F.coalesce("component", "node").alias("component")), "placed")
    first = written(placed.groupBy("component").agg(F.min("id").alias("component_id"), F.max("id").alias("last")).where("component_id < last").drop("last"), "first")
    moved = written(placed.join(first, "component").where("component_id < id").select("id", "component_id").distinct().withColumnRenamed("id", "__moved"), "moved")
    out = sketched.join(moved, F.col("id") == F.col("__moved"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.col("component_id").isNull().alias("kept"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``near_duplicates`` keeps (of rows that share an id all)."""
    told = near_duplicates(docs, size, percent, id_col=id_col, text_col=text_col)
    lost = written(told.where("not kept").select(F.col(id_col).alias("__id")).distinct(), "lost")
    return docs.join(lost, F.col(id_col) == F.col("__id"), "left_anti")
