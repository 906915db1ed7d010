"""Exact deduplication with a heavy-hitter split: Misra-Gries, verified winners, ordinary shuffle for the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text in UTF-8; texts with equal digests count as identical. Null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def misra_gries(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests, among them each that more than one row in ``counters + 1`` has.

    Each task keeps ``counters`` counters. Summaries add up, and the largest counter left out is subtracted
    from the others, which keeps the guarantee (the usual merge of such summaries).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            counts = batch.column(0).value_counts()
            held.update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())))
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - least for k, v in held.items() if v > least})
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])

    merged = digests.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    top = merged.orderBy(F.desc("n"), "digest").limit(counters + 1)
    # min over all rows is the counter left out where there are that many
    floor = top.agg(F.when(F.count("*") > counters, F.min("n")).otherwise(0).alias("floor"))
    return top.crossJoin(F.broadcast(floor)).where("n > floor").select("digest")


def verdicts(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal if identical; null counts as empty. Of equal texts the row with the largest id stays (of
    rows that repeat that id one; null ids are least). At most ``counters`` candidates, whatever the data,
    are verified by exact counts and broadcast; their groups are decided where the rows lie. Every other
    group holds at most one row in ``counters + 1``; those shuffle by digest, with sums made before. Very long texts
    are digested whole and never shuffle. An empty table gives no rows; other columns play no part.
    """
    ids = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.max(F.struct(F.col("id").isNotNull().alias("real"), "id", "row")).alias("best")
    frequent = F.broadcast(misra_gries(ids, counters))
    heavy = written(ids.join(frequent, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n"), best).where("n > 1"), "heavy")
    mine = ids.join(F.broadcast(heavy), "digest", "left")
    rest = mine.where("n is null").select("id", "digest", "row")
    light = written(rest.groupBy("digest").agg(F.count("*").alias("n"), best).where("n > 1"), "light")
    decided = mine.where("n is not null").unionByName(rest.join(light, "digest", "left"))
    return decided.select(
        F.col("id").alias(id_col),
        F.coalesce("best.id", "id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``verdicts`` keeps. Only ids and digests of dropped rows are joined
    back; of rows that repeat both id and text one stays."""
    told = written(verdicts(docs, counters, id_col, text_col).select(F.col(id_col).alias("__id"), "kept", "text_sha256"), "verdicts")
    lost = told.groupBy("__id", F.col("text_sha256").alias("__digest")).agg(F.count_if("kept").alias("__stay"), F.count("*").alias("__n")).where("__stay < __n")
    marked = docs.withColumn("__d", F.lower(F.hex(text_digest(F.col(text_col)))))
    match = (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__d") == F.col("__digest"))
    joined = marked.join(lost, match, "left").drop("__id", "__digest", "__n")
    sure = joined.where("__stay is null")
    again = joined.where("__stay > 0").dropDuplicates([id_col, "__d"])
    return sure.unionByName(again).select(*docs.columns)
