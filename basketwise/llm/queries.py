"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, lexical_search, lm_scoring, near_dedup, packing, pii, quality_rules, substring_dedup, syncmers, token_counts, whitening
from .storage import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), width=35)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.predict(docs.select("doc_id", "text"), docs.where(~held))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_quality_rules": op2_quality_rules,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op8_pii": op8_pii,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_syncmers": op12_syncmers,
    "op13_whitening": op13_whitening,
}


def _host_rule(name: str) -> str:
    """The shrunk rate of a host for one rule, in SQL."""
    weight = f"CASE WHEN v_{name} > 0 THEN least(1000.0, greatest(2.0, m_{name} * (1 - m_{name}) / v_{name} - 1)) ELSE 1000.0 END"
    return f"(f_{name} + m_{name} * ({weight})) / (n + ({weight})) > 0.5"


_TERMS = rf"regexp_extract_all(translate(text, '{lexical_search.UPPER}', '{lexical_search.LOWER}'), '{lexical_search.TERM}')"
_RULES = ("short", "repetitive", "symbols", "lines")

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(generate_series(1, CAST(len(ws) - 7 AS BIGINT))) AS i FROM w WHERE len(ws) >= 8)),
        twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
        repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
        f AS (
            SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id),
        m AS (
            SELECT *, n_words < 20 AS short, n_repeat_words * 100 > n_words * 30 AS repetitive,
                   n_symbols * 10 > n_words * 3 AS symbols, n_dup_lines * 10 > n_words * 3 AS lines FROM f),
        h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {r}) AS f_{r}" for r in _RULES)} FROM m WHERE source IS NOT NULL GROUP BY source),
        p AS (SELECT {", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in _RULES)} FROM h),
        bad AS (SELECT source FROM h, p WHERE {" OR ".join(map(_host_rule, _RULES))})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
               NOT (short OR repetitive) AND bad.source IS NULL AS kept, bad.source IS NOT NULL AS host_failed
        FROM m LEFT JOIN bad ON m.source = bad.source""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS d, doc_id, ts, len(ts) AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
        q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        p AS (SELECT x.d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(ts) AS term FROM d) x SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        f AS (SELECT item_id, d, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
              FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, d, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM f WHERE score > 0 QUALIFY rank <= 10""",
}
