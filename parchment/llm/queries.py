"""The operators as queries over the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, centroids_sql, decontaminate, line_dedup, merkle, merkle_sql, mixing, packing, quality_lm, quality_rules, rules_sql, sharding, simhash, suffix_dedup, token_counts, token_files
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.bin_pack(table(spark, sf_dir, "documents"), 8)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("char_distance", "word_distance")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(*packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_suffix_dedup, op2_sharding, op3_decontamination, op4_token_counts, op5_line_dedup, op6_quality_classifier, op7_mixing,
    op8_token_files, op9_quality_rules, op10_simhash, op11_merkle, op12_packing, op13_centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


SQL: dict[str, str] = {}

SQL["op7_mixing"] = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY k
), level AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(rest, 2.0 * source_size / w) AS rest, arg_min(open_w, 2.0 * source_size / w) AS open_w
  FROM level WHERE rest * w / open_w <= 2.0 * source_size
), t AS (
  SELECT k, source_size, least(2.0::DOUBLE * source_size, (SELECT rest FROM water) * w / (SELECT open_w FROM water)) AS target FROM s
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.doc_id) AS n
  FROM d JOIN t USING (k)
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (floor(n * rate + {mixing.offset(0)!r}) - floor((n - 1) * rate + {mixing.offset(0)!r})))::BIGINT AS taken
FROM r
"""


SQL["op9_quality_rules"] = rules_sql.SQL
SQL["op11_merkle"] = merkle_sql.SQL
SQL["op13_centroids"] = centroids_sql.SQL


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
