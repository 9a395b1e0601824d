"""From raw documents to packed shards: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontaminate, mixing, near_docs, quality_lm, sharding
from parchment.llm.common import joined, small, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 8
#: Near duplicates share this many words a shingle.
SHINGLE_WORDS = 5


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever its letters' case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row in a column of a free name, stored, so that the keys stay as they are: rows of one id,
    rows of no id and repeated rows are told apart by it."""
    key = free(docs, "row_key")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """rows but for those of the keys dropped, which are broadcast only if their counted size allows; the key goes."""
    return rows.join(small(stored(dropped.select(key).distinct(), "dropped"), 16), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    rows, key = keyed(docs)
    return without(rows, quality_lm.classify(rows, table(spark, sf_dir, "labels"), key_col=key).where("NOT kept"), key).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id: SimHash and MinHash candidates, kept
    if their shingle sets are alike by 0.8 or more. Repeated rows are near duplicates too; a null id is the largest."""
    rows, key = keyed(docs)
    found = near_docs.near_duplicates(rows, SHINGLE_WORDS, id_col=key)
    placed = stored(found.join(rows.select(key, F.struct(F.isnull("doc_id"), "doc_id", key).alias("place")), key), "components")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = joined(placed, stored(first, "firsts"), "component_id", 48).where(F.col(key) != F.col(f"first.{key}"))
    return without(rows, dropped, key).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    rows, key = keyed(docs)
    return without(rows, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key), key).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as systematic sampling takes it."""
    rows, key = keyed(docs)
    copies, copy = free(rows, "n_copies"), free(rows, "copy_number")
    found = stored(mixing.systematic_copies(rows, key_col=key).where("copies > 0").select(key, F.col("copies").cast("int").alias(copies)), "copies")
    taken = rows.join(small(found, 24), key)
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' shards and places in them."""
    return sharding.bin_pack(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Perplexities, fingerprints and token overlaps aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
