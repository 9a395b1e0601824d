"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, joined, prefix_sum, stored

#: Fixed values of the mix: weights by place in the order of sources, repeating; share of all words; cap a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def word_count(column: str = "text") -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(column), SPACES), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows (key, source_size, n) with `target`: shares of `share` of all words by weight, what exceeds `cap` times a
    source being dealt again by weight until none does.

    Sources are capped in order of cap * size / weight. What is left for the others before each of them is a running
    sum over ranges of that order, and the first that is not above its cap tells the level for all. No list of sources
    leaves the tasks.
    """
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = stored(prefix_sum(sources.withColumn("one", F.lit(0)), "one", ["key"], None, "place").withColumn("w", weigh).withColumn("full", cap * F.col("source_size") / F.col("w")), "weights")
    size, w = rows.agg(F.sum("source_size"), F.sum("w")).first()
    before = prefix_sum(rows, "one", ["full", "key"], "w", "w_before")
    before = prefix_sum(before, "one", ["full", "key"], "source_size", "size_before")
    left, open_w = share * F.lit(size or 0).cast("double") - cap * F.col("size_before"), F.lit(w or 0) - F.col("w_before")
    fits = before.select("full", "key", "source_size", "w", left.alias("left"), open_w.alias("open_w")).where(F.col("left") * F.col("w") / F.col("open_w") <= cap * F.col("source_size"))
    level = fits.agg(F.min(F.struct("full", "key", "left", "open_w")).alias("x")).first()["x"]
    most = cap * F.col("source_size")
    target = F.least(most, F.lit(level["left"]) * F.col("w") / F.lit(level["open_w"])) if level else most
    return rows.select("key", "source_size", "n", target.alias("target"))


def offset(seed: int) -> float:
    return random.Random(seed).random()


def systematic_copies(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """One row a document: id_col (or key_col, a key of the row), source, size (words), source_size, target, copies, taken (copies * size).

    Each document of a source expects target / source_size copies. The expectations are summed along the source's
    documents in order of (size, id, and with key_col the text's hash), a random offset is added once, and a document is emitted once for each integer
    that the sum crosses at it: copies are the expected number rounded down or up, reruns agree, and since
    neighbours in the order have like sizes, a source's words miss its target by about one document's. The sums are
    exact over ranges dealt to many tasks (common.prefix_sum), so a source with a third of all rows is split; sources
    are rows of a table and may be as many as hosts, only hot ones are broadcast beyond the limit. Null texts have
    size 0; null sources form one source, last in the order; rows of one id and size may change places; repeated rows
    count each; very long texts are only counted; an empty table gives an empty result; other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))  # null after any source
    more = [F.xxhash64(text_col).alias("tie"), F.col(key_col).alias("row")] if key_col else []
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), word_count(text_col).alias("size"), *more), "sizes")
    plan = stored(targets(stored(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources"), weights, share, cap), "targets")
    placed = joined(prefix_sum(rows, "key", ["size", "id", *(["tie", "row"] if key_col else [])], None, "before"), plan, "key", 64)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(k * rate + F.lit(offset(seed)))
    copies = (upto(F.col("before") + 1) - upto(F.col("before"))).cast("long")
    return placed.select(F.col("row").alias(key_col) if key_col else F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
