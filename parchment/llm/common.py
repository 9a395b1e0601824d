"""What the training-data operators share: shared-folder tables, exact distributed prefix sums,
size-checked broadcasts and connected components. Nothing here gathers rows of the data on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Largest table, in estimated bytes, that an operator may broadcast.
BROADCAST_LIMIT = 64 << 20
#: Keys of at least this part of all rows are hot, see `joined`.
HOT = 1000
#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared.path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, a lost executor costs nothing, and what was shuffled
    for it leaves the disks."""
    return shared.stored(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if its rows, counted, fit the limit; else df, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def joined(rows: DataFrame, table: DataFrame, key: str | list[str], row_bytes: int, how: str = "inner", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """rows joined with `table`, which has one row a key and how many rows of the key there are in its column n.

    The table is broadcast if its counted rows fit the limit. Else so are its hot keys only, those of a HOT-th or more
    of all rows counted, of which there are HOT at most; the other keys, none of which is a large share, are shuffled.
    """
    size, total = table.agg(F.count("*"), F.sum("n")).first()
    if size * row_bytes <= limit:
        return rows.join(F.broadcast(table), key, how)
    hot = F.broadcast(table.where(F.col("n") >= max(2, total // HOT)))
    cold = table.where(F.col("n") < max(2, total // HOT))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how), allowMissingColumns=True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def prefix_sum(df: DataFrame, group: str, order: list[str], value: str | None, name: str = "before") -> DataFrame:
    """Adds the exclusive running sum of `value` (None: 1 a row) within the non-null column `group`, in `order`.

    Rows are dealt by range of (group, order), so a hot group spans many tasks; each range's totals, one row a
    range and group, are summed first and shift the sums taken inside the ranges.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = stored(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    one = F.lit(1).cast("long") if value is None else F.col(value)
    totals = dealt.groupBy("_range", group).agg(F.sum(one).alias("_total"))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_range", group, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range", group).orderBy(*order)
    here = F.row_number().over(inside).cast("long") - 1 if value is None else F.coalesce(F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_here", here).join(shift, ["_range", group]).withColumn(name, F.col("_here") + F.col("_shift")).drop("_here", "_shift", "_range")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star contraction: both are joins with a per-node minimum that is partly
    aggregated before its shuffle, so that a node with many links is never gathered. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        following = stored(linked.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = following.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        shared.discard(now)
        if state == seen:
            return following.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
                following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, now = state, following
