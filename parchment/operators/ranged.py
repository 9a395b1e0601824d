"""Row frames over keys of any size: a key's rows are dealt by range of its order, and each range gets copies of the rows
that stand just before and after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import stored

#: The frames' columns of a range's rows, given the window of the rows.
Frames = Callable[[WindowSpec], dict[str, Column]]


def framed(rows: DataFrame, key: str, order: str, before: int, after: int, frames: Frames, ranges: int | None = None) -> DataFrame:
    """rows with the columns frames(w), where w is the window of `key` in `order` and a frame reaches `before` rows back
    and `after` rows ahead at most: the same columns as with Window.partitionBy(key).orderBy(order).

    A plain window gathers a key in one task. Here rows are dealt by range of (key, order), so that a key with half of
    all rows spans half of the ranges. A key crosses from a range to another only as the last of one and the first of the
    next; of these keys alone, at most two a range, the outermost rows are copied to the ranges beside. What is copied
    or looked up is a few rows a range, whatever the size of the data. Rows of equal (key, order) stay in one range; a
    null key is a key; an empty table stays empty.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, key, order).withColumn("_range", F.spark_partition_id()), "ranges")
    # the keys at the ends of each range; a key that is at both ends of neighbours crosses between them
    held = F.struct(F.col(key).alias("k"))
    ends = dealt.groupBy("_range").agg(F.min(held).alias("first"), F.max(held).alias("last"))
    beside = Window.orderBy("_range")  # one row a range
    crossing = ends.withColumns({"came": F.lag("last").over(beside), "goes": F.lead("first").over(beside)})
    crossing = crossing.select("_range", F.explode(F.array_distinct(F.array(F.when(F.col("came") == F.col("first"), F.col("first")), F.when(F.col("goes") == F.col("last"), F.col("last"))))).alias("end"))
    crossing = stored(crossing.where("end IS NOT NULL").select("_range", F.col("end.k").alias("_key")), "crossing")
    # for each range of a crossing key, the ranges before it that look ahead into it, and those after it that look back
    along = Window.partitionBy("_key").orderBy("_range")
    near = lambda a, b: F.collect_list("_range").over(along.rowsBetween(a, b)) if a <= b else F.array().cast("array<int>")
    to = F.broadcast(crossing.withColumns({"_back": near(-after, -1), "_ahead": near(1, before)}))  # two rows a range at most
    to = to.select(F.col("_range").alias("_at"), "_key", "_back", "_ahead")
    outer = dealt.join(to, (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
    inside = Window.partitionBy("_range", key)
    first = outer.withColumn("_nth", F.row_number().over(inside.orderBy(order))).where(F.col("_nth") <= after).withColumn("_to", F.col("_back"))
    last = outer.withColumn("_nth", F.row_number().over(inside.orderBy(F.col(order).desc()))).where(F.col("_nth") <= before).withColumn("_to", F.col("_ahead"))
    copies = first.unionByName(last).withColumn("_range", F.explode("_to")).select(*rows.columns, "_range", F.lit(True).alias("_copy"))
    both = dealt.withColumn("_copy", F.lit(False)).unionByName(copies)
    window = Window.partitionBy("_range", key).orderBy(order)
    return both.withColumns(frames(window)).where("NOT _copy").drop("_copy", "_range")
