"""Exact medians by counting ranges: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Ranges that the values between the least and the largest are parted into, each time.
PARTS = 1024


def medians(rows: DataFrame, key: str, value: str) -> dict:
    """The median of each key's values that aren't null: the middle one, or the mean of the two in the middle.

    The values are counted in PARTS ranges of equal width between their bounds; then only the range that holds the wanted
    rank is counted again, between its own bounds, until its values are all equal. A count is a partial aggregate of
    PARTS numbers a key and rank. Keys are few (engines); there are about log(values) / log(PARTS) rounds, more where
    values crowd together. Infinite or not-a-number values aren't expected.
    """
    spark = rows.sparkSession
    kept = stored(rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "values")
    bounds = {r["k"]: r for r in kept.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    # (key, rank in the range, bounds of the range) still sought; ranks count from 0
    sought = {(k, i): (i, r["low"], r["high"]) for k, r in bounds.items() for i in {(r["n"] - 1) // 2, r["n"] // 2}}
    found = {}
    while True:
        found |= {at: low for at, (_, low, high) in sought.items() if low == high}
        sought = {at: s for at, s in sought.items() if s[1] != s[2]}
        if not sought:
            break
        wanted = spark.createDataFrame([(k, i, low, high) for (k, i), (_, low, high) in sought.items()], f"k {kept.schema['k'].dataType.simpleString()}, i long, low double, high double")
        part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1))
        inside = kept.join(F.broadcast(wanted), "k").where("v BETWEEN low AND high")
        counts = inside.groupBy("k", "i", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "i", "part")
        following = {}
        for r in counts.collect():  # PARTS rows a rank at most
            at = (r["k"], r["i"])
            if at in following:
                continue
            left = sought[at][0] - r["n"]
            if left < 0:
                following[at] = (sought[at][0], r["low"], r["high"])
            else:
                sought[at] = (left, *sought[at][1:])
        sought = following
    return {k: (found[k, (r["n"] - 1) // 2] + found[k, r["n"] // 2]) / 2 for k, r in bounds.items()}
