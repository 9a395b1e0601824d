"""Comparison of two recognition engines against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import stored
from .selection import medians

ENGINES = ("easyocr", "pytesseract")
SHOWN = 100
NOT_RUN = "No result"


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


@F.pandas_udf(DoubleType())
def sequence_ratio(truth: pd.Series, guess: pd.Series) -> pd.Series:
    """difflib's ratio, for which Spark has nothing: 1 for two empty texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(truth, guess, strict=True)], dtype="float64")


def edit_ratio(truth: Column, guess: Column) -> Column:
    """1 - edit distance over the longer length, all in the JVM; 1 for two empty texts."""
    longest = F.greatest(F.length(truth), F.length(guess))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(truth, guess) / longest)


def compare(truth: DataFrame, guesses: DataFrame, ratio=sequence_ratio, key: str = "stem") -> DataFrame:
    """truth (split, stem, ground_truth) with guesses (split, stem, engine, text, error), a row an image; `key` is the column
    that names images in both.

    Images without ground truth, or the reverse, give no row. An engine's error, or its missing row (error NOT_RUN), is
    cer 1.
    """
    one = lambda e: guesses.where(F.col("engine") == e).select("split", key, F.col("text").alias(f"{e}_text"), F.col("error").alias(f"{e}_error"))
    rows = truth.where("ground_truth is not null")
    for e in ENGINES:
        rows = rows.join(one(e).withColumn(f"{e}_ran", F.lit(True)), ["split", key], "left")
        rows = rows.withColumn(f"{e}_error", F.when(F.col(f"{e}_ran").isNull(), F.lit(NOT_RUN)).otherwise(F.col(f"{e}_error")))
    wanted = normalized(F.col("ground_truth"))
    for e in ENGINES:
        rows = rows.withColumn(f"{e}_ratio", F.when(F.col(f"{e}_error").isNull(), ratio(wanted, normalized(F.col(f"{e}_text")))).otherwise(0.0))
    shown = lambda e: F.when(F.coalesce(F.col(f"{e}_text"), F.lit("")) == "", "ERROR").otherwise(F.substring(f"{e}_text", 1, SHOWN))
    told = lambda e: F.struct(shown(e).alias("text"), (1 - F.col(f"{e}_ratio")).alias("cer"), (F.col(f"{e}_ratio") * 100).alias("accuracy"), F.col(f"{e}_error").alias("error"))
    a, b = (told(e) for e in ENGINES)
    better = F.when(a["cer"] < b["cer"], ENGINES[0]).otherwise(ENGINES[1])
    return rows.select(F.col(key).alias("image"), "split", F.substring("ground_truth", 1, SHOWN).alias("ground_truth"), a.alias(ENGINES[0]), b.alias(ENGINES[1]), better.alias("better"))


def report(compared: DataFrame) -> DataFrame:
    """One row: total_images, each engine's mean cer (0 without rows) and the number of images where it was better."""
    mean = lambda e: F.coalesce(F.avg(F.col(e)["cer"]), F.lit(0.0)).alias(f"{e}_mean_cer")
    return compared.agg(F.count("*").alias("total_images"), *map(mean, ENGINES), *(F.count_if(F.col("better") == e).alias(f"{e}_better") for e in ENGINES))


def report_json(compared: DataFrame) -> tuple[DataFrame, str, str]:
    """(rows (split, image, json), head, tail) of the comparison's report, one JSON object: the means, then `results` with an
    object for each image in order of split and name. files.write_json_value writes it by many tasks."""
    means = report(compared).select(F.to_json(F.struct("total_images", *(f"{e}_mean_cer" for e in ENGINES)))).first()[0]
    rows = compared.select("split", "image", F.to_json(F.struct(*compared.columns), {"ignoreNullFields": "false"}).alias("json"))
    return rows, means[:-1] + ', "results": [', "]}"


def summary(compared: DataFrame) -> DataFrame:
    """A row an engine: n, mean, median, std (population), min, max of cer, and mean accuracy in percent. The median is
    found by counting ranges, the rest are partial sums: no task holds an engine's values."""
    long = compared.select(F.explode(F.array(*(F.struct(F.lit(e).alias("engine"), F.col(e)["cer"].alias("cer")) for e in ENGINES))).alias("x")).select("x.*")
    long = stored(long, "cer")  # compared, with its ratios, is worked out once
    middle = compared.sparkSession.createDataFrame(list(medians(long, "engine", "cer").items()), "engine string, median_cer double")
    out = long.groupBy("engine").agg(
        F.count("*").alias("n"), F.avg("cer").alias("mean_cer"), F.stddev_pop("cer").alias("std_cer"), F.min("cer").alias("min_cer"), F.max("cer").alias("max_cer"),
        ((1 - F.avg("cer")) * 100).alias("mean_accuracy"),
    )
    return out.join(F.broadcast(middle), "engine").select("engine", "n", "mean_cer", "median_cer", "std_cer", "min_cer", "max_cer", "mean_accuracy")


def winner(compared: DataFrame) -> DataFrame:
    """The engine of the lower mean; the second of equals. Means are 0 where there are no rows."""
    mean = lambda e: F.coalesce(F.avg(F.col(e)["cer"]), F.lit(0.0))
    means = compared.agg(F.count("*").alias("total_images"), *(mean(e).alias(f"{e}_mean_cer") for e in ENGINES))
    return means.withColumn("winner", F.when(F.col(f"{ENGINES[0]}_mean_cer") < F.col(f"{ENGINES[1]}_mean_cer"), ENGINES[0]).otherwise(ENGINES[1]))
