"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one in the machine's own folder for a local master, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/parchment-{sc.applicationId}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/parchment/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark removes a query's when it ends, not when the driver collects its
    garbage. A written table needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what was dealt once stays so, lineage ends here, and a lost executor
    costs nothing."""
    at = path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(table: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    spark = table.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/parchment/" in at:  # only what `path` gave
            place = spark._jvm.org.apache.hadoop.fs.Path(at)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
