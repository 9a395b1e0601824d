"""Extension: a landing folder of element files, worked on as they arrive by the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import receipts
from ..operators.repair import repair
from ..schema import ELEMENTS


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, kind: str = "json", fix: bool = True) -> StreamingQuery:
    """Each file holds whole documents; each arriving set of files becomes receipts in `out`, once."""
    arriving = spark.readStream.schema(ELEMENTS).format(kind).load(folder)

    def work(batch: DataFrame, number: int) -> None:
        receipts(repair(batch) if fix else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
