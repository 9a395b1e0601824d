"""A landing folder of images: each document becomes a receipt once, when all its files are there."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import is_image_name
from ..operators import extract, images as steps, recognize
from ..plans.pipeline import NOT_AN_IMAGE
from ..sources import files

#: `<document>.<page>of<pages>.<extension>`; any other name is a document of one page.
PAGE = r"^(.*)\.(\d+)of(\d+)\.[^.]*$"
MISSING = "Pages are missing"
FILE = "path string, modificationTime timestamp, length long, content binary"
#: Elements of a page count from its number times this.
PAGE_STEP = 1_000_000


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (doc_id, page, pages, path, accepted) of the files that arrive in `folder`; no content is read."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda k: F.nullif(F.regexp_extract(name, PAGE, k), F.lit(""))
    alone = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return found.select(
        F.coalesce(part(1), alone).alias("doc_id"), F.coalesce(part(2).try_cast("int"), F.lit(1)).alias("page"), F.coalesce(part(3).try_cast("int"), F.lit(1)).alias("pages"),
        "path", is_image_name(F.col("path")).alias("accepted"),
    )


def complete(arriving: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(doc_id, paths in order of pages, error) of each document, once, when its last page has arrived.

    The state of a document is the paths of the pages that are there, and whether it was given. A page that arrives again, and
    what arrives for a document that was given, changes nothing. With keep_ms the state of a document is dropped that long after
    its last file: one that is incomplete by then is given with an error; without, states stay.
    """

    def settle(key, batches, state: GroupState):
        if state.hasTimedOut:
            done = state.get[1]
            state.remove()
            if not done:
                yield pd.DataFrame({"doc_id": [key[0]], "paths": [[]], "error": [MISSING]})
            return
        kept, done = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, False)
        pages, refused = kept.get("pages"), False
        for rows in batches:
            for r in rows.sort_values("path").itertuples():
                refused = refused or not r.accepted
                pages = pages or int(r.pages)
                kept.setdefault(str(int(r.page)), r.path)
        kept["pages"] = pages
        wanted = [str(p) for p in range(1, pages + 1)]
        given = done
        if not done and (refused or all(p in kept for p in wanted)):
            done = True
            yield pd.DataFrame({"doc_id": [key[0]], "paths": [[] if refused else [kept[p] for p in wanted]], "error": [NOT_AN_IMAGE if refused else None]})
        state.update((json.dumps({"pages": pages} if done else kept), done))
        if keep_ms and not given:
            state.setTimeoutDuration(keep_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return arriving.groupBy("doc_id").applyInPandasWithState(settle, "doc_id string, paths array<string>, error string", "kept string, done boolean", "append", timeout)


def local_part(path):
    """A path without its scheme, which readers write with one slash or three."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def receipts_of(documents: DataFrame, reader, options: recognize.Options = recognize.Options()) -> DataFrame:
    """Receipts of the documents (doc_id, paths, error): pages are recognised, their elements follow in order of pages.

    The documents' paths are listed on the driver; they are those of one trigger and of pages that waited for it.
    """
    spark = documents.sparkSession
    rows = documents.collect()
    schema = "doc_id string, page int, path string"
    pages = spark.createDataFrame([(r["doc_id"], i, p) for r in rows for i, p in enumerate(r["paths"])], schema)
    refused = spark.createDataFrame([(r["doc_id"], False, r["error"]) for r in rows if r["error"]], "doc_id string, success boolean, error string")
    paths = [p for r in rows for p in r["paths"]]
    if not paths:
        return extract.receipts(spark.createDataFrame([], "doc_id string, seq int, text string, confidence double")).unionByName(refused, allowMissingColumns=True)
    found = recognize.elements(files.images(spark, paths), reader, options, steps.preprocess_receipt_conservative, keep_failed=True)
    at = pages.select(F.col("doc_id").alias("doc"), "page", local_part(F.col("path")).alias("at"))
    placed = found.withColumn("at", local_part(F.col("doc_id"))).join(F.broadcast(at), "at")
    out = placed.withColumns({"doc_id": F.col("doc"), "seq": F.col("page") * PAGE_STEP + F.col("seq")}).drop("doc", "page", "at")
    return extract.receipts(out).unionByName(refused, allowMissingColumns=True)


def ingest_images(spark: SparkSession, folder: str, out: str, checkpoint: str, reader, options: recognize.Options = recognize.Options(), keep_ms: int | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Images that arrive in `folder` become receipts under `out`, a document once, however often and in however many files it
    arrives, and whenever the stream is stopped and started again: a trigger's receipts are written to a folder of its
    number, which a repeated trigger overwrites with the same."""

    def work(batch: DataFrame, number: int) -> None:
        receipts_of(batch, reader, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    done = complete(arrivals(spark, folder, files_per_trigger), keep_ms)
    return done.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
