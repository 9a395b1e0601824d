"""Token-ID files: Parquet list columns in id order, with page indexes, and selective reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared
from .common import shared_path, shuffle_partitions, stored, text_or_empty

#: Rows beside the ids, so that a read of them touches no page of ids.
SCHEMA = "part int, row long, doc_id {kind}, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, dictionary: bool = True, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes (part, row, doc_id, n_tokens, ids) to `path`, ascending in id over the files and inside each; row numbers a
    part's rows as they are written.

    ids holds the encoding of the whole text (null: empty) and `end_id`. With dictionary=True ids are dictionary
    pages while the dictionary fits a page and the writer falls back beyond; with False they are delta encoded
    (format v2). Row groups and pages have bounded sizes and every column has a page index, so a filter on doc_id or
    a projection without ids reads few pages. Rows are dealt by range of (id, a hash of the text), so no task gathers more
    than its range, a hot id is split, and no text is sampled to the driver; equal ids lie together in order of that
    hash, a null id comes first. Long texts are encoded in blocks. An empty table writes an empty file.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from parchment.llm.chunked_encoding import id_bytes

        encoder, end, part, row = id_bytes(tokenizer_path), np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            start, texts = 0, batch.column(1).to_pylist()
            while start < batch.num_rows:  # a few MB of text at a time
                stop, size = start, 0
                while stop < batch.num_rows and size < 4 << 20:
                    size += len(texts[stop])
                    stop += 1
                flat = [made + end for made in encoder.folded(texts[start:stop])]
                counts = [len(f) // 4 for f in flat]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(np.arange(row, row + n)), batch.column(0).slice(start, n), pa.array(counts, pa.int64()), ids], names=["part", "row", "doc_id", "n_tokens", "ids"])
                start += n
                row += n

    n = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    out = dealt.mapInArrow(encode, SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString()))
    with shared.shuffles_removed(docs.sparkSession):
        out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", str(dictionary).lower()).option("parquet.writer.version", "v1" if dictionary else "v2").parquet(path)


def read_tokens(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The documents' ids; `where` on doc_id or n_tokens is pushed to row groups and pages."""
    files = spark.read.parquet(path)
    return files.where(where) if where else files


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it), without reading a page of ids.

    Each file range's total shifts the running sums inside it: one row a range is all that is summed in one place.
    """
    return starts(spark.read.parquet(path).select("part", "row", "doc_id", "n_tokens"))


def starts(rows: DataFrame) -> DataFrame:
    """rows with `start`, in the files' own order of parts and rows."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return here.join(shift, "part").withColumn("start", F.col("here") + F.col("shift")).drop("here", "shift", "part", "row")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) from the files."""

    def digest(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            flat, cuts = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<i4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path).select("part", "row", "doc_id", "ids")
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = stored(files.mapInArrow(digest, f"part int, row long, doc_id {kind}, n_tokens long, ids_crc32 long"), "digests")  # the ids are read once
    return starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the files (to the shared folder unless `path` is given) and returns the digests read back from them."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path)
    return token_digests(spark, path)
