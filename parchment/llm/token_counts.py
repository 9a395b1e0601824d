"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle: each task encodes the documents that it reads and returns three numbers a document. Long texts are
    cut at safe boundaries into blocks of a fixed size, so memory doesn't grow with a text, and blocks, not rows,
    are what is encoded at a time. Null and empty texts count 0 bytes and 0 tokens; repeated rows give repeated rows;
    a null id stays null; an empty table gives an empty result; other columns of docs are ignored.
    """

    def count(batches):
        import pyarrow as pa

        from parchment.llm.chunked_encoding import lengths

        encoder = lengths(tokenizer_path)
        for batch in batches:
            counts = encoder.folded(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
