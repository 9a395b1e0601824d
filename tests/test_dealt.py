"""Elements are dealt by document once, and what is parsed is parsed once."""

import numpy as np
from pyspark.sql import functions as F

from parchment import queries
from parchment.functions import text_repair
from parchment.operators import extract, images
from parchment.sources import synthetic

SMALL = "/root/testdata/sf0.001"


def test_small_tables_fill_all_parts(spark):
    rows = synthetic.elements(spark, SMALL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select(F.spark_partition_id()).distinct().count() == parts


def test_documents_need_no_further_exchange(spark):
    plan = extract.receipts(synthetic.elements(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # orders and lines


def test_largest_amount_parses_a_text_once(spark):
    plan = queries.total_fallback(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_stripped_is_strip(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{a}x{a} y{a}{a}" for a in spaces] + ["", "   ", "​x", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_repair.stripped(F.col("t")).alias("s"))
    assert [(r["t"], r["s"]) for r in rows.collect() if r["t"].strip() != r["s"]] == []


def test_pages_fill_all_parts(spark):
    rows = synthetic.pages(spark, SMALL).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(rows) > 1


def test_images_are_handed_over_in_bounded_batches(spark):
    size = images.BATCH_BYTES // 4
    one = F.expr(f"cast(repeat('x', {size}) AS binary)").alias("content")
    rows = spark.range(0, 24, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("height"), F.lit(size).alias("width"), F.lit(1).alias("channels"), one)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    found = [r["n"] for r in images.handed(rows).mapInArrow(count, "n int").collect()]
    assert sum(found) == 24 and max(found) <= 5


def test_denoise_is_by_the_definition():
    page = np.random.default_rng(7).integers(0, 256, (9, 12)).astype(np.uint8)
    source, padded, total, weights = page.astype(float), np.pad(page.astype(float), 2, mode="reflect"), 0, 0
    for dy in range(5):
        for dx in range(5):
            moved = padded[dy : dy + 9, dx : dx + 12]
            square = np.pad((source - moved) ** 2, 1, mode="edge")
            weight = np.exp(-sum(square[i : i + 9, j : j + 12] for i in range(3) for j in range(3)) / 9 / 30**2)
            total, weights = total + weight * moved, weights + weight
    assert (images.denoise(page, 30, 3, 5) == np.rint(total / weights)).all()


def test_parsing_is_compiled(spark):
    """The JVM only interprets methods of over 8,000 bytes."""
    rows = extract.parsed(spark.range(3).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("seq"), F.col("id").cast("string").alias("text")))
    stages = rows._jdf.queryExecution().debug().codegenToSeq().iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    assert max(sizes) < 8000
