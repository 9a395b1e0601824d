"""Frames over long documents against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.operators import extract
from parchment.operators.ranged import framed

WORDS = ("Date 01-02-2022", "03/04/2021", "Total", "5.00", "7", "Bread", "Milk", "12.50", "x", "Grand total", "due date", "2020-02-30", "99,999.00", "")


def elements(spark, seed=1, docs=("long", "a", "b", "c", "tiny", None)):
    rng = random.Random(seed)
    rows = []
    for d in docs:
        seq = 0
        for _ in range({"long": 3000, "tiny": 1}.get(d, rng.randint(1, 40))):
            seq += rng.choice([1, 1, 1, 5])  # places have gaps
            rows.append((d, seq, rng.choice(WORDS), 0.5))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, seq int, text string, confidence double").repartition(5)


def both(spark, rows, ranges, before, after):
    frames = lambda w: {"around": F.collect_list("text").over(w.rowsBetween(-before, after)), "next": F.lead("seq").over(w) if after else F.lit(0)}
    got = framed(rows, "doc_id", "seq", before, after, frames, ranges).collect()
    want = rows.withColumns(frames(Window.partitionBy("doc_id").orderBy("seq"))).collect()
    return sorted(map(tuple, got), key=repr), sorted(map(tuple, want), key=repr)


def test_frames_equal_plain_windows(spark):
    for ranges, before, after in ((7, 1, 4), (40, 2, 0), (40, 0, 3), (400, 3, 5), (1, 1, 1)):
        got, want = both(spark, elements(spark, ranges), ranges, before, after)
        assert got == want


def test_ranges_of_one_or_two_rows(spark):
    """A frame may reach over several ranges."""
    rows = spark.createDataFrame([(d, i, str(i), 0.5) for d in ("a", "b") for i in range(20)], "doc_id string, seq int, text string, confidence double")
    got, want = both(spark, rows, 64, 4, 6)
    assert got == want


def test_long_document_spans_ranges(spark, monkeypatch):
    rows = elements(spark, 3)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spans = {}
        from parchment.operators import ranged

        kept = ranged.stored
        monkeypatch.setattr(ranged, "stored", lambda df, name: spans.setdefault(name, kept(df, name)))
        long = extract.extract(rows, long=True)
        assert spans["ranges"].where("doc_id = 'long'").select("_range").distinct().count() > 8
        assert spans["ranges"].groupBy("_range").count().agg(F.max("count")).first()[0] < 600  # of 3,100 rows
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(long) == key(extract.extract(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    monkeypatch.undo()
    assert extract.receipts(rows.where("false"), long=True).count() == 0


def test_stored_tables(spark):
    from pathlib import Path

    from parchment.sources import shared

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    table = shared.stored(spark.range(100).repartition(3), "numbers")
    (at,) = {f.rsplit("/", 1)[0].removeprefix("file:").replace("///", "/") for f in table.inputFiles()}
    assert table.count() == 100 and spark.conf.get(key) == before and Path(at).exists()
    shared.discard(table)
    assert not Path(at).exists() and Path(at).parent.exists()
    other = Path(at).parent.parent / "kept"
    spark.range(3).write.mode("overwrite").parquet(str(other))
    shared.discard(spark.read.parquet(str(other)))  # not a stored table
    assert spark.read.parquet(str(other)).count() == 3
