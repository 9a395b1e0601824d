"""Readers and writers of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import is_image_name
from ..functions.text_repair import stripped
from ..schema import ELEMENTS
from .shared import stored

ANY_IMAGE = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"
SPLITS = ("train", "val", "test")


def stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded images as path, height, width, channels, content (blue, green, red); a file that doesn't decode keeps its
    row, with null content."""
    raw = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", ANY_IMAGE).load(path)
    found = F.col("height") > 0
    at = (F.when(found, F.col(c)).alias(name) for c, name in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "content")))
    return raw.select("image.*").select(F.col("origin").alias("path"), *at)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Undecoded image files in name order; the content column is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ANY_IMAGE).load(path)
    return files.where(is_image_name(F.col("path"))).orderBy("path")


def ground_truth(spark: SparkSession, path: str, split: str) -> DataFrame:
    """split, stem, ground_truth of the .txt files beside the images."""
    texts = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return texts.select(F.lit(split).alias("split"), stem(F.col("_metadata.file_path")).alias("stem"), stripped(F.col("value")).alias("ground_truth"))


def dataset(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """The ground truth of all splits in order."""
    first, *rest = (ground_truth(spark, f"{root}/{s}", s) for s in splits)
    for other in rest:
        first = first.unionByName(other)
    return first


def elements(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(ELEMENTS).format(kind).load(path)


def of_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The image files of a list, a row each."""
    return spark.read.format("binaryFile").load(paths).where(is_image_name(F.col("path")))


def write_json(receipts: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept, non-ASCII as it is."""
    receipts.write.option("ignoreNullFields", False).json(path)


def write_json_value(rows: DataFrame, path: str, order: list[str], head: str = "[", tail: str = "]", ranges: int | None = None) -> None:
    """rows (with a column json) as one JSON value, in `order`: head, the rows parted by commas, tail. The value is what the
    part files under `path` give one after the other, in order of their names.

    Rows are dealt by range of the order, and a task writes its range; which row is the first and which the last, so
    which has the head, which the tail and no comma, follows from the number of rows of each range: no row meets those of
    another range. Nothing but the counts, a number a range, reaches the driver. Without rows the value is head and tail.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order, F.xxhash64("json")).sortWithinPartitions(*order)
    # the number of a row: its range, and in the low 33 bits its place there
    numbered = stored(dealt.select("json", F.monotonically_increasing_id().alias("number")), "parts")
    at = F.shiftright("number", 33).cast("int")
    counts = {r["part"]: r["n"] for r in numbered.groupBy(at.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        rows.sparkSession.createDataFrame([(head + tail,)], "value string").coalesce(1).write.text(path)
        return
    first, last = min(counts) << 33, (max(counts) << 33) + counts[max(counts)] - 1
    before = F.when(F.col("number") == first, F.lit(f"{head}\n")).otherwise("")
    after = F.when(F.col("number") == last, F.lit(f"\n{tail}")).otherwise(",")
    lines = numbered.repartitionById(max(counts) + 1, at).sortWithinPartitions("number")
    lines.select(F.concat(before, "json", after).alias("value")).write.text(path)


def write_json_array(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """All rows as one JSON array, see write_json_value; the order's columns are of rows, the first one unless given."""
    order = order or rows.columns[:1]
    json = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    write_json_value(rows.select(*order, json.alias("json")), path, order)


def as_json(receipts: DataFrame) -> DataFrame:
    """(doc_id, json) for per-document files or responses."""
    return receipts.select("doc_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
