"""Fields of each document from its ordered elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import categories, parsing as P
from .ranged import framed

LEAST, MOST = 0.5, 50000.0
NO_TOTAL = "max() iterable argument is empty"


def parsed(elements: DataFrame) -> DataFrame:
    """elements with what their texts say on their own; each text is parsed once."""
    text = F.col("text")
    said = {"date": P.parse_date(text), "amount": P.parse_amount(text), "is_date_word": P.has_any(text, P.DATE_KEYWORDS), "is_total_word": P.has_any(text, P.TOTAL_KEYWORDS), "_named": P.named(text)}
    rows = elements.withColumns(said).withColumn("is_item_text", F.col("_named") & ~F.col("is_date_word") & ~F.col("is_total_word"))
    return rows.select(*elements.columns, "date", "amount", "is_date_word", "is_total_word", "is_item_text")


def frames(w: WindowSpec) -> dict[str, Column]:
    """The first date from 1 before to 3 after, the best amount from 1 before to 4 after, and whether an amount is next."""
    candidate = F.when(P.present(F.col("amount")), F.struct(F.when(F.contains("text", F.lit(".")), 1.0).otherwise(0.6).alias("conf"), F.col("amount").alias("amount")))
    return {
        "near_date": F.first("date", ignorenulls=True).over(w.rowsBetween(-1, 3)),
        "near_total": F.max(candidate).over(w.rowsBetween(-1, 4)),
        "is_item": F.col("is_item_text") & F.coalesce(P.present(F.lead("amount").over(w)), F.lit(False)),
    }


def with_neighbours(elements: DataFrame, long: bool = False) -> DataFrame:
    """Adds what the frames show.

    The three frames share one partitioning and order, which the aggregate that follows reuses: one exchange, one sort.
    With long=True documents may have any length: their rows are dealt by range (see ranged.framed) and written once.
    """
    if long:
        return framed(parsed(elements), "doc_id", "seq", 1, 4, frames)
    return parsed(elements).withColumns(frames(Window.partitionBy("doc_id").orderBy("seq")))


def extract(elements: DataFrame, long: bool = False) -> DataFrame:
    """A row a document: date, total, line_items, error, and n_elements, average_confidence, vendor.

    date: the first near a date word, else the first at all. total: near total words the amount with a decimal point,
    then the largest; else the largest of all within (LEAST, MOST), and an error where there are amounts but none
    within. line_items: texts that an amount follows, in order. Where elements have a column error (a document that
    couldn't be read has one row, without text), it is the document's error. long=True is for tables in which a
    document may have a large share of all rows: only its line items, which are one value of its row, meet in a task.
    """
    at = lambda condition, column: F.min(F.when(condition, F.struct("seq", column)))[column]
    amount = F.col("amount")
    broken = F.max(F.col("error")) if "error" in elements.columns else F.lit(None).cast("string")
    grouped = with_neighbours(elements, long).groupBy("doc_id").agg(
        broken.alias("broken"),
        F.coalesce(at(F.col("is_date_word") & F.col("near_date").isNotNull(), "near_date"), at(F.col("date").isNotNull(), "date")).alias("date"),
        F.max(F.when(F.col("is_total_word"), F.col("near_total")))["amount"].alias("near"),
        F.count(F.when(P.present(amount), 1)).alias("n_amounts"),
        F.max(F.when((amount > LEAST) & (amount < MOST), amount)).alias("largest"),
        F.array_sort(F.collect_list(F.when(F.col("is_item"), F.struct("seq", P.stripped(F.col("text")).alias("text")))))["text"].alias("line_items"),
        F.count("text").alias("n_elements"),
        F.avg("confidence").alias("average_confidence"),
        F.min(F.struct("seq", "text"))["text"].alias("vendor"),
    )
    failed = F.col("near").isNull() & (F.col("n_amounts") > 0) & F.col("largest").isNull()
    return grouped.select(
        "doc_id", "date", F.coalesce("near", "largest").alias("total"), "line_items", F.coalesce("broken", F.when(failed, F.lit(NO_TOTAL))).alias("error"),
        "n_elements", "average_confidence", "vendor",
    )


def receipts(elements: DataFrame, long: bool = False) -> DataFrame:
    """doc_id, success, date, total, category, error: a document that fails keeps its row, with null fields."""
    ok = F.col("error").isNull()
    keep = lambda c: F.when(ok, c)
    return categories.with_category(extract(elements, long)).select(
        "doc_id", ok.alias("success"), keep(F.col("date")).alias("date"), keep(F.col("total")).alias("total"), keep(F.col("category")).alias("category"), "error",
    )


def receipts_detailed(elements: DataFrame, items: int = 5) -> DataFrame:
    """receipts with debug_info; the average confidence is rounded at two places by its binary value. A document that fails
    keeps its row: success is false, error tells why, the rest is null."""
    info = F.struct(
        F.col("n_elements").cast("int").alias("ocr_elements_found"), P.round2(F.coalesce("average_confidence", F.lit(0.0))).alias("average_confidence"),
        F.size("line_items").alias("line_items_detected"), F.coalesce("vendor", F.lit("")).alias("vendor_name"), F.slice("line_items", 1, items).alias("line_items"),
    )
    ok = F.col("error").isNull()
    keep = lambda c, name: F.when(ok, c).alias(name)
    fields = (keep(F.col(c), c) for c in ("date", "total", "category"))
    return categories.with_category(extract(elements)).select("doc_id", ok.alias("success"), *fields, keep(info, "debug_info"), "error")


def with_epoch(receipts_: DataFrame) -> DataFrame:
    return receipts_.withColumn("date_epoch_ms", P.epoch_ms(F.col("date")))


def text_only(elements: DataFrame) -> DataFrame:
    """The texts of each document in order, a line each."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))["text"]
    return elements.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))


def batch_summary(receipts_: DataFrame) -> DataFrame:
    return receipts_.agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"))


def with_geometry(elements: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """center (means of the box's corners, truncated), normalized_center (that over the image's size), image_dimensions."""
    mean = lambda i: (F.aggregate("bbox", F.lit(0.0), lambda s, p: s + p[i]) / F.size("bbox")).cast("int")
    out = elements.withColumn("center", F.struct(mean(0).alias("x"), mean(1).alias("y")))
    return out.withColumns({
        "normalized_center": F.struct((F.col("center.x") / F.col(width)).alias("x"), (F.col("center.y") / F.col(height)).alias("y")),
        "image_dimensions": F.struct(F.col(width).cast("int").alias("width"), F.col(height).cast("int").alias("height")),
    })
