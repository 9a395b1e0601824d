"""Receipts as element rows, and pages as pixels, made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VENDORS = ("Tabali", "Carrefour Market", "Uber", "Seif Pharmacy", "Vodafone Store", "Galaxy Cinema", "Zara", "Unknown Store", "Chicken Fila", "Hilton Apartment", "City Library", "Dove Salon")
ITEMS = ("Bread", "Milk", "Pepsi", "Taxi ride", "Netflix subscription", "Shampoo", "Medicine", "Laptop", "Books", "Monthly house rent", "Internet bill", "Cheese Fries", "Fish", "Eggs", "Mobile phone")



def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, text, confidence of a receipt for each order. Orders differ by key in the form of dates and prices, and some
    lack a date or a total line.

    Orders and lines are dealt by doc_id once, into as many parts as shuffles have, also where they are small on disk. An order's
    lines are numbered and counted by one window, joined with the order on the window's key, and each joined row gives its
    elements with their places: they stay dealt by doc_id, so what works on documents shuffles nothing.
    """
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows, order: rows.withColumn("doc_id", F.col(order).cast("string")).repartition(parts, "doc_id")
    lines = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"), "l_orderkey")
    of_order = Window.partitionBy("doc_id")
    in_order = of_order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = lines.withColumns({"k": F.row_number().over(in_order), "n": F.count("*").over(of_order).cast("int")}).select("doc_id", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "k", "n")
    orders = dealt(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    rows = orders.join(lines.hint("merge"), "doc_id", "left")
    key, n, k = F.col("o_orderkey"), F.coalesce("n", F.lit(0)), F.col("k")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    day = lambda f: F.date_format("o_orderdate", f)
    price = F.format_number("l_extendedprice", 2)
    date = (
        F.when(key % 5 == 0, F.concat(F.lit("Date: "), day("dd-MM-yyyy"))).when(key % 5 == 1, F.concat(F.lit("Date "), day("yyyy/MM/dd")))
        .when(key % 5 == 2, day("dd/MM/yy")).when(key % 5 == 3, F.concat(F.lit("Bill date "), day("MM-dd-yyyy"))).otherwise("Server 7")
    )
    price = F.when(key % 7 == 6, F.format_string("%.2f", "l_extendedprice")).when(key % 7 == 5, F.concat(F.lit("EGP "), price)).otherwise(price)
    at = lambda seq, text: F.struct(seq.cast("int").alias("seq"), text.alias("text"))
    end = 2 * n + 2
    told = key % 6 != 5  # whether a line tells the total
    ends = F.array(
        at(F.lit(0), pick(VENDORS, F.coalesce("l_suppkey", "o_custkey"))), at(F.lit(1), date),
        F.when(told, at(end, F.when(key % 3 == 0, "Grand Total").otherwise("Total"))), at(end + told.cast("int"), F.format_number("o_totalprice", 2)),
    )
    line = F.array(at(2 * k, pick(ITEMS, F.col("l_partkey"))), at(2 * k + 1, price))
    none = F.array().cast("array<struct<seq:int,text:string>>")
    of_row = F.concat(F.when(F.coalesce(k, F.lit(1)) == 1, F.array_compact(ends)).otherwise(none), F.when(k.isNotNull(), line).otherwise(none))
    out = rows.select("doc_id", F.inline(of_row))
    return out.withColumn("confidence", (32 + (F.col("seq") * 7) % 32).cast("double") / 64)


def elements_sql() -> str:
    """The same rows in DuckDB's SQL."""
    pick = lambda words, i: f"list_extract([{', '.join(map(repr, words))}], ({i} % {len(words)} + 1)::INT)"
    money = lambda x: f"format('{{:,.2f}}', {x})"
    return f"""
WITH li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS k
  FROM lineitem
), raw AS (
  SELECT o_orderkey, 0 AS block, {pick(VENDORS, "coalesce(l_suppkey, o_custkey)")} AS text
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey AND k = 1
  UNION ALL
  SELECT o_orderkey, 1, CASE o_orderkey % 5 WHEN 0 THEN concat('Date: ', strftime(o_orderdate, '%d-%m-%Y')) WHEN 1 THEN concat('Date ', strftime(o_orderdate, '%Y/%m/%d'))
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 3 THEN concat('Bill date ', strftime(o_orderdate, '%m-%d-%Y')) ELSE 'Server 7' END
  FROM orders
  UNION ALL
  SELECT l_orderkey, 2 * k, {pick(ITEMS, "l_partkey")} FROM li
  UNION ALL
  SELECT l_orderkey, 2 * k + 1, CASE l_orderkey % 7 WHEN 6 THEN format('{{:.2f}}', l_extendedprice) WHEN 5 THEN concat('EGP ', {money("l_extendedprice")}) ELSE {money("l_extendedprice")} END FROM li
  UNION ALL
  SELECT o_orderkey, 1000001, CASE o_orderkey % 3 WHEN 0 THEN 'Grand Total' ELSE 'Total' END FROM orders WHERE o_orderkey % 6 <> 5
  UNION ALL
  SELECT o_orderkey, 1000002, {money("o_totalprice")} FROM orders
), numbered AS (
  SELECT CAST(o_orderkey AS VARCHAR(20)) AS doc_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY block) - 1 AS INT) AS seq, text FROM raw
)
SELECT doc_id, seq, text, CAST(32 + (seq * 7) % 32 AS DOUBLE) / 64 AS confidence FROM numbered"""


#: Angles by which pages are turned, in degrees, by supplier.
ANGLES = (0, 5, -7, 12, -16, 21, -26, 3)


def pages(spark: SparkSession, sf_dir: str, height: int = 240, width: int = 320, angles: tuple[int, ...] = ANGLES) -> DataFrame:
    """A page a supplier of its order lines, as rows of pixels (path, height, width, channels, content), with `angle`.

    A page is a table with ruled columns, of a size that depends on the supplier: each order line inks a cell, at a line of the page by its order's day and in a
    column by its number; the more lines a cell has, the darker it is. The page is turned by its angle: each pixel looks up
    where it was before, so nothing of the library's own image steps is used. Cells are counted by Spark; a task draws
    from a page's cells, of which there are LINES * COLUMNS at most.
    """
    import numpy as np

    lines, columns = 10, 7
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    cell = (F.day("o_orderdate") % lines) * columns + (F.col("l_linenumber") - 1) % columns
    cells = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).groupBy("l_suppkey", cell.alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")  # a page's cells are small, its pixels aren't
    inked = cells.groupBy("l_suppkey").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    angle = F.element_at(F.array(*map(F.lit, angles)), (F.col("l_suppkey") % len(angles) + 1).cast("int"))
    rows = inked.select(F.format_string("page%d.png", "l_suppkey").alias("path"), angle.alias("angle"), "cells", (width * 3 // 40 + F.col("l_suppkey") % 5).alias("wide"), (height // 16 + F.col("l_suppkey") % 4).alias("high"))

    def draw(batches):
        import pyarrow as pa

        y, x = np.arange(height)[:, None] - height / 2, np.arange(width) - width / 2
        for batch in batches:
            for r in batch.to_pylist():
                ink = np.zeros(lines * columns)
                for c in r["cells"]:
                    ink[c["cell"]] = min(60, 4 * c["n"])
                t = np.deg2rad(r["angle"])
                u = np.cos(t) * x + np.sin(t) * y + width / 2
                v = -np.sin(t) * x + np.cos(t) * y + height / 2
                u, v = (u - width // 5) / r["wide"], (v - height // 8) / r["high"]
                column, line = np.floor(u), np.floor(v)
                inside = (column >= 0) & (column < columns) & (line >= 0) & (line < lines)
                u, v, right = u - column, v - line, (columns - u) * r["wide"] < 3
                text = inside & (v > 0.35) & (v < 0.65) & (u > 0.3) & (u < 0.7)
                rule = inside & ((u * r["wide"] < 3) | right)
                gray = np.full((height, width), 250, np.uint8)
                gray[text] = 235 - ink[(line[text] * columns + column[text]).astype(int)]
                gray[rule] = 20
                page = {"path": r["path"], "height": height, "width": width, "channels": 3, "content": np.repeat(gray[..., None], 3, 2).tobytes(), "angle": r["angle"]}
                yield pa.RecordBatch.from_pylist([page], schema=schema)  # a task holds one page

    names = "path string, height int, width int, channels int, content binary, angle int"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], names).schema)
    return rows.mapInArrow(draw, names)
