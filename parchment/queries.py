"""The engine's operators as queries over the tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import categories as C
from .functions import parsing as P
from .functions import text_repair as R
from .operators import evaluate, extract, images, paragraphs, repair, terms
from .plans import pipeline
from .sources import datasets, files, shared, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a file, in as many parts as shuffles have where the file gives fewer: long texts may be small on disk."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


# SQL of the shared parts ---------------------------------------------------------------------------------------------

E = f"e AS ({synthetic.elements_sql()})"
#: The doc_id of these is checked as text; ASCII only, where RE2 and Java agree.
WS = r"[\s\x{85}\x{a0}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Fixed values, written out here apart from the functions' own, so that a wrong one there shows.
DATE_WORDS = ("date", "dated", "invoice date", "bill date", "تاريخ", "بتاريخ", "التاريخ", "تاريخ الطباعة")
TOTAL_WORDS = ("total", "grand total", "net total", "amount due", "المجموع", "الإجمالي", "المبلغ", "الكلي", "المطلوب", "المبلغ المستحق", "الصافي")
DATE_PATTERNS = (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2}\b")
NO_TOTAL = "max() iterable argument is empty"
LIKE_WORDS = (
    "total", "subtotal", "vat", "tax", "item", "sales", "cash", "paid", "change", "receipt", "order", "date", "print", "server", "pepsi", "cola", "opened", "closed",
)
MISREAD = {"totهl": "total", "tothal": "total", "totاl": "total", "subt0tal": "subtotal", "sub-total": "subtotal", "٧at": "vat", "vاt": "vat"}


def any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(w)})" for w in words) + ")"


def amount_sql(text: str) -> str:
    return (
        rf"try_cast(replace(replace(nullif(regexp_extract(trim(regexp_replace(trim({text}), '[EGPegp$£€¥₹₪﷼]', '', 'g')), "
        rf"'\b\d{{1,3}}(?:[,\s]\d{{3}})*(?:[.,]\d{{2}})?\b'), ''), ' ', ''), ',', '') AS DOUBLE)"
    )


def date_sql(text: str) -> str:
    found = "coalesce(" + ", ".join(rf"nullif(regexp_extract({text}, '{p}'), '')" for p in DATE_PATTERNS) + ")"
    found = f"replace({found}, '/', '-')"
    tried = ", ".join(f"strftime(try_strptime({found}, '{f}'), '%Y-%m-%d')" for f in ("%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y"))
    return rf"""(CASE WHEN regexp_matches({found}, '^\d{{1,2}}-\d{{1,2}}-\d\d$') THEN coalesce(strftime(try_strptime({found}, '%d-%m-%y'), '%Y-%m-%d'),
      CASE WHEN regexp_matches({found}, '^\d\d-') THEN strftime(try_strptime({found}, '%y-%m-%d'), '%Y-%m-%d') END) ELSE coalesce({tried}) END)"""


def item_sql(text: str) -> str:
    return rf"(length(trim({text})) >= 3 AND NOT {any_sql(text, TOTAL_WORDS + DATE_WORDS)} AND NOT regexp_matches(trim({text}), '^[\d.,\s]+$') AND NOT regexp_matches(trim({text}), '(?i)^[EGP$£€]'))"


FIELDS = f"""parsed AS (
  SELECT *, {date_sql("text")} AS date, {amount_sql("text")} AS amount, {any_sql("text", DATE_WORDS)} AS dw, {any_sql("text", TOTAL_WORDS)} AS tw, {item_sql("text")} AS it FROM e
), near AS (
  SELECT *, lead(amount) OVER (PARTITION BY doc_id ORDER BY seq) AS next_amount FROM parsed
), kw_dates AS (
  SELECT a.doc_id, arg_min(b.date, a.seq * 10 + b.seq - a.seq + 1) AS date
  FROM parsed a JOIN parsed b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq - 1 AND a.seq + 3 WHERE a.dw AND b.date IS NOT NULL GROUP BY 1
), candidates AS (
  SELECT a.doc_id, max({{'conf': CASE WHEN contains(b.text, '.') THEN 1.0 ELSE 0.6 END, 'amount': b.amount}}) AS best
  FROM parsed a JOIN parsed b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq - 1 AND a.seq + 4 WHERE a.tw AND b.amount IS NOT NULL AND b.amount <> 0 GROUP BY 1
), fields AS (
  SELECT doc_id, arg_min(date, seq) FILTER (date IS NOT NULL) AS any_date, count(*) FILTER (amount IS NOT NULL AND amount <> 0) AS n_amounts,
    max(amount) FILTER (amount > 0.5 AND amount < 50000) AS largest, count(*) AS n_elements, avg(confidence) AS average_confidence, arg_min(text, seq) AS vendor,
    coalesce(list(trim(text) ORDER BY seq) FILTER (it AND next_amount IS NOT NULL AND next_amount <> 0), []) AS line_items
  FROM near GROUP BY 1
), extracted AS (
  SELECT f.doc_id, coalesce(k.date, any_date) AS date, coalesce(c.best.amount, largest) AS total, line_items, n_elements, average_confidence, vendor, any_date, k.date AS kw_date, c.best AS best, largest, n_amounts,
    CASE WHEN c.best IS NULL AND n_amounts > 0 AND largest IS NULL THEN '{NO_TOTAL}' END AS error
  FROM fields f LEFT JOIN kw_dates k USING (doc_id) LEFT JOIN candidates c USING (doc_id)
), terms AS (
  SELECT * FROM (VALUES {", ".join(f"({quoted(c)}, {o}, {quoted(t)}, {w})" for c, o, _, t, w in C.terms())}) t(category, ord, term, weight)
), scored AS (
  SELECT doc_id, category, ord, sum(CASE WHEN contains(lower(vendor || ' ' || array_to_string(line_items, ' ')), term) THEN weight ELSE 0 END)::BIGINT AS score
  FROM extracted CROSS JOIN terms GROUP BY ALL
), chosen AS (
  SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_max(category, score * 100 - ord) ELSE 'Other' END AS category FROM scored GROUP BY 1
)"""


def of(rows: str, elements: str = E) -> str:
    return f"WITH {elements}, {FIELDS} {rows}"


# Sources and fields --------------------------------------------------------------------------------------------------


@query
def synth_elements(spark, sf_dir):
    return synthetic.elements(spark, sf_dir)


SQL["synth_elements"] = f"WITH {E} SELECT * FROM e"


@query
def amount_parse(spark, sf_dir):
    return synthetic.elements(spark, sf_dir).select("doc_id", "seq", P.parse_amount(F.col("text")).alias("amount"))


SQL["amount_parse"] = f"WITH {E} SELECT doc_id, seq, {amount_sql('text')} AS amount FROM e"

DATE_FORMS = {"day_first": "dd-MM-yyyy", "year_first": "yyyy/MM/dd", "month_first": "MM/dd/yyyy", "short": "dd-MM-yy", "short_year_first": "yy-MM-dd"}


@query
def date_parse(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(P.parse_date(F.concat(F.lit("on "), F.date_format(day, f), F.lit(" at"))).alias(n) for n, f in DATE_FORMS.items()))


SQL["date_parse"] = "SELECT o_orderkey, " + ", ".join(
    date_sql("('on ' || strftime(o_orderdate, '" + f.replace("yyyy", "%Y").replace("yy", "%y").replace("MM", "%m").replace("dd", "%d") + "') || ' at')") + f" AS {n}" for n, f in DATE_FORMS.items()
) + " FROM orders"


@query
def date_keyword_window(spark, sf_dir):
    near = extract.with_neighbours(synthetic.elements(spark, sf_dir)).where("is_date_word AND near_date IS NOT NULL")
    return near.groupBy("doc_id").agg(F.min_by("near_date", "seq").alias("date"))


SQL["date_keyword_window"] = of("SELECT doc_id, date FROM kw_dates")


@query
def date_fallback(spark, sf_dir):
    first = F.min_by("date", F.when(F.col("date").isNotNull(), F.col("seq")))  # a filter would repeat the parsing in its condition
    return extract.parsed(synthetic.elements(spark, sf_dir)).groupBy("doc_id").agg(first.alias("date")).where("date IS NOT NULL")


SQL["date_fallback"] = of("SELECT doc_id, any_date AS date FROM fields WHERE any_date IS NOT NULL")


@query
def total_candidates_topk(spark, sf_dir):
    near = extract.with_neighbours(synthetic.elements(spark, sf_dir)).where("is_total_word AND near_total IS NOT NULL")
    return near.groupBy("doc_id").agg(F.max("near_total").alias("best")).select("doc_id", F.col("best.conf").alias("conf"), F.col("best.amount").alias("amount"))


SQL["total_candidates_topk"] = of("SELECT doc_id, best.conf::DOUBLE AS conf, best.amount AS amount FROM candidates")


@query
def total_fallback(spark, sf_dir):
    amount = F.col("amount")
    largest = F.max(F.when((amount > extract.LEAST) & (amount < extract.MOST), amount))  # a filter would parse each text for each bound
    return extract.parsed(synthetic.elements(spark, sf_dir)).groupBy("doc_id").agg(largest.alias("total")).where("total IS NOT NULL")


SQL["total_fallback"] = of("SELECT doc_id, largest AS total FROM fields WHERE largest IS NOT NULL")


@query
def total_fallback_error(spark, sf_dir):
    """Whole documents in which every price is beyond the range and no word tells the total: each fails but for those without a price."""
    number = P.parse_amount(F.col("text"))
    text = F.when(P.present(number), F.lit("99,000.00")).otherwise(F.regexp_replace("text", "(?i)total", "sum"))
    return extract.receipts(synthetic.elements(spark, sf_dir).withColumn("text", text)).where("NOT success").select("doc_id", "success", "error")


SQL["total_fallback_error"] = of(f"SELECT doc_id, false AS success, '{NO_TOTAL}' AS error FROM fields WHERE n_amounts > 0")


@query
def line_items(spark, sf_dir):
    return extract.extract(synthetic.elements(spark, sf_dir)).select("doc_id", F.size("line_items").cast("long").alias("n"), F.array_join("line_items", "|").alias("items"))


SQL["line_items"] = of("SELECT doc_id, len(line_items)::BIGINT AS n, array_to_string(line_items, '|') AS items FROM extracted")


@query
def vendor_first(spark, sf_dir):
    return extract.extract(synthetic.elements(spark, sf_dir)).select("doc_id", "vendor")


SQL["vendor_first"] = of("SELECT doc_id, vendor FROM fields")


def _long(spark, sf_dir):
    """The elements with those of all even orders as one document: half of all rows, places with gaps."""
    order = F.col("doc_id").cast("long")
    return synthetic.elements(spark, sf_dir).withColumns({"doc_id": F.when(order % 2 == 0, "long").otherwise(F.col("doc_id")), "seq": order * 4096 + F.col("seq")})


@query
def long_documents(spark, sf_dir):
    """Fields where one document holds half of all rows, which are dealt by range."""
    rows = extract.extract(_long(spark, sf_dir), long=True)
    return rows.select("doc_id", "date", "total", "error", "n_elements", "vendor", F.size("line_items").alias("n_items"), F.md5(F.array_join("line_items", "|").cast("binary")).alias("items"))


#: FIELDS with frames instead of joins, for a document that a join with itself would square.
FRAMED = FIELDS.replace(FIELDS[FIELDS.index("kw_dates AS (") : FIELDS.index("fields AS (")], """framed AS (
  SELECT *, list(date) FILTER (date IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS ds,
    max(CASE WHEN amount IS NOT NULL AND amount <> 0 THEN {'conf': CASE WHEN contains(text, '.') THEN 1.0 ELSE 0.6 END, 'amount': amount} END)
      OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 4 FOLLOWING) AS near_best
  FROM parsed
), kw_dates AS (
  SELECT doc_id, arg_min(ds[1], seq) AS date FROM framed WHERE dw AND len(ds) > 0 GROUP BY 1
), candidates AS (
  SELECT doc_id, max(near_best) AS best FROM framed WHERE tw AND near_best IS NOT NULL GROUP BY 1
), """)
SQL["long_documents"] = f"""WITH made AS ({synthetic.elements_sql()}), e AS (
  SELECT CASE WHEN doc_id::BIGINT % 2 = 0 THEN 'long' ELSE doc_id END AS doc_id, doc_id::BIGINT * 4096 + seq AS seq, text, confidence FROM made
), {FRAMED} SELECT doc_id, date, total, error, n_elements, vendor, len(line_items)::INT AS n_items, md5(array_to_string(line_items, '|')) AS items FROM extracted"""


# Categories ----------------------------------------------------------------------------------------------------------


def _receipt_texts(spark, sf_dir):
    return _category_text(spark, sf_dir).withColumnRenamed("t", "text")


@query
def category_terms(spark, sf_dir):
    """Each term of the categories, and how many receipts have it."""
    known = C.term_table(spark)
    used = terms.matches(_receipt_texts(spark, sf_dir), known.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_receipts"))
    return known.join(used, "term", "left").select("category", "ord", "term", "weight", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"))


SQL["category_terms"] = of("""SELECT category, ord::INT AS ord, term, weight::INT AS weight, (SELECT count(*) FROM extracted WHERE contains(lower(vendor || ' ' || array_to_string(line_items, ' ')), term)) AS n_receipts
FROM terms""")


def _category_text(spark, sf_dir):
    return extract.extract(synthetic.elements(spark, sf_dir)).select("doc_id", C.category_text(F.col("vendor"), F.col("line_items")).alias("t"))


@query
def category_score(spark, sf_dir):
    rows = _category_text(spark, sf_dir).select("doc_id", F.explode(C.scores(F.col("t"))).alias("s"))
    return rows.select("doc_id", F.col("s.category").alias("category"), F.col("s.score").cast("long").alias("score"))


SQL["category_score"] = of("SELECT doc_id, category, score FROM scored")


@query
def category_argmax(spark, sf_dir):
    return C.with_category(extract.extract(synthetic.elements(spark, sf_dir))).select("doc_id", "category")


SQL["category_argmax"] = of("SELECT doc_id, category FROM chosen")

TIES = ("metro", "gas", "phone", "mobile", "chicken", "nothing", "sweet", "cinema", "uber", "gas bill", "موبايل")


@query
def category_tiebreak(spark, sf_dir):
    """Vendors whose scores tie, one for each order by its key."""
    vendor = F.element_at(F.array(*map(F.lit, TIES)), (F.col("o_orderkey") % len(TIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", vendor.alias("vendor"), F.array().cast("array<string>").alias("line_items"))
    return C.with_category(rows).select("o_orderkey", "vendor", "category")


SQL["category_tiebreak"] = of(f"""SELECT o_orderkey, vendor, category FROM (SELECT o_orderkey, list_extract([{", ".join(map(quoted, TIES))}], (o_orderkey % {len(TIES)} + 1)::INT) AS vendor FROM orders)
JOIN (SELECT vendor, CASE WHEN max(s) > 0 THEN arg_max(category, s * 100 - ord) ELSE 'Other' END AS category FROM (
  SELECT vendor, category, ord, sum(CASE WHEN contains(vendor || ' ', term) THEN weight ELSE 0 END) AS s
  FROM (VALUES {", ".join(f"({quoted(t)})" for t in TIES)}) v(vendor) CROSS JOIN terms GROUP BY ALL) GROUP BY vendor) USING (vendor)""")


@query
def category_by_table(spark, sf_dir):
    """Categories by the index of a table of terms: as by the literal plan."""
    return terms.with_category(extract.extract(synthetic.elements(spark, sf_dir)), C.term_table(spark)).select("doc_id", "category")


SQL["category_by_table"] = SQL["category_argmax"]


@query
def category_user_terms(spark, sf_dir):
    """A dictionary made of the parts' names, their words and beginnings of words, scored in the documents' whole texts."""
    word = F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("word")
    size = F.explode(F.array(*map(F.lit, PREFIXES))).alias("size")
    parts = table(spark, sf_dir, "part").select("p_type", word).select("p_type", "word", size).select(F.col("p_type").alias("category"), F.expr("left(word, size)").alias("term"))
    known = parts.groupBy("category", "term").agg(F.count("*").alias("weight")).withColumn("ord", F.length("category"))
    texts = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("text"))
    return terms.scores(texts, known).select("doc_id", "category", "score")


PREFIXES = (2, 3, 5, 30)
SQL["category_user_terms"] = f"""WITH t AS (
  SELECT category, term, count(*) AS weight FROM (SELECT p_type AS category, left(word, size) AS term FROM (
    SELECT p_type, unnest(list_concat([p_name], string_split(p_name, ' '))) AS word FROM part) CROSS JOIN (VALUES {", ".join(f"({k})" for k in PREFIXES)}) s(size)) GROUP BY ALL
) SELECT doc_id, category, sum(weight)::BIGINT AS score FROM documents JOIN t ON contains(lower(text), term) GROUP BY ALL"""


# Whole plans ---------------------------------------------------------------------------------------------------------


@query
def receipts(spark, sf_dir):
    return extract.receipts(synthetic.elements(spark, sf_dir))


RECEIPT_FIELDS = """doc_id, error IS NULL AS success, CASE WHEN error IS NULL THEN date END AS date, CASE WHEN error IS NULL THEN total END AS total,
  CASE WHEN error IS NULL THEN category END AS category, error"""
SQL["receipts"] = of(f"SELECT {RECEIPT_FIELDS} FROM extracted JOIN chosen USING (doc_id)")


@query
def receipts_repaired(spark, sf_dir):
    """With repair."""
    return pipeline.process(synthetic.elements(spark, sf_dir))


@query
def receipts_detailed(spark, sf_dir):
    rows = pipeline.process_with_details(synthetic.elements(spark, sf_dir), fix=False)
    return rows.select("doc_id", "date", "total", "category", "error", "debug_info.ocr_elements_found", F.col("debug_info.line_items_detected"), F.col("debug_info.vendor_name"), F.array_join("debug_info.line_items", "|").alias("first_items"), "debug_info.average_confidence")


SQL["receipts_detailed"] = of("""SELECT doc_id, error, COLUMNS(* EXCLUDE (doc_id, error)) FROM (SELECT doc_id, error, CASE WHEN error IS NULL THEN date END AS date, CASE WHEN error IS NULL THEN total END AS total,
  CASE WHEN error IS NULL THEN category END AS category, CASE WHEN error IS NULL THEN n_elements::INT END AS ocr_elements_found, CASE WHEN error IS NULL THEN len(line_items)::INT END AS line_items_detected,
  CASE WHEN error IS NULL THEN vendor END AS vendor_name, CASE WHEN error IS NULL THEN array_to_string(line_items[1:5], '|') END AS first_items,
  CASE WHEN error IS NULL THEN round_even(average_confidence, 2) END AS average_confidence FROM extracted JOIN chosen USING (doc_id))""")


@query
def batch_status(spark, sf_dir):
    return pipeline.batch_rows(synthetic.elements(spark, sf_dir), fix=False)


SQL["batch_status"] = of(f"SELECT {RECEIPT_FIELDS.replace('doc_id', 'doc_id AS file', 1)} FROM extracted JOIN chosen USING (doc_id)")


@query
def batch_summary(spark, sf_dir):
    return extract.batch_summary(extract.receipts(synthetic.elements(spark, sf_dir)))


SQL["batch_summary"] = of("SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NOT NULL) AS failed FROM extracted")


@query
def epoch_ms(spark, sf_dir):
    return extract.with_epoch(extract.receipts(synthetic.elements(spark, sf_dir))).select("doc_id", "date_epoch_ms")


SQL["epoch_ms"] = of("SELECT doc_id, CASE WHEN error IS NULL THEN epoch_ms(strptime(date, '%Y-%m-%d')) END AS date_epoch_ms FROM extracted")


@query
def text_join(spark, sf_dir):
    return extract.text_only(synthetic.elements(spark, sf_dir))


SQL["text_join"] = f"WITH {E} SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM e GROUP BY 1"


@query
def response_json(spark, sf_dir):
    return pipeline.responses(synthetic.elements(spark, sf_dir), fix=False)


SQL["response_json"] = of("""SELECT doc_id, CASE WHEN error IS NULL THEN 200 ELSE 500 END::INT AS status, CASE WHEN error IS NULL THEN '{"success":true,"data":{' ||
  concat_ws(',', '"date":"' || date || '"', '"total":' || total::VARCHAR, '"category":"' || category || '"', '"date_epoch_ms":' || epoch_ms(strptime(date, '%Y-%m-%d'))::VARCHAR) || '},"filename":"' || doc_id || '"}'
  ELSE '{"success":false,"filename":"' || doc_id || '","error":"' || error || '"}' END AS json FROM extracted JOIN chosen USING (doc_id)""")


@query
def response_detailed(spark, sf_dir):
    rows = pipeline.responses_detailed(synthetic.elements(spark, sf_dir), fix=False)
    return rows.select("doc_id", "status", F.get_json_object("json", "$.data.debug_info.vendor_name").alias("vendor"), F.get_json_object("json", "$.data.debug_info.ocr_elements_found").cast("int").alias("found"), F.get_json_object("json", "$.error").alias("error"))


SQL["response_detailed"] = of("""SELECT doc_id, CASE WHEN error IS NULL THEN 200 ELSE 500 END::INT AS status, CASE WHEN error IS NULL THEN vendor END AS vendor,
  CASE WHEN error IS NULL THEN n_elements END::INT AS found, error FROM extracted""")


@query
def file_ext_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))).alias("name")).withColumn("ok", P.is_image_name(F.col("name")))


EXTENSIONS = (".jpg", ".JPEG", ".png", ".gif", ".jpg.txt", "", ".tar.PNG", ".jpgx")
SQL["file_ext_filter"] = f"""SELECT doc_id, name, coalesce(lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png'), false) AS ok
FROM (SELECT doc_id, source || list_extract([{", ".join(map(quoted, EXTENSIONS))}], (doc_id % {len(EXTENSIONS)} + 1)::INT) AS name FROM documents)"""


@query
def result_files(spark, sf_dir):
    """A file a receipt, written by the sink and read back; a third of the documents have names whose stems clash."""
    order = F.col("doc_id").cast("long")
    named = extract.receipts(synthetic.elements(spark, sf_dir)).withColumn("doc_id", F.concat(F.when(order % 3 == 0, (order - order % 2).cast("string")).otherwise(F.col("doc_id")), F.when(order % 2 == 0, ".png").otherwise(".jpg")))
    at = shared.path(spark, "results")
    datasets.write_results(named, at)
    kind = "doc_id string, success boolean, date string, total double, category string, error string"
    return datasets.read_results(spark, at).select("name", F.from_json("value", kind).alias("r")).select("name", "r.*")


NAMED = """SELECT CASE WHEN doc_id::BIGINT % 3 = 0 THEN (doc_id::BIGINT - doc_id::BIGINT % 2)::VARCHAR ELSE doc_id END || CASE WHEN doc_id::BIGINT % 2 = 0 THEN '.png' ELSE '.jpg' END AS doc_id,
  COLUMNS(* EXCLUDE (doc_id)) FROM (SELECT """ + RECEIPT_FIELDS + " FROM extracted JOIN chosen USING (doc_id))"
SQL["result_files"] = of(f"""SELECT regexp_extract(doc_id, '^(.*)\\.', 1) || CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY regexp_extract(doc_id, '^(.*)\\.', 1)) THEN '' ELSE '_' || sha256(doc_id)[1:16] END || '_result.json' AS name, *
FROM ({NAMED})""")


@query
def json_array(spark, sf_dir):
    """All receipts as one JSON array, read back as lines: an object each, with a comma but for the last."""
    at = shared.path(spark, "array")
    files.write_json_array(extract.receipts(synthetic.elements(spark, sf_dir)), at, ["doc_id"])
    lines = spark.read.text(at).where("value NOT IN ('[', ']')")
    kind = "doc_id string, success boolean, date string, total double, category string, error string"
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), kind).alias("r"), F.endswith("value", F.lit(",")).alias("comma")).select("r.*", "comma")


SQL["json_array"] = of(f"SELECT {RECEIPT_FIELDS}, doc_id <> max(doc_id) OVER () AS comma FROM extracted JOIN chosen USING (doc_id)")


# Repair --------------------------------------------------------------------------------------------------------------

#: Deterministic damage, by doc_id, to the lines of the documents and to fixed cases: ASCII but for Arabic letters.
CASES = (
    "27-09-202&", "Totهl", "٧AT", "٤G؟)", "ILEI", "(22.75", "Receipt dac27- TW:2022-1=222-_", "Grand Total", "EGP 22.75", "(Large)", "Mate", "EEP 22", "E6P 5", "[5 x", "[6P 10", "egp 3",
    "12-11-202o", "02-03-202-", "1O1O1", "5S", "B8", "O5", "12l", "1OO1", "Sheep", "Case", "Printer", "Totals", "sub-total", "SUBT0TAL", "ILEII", "", "a", "Server", "Pepsl", "0P 7", "E0P", "EG9",
)
REPAIR_INPUT = f"SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(c)})' for i, c in enumerate(CASES))}) v(id, text)"


def _cases(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id int, text string")


def _turns(spark, sf_dir):
    """The conversations' turns, whole, and the fixed cases: as in TURNS."""
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("id"), "text")
    return _cases(spark).unionByName(talk)


TURNS = f"w AS ({REPAIR_INPUT} UNION ALL SELECT (conv_id * 1000 + turn)::INT, text FROM conversations)"
ASCII_DIGITS = "'٠١٢٣٤٥٦٧٨٩', '0123456789'"
LATIN = r"length(regexp_replace(text, '[^\x{0}-\x{5FF}]', '', 'g'))"
ARABIC = r"length(regexp_replace(text, '[^\x{600}-\x{6FF}]', '', 'g'))"
#: What Unicode counts as white space; RE2's \s is ASCII.
ANY_SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _numbers_sql(text: str) -> str:
    for letters, digit in (("[Oo]", "0"), ("[lI]", "1"), ("S", "5"), ("B", "8")):
        for _ in range(2):
            text = rf"regexp_replace({text}, '(\d){letters}(\d)', '\1{digit}\2', 'g')"
        text = rf"regexp_replace(regexp_replace({text}, '^{letters}(\d)', '{digit}\1'), '(\d){letters}$', '\1{digit}')"
    return text


def _cased(word: str) -> str:
    return f"CASE WHEN text = upper(text) AND text <> lower(text) THEN '{word.upper()}' WHEN left(text, 1) = upper(left(text, 1)) AND left(text, 1) <> lower(left(text, 1)) THEN '{word.capitalize()}' ELSE '{word}' END"


def _similar(word: str) -> str:
    same = " + ".join(f"(substring(lower(text), {i + 1}, 1) = '{c}')::INT" for i, c in enumerate(word))
    return f"(text <> '' AND ({same}) / greatest(length(text), {len(word)})::DOUBLE >= 0.7)"


def _digits(text: str) -> str:
    return f"translate({text}, {ASCII_DIGITS})"


#: Each step as expressions of `text` that are done one after the other.
STEP_SQL = {
    "cleaned": [rf"trim(regexp_replace(regexp_replace(text, '[\x{{200B}}\x{{200C}}\x{{200D}}]', '', 'g'), '{ANY_SPACE}', ' ', 'g'))"],
    "script": [rf"""CASE WHEN regexp_matches(text, '[0-9٠-٩]+[.,][0-9٠-٩]+') THEN translate(text, '٧٤؟G', 'VE)E')
      WHEN regexp_matches(text, '[0-9]') OR text = '' OR {LATIN} > length(text) / 2.0 THEN translate(text, 'ه٧٤لا؟G', 'aVElI)E')
      WHEN {ARABIC} > length(text) / 2.0 THEN translate(text, 'aIVE', 'اا٧٤') ELSE text END"""],
    "dates": [r"regexp_replace(regexp_replace(regexp_replace(text, '202[&\-_=]', '2022', 'g'), '(\d{2})[-–—](\d{2})[-–—](\d{4})', '\1-\2-\3', 'g'), '(\d{2}-\d{2}-202)o', '\10', 'g')"],
    "numbers": [rf"""CASE WHEN regexp_matches(text, '^[٤E٥٦٧٨٩][A-Za-zا-ي؟\)]{{1,3}}$') THEN text WHEN regexp_matches({_digits("text")}, '\d') THEN {_numbers_sql(_digits("text"))} ELSE {_digits("text")} END"""],
    "currency": [
        rf"""CASE WHEN upper(text) = 'EGP' OR starts_with(upper(text), 'EGP ') THEN chr(1) || text
      ELSE {_digits(r"regexp_replace(text, '(?i)(?:[٤E][0O6oGgق\[]?[Pp؟)]+|E+P|\b[0O6][Pp]|\[[0O6]?[Pp])(\s|$|\d)', 'EGP\1', 'g')")} END""",
        r"""CASE WHEN starts_with(text, chr(1)) THEN text[2:] ELSE regexp_replace(
      CASE WHEN upper(text) = 'EGP' THEN text ELSE regexp_replace(text, '(?i)\b(?:EGE|EGت|EG؟|EGف|EEP|E6P|E0P|EOP|\[6P|\[0P)\b', 'EGP', 'g') END, '\[(\d)', 'EGP \1', 'g') END""",
    ],
    "words": [
        f"CASE {' '.join(f'WHEN {_similar(w)} THEN {_cased(w)}' for w in LIKE_WORDS)} ELSE text END",
        f"CASE WHEN text IN ('ILEI', 'ILEII') THEN 'Q' {' '.join(f'WHEN lower(text) = {quoted(a)} THEN {_cased(b)}' for a, b in MISREAD.items())} ELSE text END",
    ],
}


def repair_sql(source: str, out: str, steps: tuple[str, ...] = R.STEPS) -> str:
    """CTEs that do the steps on the column text of the table `source`, the last of them named `out`."""
    done = [x for s in steps for x in STEP_SQL[s]]
    names = [source, *(f"{out}_{i}" for i in range(len(done) - 1)), out]
    return ", ".join(f"{b} AS MATERIALIZED (SELECT * REPLACE ({x} AS text) FROM {a})" for a, b, x in zip(names, names[1:], done, strict=False))


@query
def clean_ws(spark, sf_dir):
    text = F.concat(F.lit("  "), F.translate("text", " ", "\t"), F.lit("​ \n x "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.clean_text(text, normalize=False).alias("text"))


SQL["clean_ws"] = r"SELECT conv_id, turn, trim(regexp_replace('  ' || replace(text, ' ', chr(9)) || ' ' || chr(10) || ' x ', '\s+', ' ', 'g')) AS text FROM conversations"

#: Texts and what NFKC and the cleaning make of them.
NORMAL_FORMS = {"ﷲ": "الله", "²": "2", "ＡＢＣ１": "ABC1", "﷼ 5": "ریال 5", "é": "é", "plain": "plain", "": ""}


@query
def nfkc(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(NORMAL_FORMS)), "doc_id long, text string")
    both = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(rows)
    return both.select("doc_id", R.clean_text(F.col("text")).alias("text"))


SQL["nfkc"] = f"""SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, {quoted(x)})" for i, x in enumerate(NORMAL_FORMS.values()))}) v(doc_id, text)
UNION ALL SELECT doc_id, {STEP_SQL["cleaned"][0]} FROM documents"""


def _step(name, *steps):
    def run(spark, sf_dir):
        return R.repaired(_turns(spark, sf_dir), "text", steps=steps)

    run.__name__ = name
    SQL[name] = f"WITH {TURNS}, {repair_sql('w', 'r', steps)} SELECT id, text FROM r"
    return query(run)


_step("mixed_script", "script")
_step("fix_dates", "dates")
_step("fix_numbers", "numbers")
_step("fix_currency", "currency")
_step("common_words", "words")


@query
def fuzzy_match(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", *(R.fuzzy_match(F.lower("text"), w).alias(f"like_{w}") for w in ("total", "subtotal", "date", "server")))


SQL["fuzzy_match"] = f"WITH {TURNS} SELECT id, " + ", ".join(f"{_similar(w)} AS like_{w}" for w in ("total", "subtotal", "date", "server")) + " FROM w"


@query
def script_ratio(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", R.mostly_latin(F.col("text")).alias("latin"), R.mostly_arabic(F.col("text")).alias("arabic"))


SQL["script_ratio"] = f"WITH {TURNS} SELECT id, text = '' OR {LATIN} > length(text) / 2.0 AS latin, text <> '' AND {ARABIC} > length(text) / 2.0 AS arabic FROM w"


@query
def repair_all(spark, sf_dir):
    return repair.repair(_turns(spark, sf_dir))


SQL["repair_all"] = f"WITH {TURNS}, t AS (SELECT id, text, text AS original_text FROM w), {repair_sql('t', 'r')} SELECT * FROM r"
SQL["receipts_repaired"] = of(f"SELECT {RECEIPT_FIELDS} FROM extracted JOIN chosen USING (doc_id)", f"made AS ({synthetic.elements_sql()}), {repair_sql('made', 'e')}")


# Images and evaluation -----------------------------------------------------------------------------------------------


@query
def bbox_geometry(spark, sf_dir):
    p = lambda x, y: F.array((F.col("l_partkey") % 97 + x).cast("double"), (F.col("l_suppkey") % 89 + y).cast("double") / 2)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.array(p(0, 0), p(31, 1), p(32, 18), p(1, 17)).alias("bbox"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return extract.with_geometry(rows).select("l_orderkey", "l_partkey", "l_suppkey", "center.x", "center.y", F.col("normalized_center.x").alias("nx"), F.col("normalized_center.y").alias("ny"))


SQL["bbox_geometry"] = """SELECT l_orderkey, l_partkey, l_suppkey, x, y, x / 640.0::DOUBLE AS nx, y / 480.0::DOUBLE AS ny FROM (
SELECT *, trunc((4 * (l_partkey % 97) + 64) / 4.0::DOUBLE)::INT AS x, trunc((4 * (l_suppkey % 89) + 36) / 8.0::DOUBLE)::INT AS y FROM lineitem)"""


@query
def bbox_paragraphs(spark, sf_dir):
    """An order's lines as boxes: paragraphs, each told by its first element, the number of its boxes and their bounds."""
    x, y = (F.col("l_partkey") * 7 % 197).cast("double"), (F.col("l_suppkey") * 3 % 89).cast("double")
    high, wide = (F.col("l_linenumber") % 3 + 8).cast("double"), (F.col("l_partkey") % 30 + 10).cast("double")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")) - 1
    box = F.array(F.array(x, y), F.array(x + wide, y), F.array(x + wide, y + high), F.array(x, y + high))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), seq.alias("seq"), F.col("l_returnflag").alias("text"), F.lit(0.5).alias("confidence"), box.alias("bbox"))
    found = paragraphs.paragraphs(rows)
    at = lambda i, j: F.col("bbox")[i][j]
    return found.select("doc_id", "seq", "n_boxes", at(0, 0).alias("left"), at(0, 1).alias("top"), at(2, 0).alias("right"), at(2, 1).alias("bottom"))


SQL["bbox_paragraphs"] = """WITH RECURSIVE b AS MATERIALIZED (
  SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS i,
    (l_partkey * 7 % 197)::DOUBLE AS x1, (l_suppkey * 3 % 89)::DOUBLE AS y1, (l_partkey * 7 % 197 + l_partkey % 30 + 10)::DOUBLE AS x2, (l_suppkey * 3 % 89 + l_linenumber % 3 + 8)::DOUBLE AS y2
  FROM lineitem
), near AS MATERIALIZED (
  SELECT a.d, a.i, b.i AS j FROM b a JOIN b ON a.d = b.d
  WHERE greatest(a.x1, b.x1) - least(a.x2, b.x2) <= (a.y2 - a.y1 + b.y2 - b.y1) / 2 AND greatest(a.y1, b.y1) - least(a.y2, b.y2) <= 0.5::DOUBLE * (a.y2 - a.y1 + b.y2 - b.y1) / 2
), reach AS (
  SELECT d, i, i AS j FROM b UNION SELECT r.d, r.i, n.j FROM reach r JOIN near n ON n.d = r.d AND n.i = r.j
), least_of AS (SELECT d, i, min(j) AS p FROM reach GROUP BY d, i)
SELECT d::VARCHAR AS doc_id, p::INT AS seq, count(*)::INT AS n_boxes, min(x1) AS left, min(y1) AS top, max(x2) AS right, max(y2) AS bottom FROM least_of JOIN b USING (d, i) GROUP BY d, p"""


@query
def round_binary(spark, sf_dir):
    """Prices over 8, over 200 and over 3 at two places: halves that are exact, and those that only look so."""
    price = F.col("l_extendedprice")
    parts = {"eighths": F.floor(price) / 8.0, "thousandths": F.floor(price) / 1000.0, "thirds": price / 3.0}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(v.alias(k) for k, v in parts.items()))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(P.round2(F.col(k)).alias(k) for k in parts))


def _round_sql(x: str) -> str:
    """By whole numbers: x is below 2^17, so x * 2^70 is a whole number unless x is tiny; its hundredfold is halved exactly."""
    n, half = f"(({x}) * 1180591620717411303424)::HUGEINT * 100", "590295810358705651712"
    q, r = f"(({n}) // 1180591620717411303424)", f"(({n}) % 1180591620717411303424)"
    return f"({q} + CASE WHEN {r} > {half} OR ({r} = {half} AND {q} % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE"


SQL["round_binary"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_round_sql("eighths")} AS eighths, {_round_sql("thousandths")} AS thousandths, {_round_sql("thirds")} AS thirds
FROM (SELECT *, floor(l_extendedprice) / 8.0::DOUBLE AS eighths, floor(l_extendedprice) / 1000.0::DOUBLE AS thousandths, l_extendedprice / 3.0::DOUBLE AS thirds FROM lineitem)"""


@query
def image_skew(spark, sf_dir):
    """Each supplier's page, turned by a known angle: the angle found is that within a degree."""
    found = images.measured(synthetic.pages(spark, sf_dir), {"skew": images.skew_angle}, keep=("angle",))
    return found.select("path", "angle", (F.abs(F.col("skew") + F.col("angle")) <= 1).alias("within_a_degree"))


PAGE_ANGLE = f"list_extract([{', '.join(map(str, synthetic.ANGLES))}], (s % {len(synthetic.ANGLES)} + 1)::INT)"
PAGE_SUPPLIERS = "SELECT DISTINCT l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SQL["image_skew"] = f"SELECT 'page' || s || '.png' AS path, {PAGE_ANGLE}::INT AS angle, true AS within_a_degree FROM ({PAGE_SUPPLIERS})"


@query
def image_deskew(spark, sf_dir):
    """The same pages turned back: no skew is left, and the size stays."""
    rows = images.apply(synthetic.pages(spark, sf_dir), lambda page: images.deskew(page, straighten=True))
    left = images.measured(rows, {"skew": images.skew_angle, "height": lambda page: page.shape[0], "width": lambda page: page.shape[1]})
    return left.select("path", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), (F.abs("skew") <= 2).alias("straight"))


SQL["image_deskew"] = f"SELECT 'page' || s || '.png' AS path, 240 AS height, 320 AS width, true AS straight FROM ({PAGE_SUPPLIERS})"


@query
def image_preprocess(spark, sf_dir):
    """Small pages through the service's preprocessing, and straight pages cropped to their table and a padding."""
    small = images.apply(synthetic.pages(spark, sf_dir, 12, 150), images.preprocess_receipt_conservative)
    crop = images.apply(synthetic.pages(spark, sf_dir, angles=(0,)), images.remove_borders)
    crop = crop.select("path", F.col("height").alias("crop_height"), F.col("width").alias("crop_width"))
    return small.join(crop, "path").select("path", "height", "width", "channels", "crop_height", "crop_width")


SQL["image_preprocess"] = f"""SELECT 'page' || s || '.png' AS path, 80 AS height, 1000 AS width, 1 AS channels, (10 * (15 + s % 4) + 4)::INT AS crop_height, (7 * (24 + s % 5) + 4)::INT AS crop_width
FROM ({PAGE_SUPPLIERS})"""


def _pairs(spark, sf_dir):
    """Part names as ground truth; one engine confuses letters, the other loses spaces and sometimes fails."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("p_partkey") % 3 + 1).cast("int"))
    base = table(spark, sf_dir, "part").select(split.alias("split"), F.col("p_partkey").cast("string").alias("stem"), F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_partkey")
    truth = base.select("split", "stem", F.when(F.col("p_partkey") % 11 > 0, F.col("text")).alias("ground_truth"))
    a = base.select("split", "stem", F.lit("easyocr").alias("engine"), F.translate("text", "el", "c1").alias("text"), F.lit(None).cast("string").alias("error"))
    failed = F.col("p_partkey") % 7 == 0
    b = base.select("split", "stem", F.lit("pytesseract").alias("engine"), F.when(~failed, F.regexp_replace("text", "[ a]", "")).alias("text"), F.when(failed, "Failed to read image").alias("error"))
    return truth, a.unionByName(b)


@query
def gt_join(spark, sf_dir):
    rows = evaluate.compare(*_pairs(spark, sf_dir), ratio=evaluate.edit_ratio)
    return rows.select("image", "split", "ground_truth", F.col("easyocr.cer").alias("cer_a"), F.col("pytesseract.cer").alias("cer_b"), F.col("pytesseract.text").alias("text_b"), F.col("pytesseract.error").alias("error_b"), "better")


COMPARED = """base AS (
  SELECT list_extract(['train', 'val', 'test'], (p_partkey % 3 + 1)::INT) AS split, p_partkey::VARCHAR AS image, p_name || ' ' || p_type AS t, p_partkey FROM part
), r AS (
  SELECT split, image, t, lower(t) AS gt, lower(translate(t, 'el', 'c1')) AS a, lower(regexp_replace(t, '[ a]', '', 'g')) AS b, regexp_replace(t, '[ a]', '', 'g') AS raw_b, p_partkey % 7 = 0 AS failed FROM base WHERE p_partkey % 11 > 0
), c AS (
  SELECT *, 1 - (1 - levenshtein(gt, a) / greatest(length(gt), length(a))::DOUBLE) AS cer_a, CASE WHEN failed THEN 1.0::DOUBLE ELSE 1 - (1 - levenshtein(gt, b) / greatest(length(gt), length(b))::DOUBLE) END AS cer_b FROM r
)"""
SQL["gt_join"] = f"""WITH {COMPARED} SELECT image, split, t[1:100] AS ground_truth, cer_a, cer_b, CASE WHEN failed THEN 'ERROR' ELSE raw_b[1:100] END AS text_b,
CASE WHEN failed THEN 'Failed to read image' END AS error_b, CASE WHEN cer_a < cer_b THEN 'easyocr' ELSE 'pytesseract' END AS better FROM c"""


@query
def cer_stats(spark, sf_dir):
    out = evaluate.summary(evaluate.compare(*_pairs(spark, sf_dir), ratio=evaluate.edit_ratio))
    return out.select("engine", "n", *(F.round(c, 9).alias(c) for c in ("mean_cer", "median_cer", "std_cer", "min_cer", "max_cer", "mean_accuracy")))


SQL["cer_stats"] = f"""WITH {COMPARED}, l AS (SELECT 'easyocr' AS engine, cer_a AS cer FROM c UNION ALL SELECT 'pytesseract', cer_b FROM c)
SELECT engine, count(*) AS n, round(avg(cer), 9) AS mean_cer, round(median(cer), 9) AS median_cer, round(stddev_pop(cer), 9) AS std_cer, round(min(cer), 9) AS min_cer, round(max(cer), 9) AS max_cer, round((1 - avg(cer)) * 100, 9) AS mean_accuracy FROM l GROUP BY 1"""


@query
def cer_winner(spark, sf_dir):
    out = evaluate.winner(evaluate.compare(*_pairs(spark, sf_dir), ratio=evaluate.edit_ratio))
    return out.select("total_images", *(F.round(f"{e}_mean_cer", 9).alias(f"{e}_mean_cer") for e in evaluate.ENGINES), "winner")


SQL["cer_winner"] = f"""WITH {COMPARED} SELECT count(*) AS total_images, round(avg(cer_a), 9) AS easyocr_mean_cer, round(avg(cer_b), 9) AS pytesseract_mean_cer,
CASE WHEN avg(cer_a) < avg(cer_b) THEN 'easyocr' ELSE 'pytesseract' END AS winner FROM c"""


@query
def sm_cer(spark, sf_dir):
    return evaluate.compare(*_pairs(spark, sf_dir)).select("image", "split", F.col("easyocr.cer").alias("cer_a"), F.col("pytesseract.cer").alias("cer_b"), "better")


@query
def split_union(spark, sf_dir):
    truth, _ = _pairs(spark, sf_dir)
    one = lambda s: truth.where(F.col("split") == s)
    return one("train").unionByName(one("val")).unionByName(one("test")).where("ground_truth IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"))


SQL["split_union"] = f"WITH {COMPARED} SELECT split, count(*) AS n FROM c GROUP BY 1"
