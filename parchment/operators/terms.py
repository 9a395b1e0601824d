"""Terms of a table found in texts: an index of q-grams instead of a literal for each term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import OTHER, category_text
from ..sources.shared import stored

Q = 3
#: Largest index, in estimated bytes, that is broadcast.
LIMIT = 64 << 20
#: Most q-grams of terms that are written into the plan.
LISTED = 1024


def grams(text: Column, sizes: list[int]) -> Column:
    """Hashes of the stretches of `sizes` characters of a text, repeats included; size 0 has the empty one.

    In UTF-32 a stretch is a slice of bytes, reached by its place, so a text costs in proportion to its length. They are
    numbers, as only arrays of these are told apart by a table: arrays of bytes are by comparing each with all others.
    Stretches of one hash only give more candidates, which are checked.
    """
    none = F.array().cast("array<bigint>")

    def over(points: Column, size: int) -> Column:
        if not size:
            return F.array(F.xxhash64(F.encode(F.lit(""), "UTF-32")))
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(points) - 4 * (size - 1), F.lit(1)), F.lit(4))
        every = F.transform(starts, lambda i: F.xxhash64(F.substring(points, i, F.lit(4 * size))))
        return F.when(F.octet_length(points) < 4 * size, none).otherwise(every)

    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), lambda points: F.concat(none, *(over(points, s) for s in sizes))), F.lit(0))


def own_grams(terms: DataFrame, sizes: list[int]) -> DataFrame:
    """(term, gram) of the different terms: the q-grams of each, or itself where it is shorter."""
    size, none = F.least(F.length("term"), F.lit(Q)), F.array().cast("array<bigint>")
    own = F.concat(*(F.when(size == s, F.array_distinct(grams(F.col("term"), [s]))).otherwise(none) for s in sizes))
    return terms.select("term").distinct().select("term", F.explode(own).alias("gram"))


def index(texts: DataFrame, terms: DataFrame, own: DataFrame) -> DataFrame:
    """terms with `gram`: of the term's q-grams, those of `own`, that which the fewest texts have. A term with a gram that no text has is
    left out. texts have an array `grams` of different ones.

    Grams of texts are counted only where a term has them, in partial sums.
    """
    counts = texts.select(F.explode("grams").alias("gram")).join(bounded(own.select("gram").distinct(), 64), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
    return terms.join(rarest.where("key.n > 0").select("term", "key.gram"), "term")


def bounded(rows: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() * row_bytes <= LIMIT else rows


def matches(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text and term that the text contains: id_col and the term's columns.

    terms has a column term; rows of one term, as in a list with a word twice, each count. A term is looked up by one q-gram,
    the rarest among the texts; texts that have it are checked for the whole term. A term shorter than a q-gram is looked
    up by itself, an empty one is in every text, a null one in none. A text is checked for a term once, however many rows
    the term has; the rows are joined to what was found. The index is broadcast if its counted rows fit the
    limit; else candidates (id, term) are joined by q-gram and texts are fetched by id, which must be unique then.
    """
    terms = stored(terms.where("term IS NOT NULL"), "terms")
    sizes = sorted(r[0] for r in terms.select(F.least(F.length("term"), F.lit(Q))).distinct().collect())  # Q + 1 at most
    if not sizes:
        return texts.select(id_col).join(terms, F.lit(False))
    different = terms.select("term").distinct()
    own = stored(own_grams(different, sizes), "grams")
    wanted = [r["gram"] for r in own.select("gram").distinct().limit(LISTED + 1).collect()]
    every, few = grams(F.col(text_col), sizes), len(wanted) <= LISTED
    rows = texts.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    if few:  # a text is cut once and what it has of the terms' grams is written beside it
        rows = stored(rows.withColumn("grams", F.array_intersect(every, F.array(*map(F.lit, wanted)).cast("array<bigint>"))), "texts")
    else:
        rows = stored(rows, "texts").withColumn("grams", F.array_distinct(every))
    keys = stored(index(rows, different, own), "index")
    cut = F.explode("grams").alias("gram")
    if keys.count() * 128 <= LIMIT:
        found = rows.select(id_col, text_col, cut).join(F.broadcast(keys), "gram")
    else:
        found = rows.select(id_col, cut).join(keys, "gram").join(rows.select(id_col, text_col), id_col)
    return found.where(F.contains(text_col, "term")).select(id_col, "term").join(bounded(terms, 128), "term").select(id_col, *terms.columns)


def scores(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, category, ord, score of each text and category of which a term is found: the sum of the terms' weights."""
    return matches(texts, terms, id_col, text_col).groupBy(id_col, "category", "ord").agg(F.sum("weight").alias("score"))


def with_category(rows: DataFrame, terms: DataFrame, id_col: str = "doc_id", vendor: str = "vendor", items: str = "line_items") -> DataFrame:
    """rows with `category`: the highest score, the lower ord of equals, OTHER without any; as categories.with_category, but
    by a table of terms (category, ord, term, weight) of any size. Ids are unique."""
    texts = rows.select(id_col, category_text(F.col(vendor), F.col(items)).alias("text"))
    top = scores(texts, terms, id_col).where("score > 0").groupBy(id_col).agg(F.max(F.struct("score", (-F.col("ord")).alias("place"), "category"))["category"].alias("category"))
    return rows.join(top, id_col, "left").withColumn("category", F.coalesce("category", F.lit(OTHER)))
