"""Quality rules: counts of a text, and the divergence of its character-class and common-word histograms from its
trusted text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, small, stored, text_or_empty

#: A language's words whose histogram is compared: those that most of its trusted documents have; the last bin holds all others.
COMMON_WORDS = 16
#: A language with fewer trusted documents has no common words, and its characters are compared with those of all its documents.
LEAST_TRUSTED = 20
#: Fewer words than these fail the base rules.
BASE_WORDS = 20
SYMBOLS = "[#*$%&|<>]"
SHINGLE = 8
CHAR_CLASSES = ("lower", "space", "upper", "digit", "punctuation", "other")
#: Largest distance from the language reference that is kept, and the least size at which it is judged.
MOST_CHAR_DISTANCE, LEAST_CHARS = 0.25, 200
MOST_WORD_DISTANCE, LEAST_WORDS = 0.28, 100


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def char_classes(text: str) -> dict[str, Column]:
    """Characters of each class, each count on what the classes before have left, so long runs go first."""
    rest, out = F.col(text), {}
    for name, pattern in zip(CHAR_CLASSES[:-1], (r"\p{Ll}+", SPACES, r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?'\"()\-]+"), strict=True):
        left = F.regexp_replace(rest, pattern, "")
        out[name] = F.length(rest) - F.length(left)
        rest = left
    return out | {"other": F.length(rest)}


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance, 0 to 1, of two histograms of equal length; 0 where either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    shares = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("x"), (y / total(q)).alias("y")))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    sums = F.aggregate(shares, F.lit(0.0), lambda s, r: s + part(r["x"], (r["x"] + r["y"]) / 2) + part(r["y"], (r["x"] + r["y"]) / 2))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(sums / 2, F.lit(0.0)))).otherwise(0.0)


def language(lang: Column) -> Column:
    """A key that isn't null: a null language is one of its own."""
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit(""))


def common_words(trusted: DataFrame, least: int) -> DataFrame:
    """(key, bins) of the languages with `least` rows (lang, text) of BASE_WORDS words or more: the COMMON_WORDS words, in
    lower case, that most of them have, ties in order of the words; fewer are filled up by empty ones, which no text has.

    A word counts once a text. The empty word, given to each text, counts the texts and is the first of its language.
    """
    texts = trusted.select(language(F.col("lang")).alias("key"), words_of(F.col("text")).alias("words")).where(F.size("words") >= BASE_WORDS)
    words = texts.select("key", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.transform("words", F.lower)))).alias("word"))
    found = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON_WORDS + 1)
    ranked = first.groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("words"))
    filled = F.slice(F.concat(F.array_remove("words.word", ""), F.array_repeat(F.lit(""), COMMON_WORDS)), 1, COMMON_WORDS)
    return ranked.where(F.col("n") >= least).select("key", filled.alias("bins"))


def counts(docs: DataFrame, bins: DataFrame) -> DataFrame:
    """The numbers of each of docs (id, lang, text), in one pass over it; bins are broadcast if their counted size allows."""
    a = docs.select("id", language(F.col("lang")).alias("key"), "text").join(small(bins, 64 * COMMON_WORDS), "key", "left")
    a = a.withColumn("words", words_of(F.col("text")))
    a = a.withColumns({
        "common": F.when(F.isnotnull("bins"), F.filter(F.transform("words", F.lower), lambda w: F.array_contains("bins", w))).otherwise(F.array().cast("array<string>")),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "hashes": F.transform("words", lambda w: F.xxhash64(w)),
    })
    # hashes are used twice here, which keeps the optimizer from computing them anew inside the lambda for each window
    a = a.withColumn("grams", F.when(F.size("hashes") >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size("hashes") - SHINGLE + 1), lambda i: F.xxhash64(F.slice("hashes", i, SHINGLE)))).otherwise(F.array().cast("array<long>")))
    # only texts with a repeated window go on to sort their windows
    a = a.withColumn("grams", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")).otherwise(F.array().cast("array<long>")))
    a = a.withColumn("sorted", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    alike = lambda x, i: F.coalesce(F.get("sorted", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["g"] == x["g"], F.lit(False))
    a = a.withColumn("at", F.sort_array(F.transform(F.filter("sorted", alike), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(SHINGLE), F.coalesce(F.get("at", k + 1) - p, F.lit(SHINGLE)))), F.lit(0), lambda s, x: s + x)
    held = F.transform("bins", lambda w: (F.size("common") - F.size(F.array_remove("common", w))).cast("double"))
    out = a.select(
        "id", "key", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.array(*(c.cast("double") for c in char_classes("text").values())).alias("classes"), F.coalesce(held, F.array().cast("array<double>")).alias("held"),
    )
    rest = F.col("n_words") - F.aggregate("held", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("held", F.when(F.size("held") > 0, F.concat("held", F.array(rest))).otherwise(F.col("held")))


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """One row a document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    char_distance, word_distance (Jensen-Shannon, from the language's reference).

    Trusted are the documents that `labels` (id_col, quality, toxic) gives quality 1 and toxic 0, whole and all of them; a
    reference is the summed histograms of those of a language that pass the base rules. A distance is judged only at
    LEAST_CHARS characters or LEAST_WORDS words or more. A language with fewer than least_trusted such documents, or no
    labels at all, takes the characters of all its documents that pass the base rules, and its words aren't judged (the
    distance is 0); a null language is one of its own. Null and empty texts have counts of 0 and fail the base rules;
    very long texts are worked on whole, as arrays of one row; repeated rows are repeated, rows of null id are judged and
    never trusted; an empty table gives an empty result; other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    if labels is None:
        labels = docs.select(id_col, F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("false")
    good = small(labels.where("quality = 1 AND toxic = 0").select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct(), 16)
    trusted = lambda table: table.where("id IS NOT NULL").join(good, "id", "left_semi")
    seen = stored(counts(rows, stored(common_words(trusted(rows), least_trusted), "bins")), "counts")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sums = lambda c, n: F.array(*(F.coalesce(F.sum(F.get(c, i)), F.lit(0.0)) for i in range(n)))
    classes, held = sums("classes", len(CHAR_CLASSES)), sums("held", COMMON_WORDS + 1)
    known = trusted(seen.where(~failed)).groupBy("key").agg(F.count("*").alias("n"), classes.alias("classes_known"), held.alias("held_ref"))
    reference = seen.where(~failed).groupBy("key").agg(classes.alias("classes_all")).join(known.where(F.col("n") >= least_trusted), "key", "left")
    reference = reference.select("key", F.coalesce("classes_known", "classes_all").alias("class_ref"), "held_ref")
    out = seen.join(small(stored(reference, "reference"), 400), "key", "left").withColumn("base_failed", failed)
    none = F.array().cast("array<double>")
    out = out.withColumns({
        "char_distance": F.when(F.col("n_chars") >= LEAST_CHARS, jensen_shannon(F.col("classes"), F.coalesce("class_ref", none))).otherwise(0.0),
        "word_distance": F.when((F.col("n_words") >= LEAST_WORDS) & (F.size("held") > 0), jensen_shannon(F.col("held"), F.coalesce("held_ref", none))).otherwise(0.0),
    })
    verdict = (F.col("char_distance") <= MOST_CHAR_DISTANCE) & (F.col("word_distance") <= MOST_WORD_DISTANCE)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "char_distance", "word_distance",
    )
