"""Spending categories: fixed terms, scores and the best category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories in order of precedence, each with its keywords (weight 1) and brands (weight 3).
# A term that is listed twice counts twice.
CATEGORIES = {
    "Food & Groceries": (
        (
            "carrefour", "spinneys", "metro", "kheir zaman", "oscar", "سبينس", "كارفور", "ميترو", "خير زمان", "grocery",
            "supermarket", "market", "bread", "milk", "eggs", "vegetables", "fruits", "meat", "chicken", "fish", "خضار",
            "فواكه", "لحم", "دجاج", "سمك", "خبز", "لبن",
        ),
        ("carrefour", "spinneys", "metro", "kheir zaman"),
    ),
    "Dining Out": (
        (
            "restaurant", "cafe", "coffee", "pizza", "burger", "kfc", "mcdonalds", "hardees", "pizza hut", "dominos",
            "cook door", "مطعم", "كافيه", "قهوة", "بيتزا", "برجر", "pepsi", "cola", "sandwich", "meal", "fries",
            "chicken",
        ),
        ("kfc", "mcdonalds", "pizza hut", "tabali", "chicken fila", "cook door"),
    ),
    "Transportation": (
        (
            "uber", "careem", "taxi", "gas", "fuel", "petrol", "diesel", "parking", "toll", "metro", "bus", "تاكسي",
            "بنزين", "وقود", "مواصلات", "اوبر", "كريم", "gas station", "petrol station", "محطة بنزين",
        ),
        ("uber", "careem", "misr petroleum", "total", "wataniya"),
    ),
    "Housing / Rent": (
        ("rent", "landlord", "apartment", "flat", "house", "إيجار", "شقة", "منزل", "سكن", "real estate", "property"),
        (),
    ),
    "Utilities": (
        (
            "electricity", "water", "gas", "internet", "phone", "mobile", "we", "vodafone", "orange", "etisalat",
            "كهرباء", "مياه", "غاز", "انترنت", "تليفون", "موبايل", "bill", "utility",
        ),
        ("we", "vodafone", "orange", "etisalat", "te data", "fawry", "فوري", "فورى"),
    ),
    "Health & Medical": (
        (
            "pharmacy", "doctor", "clinic", "hospital", "medical", "medicine", "drug", "prescription", "lab",
            "laboratory", "صيدلية", "طبيب", "عيادة", "مستشفى", "دواء", "علاج", "seif", "19011", "al ezaby",
        ),
        ("seif", "19011", "al ezaby", "el ezaby"),
    ),
    "Entertainment": (
        (
            "cinema", "movie", "theatre", "theater", "game", "gaming", "playstation", "xbox", "netflix", "spotify",
            "subscription", "سينما", "فيلم", "العاب", "لعبة", "vox", "galaxy", "cinema",
        ),
        ("vox", "galaxy", "netflix", "spotify", "steam"),
    ),
    "Shopping": (
        (
            "clothing", "clothes", "shoes", "fashion", "accessories", "electronics", "mobile", "laptop", "computer",
            "phone", "ملابس", "احذية", "موضة", "الكترونيات", "موبايل", "zara", "h&m", "noon", "amazon", "jumia", "souq",
        ),
        ("zara", "h&m", "noon", "amazon", "jumia", "souq"),
    ),
    "Education": (
        (
            "school", "university", "college", "course", "tuition", "books", "library", "study", "education", "learning",
            "مدرسة", "جامعة", "كلية", "دراسة", "تعليم", "كتب", "coursera", "udemy", "udacity",
        ),
        ("coursera", "udemy", "udacity"),
    ),
    "Personal Care": (
        (
            "salon", "barber", "haircut", "spa", "beauty", "cosmetics", "makeup", "perfume", "fragrance", "shampoo",
            "صالون", "حلاق", "تجميل", "عطر", "شامبو", "loreal", "nivea", "dove",
        ),
        ("loreal", "nivea", "dove"),
    ),
}
OTHER = "Other"
WEIGHTS = {"keyword": 1, "brand": 3}


def terms() -> list[tuple[str, int, str, str, int]]:
    """(category, ord, kind, term, weight), duplicates kept."""
    return [
        (category, i, kind, term, WEIGHTS[kind])
        for i, (category, lists) in enumerate(CATEGORIES.items())
        for kind, words in zip(WEIGHTS, lists, strict=True)
        for term in words
    ]


def term_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(terms(), "category string, ord int, kind string, term string, weight int")


def category_text(vendor: Column, items: Column) -> Column:
    return F.lower(F.concat(F.coalesce(vendor, F.lit("")), F.lit(" "), F.array_join(F.coalesce(items, F.array().cast("array<string>")), " ")))


def known(ascii_only: bool) -> Column:
    """The terms, each once a category, with their summed weights, as a literal (place of the category, term, weight)."""
    weights: dict[tuple[int, str], int] = {}
    for _, place, _, term, weight in terms():
        if term.isascii() or not ascii_only:
            weights[place, term] = weights.get((place, term), 0) + weight
    return F.array(*(F.struct(F.lit(place).alias("place"), F.lit(term).alias("term"), F.lit(w).alias("weight")) for (place, term), w in weights.items()))


def found(text: Column) -> Column:
    """The terms that text has. They are looked through one by one: an expression for each makes code that the JVM only
    interprets. A text of ASCII alone has none of the others' terms."""
    once = lambda column, f: F.get(F.transform(F.array(column), f), F.lit(0))
    return once(text, lambda t: F.filter(F.when(F.octet_length(t) == F.length(t), known(True)).otherwise(known(False)), lambda x: F.contains(t, x["term"])))


def scores(text: Column) -> Column:
    """(category, score) of each category: the summed weights of its terms in text; no join and no shuffle."""
    total = lambda of, place: F.aggregate(of, F.lit(0), lambda s, x: s + F.when(x["place"] == place, x["weight"]).otherwise(0))
    each = lambda of: F.array(*(F.struct(F.lit(c).alias("category"), total(of, i).alias("score")) for i, c in enumerate(CATEGORIES)))
    return F.get(F.transform(F.array(found(text)), each), F.lit(0))


def top(scored: Column) -> Column:
    """Of scores(): the highest, the earlier of equals, as (score, place, category)."""
    return F.array_max(F.transform(scored, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("place"), s["category"].alias("category"))))


def with_category(rows: DataFrame, vendor: str = "vendor", items: str = "line_items") -> DataFrame:
    """rows with `category`: of vendor and items, OTHER if no term is found. Each step is a column, computed once."""
    out = rows.withColumn("_text", category_text(F.col(vendor), F.col(items))).withColumn("_top", top(scores(F.col("_text"))))
    return out.withColumn("category", F.when(F.col("_top.score") > 0, F.col("_top.category")).otherwise(OTHER)).drop("_text", "_top")
