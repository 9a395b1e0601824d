"""Repair of recognised text, Column to Column: six steps, each usable alone, applied in order by `repaired`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Confusions between scripts, as parallel strings for translate().
ARABIC_CONFUSED, ENGLISH_MEANT = "ه٧٤لا؟G", "aVElI)E"
ARABIC_CONFUSED_IN_AMOUNTS, ENGLISH_MEANT_IN_AMOUNTS = "٧٤؟G", "VE)E"
ENGLISH_CONFUSED, ARABIC_MEANT = "aIVE", "اا٧٤"
ARABIC_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
# Keywords that an element may be a misreading of, in order of preference.
KEYWORDS = (
    "total", "subtotal", "vat", "tax", "item", "sales", "cash", "paid", "change", "receipt", "order", "date",
    "print", "server", "pepsi", "cola", "opened", "closed",
)
# Whole-element misreadings, any case; then two in exact case.
MISREAD = {"totهl": "total", "tothal": "total", "totاl": "total", "subt0tal": "subtotal", "sub-total": "subtotal", "٧at": "vat", "vاt": "vat"}
MISREAD_EXACT = {"ILEI": "Q", "ILEII": "Q"}
# Three-character misreadings of the currency code.
CODES = ("EGE", "EGت", "EG؟", "EGف", "EEP", "E6P", "E0P", "EOP", r"\[6P", r"\[0P")
SIMILAR = 0.7
#: Longer texts are like no keyword.
LONGEST_LIKE = int(max(map(len, KEYWORDS)) / SIMILAR) + 1
ZERO_WIDTH = "​‌‍"
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The characters of SPACE, one by one.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for; a batch without non-ASCII text passes as it is."""
    return text.where(text.isna() | text.map(lambda t: t is None or t.isascii()), text.str.normalize("NFKC"))


def stripped(text: Column) -> Column:
    """Without white space at the ends; most texts begin and end with a printed ASCII character and need no search for it."""
    printed = lambda letter: F.ascii(letter).between(33, 126)
    return F.when(printed(text) & printed(F.right(text, F.lit(1))), text).otherwise(F.btrim(text, F.lit(SPACES)))


def clean_text(text: Column, normalize: bool = True) -> Column:
    """Zero-width characters go, NFKC, white space collapses. normalize=False stays in the JVM (right for ASCII)."""
    bare = F.translate(text, ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(nfkc(bare) if normalize else bare, SPACE, " "))


def share_above_half(text: Column, others: str) -> Column:
    """Whether more than half of the characters remain when those of the class `others` go."""
    return F.length(F.regexp_replace(text, others, "")) > F.length(text) / 2


def mostly_latin(text: Column) -> Column:
    return (F.length(text) == 0) | share_above_half(text, r"[^\x{0}-\x{5FF}]")


def mostly_arabic(text: Column) -> Column:
    return (F.length(text) > 0) & share_above_half(text, r"[^\x{600}-\x{6FF}]")


def fix_mixed_script(text: Column) -> Column:
    """First rule that holds: decimals, ASCII digits or mostly Latin make characters English; mostly Arabic, Arabic."""
    english = F.translate(text, ARABIC_CONFUSED, ENGLISH_MEANT)
    return (
        F.when(text.rlike(r"(?U)\d+[.,]\d+"), F.translate(text, ARABIC_CONFUSED_IN_AMOUNTS, ENGLISH_MEANT_IN_AMOUNTS))
        .when(text.rlike("[0-9]") | mostly_latin(text), english)
        .when(mostly_arabic(text), F.translate(text, ENGLISH_CONFUSED, ARABIC_MEANT))
        .otherwise(text)
    )


def fix_dates(text: Column) -> Column:
    text = F.regexp_replace(text, r"202[&\-_=]", "2022")
    text = F.regexp_replace(text, r"(?U)(\d{2})[-–—](\d{2})[-–—](\d{4})", "$1-$2-$3")
    return F.regexp_replace(text, r"(?U)(\d{2}-\d{2}-202)o", "$10")


def fix_numbers(text: Column) -> Column:
    """Arabic-Indic digits to ASCII, and letters that stand for digits between, before or after digits."""
    fixed = ascii_ = F.translate(text, ARABIC_DIGITS, DIGITS)
    for letters, digit in (("[Oo]", "0"), ("[lI]", "1"), ("S", "5"), ("B", "8")):
        fixed = F.regexp_replace(fixed, rf"(?U)(?:(?<=\d)|^){letters}(?=\d)|(?<=\d){letters}$", digit)
    code = text.rlike(r"^[٤E٥٦٧٨٩][A-Za-zا-ي؟\)]{1,3}$")
    return F.when(code, text).when(ascii_.rlike(r"(?U)\d"), fixed).otherwise(ascii_)


def is_currency(text: Column) -> Column:
    return (F.upper(text) == "EGP") | F.upper(text).startswith("EGP ")


def recode_currency(text: Column) -> Column:
    """Misread codes become EGP and Arabic-Indic digits ASCII, but in a text that begins with the code."""
    seen = F.regexp_replace(text, r"(?iuU)(?:[٤E][0O6oGgق\[]?[Pp؟)]+|E+P|\b[0O6][Pp]|\[[0O6]?[Pp])(?=\s|$|\d)", "EGP")
    return F.when(is_currency(text), text).otherwise(F.translate(seen, ARABIC_DIGITS, DIGITS))


def finish_currency(text: Column, recoded: Column) -> Column:
    """What is left of known misreadings, and a bracket before a digit; `text` is what was recoded."""
    coded = F.when(F.upper(recoded) == "EGP", recoded).otherwise(F.regexp_replace(recoded, rf"(?iuU)\b(?:{'|'.join(CODES)})\b", "EGP"))
    return F.when(is_currency(text), text).otherwise(F.regexp_replace(coded, r"(?U)\[(\d)", "EGP $1"))


def fuzzy_match(text: Column, word: str, threshold: float = SIMILAR) -> Column:
    """Equal characters at equal places, over the longer length, reach the threshold."""
    same = sum((F.when(F.substring(text, i + 1, 1) == c, 1).otherwise(0) for i, c in enumerate(word)), F.lit(0))
    n = F.length(text)
    return (n > 0) & (n <= int(len(word) / threshold) + 1) & (same / F.greatest(n, F.lit(len(word))) >= threshold)


def cased_like(text: Column, word: str) -> Column:
    first = F.substring(text, 1, 1)
    is_upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    return F.when(is_upper(text), F.lit(word.upper())).when(is_upper(first), F.lit(word.capitalize())).otherwise(F.lit(word))


#: Bits that count a keyword's characters in a number of `agreements`, and keywords a number holds.
COUNT_BITS, COUNTED = 4, 9


def agreements(lower: Column) -> Column:
    """How many characters of each of KEYWORDS stand at the same place in `lower`, as numbers of COUNTED counts each.

    Each place looks its letter up in a table of 26 numbers, which has a 1 in the count of each keyword with that letter
    there: all keywords are compared by a few look-ups and additions.
    """

    def number(words: tuple[str, ...]) -> Column:
        held = F.lit(0).cast("long")
        for place in range(max(map(len, words))):
            table = [sum(1 << COUNT_BITS * k for k, w in enumerate(words) if w[place : place + 1] == chr(97 + i)) for i in range(26)]
            letter = F.ascii(F.substring(lower, place + 1, 1)) - 97
            held += F.coalesce(F.get(F.array(*(F.lit(x).cast("long") for x in table)), letter), F.lit(0).cast("long"))
        return held

    return F.array(*(number(KEYWORDS[i : i + COUNTED]) for i in range(0, len(KEYWORDS), COUNTED)))


def like_keyword(n: Column, counts: Column) -> Column:
    """The first of KEYWORDS that a text of n characters is like; null without one. Give it columns: they are used many times."""
    found = F.when(F.forall(counts, lambda c: c == 0), None)
    for k, word in enumerate(KEYWORDS):
        same = F.shiftright(counts[k // COUNTED], COUNT_BITS * (k % COUNTED)).bitwiseAND((1 << COUNT_BITS) - 1)
        found = found.when((same > 0) & (same / F.greatest(n, F.lit(len(word))) >= SIMILAR), F.lit(word))
    return found


def fix_keywords(text: Column, word: Column) -> Column:
    """An element like one of KEYWORDS, `word`, becomes it, whole, in its own case."""
    first = F.substring(text, 1, 1)
    is_upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    cased = F.when(is_upper(text), F.upper(word)).when(is_upper(first), F.initcap(word)).otherwise(word)
    return F.when(word.isNull(), text).otherwise(cased)


def fix_misread(text: Column) -> Column:
    lower, found = F.lower(text), F
    for wrong, right in MISREAD_EXACT.items():
        found = found.when(text == wrong, F.lit(right))
    for wrong, right in MISREAD.items():
        found = found.when(lower == wrong, cased_like(text, right))
    return found.otherwise(text)


def repaired(rows: DataFrame, column: str = "text", normalize: bool = True, steps: tuple[str, ...] | None = None) -> DataFrame:
    """rows with the steps (STEPS, all by default) done on a column in order. Each step is a projection of its own, as
    its expression uses the text many times."""
    for step in steps or STEPS:
        text = F.col(column)
        if step == "cleaned":
            rows = rows.withColumn(column, clean_text(text, normalize))
        elif step == "currency":
            rows = rows.withColumn("_seen", recode_currency(text)).withColumn(column, finish_currency(text, F.col("_seen"))).drop("_seen")
        elif step == "words":
            short = F.when(F.length(text) <= LONGEST_LIKE, F.lower(text))
            rows = rows.withColumn("_same", agreements(short)).withColumn("_word", like_keyword(F.length(text), F.col("_same")))
            rows = rows.withColumn(column, fix_keywords(text, F.col("_word"))).withColumn(column, fix_misread(text)).drop("_same", "_word")
        else:
            rows = rows.withColumn(column, {"script": fix_mixed_script, "dates": fix_dates, "numbers": fix_numbers}[step](text))
    return rows


#: The steps in their order.
STEPS = ("cleaned", "script", "dates", "numbers", "currency", "words")
