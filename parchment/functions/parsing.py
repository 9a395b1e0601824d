"""Dates, amounts and keywords in element texts, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_repair import stripped

# Keywords searched for anywhere in an element's lower-case text.
DATE_KEYWORDS = ("date", "dated", "invoice date", "bill date", "تاريخ", "بتاريخ", "التاريخ", "تاريخ الطباعة")
TOTAL_KEYWORDS = (
    "total", "grand total", "net total", "amount due", "المجموع", "الإجمالي", "المبلغ", "الكلي", "المطلوب",
    "المبلغ المستحق", "الصافي",
)
# The patterns of dates (the first that matches decides) and of amounts.
YEAR_FIRST = r"(?U)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
YEAR_LAST = r"(?U)\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b"
SHORT_YEAR = r"(?U)\b\d{1,2}[-/]\d{1,2}[-/]\d{2}\b"
AMOUNT = r"(?U)\b\d{1,3}(?:[,\s]\d{3})*(?:[.,]\d{2})?\b"
CURRENCY = "EGPegp$£€¥₹₪﷼"
NOT_AN_ITEM = r"(?U)^(?:[EGPegp$£€]|[\d.,\s]+$)"
OTHER_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text has one of the words; those with another of the words inside need no look of their own."""
    lower, least = F.lower(text), [w for w in words if not any(v in w for v in words if v != w)]
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in dict.fromkeys(least)))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null where there is no such day; years below 1000 aren't padded."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    ok = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= days)
    return F.when(ok, F.concat_ws("-", year.cast("string"), two(month), two(day)))


def date_parts(text: Column) -> Column:
    """The numbers, as text, of the first date of the first pattern that matches; null without one."""
    # no nullif: its argument would be a column of its own, so that all texts are searched
    found = F.coalesce(*(F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in (YEAR_FIRST, YEAR_LAST, SHORT_YEAR)))
    return F.split(F.translate(found, "/", "-"), "-")


def date_numbers(parts: Column) -> Column:
    """date_parts as whole numbers, with the lengths of the first and last. A part in other digits than ASCII is a number
    only where it has four, that is, is a year."""
    part = lambda i: F.try_element_at(parts, F.lit(i + 1))
    # digits of one byte each are ASCII
    plain = lambda i: F.when((F.length(part(i)) == 4) | (F.octet_length(part(i)) == F.length(part(i))), F.translate(part(i), OTHER_DIGITS, DIGITS))
    number = lambda i, name: plain(i).try_cast("int").alias(name)
    return F.struct(number(0, "a"), number(1, "b"), number(2, "c"), F.length(part(0)).alias("first"), F.length(part(2)).alias("last"))


def date_ways(n: Column) -> Column:
    """date_numbers as the two ways (year, month, day) to read them, the second of which counts if the first is no day. Day
    first, else month first; two-digit years: 69 to 99 are 1900s; year-month-day with a short year needs two digits for
    the year. Give it a column: it is used many times."""
    a, b, c, first, last = n["a"], n["b"], n["c"], n["first"], n["last"]
    century = lambda y: F.when(y < 69, y + 2000).otherwise(y + 1900)
    return F.struct(
        F.when(first == 4, a).when(last == 4, c).otherwise(century(c)).alias("y"), b.alias("m"), F.when(first == 4, c).otherwise(a).alias("d"),
        F.when(first == 4, None).when(last == 4, c).when(first == 2, century(a)).alias("y2"), F.when(last == 4, a).otherwise(b).alias("m2"), F.when(last == 4, b).otherwise(c).alias("d2"),
    )


def date_of(w: Column) -> Column:
    """date_ways as YYYY-MM-DD; null where they are no date. Give it a column."""
    return F.coalesce(iso_date(w["y"], w["m"], w["d"]), iso_date(w["y2"], w["m2"], w["d2"]))


def parse_date(text: Column) -> Column:
    """The first date of the first pattern that matches, as YYYY-MM-DD; null where it is no date.

    Most texts have neither separator and go no further. The others' steps are functions of one value: as columns of a
    whole stage they make a method of over 8,000 bytes, which the JVM only interprets, for all texts.
    """
    once = lambda column, f: F.get(F.transform(F.array(column), f), F.lit(0))
    return F.when(F.contains(text, F.lit("-")) | F.contains(text, F.lit("/")), once(once(once(date_parts(text), date_numbers), date_ways), date_of))


def parse_amount(text: Column) -> Column:
    """The first amount with grouped thousands. 0.0 is an amount here; `present` tells those that count."""
    digits = (F.octet_length(text) > F.length(text)) | text.rlike("[0-9]")  # an ASCII text without a digit has no amount
    found = F.when(digits, F.regexp_extract(F.translate(text, CURRENCY, ""), AMOUNT, 0))  # white space at the ends is in no amount
    return F.translate(found, OTHER_DIGITS + " ,", DIGITS).try_cast("double")


def present(amount: Column) -> Column:
    return amount.isNotNull() & (amount != 0)


def may_be_item(text: Column) -> Column:
    """A text that may name a line item, if an amount follows."""
    return named(text) & ~has_any(text, TOTAL_KEYWORDS) & ~has_any(text, DATE_KEYWORDS)


def named(text: Column) -> Column:
    """What an item's name is but for keywords: three characters or more, no number and no currency's letter in front."""
    bare = stripped(text)
    return (F.length(bare) >= 3) & ~bare.rlike(NOT_AN_ITEM)


def epoch_ms(date: Column) -> Column:
    """Milliseconds of a date's midnight in the session's time zone; null for null or malformed dates."""
    return F.unix_millis(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))


def is_image_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)).isin(".jpg", ".jpeg", ".png")


#: Doubles from here on have no more than two places.
WHOLE = 2.0**46


def round2(x: Column) -> Column:
    """x rounded to two places as its binary value has it, halves to even: 2.675, which is a little less, gives 2.67.

    100 * x is taken without error as a rounded product and its remainder (x parted into two factors of few bits), so that a
    product that looks like a half is judged by what was rounded off. Give it a column: it is used many times.
    """
    product = x * 100.0
    high = x * 134217729.0 - (x * 134217729.0 - x)
    remainder = (high * 100.0 - product) + (x - high) * 100.0
    near = F.rint(product)
    past = product - near
    # rint took the even neighbour; the other is meant where the remainder tells so
    up = F.when((past == 0.5) & (remainder > 0), near + 1.0).when((past == -0.5) & (remainder < 0), near - 1.0).otherwise(near)
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(up / 100.0)
