"""Scalar expressions.  All of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade import config

# Text forms read as a number, text read as missing, currency and unit marks removed.
NUMBER_PATTERN = (
    r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
)
WHOLE_PATTERN = r"^\s*[+-]?[0-9]{1,18}\s*$"
MISSING_TOKENS = ("nan", "None", "", "NaN")
MONEY_MARKS = r"[,\s$€£¥%]"
# All characters of texts that become numbers (`$` in a pattern allows one line end of any kind): other texts, most labels
# among them, fail at their first other character and are not rewritten.
NUMBER_CHARACTERS = r"^[-+0-9.eEiInNfFtTyY,\s$€£¥%\u0085\u2028\u2029]*$"

# Date layouts, each with the shape of the text it is tried on.
DATE_LAYOUTS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d HH:mm": r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}$",
    "yyyy-M-d HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$",
    "yyyy-M-d'T'HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
}

# Every layout has a year: texts without four digits in a row are tried on none.
YEAR = r"[0-9]{4}"

# Fixed value: date and time with a fraction, a `Z` or an offset, of which at least one is there.
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9}|(\.\d{1,9})? ?(Z|[+-]\d{2}:?\d{2}))$"


def normalize_name(name: object) -> str:
    return str(name).strip().lower().replace(" ", "_")


def normalize_label(col: Column) -> Column:
    return F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit("_"))


def is_number_text(col: Column) -> Column:
    return col.rlike(NUMBER_PATTERN)


def is_whole_text(col: Column) -> Column:
    return col.rlike(WHOLE_PATTERN)


def to_number(col: Column, kind: str = "double") -> Column:
    """Text to number; anything that is not wholly a number becomes NULL.  The pattern guards the
    cast because Spark alone would also read forms such as '5d'."""
    return F.when(is_number_text(col), F.regexp_replace(col, r"\s", "").try_cast(kind))


def null_tokens(col: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def clean_number(col: Column) -> Column:
    """Drop thousands separators, blanks and currency or percent marks, then read the number.
    A percentage keeps its face value."""
    return F.when(col.rlike(NUMBER_CHARACTERS), to_number(F.regexp_replace(col, MONEY_MARKS, "")))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | col.contains(word)
    return hit


def edit_distance(a: Column, b: Column, limit: int = 2) -> Column:
    """Levenshtein distance; limit + 1 where the distance is greater than the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def parse_date(col: Column, layouts: dict[str, str] = DATE_LAYOUTS) -> Column:
    """Text to timestamp by the first layout that reads it, else NULL; a time with an offset becomes the
    session's time.  The shape test keeps other texts away from the parser; every layout has a year of four digits."""
    text = F.trim(col)
    tries = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in layouts.items()]
    plain = F.regexp_replace(F.regexp_replace(text, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2"), r" Z$", "Z")
    iso = F.when(text.rlike(ISO_TIME), plain.try_cast("timestamp"))
    return F.when(text.rlike(YEAR), F.coalesce(*tries, iso))


def clip(col: Column, low: Column, high: Column) -> Column:
    return F.when(col.isNotNull(), F.greatest(low, F.least(high, col)))


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default).cast("double"))


def pct_change(first: Column, second: Column) -> Column:
    """Change in percent of the size of the first value, NULL when that is zero."""
    return F.try_divide(second - first, F.abs(first)) * 100


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation in percent, 0 for a zero mean."""
    return safe_ratio(F.abs(std) * 100, F.abs(mean))


def volatility_band(cv: Column) -> Column:
    return (
        F.when(cv > 100, "extreme").when(cv > 50, "high").when(cv > 20, "moderate").otherwise("low")
    )


def skew_class(skew: Column, threshold: float = config.SKEW_NORMAL) -> Column:
    return (
        F.when(skew.isNull(), "unknown")
        .when(F.abs(skew) < threshold, "roughly normal")
        .when(skew > 0, "right-skewed")
        .otherwise("left-skewed")
    )


def near_equal(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-6) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def is_year(col: Column) -> Column:
    return col.between(1900, 2100)
