"""Shapes and semantic classes of values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class patterns in their order; the first that most values match wins.
CLASSES = {
    "guid": r"^(\{[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})$",
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"(?i)^((https?|ftp)://|www\.)\S+$",
    "datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,7})?)?(Z|[+-]\d{2}:?\d{2})?$|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}[ T]\d{1,2}:\d{2}(:\d{2})?(\s?[AaPp][Mm])?$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{4}/\d{2}/\d{2}$|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$",
    "flag": r"(?i)^(y|n|yes|no|t|f|true|false|0|1)$",
    "postal_code": r"^\d{5}(-\d{4})?$|^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$|^[A-Z]\d[A-Z] ?\d[A-Z]\d$|^\d{4} ?[A-Z]{2}$",
    "integer": r"^[-+]?\d{1,18}$",
    "decimal": r"^[-+]?\d{1,18}[.,]\d+$",
    "phone": r"^\+?[\d\s\-().]{7,24}$",
    "country_code": r"^[A-Z]{2}$",
}


#: Digits and blanks of all scripts count as such.
UNICODE = "(?U)"


def value_pattern(value: Column) -> Column:
    """Upper-case letters as A, other letters as a, digits as 9, runs collapsed."""
    out = F.regexp_replace(value, r"\p{Lu}", "A")
    out = F.regexp_replace(out, r"[\p{L}&&[^A]]", "a")
    out = F.regexp_replace(out, r"\p{Nd}", "9")
    return F.regexp_replace(out, r"(?s)(.)\1+", "$1")


def in_class(name: str, value: Column) -> Column:
    told = value.rlike(UNICODE + CLASSES[name])
    return told & (F.length(F.regexp_replace(value, UNICODE + r"\D", "")) >= 7) if name == "phone" else told


def semantic_class(value: Column) -> Column:
    """Aggregate: the first class that at least four fifths of the trimmed, non-blank values match; text if none; null without values."""
    text = F.regexp_replace(value.cast("string"), UNICODE + r"^\s+|\s+$", "")
    present = F.count(F.when(text != "", 1))
    out = F.when(present == 0, F.lit(None).cast("string"))
    for name in CLASSES:
        out = out.when(F.count(F.when((text != "") & in_class(name, text), 1)) * 5 >= present * 4, name)
    return out.otherwise("text")


def compare_key(value: Column) -> Column:
    """A string as a case-insensitive, blank-padded collation compares it."""
    return F.lower(F.rtrim(value))


def text_length(value: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(value))


def shortened(value: Column, most: int = 40) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("…"))).otherwise(value)
