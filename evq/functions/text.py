"""Text as columns: tokens, sentences, numbers, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and white space; trimmed, none empty."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), UUID, "[uuid]")


def numbers(text: Column) -> Column:
    """The numbers of a text, without thousands separators."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, ",", "").cast("double"))


def total(x: Column) -> Column:
    """A sum that is 0.0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0.0))
