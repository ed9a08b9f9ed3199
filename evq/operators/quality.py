"""Data-quality checks: each is one aggregation or anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.sources.build import differences


def format_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.agg(F.count_if(~F.col(column).rlike(rf"\A{pattern}\z")).alias("n_bad"), F.count("*").alias("n"))


def case_duplicates(df: DataFrame, column: str) -> DataFrame:
    """The two counts differ where values differ by case or outer space only."""
    return df.agg(F.count_distinct(column).alias("n_plain"), F.count_distinct(F.upper(F.trim(column))).alias("n_folded"))


def biconditional(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.count_if(a != b).alias("n_bad"))


def disagreement(a: DataFrame, a_key: str, a_value: str, b: DataFrame, b_key: str, b_value: str) -> DataFrame:
    """Keys for which two sources name different values."""
    left = a.select(F.col(a_key).alias("k"), F.col(a_value).alias("a")).distinct()
    return left.join(b.select(F.col(b_key).alias("k"), F.col(b_value).alias("b")).distinct(), "k").where("a <> b")


def content_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """fingerprint of all rows' keys and texts, whatever their order: n and two sums of 60 bits of each row's SHA-256.

    A null key or text differs from an empty one, and repeated rows count.
    """
    row = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\t"), F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit(""))), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(30,0)").cast("string")
    return df.agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(16)).alias("fingerprint"))


def round_trip(a: DataFrame, b: DataFrame) -> DataFrame:
    return differences(a, b).agg(F.count("*").alias("n_differences")).withColumn("n", F.lit(a.count()))


def report(checks: dict[str, tuple[DataFrame, dict[str, object]]]) -> list[dict]:
    """check, got, expected, passed for one-row checks."""
    out = []
    for name, (df, expected) in checks.items():
        got = df.first().asDict()
        out.append({"check": name, "got": got, "expected": expected, "passed": all(got.get(k) == v for k, v in expected.items())})
    return out
