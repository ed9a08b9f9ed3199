"""Reading sources and publishing tables: built aside, validated by reading back, then put in place at once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook (needs openpyxl, as pandas does): small by nature, so it is read on the driver."""
    import pandas as pd

    out = {}
    for name, sheet in pd.read_excel(path, sheet_name=None, dtype=object).items():
        while len(sheet) and sheet.iloc[-1].isna().all():
            sheet = sheet.iloc[:-1]
        if sheet.isna().all(axis=1).any():
            raise ValueError(f"{name}: a blank row inside")
        out[name] = spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None))
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def checksum(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            h.update(block)
    return h.hexdigest()


def fingerprint(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
    got = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return f"{got['n']}-{(got['x'] or 0) & ((1 << 64) - 1):016x}-{got['s'] or 0}"


def publish(tables: dict[str, DataFrame], folder: str, validate: Callable[[SparkSession, str], None] | None = None, sort_by: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Writes the tables and a manifest to folder; readers see the old folder or the new one, never a part.

    sort_by: keys by which a table's rows are dealt and sorted, so that row groups tell which keys they hold.

    Works through Spark's file system, so folder may be in any store it knows. Returns the row counts read back.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside, place = jvm.org.apache.hadoop.fs.Path(f"{folder}.building"), jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(conf)
    fs.delete(aside, True)
    for name, df in tables.items():
        if keys := (sort_by or {}).get(name):
            df = df.repartition(*keys).sortWithinPartitions(*keys)
        df.write.parquet(f"{folder}.building/{name}.parquet")
    counts = {name: spark.read.parquet(f"{folder}.building/{name}.parquet").count() for name in tables}
    sums = {name: fingerprint(spark.read.parquet(f"{folder}.building/{name}.parquet")) for name in tables}
    meta = {"built": datetime.now(UTC).isoformat(timespec="seconds"), "rows": counts, "checksums": sums}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{folder}.building/_manifest")
    if validate:
        validate(spark, f"{folder}.building")
    old = jvm.org.apache.hadoop.fs.Path(f"{folder}.old")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    if not fs.rename(aside, place):
        fs.rename(old, place)  # readers keep what they had
        raise OSError(f"could not publish {folder}")
    fs.delete(old, True)
    return counts


def write_results(results: list[dict], folder: str) -> None:
    """A run's results as JSON, and their summary as a table in Markdown."""
    from evq.plans.evaluate import markdown, summarize

    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    (place / "results.json").write_text(json.dumps(results, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    (place / "summary.md").write_text(markdown(summarize(results)) + "\n", encoding="utf-8")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; none for a faithful round trip."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
