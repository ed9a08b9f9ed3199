"""Views, ranks, latest rows, set comparisons and combined aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.operators.search_index import shared_folder

#: Rows that a task numbers, about, where the session doesn't ask for more tasks.
ROWS_A_TASK = 1_000_000


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest rows of each key; rows tied for the latest all stay. A key is compared with its own rows only."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def latest_one(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One latest row a key by partial aggregation, which shuffles a row a key and task instead of all."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("_m")).select(key, *(f"_m.{c}" for c in [*order, *keep]))


def only(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """A view of allowed columns of flagged rows."""
    return df.where(flag).select(*columns)


def competition_rank(df: DataFrame, score: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """1, 2, 2, 4 by score, highest first."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are in a only, in b only and in both."""
    both = distinct_keys(a, key).withColumn("a", F.lit(1)).join(distinct_keys(b, key).withColumn("b", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))


def combined(left: DataFrame, right: DataFrame, key: str, left_aggs: Sequence[Column], right_aggs: Sequence[Column]) -> DataFrame:
    """Each side is aggregated at its own grain first and joined one to one after: rows never multiply."""
    return left.groupBy(key).agg(*left_aggs).join(right.groupBy(key).agg(*right_aggs), key, "full_outer")


def functional_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def capped(df: DataFrame, cap: int = 50) -> tuple[list, bool]:
    """At most cap rows on the driver, and whether there were more."""
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read back: its rows keep their partitions and order."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[str], name: str, per_bucket: int = 100_000) -> DataFrame:
    """df with name: 0, 1, 2, ... by order, nulls last.

    Rows are dealt into ranges of order, sorted there and checkpointed, so that a row's place stays: its number is that
    place and the counted rows of the ranges before. Work grows with the rows alone, however many ranges there are.
    A range has per_bucket rows or more, up to ROWS_A_TASK if the session has few shuffle partitions.
    """
    by = [F.asc_nulls_last(c) for c in order]
    rows = checkpointed(df)
    n = rows.count()
    ranges = min(n // per_bucket + 1, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_TASK + 1))
    placed = checkpointed(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by))
    sizes = {r["at"]: r["count"] for r in placed.groupBy(F.spark_partition_id().alias("at")).count().collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), F.spark_partition_id() + 1)
    return placed.withColumn(name, offset + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
