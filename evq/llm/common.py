"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator here: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch between the JVM and Python: whole texts are long, and each side holds a few batches at once.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bounds what a batch of whole texts takes in executors; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() cuts at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir. Where none is set, one is made in a local session (tests, one
    machine); on a cluster that is an error, since executors share no local folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "evq-checkpoints"))
    return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Deletes what checkpointed() wrote for df. Nothing that is still to be computed may depend on it."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if more than one in so many rows has it, and so many at least; there are no more hot keys than HOT.
HOT, HOT_ROWS = 500, 1000
#: What may be broadcast, by its size in memory as counted on the driver.
BROADCAST_BYTES = 32 << 20


def hot_values(counts: DataFrame, key: str, n: str, rows: int) -> list:
    """The hot keys of a table of counts, most of them first: at most HOT of them."""
    least = max(HOT_ROWS, rows // HOT)
    return [r[0] for r in counts.where(F.col(n) > least).orderBy(F.desc(n), key).limit(HOT).select(key).collect()] if rows > least else []


def joined_to_one(rows: DataFrame, table: DataFrame, key: str, hot: list, spread: Column) -> DataFrame:
    """rows joined to the one row of table with the same key (an inner join that keeps the columns of both).

    Rows of hot keys don't meet in a task: their rows of table, at most HOT, are broadcast, and in the exchange they
    are dealt by spread, a number.
    """
    if not hot:
        return rows.join(table, key)
    names = [c for c in table.columns if c != key]
    is_hot = F.col(key).isin(hot)
    told = table.select(key, F.struct(*names).alias("_told"))
    few = told.where(is_hot).withColumnRenamed("_told", "_few")
    # 0 as the optimizer can't see it: it would take a literal out of the join's keys, and hot rows would meet again
    zero = F.xxhash64(key).bitwiseAND(F.lit(0).cast("long"))
    rest = told.where(~is_hot).withColumn("_dealt", zero)
    dealt = rows.withColumn("_dealt", F.when(is_hot, spread.bitwiseOR(F.lit(1).cast("long"))).otherwise(zero))
    out = dealt.join(rest, [key, "_dealt"], "left").join(F.broadcast(few), key, "left").withColumn("_one", F.coalesce("_few", "_told"))
    return out.where("_one is not null").select(*rows.columns, *(F.col(f"_one.{c}").alias(c) for c in names))


def word_count(text):
    """Number of words in a string column, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns memory that this worker has freed to the system: workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
