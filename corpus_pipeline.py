"""From documents to packed training sequences: language, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import language_id, mixing, ngram_join, packing, secret_scan
from evq.llm.common import checkpointed, short_batches, table
from evq.llm.queries import tokenizer_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is ambiguous; fills in a missing lang.

    Null and empty texts have no letter and go; a null lang takes the predicted one, a given one stays. Without any
    labelled text nothing is ambiguous and every text with a letter stays. Repeated rows are judged alike, whole texts
    of any length are read, columns of any name are kept, and an empty table gives an empty one.
    """
    short_batches(spark)
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    told = language_id.identify(rows, model, keep=("row",))
    known = F.col("lang_pred") != language_id.UNKNOWN
    kept = told.where(known & ~F.col("ambiguous")) if model else told.where(F.col("row.text").rlike(r"\p{L}"))
    lang = F.coalesce(F.col("row.lang"), F.when(known, F.col("lang_pred")))
    return kept.select(*(lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: the one with the least id (nulls last), ties by a
    hash of the text. Documents without words stay, one for each id; of rows repeated in full one stays."""
    short_batches(spark)
    return ngram_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text, and stays as it is where that is null."""
    table_ = secret_scan.train(secret_scan.samples(spark, docs))
    return secret_scan.redact(docs, table_).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times; a null source is one too. Empty
    documents weigh nothing and are taken with their source's full passes."""
    return mixing.blend(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences: a null or empty text is the end id alone, a long one is cut wherever a
    sequence ends, repeated rows are documents of their own, and an empty table gives no rows."""
    short_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", languages), ("ngram_jaccard", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
