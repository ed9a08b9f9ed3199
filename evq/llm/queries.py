"""The query of each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, mixing, ngram_join, packing, quality, secret_scan, simhash, substring_dedup, url_filter
from .common import table
from .oracles import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(docs, secret_scan.train(secret_scan.samples(spark, docs)))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_equal", "n_near"]
    return simhash.fingerprinted(table(spark, sf_dir, "documents")).select(*names)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_all(table(spark, sf_dir, "pages"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad of each page whose document is labelled; the document's number is in the path of the url."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long")
    rows = pages.select(url_filter.host_of(F.col("url")).alias("host"), number.alias("doc_id")).where("doc_id is not null")
    return rows.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").select("host", (1 - F.col("quality")).alias("bad"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1_mixing what SQL can say."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3_secrets what SQL can say."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5_quality what SQL can say."""
    return op5_quality(spark, sf_dir).drop("kept", "score")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6_simhash what SQL can say."""
    return simhash.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_secrets, op4_language, op5_quality, op6_simhash, op7_jaccard, op8_html, op9_substrings, op10_urls, mixing_targets, secret_counts, quality_counts, edited_texts)}
