"""Sentence corpus, cosine search, fusion of ranked lists and evidence selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.functions.text import sentences

RRF_K, DEPTH, TOP = 60, 50, 20


def sentence_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, pos, sentence."""
    return docs.select(doc_id, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def first_seen(rows: DataFrame, doc_id: str) -> DataFrame:
    """The distinct sentences with where each comes first; the order of (doc, pos), null docs last, orders their ids."""
    return rows.groupBy("sentence").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), doc_id, "pos")).alias("first"), F.count("*").alias("n_rows")).select("sentence", f"first.{doc_id}", "first.pos", "n_rows")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a null vector and for one without direction."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scored(vectors: DataFrame, query: Sequence[float], column: str = "embedding") -> DataFrame:
    """vectors with score, the cosine to the query; the query is a literal, so nothing is shuffled."""
    return vectors.withColumn("score", cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query))))


def scored_in_bulk(vectors: DataFrame, query: Sequence[float], key: str, column: str = "embedding") -> DataFrame:
    """key and score by matrix products over Arrow batches, for very many vectors; null as in cosine()."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = np.asarray(b.column(1).is_valid())
            m = np.asarray(b.column(1).drop_null().flatten(), np.float64).reshape(-1, len(q))
            norm = np.linalg.norm(m, axis=1)
            score, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            score[there], known[there] = m @ q / np.where(norm > 0, norm, 1), (norm > 0) & bool(q.any())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, mask=~known)], [key, "score"])

    return vectors.select(key, column).mapInArrow(rows, f"{key} {vectors.schema[key].dataType.simpleString()}, score double")


def best_per(rows: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """The best row of each key, the first position of equals, by partial aggregation."""
    best = F.max_by(F.struct(score, position), F.struct(F.col(score), -F.col(position)))
    return rows.groupBy(key).agg(best.alias("b")).select(key, f"b.{score}", f"b.{position}")


def depth(rows: DataFrame, score: str, name: str, cut: int = DEPTH) -> DataFrame:
    """Competition ranks up to cut; ties at the cut stay. Rows without a score have no rank.

    Rows below the cut-th score can't stay, so a top-k finds that score first. Above it are cut different scores at
    most: they are ranked by counting, and joined back, so however many rows are tied none of them meet in a task.
    """
    edge = rows.select(F.col(score).alias("_s")).where("_s is not null").orderBy(F.desc("_s")).limit(cut).agg(F.min("_s").alias("_edge"))
    near = rows.join(F.broadcast(edge), F.col(score) >= F.col("_edge")).drop("_edge")
    before = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    counted = near.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = counted.select("_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int").alias(name))
    return near.join(F.broadcast(ranked), F.col(score) == F.col("_s")).drop("_s")


def rrf(*ranks: Column) -> Column:
    return F.round(sum((F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0)), 12)


def fused(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Both ranked lists by key with lexical_rank, semantic_rank and rrf."""
    return lexical.join(semantic, key, "full_outer").withColumn("rrf", rrf(F.col("lexical_rank"), F.col("semantic_rank")))


def top(rows: DataFrame, key: str, k: int = TOP) -> DataFrame:
    return rows.orderBy(F.desc("rrf"), F.asc_nulls_last("lexical_rank"), key).limit(k)


def selected(rows: DataFrame) -> DataFrame:
    """Evidence: what the words found, and the best by meaning."""
    return rows.where(F.col("lexical_rank").isNotNull() | (F.col("semantic_rank") == 1))
