"""BM25 with weighted fields, phrases, scopes and snippets, as DataFrame expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.text import tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, doc_id: str, fields: Sequence[str]) -> DataFrame:
    """doc_id, field, term, tf: the inverted index, for writing sorted by term."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields))
    one = docs.select(doc_id, F.explode(each).alias("e")).select(doc_id, "e.field", F.explode("e.t").alias("term"))
    return one.groupBy(doc_id, "field", "term").agg(F.count("*").alias("tf"))


def occurrences(field_tokens: Column, term: str) -> Column:
    """How often a term, or a phrase of several words, occurs in an array of tokens; phrases may overlap."""
    parts = term.split()
    if len(parts) == 1:
        return F.size(F.filter(field_tokens, lambda t: t == term))
    last = F.size(field_tokens) - len(parts) + 1
    fits = F.when(last > 0, F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(field_tokens, i, len(parts)) == F.array(*map(F.lit, parts))))
    return F.coalesce(F.size(fits), F.lit(0))


def counted(docs: DataFrame, terms: Sequence[str], fields: Mapping[str, float]) -> DataFrame:
    """docs with _len (tokens in all fields), _tf (weighted counts by term) and _in (whether a field has each term)."""
    all_tokens = {f: F.col(f"_t_{f}") for f in fields}
    out = docs.withColumns({f"_t_{f}": tokens(F.col(f)) for f in fields})
    counts = [[occurrences(t, term) for t in all_tokens.values()] for term in terms]
    weighted = [sum((F.lit(float(w)) * c for w, c in zip(fields.values(), row)), F.lit(0.0)) for row in counts]
    present = [sum(row, F.lit(0)) > 0 for row in counts]
    return out.withColumn("_len", sum((F.size(t) for t in all_tokens.values()), F.lit(0))).withColumn("_tf", F.array(*weighted)).withColumn("_in", F.array(*present))


def bm25(docs: DataFrame, terms: Sequence[str], fields: Mapping[str, float], scope: Column | None = None) -> DataFrame:
    """docs that have a term, with bm25 (higher is better).

    Numbers of documents, mean length and document frequencies are those of all docs, whatever the scope. One
    aggregation over query terms only; scoring is a map, so nothing of the collection is shuffled.
    """
    rows = counted(docs, terms, fields)
    stat = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(F.col("_in")[i]).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log((stat["n"] - stat[f"d{i}"] + 0.5) / (stat[f"d{i}"] + 0.5)) if stat["n"] else 0.0
        idf = idf if idf > 0 else FLOOR
        tf = F.col("_tf")[i]
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(float(stat["avg"] or 1))))
    hit = F.exists("_in", lambda x: x)
    if scope is not None:
        rows = rows.where(scope)
    return rows.where(hit).withColumn("bm25", score)


def matched(terms: Sequence[str]) -> Column:
    return F.filter(F.array(*(F.when(F.col("_in")[i], F.lit(t)) for i, t in enumerate(terms))), lambda x: x.isNotNull())


def snippet(text: Column, terms: Sequence[str], width: int = 30) -> Column:
    """The stretch of width words from the first word that holds a term, with the hits in double brackets."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    is_hit = lambda w: F.arrays_overlap(tokens(w), F.array(*map(F.lit, terms)))
    first = F.coalesce(F.array_position(F.transform(ws, is_hit), True), F.lit(0))
    window = F.slice(ws, F.greatest(first, F.lit(1)).cast("int"), width)
    return F.array_join(F.transform(window, lambda w: F.when(is_hit(w), F.concat(F.lit("[["), w, F.lit("]]"))).otherwise(w)), " ")
