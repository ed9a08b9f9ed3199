"""A stored inverted index with positions: built in one pass, sorted by term, read by search through pushed-down terms."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.operators.lexical import B, FLOOR, K1

TOKEN = re.compile(r"[^\W_]+")
#: Positions of a field begin at its number times this; longer fields are an error.
FIELD = 1 << 26
#: Parts that the postings of a term are dealt in.
SPREAD = 16


def folded_tokens(text: str | None) -> list[str]:
    """Words in normal form C and case-folded."""
    return TOKEN.findall(unicodedata.normalize("NFC", text).casefold()) if text else []


def postings(docs: DataFrame, doc_id: str, fields: Sequence[str]) -> DataFrame:
    """term, doc_id, size (tokens of the document in all fields), at (its positions): one pass, nothing is shuffled."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                terms: list[str] = []
                ids, sizes, at = [], [], []
                for key, *texts in zip(*(c.to_pylist() for c in b.columns)):
                    found: dict[str, list[int]] = {}
                    size = 0
                    for f, text in enumerate(texts):
                        ts = folded_tokens(text)
                        if len(ts) >= FIELD:
                            raise ValueError(f"{key}: a field of {len(ts)} tokens")
                        size += len(ts)
                        for i, t in enumerate(ts):
                            found.setdefault(t, []).append(f * FIELD + i)
                    terms += found
                    at += found.values()
                    ids += [key] * len(found)
                    sizes += [size] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, b.schema.types[0]), pa.array(sizes, pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["term", doc_id, "size", "at"])

    return docs.select(doc_id, *fields).mapInArrow(rows, f"term string, `{doc_id}` {kind}, size int, at array<int>")


@dataclass
class Index:
    """postings sorted by term, with the number of documents and their mean size."""

    rows: DataFrame
    doc_id: str
    fields: tuple[str, ...]
    n: int
    mean: float

    def weighted(self, weights: Mapping[str, float], at: Column) -> Column:
        """Occurrences in all fields, each weighing its field's weight."""

        def inside(i: int):  # a lambda's second parameter would be the place in the array
            return lambda p: (p >= i * FIELD) & (p < (i + 1) * FIELD)

        return sum((F.lit(float(weights[f])) * F.size(F.filter(at, inside(i))) for i, f in enumerate(self.fields) if f in weights), F.lit(0.0))

    def places(self, wanted: str, number: int, within: Mapping[str, float]) -> DataFrame:
        """q (number), doc_id, size, at of a word or phrase in the fields: a phrase is where its words follow each other."""
        words = folded_tokens(wanted)
        rows = self.rows.where(F.col("term").isin(list(dict.fromkeys(words))))
        if len(words) > 1:
            by = rows.groupBy(self.doc_id, "size").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("by"))

            def starts(i: int, w: str) -> Column:
                return F.transform(F.coalesce(F.try_element_at("by", F.lit(w)), F.array().cast("array<int>")), lambda p: p - i)

            for i, w in enumerate(words):
                by = by.withColumn("at", starts(i, w) if i == 0 else F.array_intersect("at", starts(i, w)))
            rows = by.drop("by")
        kept = F.filter("at", lambda p: F.floor(p / FIELD).isin([i for i, f in enumerate(self.fields) if f in within]))
        return rows.select(F.lit(number).alias("q"), self.doc_id, "size", kept.alias("at")).where("size(at) > 0")

    def hits(self, wanted: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
        """q, doc_id, size, at for all words and phrases wanted; single words are one scan."""
        singles = {folded_tokens(w)[0]: i for i, w in enumerate(wanted) if len(folded_tokens(w)) == 1}
        out = None
        if singles:
            inside = F.filter("at", lambda p: F.floor(p / FIELD).isin([i for i, f in enumerate(self.fields) if f in weights]))
            number = F.create_map(*(F.lit(x) for item in singles.items() for x in item))[F.col("term")]
            out = self.rows.where(F.col("term").isin(list(singles))).select(number.alias("q"), self.doc_id, "size", inside.alias("at")).where("size(at) > 0")
        for i, w in enumerate(wanted):
            if len(folded_tokens(w)) > 1:
                one = self.places(w, i, weights)
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.rows.select(F.lit(0).alias("q"), self.doc_id, "size", "at").where("false")

    def bm25(self, wanted: Sequence[str], weights: Mapping[str, float], scope: DataFrame | None = None) -> DataFrame:
        """doc_id, bm25 (higher is better), matched (numbers of the words and phrases found), in_fields.

        Statistics are those of all documents, whatever the scope (a table of doc_id). Only the postings of the words
        are read, and a row for each document that has one is aggregated.
        """
        found = self.hits(wanted, weights)
        counts = {r["q"]: r["n"] for r in found.groupBy("q").agg(F.count("*").alias("n")).collect()}
        idf = {q: max(math.log((self.n - n + 0.5) / (n + 0.5)), 0.0) or FLOOR for q, n in counts.items()}
        known = F.create_map(*(F.lit(x) for item in idf.items() for x in item))[F.col("q")] if idf else F.lit(0.0)
        tf = self.weighted(weights, F.col("at"))
        score = known * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(self.mean or 1.0)))
        places = F.array_distinct(F.transform("at", lambda p: F.floor(p / FIELD)))
        if scope is not None:
            found = found.join(scope.select(self.doc_id), self.doc_id, "left_semi")
        return found.withColumn("s", score).withColumn("f", places).groupBy(self.doc_id).agg(F.sum("s").alias("bm25"), F.sort_array(F.collect_set("q")).alias("matched"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("f")))).alias("in_fields"))


def write(docs: DataFrame, doc_id: str, fields: Sequence[str], path: str, partitions: int | None = None) -> None:
    """Writes the index: each file has terms in order, so row groups tell theirs; a term is dealt over SPREAD files by its
    documents, so a common one is no task of its own. The statistics are written last: an index without them is none."""
    spark = docs.sparkSession
    rows = postings(docs, doc_id, fields)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "term", F.pmod(F.xxhash64(doc_id), F.lit(SPREAD))).sortWithinPartitions("term", doc_id).write.mode("overwrite").option("parquet.block.size", 1 << 22).parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings").select(doc_id, "size").distinct()
    total = stored.agg(F.sum("size").alias("s")).first()["s"] or 0
    stats = {"n": docs.count(), "tokens": total, "fields": list(fields), "doc_id": doc_id}
    spark.createDataFrame([(json.dumps(stats),)], "stats string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")


def read(spark: SparkSession, path: str) -> Index | None:
    """The index at a path, or None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    stats = json.loads(spark.read.text(f"{path}/stats").first()[0])
    return Index(spark.read.parquet(f"{path}/postings"), stats["doc_id"], tuple(stats["fields"]), stats["n"], stats["tokens"] / stats["n"] if stats["n"] else 0.0)


def shared_folder(spark: SparkSession) -> str:
    """Where derived tables go: the session's checkpoint folder; a local one in local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or os.path.join(tempfile.gettempdir(), "evq-checkpoints")


def index_of(spark: SparkSession, source: str, doc_id: str, fields: Sequence[str]) -> Index:
    """The index of a parquet table, built where it is missing: it goes by the table's files, their sizes and times."""
    jvm, place = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(source)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    files = []
    while listed.hasNext():
        f = listed.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = hashlib.sha256(json.dumps([sorted(files), doc_id, list(fields)]).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/evq-index/{key}"
    found = read(spark, path)
    if found is None:
        write(spark.read.parquet(source), doc_id, fields, path)
        found = read(spark, path)
    return found


def disagreements(index: Index, docs: DataFrame, column: Column) -> DataFrame:
    """Documents whose tokens in the index are not as many as an independent count says."""
    counted = docs.select(index.doc_id, column.cast("long").alias("counted"))
    indexed = index.rows.groupBy(index.doc_id).agg(F.sum(F.size("at")).cast("long").alias("indexed"))
    return counted.join(indexed, index.doc_id, "full_outer").where(~F.coalesce("counted", F.lit(0)).eqNullSafe(F.coalesce("indexed", F.lit(0)))).select(index.doc_id, "counted", "indexed")
