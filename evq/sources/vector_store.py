"""Vectors of distinct sentences: embedded in chunks that a later run need not make again, checked when loaded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.sources.build import checksum, fingerprint

FORMAT, CHUNK, WORKERS = 1, 400, 8


def name_of(chunk: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(chunk).encode("utf-8", "surrogatepass")).hexdigest()[:24]


def build(texts: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], path: str, config: dict, chunk: int = CHUNK, workers: int = WORKERS) -> dict[str, int]:
    """Embeds the distinct sentences of a table with one column and writes them with a manifest.

    Chunks are named by their sentences: those a run left behind are kept, so a build that failed goes on where it
    stopped. A folder of other settings is an error; nothing is mixed. The embedder is a service with a quota, so the
    driver asks it, with a few workers; for one that runs anywhere use mapInArrow instead.
    """
    place = Path(path)
    (place / "chunks").mkdir(parents=True, exist_ok=True)
    settings = place / "config.json"
    if settings.exists() and json.loads(settings.read_text()) != config:
        raise ValueError(f"{path} holds vectors of other settings")
    settings.write_text(json.dumps(config, sort_keys=True))
    sentences = [r[0] for r in texts.where(F.col(texts.columns[0]).isNotNull()).distinct().orderBy(texts.columns[0]).toLocalIterator()]
    parts = [sentences[i : i + chunk] for i in range(0, len(sentences), chunk)]
    files = {f"{name_of(p)}.parquet": p for p in parts}
    there = {f.name for f in (place / "chunks").glob("*.parquet")}

    def make(name: str) -> int:
        vectors = [list(map(float, v)) for v in embed(files[name])]
        if len(vectors) != len(files[name]):
            raise ValueError("the embedder left sentences out")
        aside = place / "chunks" / f"{name}.part"
        pq.write_table(pa.table({"sentence": files[name], "embedding": pa.array(vectors, pa.list_(pa.float32()))}), aside)
        aside.rename(place / "chunks" / name)
        return len(vectors)

    (place / "manifest.json").unlink(missing_ok=True)
    with ThreadPoolExecutor(workers) as pool:
        made = sum(pool.map(make, [n for n in files if n not in there]))
    for stale in there - files.keys():
        (place / "chunks" / stale).unlink()
    manifest = {"format": FORMAT, "config": config, "n": len(sentences), "texts": fingerprint(texts.distinct()), "files": {n: checksum(place / "chunks" / n) for n in sorted(files)}}
    (place / "manifest.json").write_text(json.dumps(manifest, indent=1))
    return {"made": made, "kept": len(sentences) - made}


def load(spark: SparkSession, path: str, texts: DataFrame, config: dict) -> DataFrame:
    """sentence, embedding; an error if format, settings, the texts' fingerprint, a file's checksum, the number of
    vectors, their length or a value isn't what it should be."""
    place = Path(path)
    if not (place / "manifest.json").exists():
        raise ValueError(f"{path}: no manifest, the build is not finished")
    manifest = json.loads((place / "manifest.json").read_text())
    wrong = [
        *(["format"] if manifest["format"] != FORMAT else []),
        *(["config"] if manifest["config"] != config else []),
        *(["fingerprint"] if manifest["texts"] != fingerprint(texts.distinct()) else []),
        *(n for n, h in manifest["files"].items() if not (place / "chunks" / n).exists() or checksum(place / "chunks" / n) != h),
    ]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    found = spark.read.parquet(f"file://{(place / 'chunks').resolve()}") if manifest["files"] else spark.createDataFrame([], "sentence string, embedding array<float>")
    size = config.get("size")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = found.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != F.lit(size)).alias("sizes"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("values"), F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zeros")).first()
    if told["n"] != manifest["n"] or (size and told["sizes"]) or told["values"] or told["zeros"]:
        raise ValueError(f"{path}: {told.asDict()}")
    return found.select("sentence", "embedding")


def bulk(texts: DataFrame, make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]) -> DataFrame:
    """sentence, embedding by an embedder that each worker makes for itself: no driver in between."""

    def rows(batches):
        embed = make()
        for b in batches:
            ts = b.column(0).to_pylist()
            vectors = [np.asarray(v, np.float32).tolist() for v in embed(ts)] if ts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["sentence", "embedding"])

    return texts.select(F.col(texts.columns[0]).alias("sentence")).where("sentence is not null").distinct().mapInArrow(rows, "sentence string, embedding array<float>")
