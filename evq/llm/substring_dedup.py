"""Removal of word sequences that an earlier document has, by FM-indexes over shards.

1. Each window of 13 words has an anchor: of its runs of 6 words the one with the least hash. Anchors that occur in
   one text only can't lie in a repeated window; the others are found by one aggregation.
2. The windows left, cut into segments of one anchor each, go to the shard of that anchor, equal segments as one with
   the least id of their documents. So all copies of a window meet in one shard, whatever document they are in.
3. A shard's segments become an FM-index; every segment is streamed through it by backward search, and a window that
   matches in full gives the range of its copies and with it the least id among their documents.
4. A window is repeated if that id is smaller than its document's; its words go.
Texts that are equal as a whole are indexed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, hot_values, words
from .fm_index import FMIndex
from .shingles import runs, word_hashes

WINDOW, ANCHOR = 13, 6
#: Segments (expected) of one shard's index.
SHARD_SEGMENTS = 30_000
#: Stands for a null id: nothing comes after it.
NO_ID = (1 << 63) - 1
#: Texts that a task remembers, so that of a text's copies one a task is looked at.
REMEMBERED = 1 << 18


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ANCHOR words, and for each window the place of its anchor (the first of the least)."""
    r = runs(h, ANCHOR)
    span = WINDOW - ANCHOR + 1
    n = len(h) - WINDOW + 1
    if n < 1:
        return r, np.empty(0, np.int64)
    best, at = r[:n].copy(), np.arange(n)
    for k in range(1, span):
        less = r[k : n + k] < best
        best = np.where(less, r[k : n + k], best)
        at = np.where(less, np.arange(k, n + k), at)
    return r, at


def anchored(texts: DataFrame) -> DataFrame:
    """anchor, mark: the distinct anchors of each text, once for all copies that a task meets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found, marks = [np.empty(0, np.int64)], [0]
                for mark, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if mark in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    r, places = anchors(word_hashes(t))
                    found.append(np.unique(r[np.unique(places)]).view(np.int64))
                    marks.append(mark)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(np.array(marks, np.int64), [len(f) for f in found]))], ["anchor", "mark"])

    return texts.select("mark", "text").mapInArrow(rows, "anchor long, mark long")


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """mark, repeated: the distinct anchors of each text that another text has too, however many copies there are."""
    same = Window.partitionBy("anchor")
    several = anchored(texts).withColumn("a", F.min("mark").over(same)).withColumn("b", F.max("mark").over(same)).where("a < b")
    return several.groupBy("mark").agg(F.collect_set("anchor").alias("repeated"))


def segments_of(h: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int, int]]:
    """anchor, start, windows of each stretch of windows with one anchor, where that anchor is repeated."""
    r, at = anchors(h)
    if not len(at):
        return []
    clean = np.isin(r[at].view(np.int64), repeated)
    cut = np.flatnonzero(np.diff(at, prepend=-1, append=-1) | np.diff(clean, prepend=0, append=0))
    return [(int(r[at[a]].view(np.int64)), int(a), int(b - a)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if clean[a]]


def cut_segments(flagged: DataFrame) -> DataFrame:
    """anchor, content (word hashes), places of the segments of texts with their repeated anchors.

    places are own, mark, check and start of each of the segment's texts as 64-bit numbers: equal segments of a batch
    are one row, so a passage of very many texts is shipped a few times only.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                found: dict[tuple[int, bytes], list[int]] = {}
                for own, mark, check, text, repeated in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns)):
                    h = word_hashes(text)
                    raw = h.tobytes()
                    for a, s, n in segments_of(h, np.array(repeated, np.int64)):
                        found.setdefault((a, raw[8 * s : 8 * (s + n + WINDOW - 1)]), []).extend((own, mark, check, s))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()), pa.array([np.array(v, "<i8").tobytes() for v in found.values()], pa.binary())], ["anchor", "content", "places"])

    return flagged.select("own", "mark", "check", "text", "repeated").mapInArrow(rows, "anchor long, content binary, places binary")


def indexed(shard: pa.Table) -> pa.Table:
    """mark, check, own, starts: the starts of a shard's repeated windows, by text."""
    places = [np.frombuffer(p, "<i8").reshape(-1, 4) for p in shard.column("places").to_pylist()]
    at: dict[bytes, int] = {}
    which = np.array([at.setdefault(c, len(at)) for c in shard.column("content").to_pylist()])
    own = np.full(len(at), NO_ID)
    np.minimum.at(own, which, np.array([p[:, 0].min() for p in places]))
    least = least_ids([np.frombuffer(c, np.uint64) for c in at], own)
    out: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for k, p in zip(which.tolist(), places):
        best = least[k]
        for o, mark, check, start in p[p[:, 0] > best.min()].tolist():
            out.setdefault((mark, check, o), []).append(np.flatnonzero(best < o) + start)
    keys = list(out)
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    return pa.table({"mark": columns[0], "check": columns[1], "own": columns[2], "starts": pa.array([np.concatenate(v).astype("<i4").tobytes() for v in out.values()], pa.binary())})


def least_ids(seqs: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
    """For each window of each sequence: the least of own over all sequences that have it."""
    sizes = np.array([len(s) for s in seqs])
    _, code = np.unique(np.concatenate(seqs), return_inverse=True)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(seqs)), sizes + 1)
    place = np.arange(len(text)) - starts[owner]
    inside = place < sizes[owner]
    text[inside] = code + 1
    index = FMIndex(text, WINDOW + 1)
    ends = np.flatnonzero(inside & (place >= WINDOW - 1))
    matched, low, high = index.matched(text, ends, WINDOW)
    least = own[owner[ends]].copy()
    full = np.flatnonzero(matched == WINDOW)
    if len(full):
        lows, which = np.unique(low[full], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high[full]
        # ranges of different windows don't overlap, so every other result of reduceat is that of a range
        best = np.minimum.reduceat(np.append(own[owner[index.order]], NO_ID), np.stack((lows, highs), 1).reshape(-1))[::2]
        least[full] = best[which]
    return np.split(least, np.cumsum(sizes - WINDOW + 1)[:-1])


def removed_words(n: int, starts: np.ndarray) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(cover[:-1]) > 0


def dedup(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    A null text has no words; texts of fewer than 13 words lose none. A null id comes after all others. Rows with
    equal ids don't take words from each other. kept_sha256 is that of the kept words joined by one space. An empty
    table gives no rows. doc_id has to be an integer; other columns aren't read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    # equal texts are told by two hashes; the first one is the key of all joins, so the texts are shuffled once
    texts = texts.withColumn("mark", F.xxhash64("text")).withColumn("check", F.hash("text").cast("long"))
    firsts = checkpointed(texts.groupBy("mark", "check").agg(F.min("own").alias("first"), F.count("*").alias("n")))
    totals = firsts.agg(F.sum("n").alias("n")).first()
    hot = hot_values(firsts.groupBy("mark").agg(F.sum("n").alias("n")), "mark", "n", totals["n"] or 0)
    told = [(r["mark"], r["first"]) for r in firsts.where(F.col("mark").isin(hot)).collect()] if hot else []
    first_of = {m: first for m, first in told if sum(m == other for other, _ in told) == 1}  # a mark of one text
    # rows of a text with very many copies are dealt by their own ids instead, its first row among them
    is_hot = F.col("mark").isin(list(first_of)) if first_of else F.lit(False)

    def dealt(own) -> Column:
        return F.when(is_hot, F.xxhash64(F.lit(1), own)).otherwise(F.col("mark")).alias("dealt")

    if first_of:
        lead = F.create_map(*(F.lit(x).cast("long") for m, first in first_of.items() for x in (m, first)))[F.col("mark")]
    else:
        lead = F.lit(None).cast("long")
    per_text = checkpointed(repeated_anchors(texts).select(dealt(lead), "mark", "repeated"))
    n = per_text.agg(F.sum(F.size("repeated"))).first()[0] or 0
    shards = max(1, n // shard_segments)
    listed = firsts.where(~is_hot).groupBy(F.col("mark").alias("dealt")).agg(F.collect_list(F.struct("check", "first")).alias("firsts"))
    first = F.coalesce(F.when(is_hot, lead), F.filter("firsts", lambda x: x["check"] == F.col("check"))[0]["first"])
    laid = texts.withColumn("dealt", dealt(F.col("own"))).join(listed, "dealt", "left").withColumn("first", first).drop("firsts")
    own_rows = laid.where("own = first").join(per_text.select("dealt", F.col("mark").alias("of"), "repeated"), "dealt").where(F.col("mark").bitwiseXOR(F.col("of")) == 0)
    pieces = cut_segments(own_rows)
    found = pieces.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(lambda t: indexed(t), "mark long, check long, own long, starts binary")
    gone = found.groupBy("mark").agg(F.collect_list(F.struct("mark", "check", "own", "starts")).alias("gone")).select(dealt(lead), "gone")
    mine = F.filter("gone", lambda x: (x["mark"] == F.col("mark")) & (x["check"] == F.col("check")) & (x["own"] == F.col("own")))
    whole = laid.join(gone, "dealt", "left").select("doc_id", "own", "first", "text", F.transform(mine, lambda x: x["starts"]).alias("starts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, own, first, text, found in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(text)
                if own > first and len(ws) >= WINDOW:
                    kept = []
                elif own == first and found:
                    gone_ = removed_words(len(ws), np.concatenate([np.frombuffer(s, "<i4") for s in found]))
                    kept = [w for w, g in zip(ws, gone_.tolist()) if not g]
                else:
                    kept = ws
                out.append((doc_id, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return whole.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")
