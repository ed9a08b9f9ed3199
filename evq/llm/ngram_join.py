"""Jaccard join of documents on word shingles with Bayesian pruning of candidates.

1. Texts with equal shingle sets are one class from the start, however many there are.
2. MinHash bands deal the classes into buckets. At the default 32 bands of 4 a pair of similarity 0.8 shares no bucket
   with a probability of 5e-8. Only buckets of two classes or more go on, with the signatures of their classes.
3. Within a bucket signatures are compared 16 values at a time, and a pair is dropped once the posterior probability
   of reaching the threshold falls below the tolerance. A bucket returns a spanning forest of the pairs that stay, so
   classes are clustered by likely links, not by having met. Large buckets are compared in pairs of blocks.
4. Texts are joined to the members of clusters only. Within a cluster pairs that pass the same pruning are verified on
   the whole shingle sets, in blocks of bounded size. Pairs never become rows: a block returns link counts and a
   spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, give_back, hot_values, joined_to_one
from .components import components
from .shingles import HASHES, minhash, packed, shingle_set, unpacked

THRESHOLD, TOLERANCE, STEP = 0.8, 1e-7, 16
#: Classes of a block, and shingles of a block (expected): both bound the memory of a comparison.
BLOCK, BLOCK_SHINGLES = 800, 600_000
#: Classes of a block of a large bucket, where signatures alone are compared.
BUCKET_BLOCK = 4096


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 16, 32, ... values looked at: the least number of matches with which a pair stays.

    With a uniform prior and m matches of n the similarity is Beta(m + 1, n - m + 1); that it reaches t has the
    probability that n + 1 trials of chance t give m successes at most.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def likely(signatures: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs of places a, b stay: sizes that allow the threshold, and matches that leave it probable."""
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    live = np.flatnonzero(low >= threshold * high)  # sets of too different sizes can't be similar
    hits = np.zeros(len(live), np.int64)
    for i, limit in enumerate(least_matches(threshold)):
        part = slice(i * STEP, (i + 1) * STEP)
        hits = hits + (signatures[a[live], part] == signatures[b[live], part]).sum(1)
        keep = hits >= limit
        live, hits = live[keep], hits[keep]
        if not len(live):
            break
    return live


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, signatures: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of left x right, each pair once, with a Jaccard similarity of threshold or more."""
    signatures = np.array([minhash(s) for s in sets]).reshape(-1, HASHES) if signatures is None else signatures
    sizes = np.array([len(s) for s in sets])
    same = left is right
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, a in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        mine = np.full(len(others), a)
        live = likely(signatures, sizes, mine, others, threshold)
        found.append((mine[live], others[live]))
    x = np.concatenate([f[0] for f in found]) if found else np.empty(0, int)
    y = np.concatenate([f[1] for f in found]) if found else np.empty(0, int)
    if not len(x):
        return x, y
    common = shared_counts(sets, x, y)
    ok = common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9
    return x[ok], y[ok]


def forest(signatures: np.ndarray, sizes: np.ndarray, starts: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the likely pairs within each group of rows (starts: where the groups begin).

    All rows are compared with the first of their group at once. Where some are left, the walk goes on: each row that
    was reached is compared with those that weren't, so a group of likes costs one pass.
    """
    n = len(sizes)
    counts = np.diff(starts, append=n)
    leader = np.repeat(starts, counts)
    rows = np.flatnonzero(np.arange(n) != leader)
    hit = rows[likely(signatures, sizes, leader[rows], rows, threshold)]
    x, y = [leader[hit]], [hit]
    reached = np.zeros(n, bool)
    reached[hit] = True
    reached[starts] = True
    for s in np.unique(leader[~reached]).tolist():
        group = np.arange(s, s + counts[np.searchsorted(starts, s)])
        rest, waiting = group[~reached[group]], group[reached[group]][1:].tolist()
        while len(rest):
            if not waiting:
                waiting, rest = [int(rest[0])], rest[1:]
            a = waiting.pop()
            live = likely(signatures, sizes, np.full(len(rest), a), rest, threshold)
            x.append(np.full(len(live), a))
            y.append(rest[live])
            waiting += rest[live].tolist()
            rest = np.delete(rest, live)
    return np.concatenate(x), np.concatenate(y)


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[x] and sets[y]."""
    used, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    px, py = place[: len(x)], place[len(x) :]
    if len(x) < 4 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)])
    # many pairs: products of 0/1 matrices over the shingles that two sets or more have
    values = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    several = n[code] > 1
    _, code = np.unique(code[several], return_inverse=True)
    owner = owner[several]
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(code.max(initial=-1)) + 1, 8192):
        some = (code >= at) & (code < at + 8192)
        m = np.zeros((len(used), 8192), np.float32)
        m[owner[some], code[some] - at] = 1
        total += m @ m.T
    return total[px, py].astype(np.int64)


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place of each place's component."""
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], int)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), key (of the shingle set; null without words), its size, signature (bands)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, signatures = [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(packed(minhash(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "size", "signature"])
        give_back()

    return docs.select("doc_id", "mark", "text").mapInArrow(rows, "doc_id long, mark long, key binary, size long, signature array<long>")


def likely_links(met: DataFrame, threshold: float) -> DataFrame:
    """u, v: spanning forests of the likely pairs in each bucket.

    met: bucket, first, second (blocks of a large bucket, else 0), node, size, signature. Rows come sorted by bucket, so
    a task holds the rows of a few buckets at once, of a large one no more than two blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def told(table: pa.Table) -> pa.RecordBatch:
            group = np.stack([table.column(i).to_numpy() for i in range(3)], 1)
            node, sizes = table.column(3).to_numpy(), table.column(4).to_numpy()
            signatures = unpacked(pc.list_flatten(table.column(5)).to_numpy())
            starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
            x, y = forest(signatures, sizes, starts, threshold)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cut = np.flatnonzero((group[1:] != group[:-1]).any(1))  # the last group may go on in the next batch
            if last is not None and (group[0] != last).any():
                yield told(pa.Table.from_batches(held))
                held = []
            if len(cut):
                yield told(pa.Table.from_batches([*held, b.slice(0, cut[-1] + 1)]))
                held, b = [], b.slice(cut[-1] + 1)
            held.append(b)
            last = group[-1]
        if held:
            yield told(pa.Table.from_batches(held))
        give_back()

    return met.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second").select("bucket", "first", "second", "node", "size", "signature").mapInArrow(rows, "u long, v long")


def compared(rows: pa.Table, threshold: float) -> pa.Table:
    """Link counts and forest of one pair of blocks: columns key, block, n, text, signature, first, second."""
    first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
    rows = rows.take(pc.sort_indices(rows, [("key", "ascending")]))
    keys = rows.column("key").to_pylist()
    own = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]  # a document's rows may be repeated
    rows = rows.take(pa.array(own))
    keys = [keys[i] for i in own]
    sets = [shingle_set(t) for t in rows.column("text").to_pylist()]
    block, n = rows.column("block").to_numpy(), rows.column("n").to_numpy()
    signatures = unpacked(pc.list_flatten(rows.column("signature")).to_numpy())
    left = np.flatnonzero(block == first)
    x, y = similar_pairs(sets, left, left if first == second else np.flatnonzero(block == second), threshold, signatures)
    links = np.bincount(x, n[y], len(keys)) + np.bincount(y, n[x], len(keys))
    root = roots(len(keys), x, y)
    some = np.flatnonzero(links)
    return pa.table({"key": pa.array([keys[i] for i in some], pa.binary()), "root": pa.array([keys[root[i]] for i in some], pa.binary()), "links": pa.array(links[some].astype(np.int64))})


def dealt(rows: DataFrame, parts: str, salt: int, together: bool) -> DataFrame:
    """Each row with its block in parts blocks, for each pair first, second of blocks it takes part in.

    together: a block meets itself too; else only where there is no other, as two blocks that meet compare all."""
    block = F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")
    met = rows.withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("other"))
    if not together:
        met = met.where((F.col(parts) == 1) | (F.col("block") != F.col("other")))
    return met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0)))


def joined(docs: DataFrame, threshold: float, block: int, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """join() with a further column keeper: id and mark of the one document that may stand for the class."""
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    rows = checkpointed(sketched(texts))
    kept = rows.where("key is not null")
    node = F.xxhash64("key").alias("node")
    classes = kept.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("size").alias("shingles"))
    # a bucket counts its classes by an upper bound: rows of one class and task are one
    placed = kept.select(node, F.posexplode("signature").alias("i", "value")).select("node", F.xxhash64("i", "value").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    shared = checkpointed(placed.join(buckets, "bucket", "left_semi").distinct())
    signed = kept.select(node, "size", "signature").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("size").alias("size"), F.first("signature").alias("signature"))
    signed = checkpointed(signed)
    counts = shared.groupBy("bucket").agg(F.ceil(F.count("*") / bucket_block).cast("int").alias("parts")).where("parts > 1")
    sized = shared.join(counts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = dealt(sized, "parts", 5, False).join(signed, "node")
    clusters = components(likely_links(met, threshold)).select("node", F.col("root").alias("cluster"))
    members = classes.withColumn("node", node).join(clusters, "node").join(signed.select("node", "signature"), "node")
    members = checkpointed(members.select("cluster", "node", "key", "rep", "n", "shingles", "signature"))
    discard(shared)
    discard(signed)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("shingles").alias("all"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    told = members.select("cluster", "node", "key", "n", "signature", F.xxhash64("rep.doc_id", "rep.mark").alias("own"))
    # a row repeated in full is told from none of its kind: its text is taken once
    one = texts.withColumn("own", F.xxhash64("doc_id", "mark")).join(told, "own").dropDuplicates(["own", "key"])
    spread = dealt(one.select("cluster", "node", "key", "n", "signature", "text").join(sizes, "cluster"), "parts", 3, True)
    found = checkpointed(spread.select("cluster", "first", "second", "key", "n", "block", "text", "signature").groupBy("cluster", "first", "second").applyInArrow(lambda t: compared(t, threshold), "key binary, root binary, links long"))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    whole = classes.select("key", "least", "rep", "n").join(linked, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = checkpointed(whole)
    named = whole.groupBy("root").agg(F.min("least").alias("class_id"), F.min("rep").alias("rep"))
    by_key = whole.drop("rep").join(named, "root").select("key", "n", F.coalesce("links", F.lit(0)).alias("links"), "class_id", F.struct("rep.doc_id", "rep.mark").alias("rep"))
    hot = hot_values(whole, "key", "n", kept.count())
    told = joined_to_one(kept.select("doc_id", "mark", "key"), by_key, "key", hot, F.xxhash64("doc_id", "mark"))
    without = rows.where("key is null").select("doc_id", "mark", "key")
    return told.unionByName(without, allowMissingColumns=True).select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", F.struct("doc_id", "mark")).alias("keeper"),
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: one row for each row of docs.

    n_links: other documents with a similarity of the threshold or more, copies among them; class_id: the least id
    of the documents connected by such links. A null or empty text, or one of white space, has no links and its own
    id as class. A text of fewer than five words is one shingle, so it is similar to its like only. Null ids are
    kept (a class of nulls alone has a null id). Rows repeated in full are copies of each other. doc_id has to be an
    integer; other columns aren't read.
    """
    return joined(docs, threshold, block).drop("keeper")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs with one document of each class: the one with the least id, ties by a hash of the text.

    Documents without words stay, one for each id. Columns are those of docs.
    """
    keepers = joined(docs, threshold, block).select(F.xxhash64("keeper.doc_id", "keeper.mark").alias("_own")).distinct()
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # whatever its columns are called
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    own = docs.select(whole_row, F.xxhash64(F.col("doc_id").cast("long"), mark).alias("_own"))
    return own.join(keepers, "_own").dropDuplicates(["_own"]).select("_row.*")
