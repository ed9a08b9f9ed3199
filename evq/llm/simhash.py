"""Document fingerprints by SimHash, and their search through permuted block tables.

Table i holds every distinct fingerprint under its i-th block of bits; two fingerprints within the radius agree in one
block at least, and are counted in the first they agree in. Only blocks that two fingerprints share go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_values, joined_to_one, words

BITS = 128
#: Hamming radius of the query's search: 128 bits in 4 blocks of 32, few enough values of which are shared by chance.
RADIUS = 3
#: Fingerprints of a block table's value that are compared at once; a value of more is compared in pairs of blocks.
BLOCK = 2048
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 16
#: Documents of one stretch of the descending order.
STRETCH, MOST_STRETCHES = 4000, 100_000

_HASHES: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hash(w: bytes) -> int:
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    h = _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    return h


def fingerprint(text: str | None) -> int:
    """BITS signs of the sum of +-weight over the hashes of the text's terms.

    Terms: words, and pairs of neighbouring words at twice the weight; the weight grows with the logarithm of the
    count. A text without words has the fingerprint 0; a sum of exactly 0 gives bit 0. Equal texts are alike.
    """
    ws = words(text)
    if not ws:
        return 0
    get = _HASHES.get
    h = np.fromiter([get(w) or _hash(w) for w in ws], np.uint64, len(ws))
    pairs = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    total = np.zeros(BITS, np.float32)
    for terms, scale in ((h, 1.0), (pairs, 2.0)):
        if len(terms):
            unique, n = np.unique(terms, return_counts=True)
            both = np.stack((_mixed(unique), _mixed(unique + np.uint64(0x632BE59BD9B4E019))), 1)
            weight = (scale * (1 + np.log(n))).astype(np.float32)
            for at in range(0, len(unique), 8192):  # bounded memory for very long texts
                signs = np.unpackbits(both[at : at + 8192].view(np.uint8), axis=1)
                w = weight[at : at + 8192]
                total += 2 * (w @ signs.astype(np.float32)) - w.sum()
    return int.from_bytes(np.packbits(total > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, other: str) -> str:
    """The last half of the text (rounded down) replaced by as many first code points of the other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


class Stretches:
    """The descending order of (id, hash of the text), cut at sampled quantiles of the ids.

    An id that is several quantiles at once (repeated or null ids) is cut further, at equal steps of the hash.
    """

    def __init__(self, points: list[int]):
        self.ids, times = np.unique(np.array(points, np.int64), return_counts=True)
        # each id ends a stretch; one met several times also begins one, and is parted into that many
        self.hot = {int(i): int(t) for i, t in zip(self.ids, times) if t > 1}
        widths = np.array([1 + self.hot.get(int(i), 0) for i in self.ids], np.int64)
        self.ends = np.cumsum(widths)  # stretches up to each id, from the least
        self.n = int(self.ends[-1]) + 1 if len(self.ids) else 1

    def of(self, rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The stretch of each row, 0 for the greatest ids."""
        at = np.searchsorted(self.ids, rank, "left")
        below = np.where(at > 0, self.ends[np.maximum(at, 1) - 1], 0) if len(self.ids) else np.zeros(len(rank), np.int64)
        if self.hot:
            inside = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == rank)
            for i in np.unique(rank[inside]).tolist():
                if i in self.hot:
                    mine = rank == i
                    share = (tie[mine].astype(np.float64) + 2.0**63) / 2.0**64
                    below[mine] += 1 + np.minimum((share * self.hot[i]).astype(np.int64), self.hot[i] - 1)
        return self.n - 1 - below


def with_next(docs: DataFrame, lowest: int = -(1 << 63)) -> DataFrame:
    """Rows _stretch, _extra, doc_id, text laid out so that each document is followed by its next one.

    The order is doc_id descending, nulls last, equal ids by a hash of the text, descending. It's cut into stretches of
    about STRETCH documents, a task each. The first document of each stretch also goes to the end of the one before
    it (the first of all to the last), marked _extra. Only ids are read for the cut; the driver holds a few numbers a
    stretch. Beyond STRETCH * MOST_STRETCHES documents stretches grow; they are streamed, never held.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_rank", F.coalesce("doc_id", F.lit(lowest))).withColumn("_tie", F.xxhash64("text"))
    n = rows.count()
    cuts = max(1, min(MOST_STRETCHES, n // STRETCH))
    points = rows.agg(F.percentile_approx("_rank", [i / cuts for i in range(1, cuts)], 10 * cuts + 100)).first()[0] if cuts > 1 else []
    order = Stretches(points or [])

    @F.pandas_udf("int")
    def stretch(rank: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(order.of(rank.to_numpy(np.int64), tie.to_numpy(np.int64))).astype("int32")

    tie = F.col("_tie") if order.hot else F.lit(0).cast("long")  # texts are read for the cut only where ids repeat
    heads = rows.select("_rank", tie.alias("_tie")).withColumn("s", stretch("_rank", "_tie")).groupBy("s").agg(F.max(F.struct("_rank", "_tie")).alias("h")).collect()
    there = sorted(r["s"] for r in heads)
    before = {s: there[i - 1] for i, s in enumerate(there)}
    head_rank, head_tie, prior = (np.zeros(order.n, np.int64) for _ in range(3))
    for r in heads:
        head_rank[r["s"]], head_tie[r["s"]], prior[r["s"]] = r["h"]["_rank"], r["h"]["_tie"], before[r["s"]]

    @F.pandas_udf("array<int>")
    def places(rank: pd.Series, tie: pd.Series) -> pd.Series:
        r, t = rank.to_numpy(np.int64), tie.to_numpy(np.int64)
        own = order.of(r, t)
        first = (head_rank[own] == r) & (head_tie[own] == t)
        return pd.Series([[s, p] if f else [s] for s, p, f in zip(own.tolist(), prior[own].tolist(), first.tolist())])

    laid = rows.select("*", F.posexplode(places("_rank", tie)).alias("_extra", "_stretch"))
    return laid.repartitionById(order.n, F.col("_stretch")).sortWithinPartitions("_extra", F.desc("_rank"), F.desc("_tie"), "text").select("_stretch", "_extra", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and the likeness of both and of the next document.

    Null texts count as empty. Of documents with equal ids a hash of the text decides the order; a single document is
    its own next one. An empty table gives no rows. doc_id has to be an integer; other columns aren't read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for stretch, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if last and last[0] == stretch:
                    mine = fingerprint(text)
                    out.append(_row(last, text, mine))
                else:
                    mine = None
                last = None if extra else (stretch, doc_id, text, fingerprint(text) if mine is None else mine)
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return with_next(docs).mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc: tuple[int, int | None, str, int], other: str, others: int) -> dict:
    _, doc_id, text, mine = doc
    new = edited(text, other)
    changed = fingerprint(new)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": f"{mine:0{BITS // 4}x}", "edited_fingerprint": f"{changed:0{BITS // 4}x}", "near_edited": likeness(mine, changed), "near_next": likeness(mine, others)}


def blocks_of(radius: int, digits: int) -> list[tuple[int, int]]:
    """Start and size of radius + 1 blocks of hex digits: two fingerprints within the radius agree in one of them."""
    if not 0 <= radius < digits:
        raise ValueError("radius must be from 0 to one less than the number of hex digits")
    cut = [round(i * digits / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def near_counts(table: DataFrame, radius: int = RADIUS, digits: int = BITS // 4, block: int = BLOCK) -> DataFrame:
    """fingerprint, n_equal, n_near: each distinct fingerprint of a table with a column fingerprint (hex), how many rows
    have it, and how many rows have another one within the Hamming radius.

    Pairs never become rows: the fingerprints under a value of a block table are compared in numpy, those of a common
    value in pairs of blocks, and their counts are added up. Nulls are left out; an empty table gives no rows.
    """
    parts_of = blocks_of(radius, digits)
    one = checkpointed(table.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")))
    keyed = one.select("fingerprint", "n", F.posexplode(F.array(*(F.xxhash64(F.substring("fingerprint", a + 1, n)) for a, n in parts_of))).alias("i", "v"))
    sizes = keyed.groupBy("i", "v").agg(F.count("*").alias("size")).where("size > 1").select("i", "v", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    met = keyed.join(sizes, ["i", "v"]).withColumn("block", F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table_ in _groups(batches, 4):
            # first hex digits at the front: a pair counts in the first block it agrees in
            hexes = table_.column("fingerprint").to_pylist()
            x = np.frombuffer(bytes.fromhex("".join(h.zfill(-(-digits // 16) * 16) for h in hexes)), ">u8").reshape(len(hexes), -1).astype(np.uint64)
            n, own = table_.column("n").to_numpy(), table_.column("block").to_numpy()
            pieces = np.array([[int(h[a : a + k], 16) for a, k in parts_of[: key[0]]] for h in hexes], np.uint64).reshape(len(hexes), -1)
            total = np.zeros(len(hexes), np.int64)
            left, right = np.flatnonzero(own == key[2]), np.flatnonzero(own == key[3])
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                near = np.bitwise_count(x[a][:, None] ^ x[right][None]).sum(2, dtype=np.int64) <= radius
                near &= a[:, None] != right[None]
                if key[0]:
                    near &= ~(pieces[a][:, None] == pieces[right][None]).any(2)
                total[a] += near @ n[right]
                if key[2] != key[3]:
                    total[right] += n[a] @ near
            yield pa.RecordBatch.from_arrays([pa.array(hexes), pa.array(total)], ["fingerprint", "near"])

    dealt = met.repartition("i", "v", "first", "second").sortWithinPartitions("i", "v", "first", "second").select("i", "v", "first", "second", "fingerprint", "n", "block")
    found = dealt.mapInArrow(rows, "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))
    return one.join(found, "fingerprint", "left").select("fingerprint", F.col("n").alias("n_equal"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The groups of rows that come sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for b in batches:
        group = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1)))) if b.num_rows else np.empty(0, int)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            key = tuple(group[s].tolist())
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def fingerprinted(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprints() with n_equal and n_near: rows of the same fingerprint (itself among them), and rows of others
    within the radius, found through the block tables."""
    rows = checkpointed(fingerprints(docs))
    near = checkpointed(near_counts(rows.select("fingerprint"), radius))
    hot = hot_values(near, "fingerprint", "n_equal", rows.count())
    return joined_to_one(rows, near, "fingerprint", hot, F.xxhash64("doc_id", "edited_fingerprint"))


def within(table: DataFrame, queries: DataFrame, radius: int, digits: int = BITS // 4) -> DataFrame:
    """Pairs query_fingerprint, fingerprint, distance of different or equal fingerprints within a Hamming radius.

    Both inputs have a column fingerprint (hex). Equal fingerprints are one row here: membership is the caller's
    column, so copies are never expanded. Table i holds every fingerprint under its i-th block of digits; two
    fingerprints within the radius agree in one of radius + 1 blocks at least. A pair is reported by the first block
    it agrees in. Nulls are in no pair. A common block is one skewed join key, which adaptive execution splits.
    """
    block = blocks_of(radius, digits)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.posexplode(F.array(*(F.substring(name, a + 1, n) for a, n in block))).alias("i", "v"))

    pairs = keyed(table, "fingerprint").join(keyed(queries, "query_fingerprint"), ["i", "v"])
    f, q = F.col("fingerprint"), F.col("query_fingerprint")
    first = F.lit(True)
    for k, (a, n) in enumerate(block):
        first = first & ((F.col("i") <= k) | (F.substring(f, a + 1, n) != F.substring(q, a + 1, n)))
    distance = F.lit(0)
    for a in range(0, digits, 15):
        part = [F.conv(F.substring(x, a + 1, 15), 16, 10).cast("long") for x in (f, q)]
        distance = distance + F.bit_count(part[0].bitwiseXOR(part[1]))
    return pairs.where(first).withColumn("distance", distance).where(F.col("distance") <= radius).select("query_fingerprint", "fingerprint", "distance")
