"""Mixing sources to target weights as a min-cost flow.

Documents are counted by membership pattern (the set of sources a document belongs to); only those counts, one row
per pattern, reach the driver. There a flow routes each pattern's capacity to the quotas of its sources: the k-th
pass over a pattern costs more than the one before, so repetition is spread before it is deepened. The flow of a
pattern is then a tape laid over its documents in a seeded order, pass after pass, and each document takes the words
of the tape that fall on it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, checkpointed, discard, word_count

MAX_REPEATS = 3
#: Relative weights of the sources in code-point order, repeated as needed.
CYCLE = (5, 2, 1)
#: Rows of the catalogue of patterns that the driver accepts: it grows with the kinds of document, not with their number.
MAX_PATTERNS = 200_000
#: Documents (expected) of a bucket: the seeded order of a pattern is cut into buckets, offsets are summed over buckets
#: first and inside a bucket after.
BUCKET_DOCS = 4000
#: Rows that the parts of a hot pattern's documents are spread over where the catalogue is too large to be broadcast.
SALTS = 64


def targets(total: int, sizes: Sequence[int], weights: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[tuple[int, int]]:
    """Each source's share of total words as a fraction (numerator, denominator).

    A share stops at max_repeats times the source's size; what is above is shared again by weight among the others.
    """
    left, open_, out = total, list(range(len(sizes))), [(0, 1)] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > max_repeats * sizes[i] * w}
        if not over:
            for i in open_:
                out[i] = (left * weights[i], w)
            break
        for i in over:
            out[i] = (max_repeats * sizes[i], 1)
            left -= max_repeats * sizes[i]
        open_ = [i for i in open_ if i not in over]
    return out


def whole(shares: Sequence[tuple[int, int]]) -> list[int]:
    """The shares in whole words with the same sum, by largest remainder, ties to the first."""
    floors = [n // d for n, d in shares]
    spare = round(sum(n / d - n // d for n, d in shares))
    by_rest = sorted(range(len(shares)), key=lambda i: (-(shares[i][0] % shares[i][1]) / shares[i][1], i))
    for i in by_rest[:spare]:
        floors[i] += 1 if shares[i][0] % shares[i][1] else 0
    return floors


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources: a maximal flow of least cost.

    Pass k over a pattern (k from 0) costs k a word. Successive shortest paths with potentials: Dijkstra from the
    patterns that can still send, through residual arcs, to a source with quota left. Arcs: patterns x their sources.
    """
    n, m = len(capacity), len(quotas)
    sent: list[dict[int, int]] = [{} for _ in range(n)]
    used, left = [0] * n, list(quotas)
    holders: list[set[int]] = [set() for _ in range(m)]  # patterns that send to a source now

    def price(p: int) -> int:
        return used[p] // capacity[p]

    while True:
        dist: dict[tuple[str, int], float] = {}
        back: dict[tuple[str, int], tuple[str, int] | None] = {}
        heap = [(price(p), 0, p) for p in range(n) if capacity[p] and used[p] < max_repeats * capacity[p]]
        for c, _, p in heap:
            dist["p", p], back["p", p] = c, None
        heapq.heapify(heap)
        end = None
        done: set[tuple[str, int]] = set()
        while heap:
            d, kind, x = heapq.heappop(heap)
            node = ("ps"[kind], x)
            if node in done:
                continue
            done.add(node)
            if kind == 1 and left[x]:
                end = node
                break
            after = [("s", s) for s in members[x]] if kind == 0 else [("p", p) for p in holders[x]]
            for y in after:
                if d < dist.get(y, float("inf")):
                    dist[y], back[y] = d, node
                    heapq.heappush(heap, (d, "ps".index(y[0]), y[1]))
        if end is None:
            return sent
        path, node = [end], back[end]
        while node is not None:
            path.append(node)
            node = back[node]
        path.reverse()
        first = path[0][1]
        amount = min(left[end[1]], (price(first) + 1) * capacity[first] - used[first])
        for a, b in zip(path, path[1:]):
            if a[0] == "s":  # taken back from pattern b, which then sends elsewhere
                amount = min(amount, sent[b[1]][a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "p":
                sent[a[1]][b[1]] = sent[a[1]].get(b[1], 0) + amount
                holders[b[1]].add(a[1])
            else:
                sent[b[1]][a[1]] -= amount
                if not sent[b[1]][a[1]]:
                    holders[a[1]].discard(b[1])
        used[first] += amount
        left[end[1]] -= amount


class Plan:
    """The flow for a table and its documents' places in the seeded order. Attributes: rows (one for each document:
    _id, _size, _key, _place), spec (a tuple for each pattern and source), flows and capacity by pattern."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, sources: str, seed: int, weights: Sequence[int], max_repeats: int):
        self.spark = docs.sparkSession
        size, text = word_count(F.col(f"`{text_col}`")), F.col(f"`{text_col}`")
        rows = docs.select(F.col(f"`{id_col}`").alias("_id"), size.alias("_size"), pattern_of(docs, sources).alias("_key"), place_of(seed, F.col(f"`{id_col}`"), text).alias("_place"))
        self.rows = checkpointed(rows)
        counted = self.rows.groupBy("_key").agg(F.sum("_size").alias("n"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
        if len(counted) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns: not a catalogue of sources")
        patterns = sorted((r["_key"], json.loads(r["_key"]), int(r["n"])) for r in counted)
        #: Bits of a place that tell its bucket: as many as the largest pattern needs.
        self.bits = max((r["docs"] // BUCKET_DOCS for r in counted), default=0).bit_length()
        names = sorted({s for _, p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
        at = {s: i for i, s in enumerate(names)}
        members = [[at[s] for s in p] for _, p, _ in patterns]
        self.capacity = {k: n for k, _, n in patterns}
        sizes = [0] * len(names)
        for m, (_, _, n) in zip(members, patterns):
            for s in m:
                sizes[s] += n
        asked = [weights[i % len(weights)] for i in range(len(names))]
        shares = targets(sum(self.capacity.values()), sizes, asked, max_repeats)
        sent = route(list(self.capacity.values()), members, whole(shares), max_repeats)
        self.spec, self.flows = [], {}
        for (k, _, n), m, f in zip(patterns, members, sent):
            start = 0
            for s in m:
                self.spec.append((k, names[s], sizes[s], shares[s][0] / shares[s][1], n, start, start + f.get(s, 0)))
                start += f.get(s, 0)
            self.flows[k] = start

    def told(self, rows: DataFrame, catalogue: Sequence[tuple], ddl: str) -> DataFrame:
        """rows with what a catalogue by _key says: broadcast, so a source of a third of all documents is no task of
        its own; if its size on the driver forbids that, joined in SALTS parts of each pattern."""
        table = self.spark.createDataFrame(catalogue, f"_key string, {ddl}")
        if sum(len(str(c)) + 16 for row in catalogue for c in row) <= BROADCAST_BYTES:
            return rows.join(F.broadcast(table), "_key")
        salted = table.withColumn("_salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
        return rows.withColumn("_salt", F.pmod("_place", F.lit(SALTS))).join(salted, ["_key", "_salt"]).drop("_salt")

    def bucket(self):
        """The first bits of a place, as a number from 0: buckets are in the order of places."""
        return F.shiftrightunsigned(F.col("_place").bitwiseXOR(F.lit(-(1 << 63))), 63 - self.bits) if self.bits else F.lit(0).cast("long")

    def placed(self) -> DataFrame:
        """rows with _a, the words before the document in the seeded order of its pattern: sums over buckets, then
        inside each bucket. Rows with equal places follow each other in any order."""
        rows = self.rows.withColumn("_bucket", self.bucket())
        before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        heads = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words")).select("_key", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_head"))
        inside = Window.partitionBy("_key", "_bucket").orderBy("_place", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(heads, ["_key", "_bucket"]).withColumn("_a", F.col("_head") + F.col("_in"))


def pattern_of(docs: DataFrame, sources: str):
    """The membership pattern as JSON: a sorted list of sources; none at all is the one source null."""
    column = F.col(f"`{sources}`")
    if isinstance(docs.schema[sources].dataType, T.ArrayType):
        column = F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.array_sort(F.array_distinct(column))).otherwise(F.array(F.lit(None).cast("string")))
    else:
        column = F.array(column.cast("string"))
    return F.to_json(column, {"ignoreNullFields": "false"})


def place_of(seed: int, doc_id, text):
    """A document's place in the seeded order, by its id and text: rows of one id are apart unless they are equal."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str = "source", seed: int = 17, weights: Sequence[int] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """What the mix takes of each document and source.

    sources: a string column (one source a document; null is a source, ordered last) or an array of strings (the
    document may serve any of them; an empty or null array is the one source null). Returns a row per document and
    source it may serve: id_col, size (words; 0 for null text), source, source_size, target, taken, doc_taken.
    Null ids are kept; rows with equal ids are documents of their own. An empty table gives no rows. Columns of docs
    other than those named, whatever their names, are not read. More than MAX_PATTERNS patterns are an error.
    """
    plan = Plan(docs, id_col, text_col, sources, seed, weights, max_repeats)

    def until(x):
        """Words of the tape up to x that fall on the document, which is at _a of _cap."""
        cap = F.greatest("_cap", F.lit(1))
        part = F.greatest(F.lit(0), F.least(F.col("_size"), F.pmod(x, cap) - F.col("_a")))
        return F.when(F.col("_cap") > 0, F.floor(x / cap) * F.col("_size") + part).otherwise(0).cast("long")

    tape = [(*row, plan.flows[row[0]]) for row in plan.spec]
    out = plan.told(plan.placed(), tape, "source string, source_size long, target double, _cap long, _from long, _to long, _flow long")
    out = out.withColumn("taken", until(F.col("_to")) - until(F.col("_from"))).withColumn("doc_taken", until(F.col("_flow")))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source", "source_size", "target", "taken", "doc_taken")


def blend(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str = "source", seed: int = 17, weights: Sequence[int] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs as the mix takes them, in whole documents: each repeated as often as the tape passes its middle.

    A pattern's full passes take every document, the last pass those up to a place in the seeded order. So only the
    passes and that place, one row a pattern, are joined to the documents, which aren't shuffled. Of rows repeated in
    full at that place as many are taken as the tape passes. Columns are those of docs. Null ids, texts and sources
    are kept as mix() does; an empty table gives no rows.
    """
    plan = Plan(docs, id_col, text_col, sources, seed, weights, max_repeats)
    spec = [(k, f // plan.capacity[k] if plan.capacity[k] else 0, f % plan.capacity[k] if plan.capacity[k] else 0) for k, f in plan.flows.items()]
    reached = plan.told(plan.placed(), [(k, rest) for k, _, rest in spec], "_rest long").where("_rest > 0 and _a + _size / 2.0 <= _rest")
    last = {r["_key"]: r["_last"] for r in reached.groupBy("_key").agg(F.max(F.struct("_place", (-F.col("_a")).alias("minus"), "_size")).alias("_last")).collect()}
    edges = [(k, last[k]["_place"]) for k in last]
    there = {r["_key"]: r["n"] for r in plan.told(plan.rows, edges, "_edge long").where("_place = _edge").groupBy("_key").agg(F.count("*").alias("n")).collect()} if edges else {}

    def passed(k: str, rest: int) -> int:
        """How many of the rows at the last place the tape passes."""
        a, size = -last[k]["minus"], last[k]["_size"]
        return there[k] if not size else min(there[k], int((rest - a - size / 2) // size) + 1)

    catalogue = [(k, full, last[k]["_place"], passed(k, rest), there[k]) if k in last else (k, full, None, 0, 0) for k, full, rest in spec]
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # whatever its columns are called
    own = docs.select(whole_row, pattern_of(docs, sources).alias("_key"), place_of(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_place"))
    own = plan.told(own, catalogue, "_full long, _edge long, _passed long, _there long")
    before = F.coalesce(F.col("_place") <= F.col("_edge"), F.lit(False))
    parted = F.coalesce((F.col("_place") == F.col("_edge")) & (F.col("_passed") < F.col("_there")), F.lit(False))
    if any(row[3] < row[4] for row in catalogue):  # equal rows of one id, of which a part is taken
        number = F.row_number().over(Window.partitionBy("_key").orderBy("_place"))
        edge = own.where(parted).withColumn("_times", F.col("_full") + (number <= F.col("_passed")).cast("long"))
        own = own.where(~parted).withColumn("_times", F.col("_full") + before.cast("long")).unionByName(edge)
    else:
        own = own.withColumn("_times", F.col("_full") + before.cast("long"))
    discard(plan.rows)  # what is left to compute reads the documents and the catalogue only
    return own.where("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
