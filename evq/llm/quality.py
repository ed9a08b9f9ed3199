"""Quality rules: boosted trees over document statistics.

One pass over the texts gives each document's statistics; the trees are grown on the driver from a bounded sample of
labelled rows (MAX_ROWS at most) and flattened into numpy arrays, by which batches are scored. On chosen features
the score may only fall (or only rise) as the feature grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, words

#: The most labelled rows that the trees are grown on.
MAX_ROWS = 20_000
MIN_WORDS, REPEATED_PERCENT = 50, 50
#: A document is kept if its probability of being good is at least this.
KEEP_FROM = 0.35
_SYMBOLS = re.compile(r"[#*$%&|<>]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "unique_share", "top_share", "line_words", "mark_words")
#: -1: more of it may only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_share": -1}


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that lie in windows found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, window):  # exact: ranks of pairs stay below the number of words
        _, key = np.unique(key * (int(ids.max()) + 1) + ids[k : n + k], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of a whole text; a null or empty one has zeros."""
    text = text or ""
    ws = words(text)
    n = len(ws)
    if not n:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0), (0.0,) * len(FEATURES)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, n)
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    chars = len(text) - white
    symbols = len(_SYMBOLS.findall(text))
    seen: set[str] = set()
    dup = full = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            full += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(ids)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = np.bincount(raw, minlength=256)
    upper, digits, marks = kind[65:91].sum(), kind[48:58].sum(), kind[33:48].sum() + kind[58:65].sum() + kind[91:97].sum() + kind[123:127].sum()
    odd = sum(not any(97 <= c <= 122 or c >= 128 for c in w) for w in list(index))
    features = (np.log1p(n), chars / n, symbols / n, dup / max(1, full), repeat / n, upper / chars, digits / chars, marks / chars, len(index) / n, np.bincount(ids).max() / n, np.log1p(n / max(1, full)), odd / len(index))
    return (n, chars, symbols, dup, repeat), tuple(float(x) for x in features)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] <= self.limit[at], self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees for the logistic loss. A split that would break a monotonic constraint isn't made, and the leaves
    on its two sides are kept on the two sides of its middle, so that deeper splits can't break it either."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cells = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    rate_good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate_good / (1 - rate_good)))
    total = np.full(len(x), base)
    nodes: list[list[float]] = []
    roots = []

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([-1, 0.0, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            sg, sh = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = cells[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((sg - gl) / (sh - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float((vl[k] + vr[k]) / 2))
        if best[1] >= 0:
            _, j, k, mid = best
            goes = cells[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
            nodes[me][:2] = [j, float(edges[j][k])]
            nodes[me][2] = build(rows[goes], g, h, level + 1, *bounds[0])
            nodes[me][3] = build(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(build(np.arange(len(x)), y - p, p * (1 - p), 0, -np.inf, np.inf))
        table = np.array(nodes)
        total = total + np.log(1e-300 + (q := flat(table, roots[-1:], 0.0).probability(x))) - np.log(1e-300 + 1 - q)
    return flat(np.array(nodes), roots, base)


def flat(table: np.ndarray, roots: Sequence[int], base: float) -> Trees:
    return Trees(np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], base)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and the features, one row for each row of docs: whole texts, null and empty ones with zeros."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([list(g[1]) for g in got], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def train(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    """Trees from at most max_rows labelled documents, those with the least hashes; None unless both outcomes occur.

    Labels with null quality or id don't count; of an id labelled more than once each different label counts. Equal
    documents (in id, label and statistics) are one, so repeated rows and ids don't add up on the driver.
    """
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    n = labels.count()
    if n > 2 * max_rows:  # a threshold first, so that few more rows than wanted are counted off
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * (2 * max_rows / n))
    rows = measured.select("doc_id", "features").join(labels, "doc_id").withColumn("h", F.xxhash64("doc_id", "quality", "features")).dropDuplicates(["doc_id", "quality", "h"])
    got = sorted((r["doc_id"], float(r["quality"]), r["features"]) for r in rows.orderBy("h", "doc_id").limit(max_rows).collect())
    y = np.array([g[1] for g in got])
    if len(set(y.tolist())) < 2:
        return None
    return grow(np.array([g[2] for g in got]), y, [MONOTONE.get(f, 0) for f in FEATURES])


def rate(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score for each document.

    Null and empty texts have no words and so fail the base rule. Without labels of both outcomes the base rule alone
    decides (score 1.0). Repeated rows are rated alike.
    """
    measured = checkpointed(measure(docs))
    trees = train(measured, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").flatten()).reshape(b.num_rows, len(FEATURES))
            p = trees.probability(x) if trees is not None and b.num_rows else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from))
