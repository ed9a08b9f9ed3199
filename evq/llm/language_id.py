"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. One linear logistic classifier per bit works on hashed character n-grams;
decoding adds up the logistic losses of all bits for each codeword and takes the least. The classifiers are fitted on
the driver from a bounded sample (at most PER_LANGUAGE rows of each language and MAX_ROWS in all); everything else is
one pass in which each text is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back

#: Training rows: the most of each language and of all, and hashed features.
PER_LANGUAGE, MAX_ROWS, FEATURES = 500, 50_000, 2048
#: Below this gap between the two best languages' shares a document is ambiguous.
AMBIGUOUS = 0.2
#: Kinds of language label that train() accepts; more are an error, never left out.
MAX_LANGUAGES = 5000
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1/-1, far apart: all splits for up to 5 languages, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [[1] + [1 if (m >> i) & 1 else -1 for i in range(n - 1)] for m in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(15, int(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) if n <= 60 else (code[0] != code[1:]).sum(1).min()
        if gap > far:
            best, far = code, gap
    return best


def grams(text: str | None, features: int = FEATURES) -> np.ndarray | None:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the whole text; None if it has no letter.

    Lower case; each run of anything but letters is one break.
    """
    global _LETTERS
    if not text:
        return None
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTERS[points]
    if not letters.any():
        return None
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of each break stays
    c = np.where(letters, points, 0)[keep].astype(np.uint32)
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    h1, h2 = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
    two = h1[:-1] ^ (h2[1:] + np.uint32(0x27D4EB2F))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ h1[2:]
    shift = np.uint32(32 - int(features).bit_length() + 1)
    out = np.zeros(features)
    for h in (h1 * np.uint32(0x165667B1), two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA77)):
        n = np.bincount(h >> shift, minlength=features)
        out += n / max(1, len(h))
    return np.sqrt(out)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and the gap to the next, for each row of x."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        best = share.argmax(1)
        return best, share[np.arange(len(x)), best], order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic regressions for all bits at once by Adam; rows are weighted so that languages weigh alike."""
    code = codewords(len(languages))
    goal = code[y].astype(np.float32)
    x = x.astype(np.float32)
    weight = (1 / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        g = -goal * weight / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30)))
        for i, (p, d) in enumerate(((w, x.T @ g + ridge * w), (b, g.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            p -= 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)
    return Model(languages, code, w, b)


def sampled(rows: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """l, t: at most per_language different texts of each language l, those with the least hashes.

    Hashes are of the text, so repeated rows, equal ids and null ids are drawn like any others. A threshold on the
    hash leaves few more rows than wanted before they are counted off.
    """
    spark = rows.sparkSession
    share = spark.createDataFrame([(k, min(1.0, 2.0 * per_language / n)) for k, n in counts.items()], "l string, share double")
    drawn = rows.select("l", "t", F.xxhash64("t").alias("h")).join(F.broadcast(share), "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    each = drawn.groupBy("l", "h").agg(F.min("t").alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return each.withColumn("place", place).where(F.col("place") <= per_language).select("l", "t")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """A model of all languages from at most per_language texts of each and max_rows in all; None without usable rows.

    Rows with a null text or language don't count. More than max_languages languages are an error.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").alias("l"), F.col(f"`{text_col}`").alias("t")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: {lang_col} is no list of languages")
    if not counts:
        return None
    sample = sampled(rows, counts, max(1, min(per_language, max_rows // len(counts))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(lang, x) for lang, x in zip(b.column(0).to_pylist(), map(grams, b.column(1).to_pylist())) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())], ["l", "x"])

    got = sorted((r["l"], bytes(r["x"])) for r in sample.mapInArrow(features, "l string, x binary").collect())
    if not got:
        return None
    languages = sorted({g[0] for g in got})
    at = {lang: i for i, lang in enumerate(languages)}
    return fit(np.stack([np.frombuffer(g[1], np.float32) for g in got]), np.array([at[g[0]] for g in got]), languages)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score, ambiguous and the columns in keep, for each row.

    A null text, one without a letter, or a model that learned nothing gives und, 0.0 and ambiguous = true. Ties go to
    the language that sorts first. Repeated rows are scored alike.
    """
    schema = docs.select(*dict.fromkeys((id_col, *keep))).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounds the dense features held at once
                b = whole.slice(at, 256)
                xs = [grams(t) if model else None for t in b.column(b.num_columns - 1).to_pylist()]
                known = [i for i, x in enumerate(xs) if x is not None]
                lang, share, vague = [UNKNOWN] * len(xs), np.zeros(len(xs)), np.ones(len(xs), bool)
                if known:
                    best, s, gap = model.decode(np.stack([xs[i] for i in known]))
                    share[known], vague[known] = np.clip(s, 0, 1), gap < AMBIGUOUS
                    for i, k in zip(known, best):
                        lang[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(share), pa.array(vague)], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

        give_back()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double, ambiguous boolean"
    return docs.select(*(F.col(f"`{c}`") for c in schema.names), F.col(f"`{text_col}`").alias("__text")).mapInArrow(score, ddl)
