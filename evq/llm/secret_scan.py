"""Secret scans with DataFrame functions only: fixed patterns, then character Markov models.

Two first-order models over the characters of a token, one of random strings and one of ordinary identifiers, are
counted from labelled samples. A token of the text is a secret too if the mean log-likelihood ratio of its steps is
above a limit. The counts are one small table (an alphabet squared), which the driver turns into a literal array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base rules. For access and hex the least length is part of the pattern, which
# finds the same spans as the open pattern with short ones dropped: both are runs that start where the pattern starts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Tokens the models look at, and the mean log-likelihood ratio of a secret's steps.
TOKEN, LIMIT = r"[A-Za-z0-9+/_=.-]{20,}", 0.5
#: Random strings made for training, and documents (expected) whose words are the ordinary identifiers.
RANDOM_STRINGS, ORDINARY_DOCS = 3000, 1000


def samples(spark: SparkSession, docs: DataFrame, n_random: int = RANDOM_STRINGS, n_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled samples: token, random (1 or 0).

    Random: digests in hex, base 64 and 36, made from numbers. Ordinary: the words of about n_docs documents, chosen
    by a hash of the text, without those that the patterns match or that have 3 digits, and joined ones of them.
    """
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    made = spark.range(n_random).select(F.explode(F.array(digest, F.base64(F.unhex(digest)), F.concat(*(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 36) for i in range(4))))).alias("token"), F.lit(1).alias("random"))
    n = docs.select(F.count("*")).first()[0]
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, n_docs / max(1, n)))))
    word = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=.-]{4,}"), F.lit(0))).alias("token")).where(~F.col("token").rlike(r"[0-9].*[0-9].*[0-9]") & ~F.col("token").rlike(HEX))
    path = F.concat_ws("_", F.col("token"), F.reverse(F.lower("token")))
    return made.unionByName(word.select("token", F.lit(0).alias("random"))).unionByName(word.select(F.when(F.length("token") > 6, path).alias("token"), F.lit(0).alias("random")).where("token is not null"))


def train(labelled: DataFrame, prior: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all steps between two characters of ALPHABET, row by row."""
    chars = F.split("token", "")
    steps = labelled.where("length(token) > 1 and random is not null").select(
        F.col("random").cast("int").alias("random"),
        F.explode(F.arrays_zip(F.slice(chars, 1, F.length("token") - 1).alias("a"), F.slice(chars, 2, F.length("token") - 1).alias("b"))).alias("s"),
    )
    at = {c: i for i, c in enumerate(ALPHABET)}
    n = len(ALPHABET)
    counts = [[[prior] * n for _ in range(n)] for _ in range(2)]
    known = F.lit(ALPHABET)
    for r in steps.select("random", "s.a", "s.b").where(F.contains(known, F.col("a")) & F.contains(known, F.col("b"))).groupBy("random", "a", "b").count().collect():
        if r["a"] in at and r["b"] in at and r["random"] in (0, 1):
            counts[r["random"]][at[r["a"]]][at[r["b"]]] += r["count"]
    return [math.log(counts[1][i][j] / sum(counts[1][i])) - math.log(counts[0][i][j] / sum(counts[0][i])) for i in range(n) for j in range(n)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the steps of a token whose characters are all in ALPHABET."""
    ratios = F.split(F.lit(",".join(f"{x:.3f}" for x in table)), ",").cast("array<double>")  # folded into one literal
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(place, 1, F.length(token) - 1), F.slice(place, 2, F.length(token) - 1), lambda a, b: F.get(ratios, a * len(ALPHABET) + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.length(token) - 1)


def found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, kind, end, token; code points, end exclusive.

    What lies between the matches and the matches themselves alternate, so their lengths add up to the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), tokens.alias("token"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    walked = F.aggregate(
        F.slice(parts, 1, F.size(matches)),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["match"])).alias("at"), F.array_append(acc["spans"], F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["token"].alias("token"))).alias("spans")),
    )["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def scan(docs: DataFrame, table: list[float], limit: float = LIMIT) -> DataFrame:
    """row (a struct of docs' columns, whatever their names), text, base (array of spans start, kind, end, token) and
    spans (base and the models', in order).

    kind is a place in KINDS; spans are ordered by start, then kind. A null or empty text has no spans. The models'
    spans are the parts of their tokens that lie outside the base ones. Rows are scanned each by itself, repeated
    ones alike; an empty table gives none. Nothing is shuffled.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(found(text, ASSIGN, 0, 2), lambda s: F.length(s["token"]) >= ASSIGN_LEAST)
    out = rows.withColumn("base", F.array_sort(F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2))))
    more = F.filter(found(text, TOKEN, 3), lambda s: ratio(s["token"], table) > limit)
    return out.withColumn("spans", F.array_sort(F.concat("base", F.flatten(F.transform(more, lambda s: outside(s, F.col("base")))))))


def outside(span: Column, base: Column) -> Column:
    """The parts of a span that no base span covers; base is ordered by start."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def part(start: Column, end: Column) -> Column:
        text = F.substring(span["token"], start - span["start"] + 1, end - start)
        return F.when(start < end, F.array(F.struct(start.alias("start"), span["kind"].alias("kind"), end.alias("end"), text.alias("token")))).otherwise(none)

    touching = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(
        touching,
        F.struct(span["start"].alias("at"), none.alias("parts")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["parts"], part(acc["at"], b["start"])).alias("parts")),
        lambda acc: F.concat(acc["parts"], part(acc["at"], span["end"])),
    )


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: what scan() found, one row for each row of docs."""
    rows = scan(docs.select("doc_id", "text"), table)

    def count(kind: int) -> Column:  # a lambda's second parameter would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select("row.doc_id", *map(count, range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, table: list[float], mark: str = "[secret]") -> DataFrame:
    """docs with each span of text (overlapping ones together) replaced by the mark; other columns as they are.

    Texts without spans, null and empty ones too, stay as they are.
    """
    rows = scan(docs, table)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])),
    )
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
