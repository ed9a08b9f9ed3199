"""Exact entity resolution over a dictionary of names: no fuzzy match ever resolves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.text import tokens

CANDIDATES = 10
#: A dictionary up to so many bytes, with what a row takes besides its texts, may be broadcast.
BROADCAST_BYTES, NAME_BYTES = 8 << 20, 64


def normal(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def dictionary(names: dict[str, DataFrame]) -> DataFrame:
    """etype, value, n, key of each distinct name of one-column tables."""
    out = None
    for etype, df in names.items():
        one = df.select(F.lit(etype).alias("etype"), F.col(df.columns[0]).cast("string").alias("value")).where("value is not null").groupBy("etype", "value").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("key", normal(F.col("value")))


def exact(words: DataFrame, text: str) -> DataFrame:
    return words.where(F.col("value") == text)


def normalized(words: DataFrame, text: str) -> DataFrame:
    return words.where(F.col("key") == normal(F.lit(text)))


def partial(words: DataFrame, text: str) -> DataFrame:
    """Names that hold the text's tokens as whole consecutive words: for diagnosis only."""
    return words.where(F.concat(F.lit(" "), F.col("key"), F.lit(" ")).contains(F.concat(F.lit(" "), normal(F.lit(text)), F.lit(" "))))


def suffixed(df: DataFrame, column: str, digits: str) -> DataFrame:
    return df.where(F.col(column).endswith(digits))


def candidates(words: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    return words.orderBy("etype", "value").limit(cap)


def resolve(words: DataFrame, text: str) -> dict:
    """status resolved, ambiguous or not_found: by exact text, else by normal form; candidates of at most CANDIDATES."""
    for rule, found in (("exact", exact(words, text)), ("normalized", normalized(words, text))):
        rows = candidates(found, CANDIDATES + 1).collect()
        if rows:
            values = [(r["etype"], r["value"]) for r in rows]
            return {"status": "resolved" if len(values) == 1 else "ambiguous", "rule": rule, "candidates": values[:CANDIDATES], "more": len(values) > CANDIDATES}
    return {"status": "not_found", "rule": None, "candidates": [(r["etype"], r["value"]) for r in candidates(partial(words, text)).collect()], "more": False}


def mentions(texts: DataFrame, key: str, text: str, words: DataFrame, longest: int | None = None) -> DataFrame:
    """key, at, size, etype, value: names in many texts, the longest first and none overlapping.

    Runs of tokens are looked up by an equi-join, in every length that a name of the dictionary has (or those up to
    longest, if it's given); which of the overlapping ones stay is decided per text, and only those meet their names.
    The planner takes runs for as small as the file of their texts and would send them all through the driver, so the
    joins are told: the dictionary is broadcast if its counted bytes are few, else both sides are sorted and merged.
    """
    bytes_ = F.sum(NAME_BYTES + F.octet_length("key") + F.octet_length("etype") + F.octet_length("value"))
    held = words.where("key is not null").agg(F.collect_set(F.size(F.split("key", " "))).alias("sizes"), bytes_.alias("bytes")).first()
    how = "broadcast" if (held["bytes"] or 0) <= BROADCAST_BYTES else "merge"
    sizes = [n for n in sorted(held["sizes"]) if longest is None or n <= longest] or [1]
    runs = texts.select(key, F.xxhash64(text).alias("_text"), tokens(F.col(text)).alias("t")).select(key, "_text", F.explode(F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.struct(i.alias("at"), n.alias("size"), F.array_join(F.slice("t", i, n), " ").alias("k")))).otherwise(F.array().cast("array<struct<at:int,size:int,k:string>>"))))).alias("r"))
    found = runs.select(key, "_text", "r.at", "r.size", F.col("r.k").alias("key_")).join(words.select(F.col("key").alias("key_")).hint(how), "key_", "left_semi")
    # a text that a key has several times has each of its spans as often
    spans = found.groupBy(key, "_text").agg(F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("s"), "at", "size", "key_"))).alias("spans"), F.count("*").alias("n"))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["at"] < x["at"] + x["size"]) & (x["at"] < y["at"] + y["size"]))
    kept = F.aggregate("spans", F.array().cast("array<struct<s:int,at:int,size:int,key_:string>>"), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    each = F.flatten(F.array_repeat(kept, (F.col("n") / F.size("spans")).cast("int")))
    return spans.select(key, F.explode(each).alias("x")).select(key, "x.at", "x.size", "x.key_").join(words.select(F.col("key").alias("key_"), "etype", "value").hint(how), "key_").select(key, "at", "size", "etype", "value")


def membership(a: DataFrame, a_group: str, a_member: str, b: DataFrame, b_group: str, b_member: str) -> DataFrame:
    """k, differs: whether two sources name different members of a group."""
    left = a.groupBy(F.col(a_group).alias("k")).agg(F.sort_array(F.collect_set(a_member)).alias("ma"))
    right = b.groupBy(F.col(b_group).alias("k")).agg(F.sort_array(F.collect_set(b_member)).alias("mb"))
    none = F.array().cast("array<bigint>")
    return left.join(right, "k", "full_outer").select("k", (F.coalesce(F.col("ma").cast("array<bigint>"), none) != F.coalesce(F.col("mb").cast("array<bigint>"), none)).alias("differs"))


