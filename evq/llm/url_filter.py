"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards its registered domain's, a
domain's towards its suffix's and a suffix's towards the overall rate, each through a beta-binomial prior whose
strength is fitted to that level's counts by moments. A page is blocked if its host's bad rate is credibly above the
overall rate: the lower posterior bound exceeds LIFT times that rate, unless a rule decides. A host without labelled
pages has the bound of the nearest level above it that has some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpointed

#: Rules of the query: host, start of the path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A host is blocked where, with this many standard deviations to spare (a one-sided 95 %), its rate of bad pages is above
#: this many times the overall rate. The limit moves with the labels: what share of pages is called bad is theirs to say.
LIFT, DEVIATIONS = 1.0, 1.645
#: Prior strengths lie between these numbers of pages.
WEAKEST, STRONGEST = 2.0, 200.0
#: Suffixes of two labels under which domains are registered. A parameter: pass a longer list at will.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
#: Entries of the suffix level that are broadcast; more are joined by an exchange.
MOST_SUFFIXES = BROADCAST_BYTES // 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    """From behind the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


NUMERIC, PORT = r"\A[0-9.:\[\]]*\z", r":[0-9]*\z"


def named(host):
    """The host without its port."""
    return F.regexp_replace(host, PORT, "")


def suffix_of(host, suffixes: Sequence[str] = SUFFIXES):
    """The last label, or the last two if they are one of suffixes; an address of digits has the suffix empty."""
    name = named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(host.rlike(NUMERIC), F.lit("")).when(two.isin(list(suffixes)), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host, suffixes: Sequence[str] = SUFFIXES):
    """The registered domain: the suffix and one label more; an address of digits and dots is its own domain."""
    name = named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(host.rlike(NUMERIC), name).when(two.isin(list(suffixes)), F.substring_index(name, ".", -3)).otherwise(two)


def rule_for(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """The longest rule that fits, as a struct of its name and verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def strength(level: DataFrame, parent: str) -> float:
    """Strength of the beta prior, in pages, that fits the spread of a level's rates around their parent's.

    Moments: E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) / (s + 1)), summed over the units.
    """
    m = F.col(parent)
    r = level.where("n > 1").agg(
        F.sum(F.pow(F.col("k") - F.col("n") * m, 2) - F.col("n") * m * (1 - m)).alias("extra"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("scale"),
    ).first()
    rho = (r["extra"] or 0.0) / r["scale"] if r["scale"] else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def levels(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> tuple[dict[str, DataFrame], dict[str, float], tuple[float, float], int]:
    """By level (suffix, domain, host): its units with n, k and their posterior's a, b; the strength of its prior. Then a and b of all pages, and about how many suffixes there are.

    outcomes: host, bad (0 or 1; null rows don't count). One row a host or less is shuffled at each level. The suffix
    level is broadcast if its size allows, so a suffix of a third of all hosts is no task of its own.
    """
    hosts = checkpointed(outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
                         .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    top = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.approx_count_distinct("suffix").alias("s")).first()
    a, b = (top["k"] or 0) + 0.5, (top["n"] or 0) - (top["k"] or 0) + 0.5
    chain, found, strengths = None, {}, {}
    for unit, keys in (("suffix", ["suffix"]), ("domain", ["suffix", "domain"]), ("host", ["suffix", "domain", "host"])):
        level = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        level = level.withColumn("m", F.lit(a / (a + b))) if chain is None else level.join(few(chain, top["s"]) if unit == "domain" else chain, keys[:-1])
        s = strengths[unit] = strength(level, "m")
        found[unit] = level = level.withColumns({"a": F.col("m") * s + F.col("k"), "b": (1 - F.col("m")) * s + F.col("n") - F.col("k")})
        chain = level.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    return found, strengths, (a, b), top["s"]


def few(level: DataFrame, n: int) -> DataFrame:
    """A level of about n units, to be broadcast if they are few."""
    return F.broadcast(level) if n < MOST_SUFFIXES else level


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, a, b: labelled pages, bad ones, and the beta posterior of each labelled host."""
    return levels(outcomes)[0]["host"].select("host", "n", "k", "a", "b")


def lower_bounds(hosts: DataFrame, outcomes: DataFrame, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES) -> tuple[DataFrame, float]:
    """host, bad_low (six decimals) of each distinct host: the lower bound of its bad rate by the nearest level that
    has outcomes; and the overall rate.

    A host without labelled pages is drawn from the priors below that level: given a mean m with posterior a, b its
    variance is m (1 - m) (1 - product of s / (s + 1)), s being a + b and the strength of each level below. An empty
    host is of no domain and no suffix.
    """
    found, strengths, (a, b), n_suffixes = levels(outcomes, suffixes)
    has_name = F.col("host") != ""
    rows = hosts.select("host").distinct().withColumns({"domain": F.when(has_name, domain_of(F.col("host"), suffixes)), "suffix": F.when(has_name, suffix_of(F.col("host"), suffixes))})
    posterior = F.lit(None).cast("struct<a:double,b:double,rest:double>")
    rest = 1.0
    for unit, keys in (("host", ["host"]), ("domain", ["suffix", "domain"]), ("suffix", ["suffix"])):
        told = found[unit].select(*keys, F.struct("a", "b", F.lit(rest).alias("rest")).alias(f"by_{unit}"))
        rows = rows.join(few(told, n_suffixes) if unit == "suffix" else told, keys, "left")
        posterior = F.coalesce(posterior, F.col(f"by_{unit}"))
        rest *= strengths[unit] / (strengths[unit] + 1)
    posterior = F.coalesce(posterior, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(rest).alias("rest")))
    size = F.col("p.a") + F.col("p.b")
    mean = F.col("p.a") / size
    spread = F.sqrt(mean * (1 - mean) * (1 - F.col("p.rest") * size / (size + 1)))
    return rows.select("host", posterior.alias("p")).select("host", F.round(F.greatest(F.lit(0.0), mean - deviations * spread), 6).alias("bad_low")), a / (a + b)


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lift: float = LIFT, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_low: one row for each page, whatever its url.

    A null url, or one without ://, has an empty host and path; no rule fits it. Hosts without labelled pages are
    judged by their domain, else their suffix, else all pages (which blocks nothing). Repeated rows are judged alike;
    other columns of pages aren't read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hit = rule_for(F.col("host"), F.col("path"), rules)
    low, overall = lower_bounds(rows, outcomes, deviations, suffixes)
    return rows.join(low, "host", "left").withColumn("hit", hit).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("bad_low") > lift * overall, "block").otherwise("allow")).alias("verdict"),
        "bad_low",
    )
