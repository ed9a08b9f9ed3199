"""What DuckDB says to the queries of this subpackage that SQL can express, in whole or by their counts."""

from __future__ import annotations

from .mixing import CYCLE, MAX_REPEATS
from .url_filter import DEVIATIONS, LIFT, RULES, STRONGEST, SUFFIXES, WEAKEST

SPACE = r"\x20\x09-\x0D"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"

# --- 1: sizes and targets. Shares stop in the order of size to weight: the water level is the first at which all that
# are still open stay below their stop.

MIXING_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, ([{", ".join(map(str, CYCLE))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(CYCLE)} + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {MAX_REPEATS} * n / w, source NULLS LAST) AS i FROM s),
c AS (SELECT *, coalesce(sum({MAX_REPEATS} * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(n) OVER () AS total FROM o),
f AS (SELECT *, (total - stopped) * w / open AS share, (total - stopped) * w / open > {MAX_REPEATS} * n AS over FROM c),
g AS (SELECT *, min(i) FILTER (NOT over) OVER () AS level_at FROM f),
l AS (SELECT *, max(CASE WHEN i = level_at THEN (total - stopped) / open END) OVER () AS level FROM g),
t AS (SELECT source, n, CASE WHEN level_at IS NULL OR i < level_at THEN {MAX_REPEATS} * n ELSE level * w END AS target FROM l)
SELECT d.doc_id, d.size, CAST(t.n AS BIGINT) AS source_size, round(t.target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

# --- 3: the counts of the base rules

SECRET_COUNTS = """
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:(?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
"""

# --- 5: the counts of the base rules

QUALITY_COUNTS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{SPACE}]') GROUP BY r),
a AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
"""

# --- 6: the edited texts

EDITED_TEXTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(text, 1, n - n // 2) || substring(other, 1, n // 2)) AS edited_sha256 FROM e
"""

# --- 7: shingles of five words, pairs by common shingles, classes by a recursive walk over the links

SETS = f"""
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND 4 UNION SELECT doc_id, array_to_string(w[i : i + 4], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
k AS (SELECT doc_id, count(*) AS size, sha256(string_agg(s, chr(10) ORDER BY s)) AS key FROM x GROUP BY doc_id)
"""
JACCARD = f"""
WITH RECURSIVE {SETS},
c AS (SELECT key, min(doc_id) AS rep, any_value(size) AS size, count(*) AS n_copies FROM k GROUP BY key),
y AS (SELECT s, doc_id FROM x WHERE doc_id IN (SELECT rep FROM c)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM y a JOIN y b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, nb.n_copies AS n FROM p JOIN c na ON p.a = na.rep JOIN c nb ON p.b = nb.rep WHERE 10 * common >= 8 * (na.size + nb.size - common)),
walk AS (SELECT rep AS node, rep AS low FROM c UNION SELECT e.b, w.low FROM walk w JOIN e ON e.a = w.node),
root AS (SELECT node, min(low) AS class_id FROM walk GROUP BY node),
links AS (SELECT a, sum(n) AS n FROM e GROUP BY a)
SELECT d.doc_id, coalesce(root.class_id, d.doc_id) AS class_id, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(c.n_copies - 1, 0) + coalesce(links.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON k.key = c.key LEFT JOIN root ON root.node = c.rep LEFT JOIN links ON links.a = c.rep
"""

# --- 9: windows of thirteen words and the least document of each

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f WHERE least < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

# --- 10: counts by level, strengths by moments, posteriors and bounds


def _level(name: str, keys: str, parent: str) -> str:
    """Units with their prior mean m, the strength of the level's prior, and the posterior."""
    return f"""
{name}0 AS (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM h GROUP BY {keys}),
{name}1 AS (SELECT u.*, {parent}),
{name}s AS (SELECT CASE WHEN rho > 0 THEN least({STRONGEST}, greatest({WEAKEST}, 1 / rho - 1)) ELSE {STRONGEST} END AS s FROM (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)), 0) / sum(n * (n - 1) * m * (1 - m)) ELSE 0 END AS rho FROM {name}1 WHERE n > 1)),
{name} AS (SELECT {keys}, m * s + k AS a, (1 - m) * s + n - k AS b FROM {name}1, {name}s)"""


HOST = r"translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '')"
NAME = r"regexp_replace(host, ':[0-9]*$', '')"
IS_NUMBER = r"regexp_full_match(host, '[0-9.:\[\]]*')"
TWO, THREE = (f"array_to_string(string_split({NAME}, '.')[-{n}:], '.')" for n in (2, 3))
LISTED = f"{TWO} IN ({', '.join(repr(x) for x in SUFFIXES)})"
DOMAIN = f"CASE WHEN {IS_NUMBER} THEN {NAME} WHEN {LISTED} THEN {THREE} ELSE {TWO} END"
SUFFIX = f"CASE WHEN {IS_NUMBER} THEN '' WHEN {LISTED} THEN {TWO} ELSE array_to_string(string_split({NAME}, '.')[-1:], '.') END"
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
RULE = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS) + " END"
RULED = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS) + " END"

URLS = rf"""
WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
o AS (SELECT host, 1 - quality AS bad FROM (SELECT host, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) AS doc_id FROM p) JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
h AS (SELECT host, {DOMAIN} AS domain, {SUFFIX} AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM o GROUP BY host),
t AS (SELECT coalesce(sum(k), 0) + 0.5 AS a, coalesce(sum(n), 0) - coalesce(sum(k), 0) + 0.5 AS b FROM h),
{_level("x", "suffix", "a / (a + b) AS m FROM x0 u, t")},
{_level("y", "suffix, domain", "x.a / (x.a + x.b) AS m FROM y0 u JOIN x USING (suffix)")},
{_level("z", "suffix, domain, host", "y.a / (y.a + y.b) AS m FROM z0 u JOIN y USING (suffix, domain)")},
q AS (SELECT host, {DOMAIN} AS domain, {SUFFIX} AS suffix FROM (SELECT DISTINCT host FROM p)),
r AS (SELECT q.host, CASE WHEN z.a IS NOT NULL THEN {{'a': z.a, 'b': z.b, 'rest': 1.0::DOUBLE}} WHEN q.host <> '' AND y.a IS NOT NULL THEN {{'a': y.a, 'b': y.b, 'rest': zs.s / (zs.s + 1)}}
    WHEN q.host <> '' AND x.a IS NOT NULL THEN {{'a': x.a, 'b': x.b, 'rest': zs.s / (zs.s + 1) * ys.s / (ys.s + 1)}} ELSE {{'a': t.a, 'b': t.b, 'rest': zs.s / (zs.s + 1) * ys.s / (ys.s + 1) * xs.s / (xs.s + 1)}} END AS v
  FROM q LEFT JOIN z ON z.host = q.host LEFT JOIN y ON y.domain = q.domain AND y.suffix = q.suffix LEFT JOIN x ON x.suffix = q.suffix, xs, ys, zs, t),
b AS (SELECT host, round(greatest(0.0, v.a / (v.a + v.b) - {DEVIATIONS} * sqrt(v.a * v.b / pow(v.a + v.b, 2) * (1 - v.rest * (v.a + v.b) / (v.a + v.b + 1)))), 6) AS bad_low FROM r)
SELECT page_id, host, path, {RULE} AS rule, coalesce({RULED}, CASE WHEN bad_low > {LIFT} * t.a / (t.a + t.b) THEN 'block' ELSE 'allow' END) AS verdict, bad_low FROM p JOIN b USING (host), t
"""

ORACLES = {
    "op7_jaccard": JACCARD,
    "op9_substrings": SUBSTRINGS,
    "op10_urls": URLS,
    "mixing_targets": MIXING_TARGETS,
    "secret_counts": SECRET_COUNTS,
    "quality_counts": QUALITY_COUNTS,
    "edited_texts": EDITED_TEXTS,
}
