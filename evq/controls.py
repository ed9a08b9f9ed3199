"""Queries over the driver-side rules; what is expected of them stands in their SQL as labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.plans import grounding, resolution, retrieval, routing
from evq.plans.guard import Guard, single_object_issues
from evq.sources.build import table

ROUTED = {
    "What is the total amount invested by client A1?": "investment",
    "How many investment records does client C1 have?": "investment",
    "List the deal names for client D1.": "investment",
    "What is the latest AUM for client A1?": "performance",
    "Show the latest performance snapshot for client C1.": "performance",
    "What is the IRR of client B1?": "performance",
    "What concerns were raised in client A1's meetings?": "meeting",
    "What action items were recorded for client A1?": "meeting",
    "Which meeting had the largest estimated deal size?": "meeting",
    "How many investment records and how many meetings does client B1 have?": "hybrid",
    "Which clients with AUM above 10M discussed refinancing in meetings?": "hybrid",
    "Tell me about client A1.": "ambiguous:no_intent_signals",
    "What is the total amount?": "ambiguous:weak_signal_only",
    "How many clients are Dormant?": "ambiguous:status_source_unclear",
    "What is client A1's total investment and latest MOIC?": "ambiguous:multiple_structured_sources",
    "How many meetings were held by relationship manager Priya?": "ambiguous:rm_meeting_link",
    "What is the latest return amount?": "ambiguous:conflicting_weak_signals",
}
INTENTS = {
    "What did they say about pricing in meetings?": "topical",
    "How many meetings took place in 2023?": "aggregate",
    "When was the most recent meeting?": "listing",
    "Which meetings of client A12345 happened since 2024-03-01?": "unsupported",
    "Meetings for client A12345 between 2024-01-01 and 2024-06-30": "unsupported",
}
RELATIONS = {
    "Meetings since 2026-01-01": "since:2026-01-01",
    "Meetings prior to 2024-01-01": "prior to:2024-01-01",
    "Meetings between 2023-01-01 and 2023-06-30": "between:2023-01-01",
    "Meetings on or  after 2024-05-05": "on or after:2024-05-05",
    "Meetings since March 2025": "since:March 2025",
    "Meetings after the 2024-10-25 snapshot": "after:2024-10-25",
    "What happened in the meeting on 2022-10-01?": "",
    "Meetings after its latest performance snapshot": "",
    "Who joined after the deal closed?": "",
    "How many meetings were held?": "",
}
FIELDS = {
    "What was the estimated deal size at the series B stage?": "stage,deal_size",
    "Which company?": "company",
    "Which sectors and regions?": "sector,region",
    "How many meetings were held?": "",
}
CITATIONS = {
    "1,234.5 [investments].": "",
    "1,234.5 [performance].": "unused_source:performance",
    "Raised once [meeting: 7, 2024-01-02].": "",
    "Raised once [Meeting: 7 , 2024-01-02].": "",
    "Raised once [meeting: 7, 2024-01-01].": "bad_citation:7",
    "Raised once [meeting: 8, 2024-01-02].": "bad_citation:8",
    "Raised once [meeting 7].": "malformed_citation:meeting 7",
    "Raised [sic] once.": "",
}
STATEMENTS = {
    "SELECT count(*) AS n FROM orders_view": "ok",
    "WITH t AS (SELECT client FROM orders_view) SELECT count(*) AS n FROM t": "ok",
    "SELECT client, rank() OVER (ORDER BY amount) AS r FROM orders_view": "ok",
    "": "empty_sql",
    "SELECT 'a FROM orders_view": "unbalanced_quotes",
    "SELECT 1 -- hidden": "comment_not_allowed",
    "SELECT 1; SELECT 2": "multiple_statements",
    "DELETE FROM orders_view": "forbidden_keyword,not_a_select",
    "WITH orders_view AS (SELECT 1 AS x) SELECT x FROM orders_view": "cte_name_collision",
    "SELECT * FROM secrets": "unauthorized_table",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') AS x FROM orders_view": "unauthorized_function",
    "SELECT ntile(4) OVER (ORDER BY amount) AS x FROM orders_view": "unauthorized_function",
    "SELECT hidden FROM orders_view": "unauthorized_column",
    "SELECT * FROM parquet.`/etc/passwd`": "unauthorized_table",
    "SELECT java_method ('java.lang.System', 'getProperty', 'user.home') AS x FROM orders_view": "unauthorized_function",
    "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home') AS x FROM orders_view": "unauthorized_function",
    "SELECT \"reflect\"('java.lang.System', 'getProperty', 'user.home') AS x FROM orders_view": "unauthorized_function",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM orders_view": "unauthorized_function",
    "SELECT client FROM orders_view WHERE amount > (SELECT max(length(java_method ('java.lang.System', 'getProperty', 'user.home'))) FROM orders_view)": "unauthorized_function",
    "SELECT current_user FROM orders_view": "unauthorized_function",
    "SELECT session_user, client FROM orders_view": "unauthorized_function",
    "SELECT TRANSFORM(client) USING 'cat' AS c FROM orders_view": "unauthorized_function",
    "SELECT * FROM orders_view LATERAL VIEW explode (array(1)) e AS c": "unauthorized_function",
    "SELECT id FROM range (5)": "unauthorized_table",
    "SELECT client FROM default.orders_view": "unauthorized_table",
    "SELECT typeof(client) AS t FROM orders_view": "unauthorized_function",
    "SELECT CAST(client AS decimal(10,2)) AS c FROM orders_view": "ok",
    "SELECT total(amount) AS t, iif(count(*) > 1, 'many', 'one') AS n FROM orders_view": "ok",
    "SELECT strftime('%W', day) AS w FROM orders_view": "unsupported_format",
    "SELECT client FROM orders_view WHERE deal_name LIKE 'x%'": "like_on_deal_name",
    "SELECT client FROM orders_view WHERE lower(deal_name) LIKE 'x%'": "like_on_deal_name",
    "SELECT client FROM orders_view WHERE deal_name = 'x' AND day LIKE '1%'": "ok",
}
SINGLE = {
    "SELECT count(*) AS n FROM orders_view": "",
    "SELECT count(*) AS n FROM orders_view a JOIN orders_view b ON a.client = b.client": "join_not_allowed",
    "SELECT count(*) AS n FROM orders_view a, orders_view b": "join_not_allowed",
    "SELECT count(*) AS n FROM orders_view WHERE client IN (SELECT client FROM more_view)": "join_not_allowed",
}
ANSWERS = {
    "The total is 1,234.5 [investments].": "",
    "The total is 1.2 thousand [investments].": "",
    "The total is 1,300 [investments].": "ungrounded_number:1300",
    "It was raised on 2024-02-30 [investments], 1234.5 in all.": "ungrounded_date:2024-02-30",
    "The total is 1234.5.": "missing_citation:investments",
    "No data was found [investments].": "denies_evidence",
    "See [meeting: 7, 2024-01-01] [investments].": "bad_citation:7",
}


#: type or context, form, source, value, said: a small dictionary, with what it must say to names and questions.
NAMED = [
    *(("client", "client_id", "investments", c, c) for c in ("A12345", "B12345")), ("client", "client_id", "meetings", "A12345", "A12345"), ("client", "client_id", "meetings", "C12345", "C12345"),
    ("client", "client_name", "investments", "A12345", "Client_A12345"), ("deal_id", "deal_id", "investments", "DL100001", "DL100001"),
    ("rm", "account_rm", "investments", "Ann Lee", "Ann Lee"), ("rm", "account_rm", "investments", "Ann Lee Moss", "Ann Lee Moss"), ("attendee", "attendee", "meetings", "Ann Lee", "Ann Lee"), ("company", "company", "meetings", "Blue Fir", "Blue Fir"),
]
NAMES = {
    "A12345": "resolved:A12345:exact", "client a12345": "resolved:A12345:normalized", "12345": "ambiguous::numeric_suffix", "54321": "not_found::numeric_suffix", "A99999": "not_found::no_match",
    "DL100001": "resolved:DL100001:exact", "ann LEE": "resolved:Ann Lee:normalized", "Lee": "ambiguous::partial", "Blue Fir": "not_found::meeting_text", "group 7": "resolved:7:exact", "group 9": "not_found::no_match",
}
MENTIONED = {
    "Did Ann Lee Moss meet A12345?": "Ann Lee Moss,A12345",
    "Group 7 or 12345 on private equity": "Group 7,12345",
    "Who asked D77777 about Blue Fir?": "D77777,Blue Fir",
    "Nothing named here": "",
}
#: source and question: what the gate says before evidence is read.
GATED = {
    "investments: total of A12345": "open", "investments: total of C12345": "no_data", "performance: AUM of Ann Lee Moss": "no_data", "meetings: of Ann Lee Moss": "unsupported", "meetings: on DL100001": "unsupported",
    "meetings: of 12345": "clarification_needed", "meetings: of D77777": "entity_not_found", "meetings: with Blue Fir": "open", "investments: of Blue Fir": "entity_not_found",
}
DERIVED = {
    'What did they say about "capital calls" and hedging?': "hedging|capital calls||",
    "Action items on pricing from 2024-05-01": "pricing||2024-05-01|actions",
    "List the meetings": "|||",
    "Which \"x\" was raised about fees": "fees|||",
}


def values(rows: dict[str, str], key: str, value: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({quote(k)}, {quote(v)})' for k, v in rows.items())}) t({key}, {value})"


def route_questions(spark, d):
    got = [(q, r.route if r.route != routing.AMBIGUOUS else f"{r.route}:{r.rule}") for q in ROUTED for r in [routing.route(q)]]
    return spark.createDataFrame(got, "question string, route string")


def intent_questions(spark, d):
    return spark.createDataFrame([(q, routing.intent(q)) for q in INTENTS], "question string, intent string")


def orders_view(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderpriority").alias("deal_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def guard_verdicts(spark, d):
    guard = Guard(spark, {"orders_view": orders_view(spark, d)})
    got = [(s, ",".join(sorted(v.issues)) or "ok") for s in STATEMENTS for v in [guard.validate(s)]]
    return spark.createDataFrame(got, "statement string, verdict string")


def guard_execute(spark, d):
    got = Guard(spark, {"orders_view": orders_view(spark, d)}).execute("SELECT client, count(*) AS n FROM orders_view GROUP BY client ORDER BY n DESC, client")
    return spark.createDataFrame([(*r, got["truncated"]) for r in got["rows"]], "client long, n long, truncated boolean")


def single_object(spark, d):
    guard = Guard(spark, {"orders_view": orders_view(spark, d), "more_view": orders_view(spark, d)})
    return spark.createDataFrame([(s, ",".join(single_object_issues(guard.validate(s)))) for s in SINGLE], "statement string, issues string")


def guarded(statement: str):
    """A query for what a statement gives behind the guard, without its cap."""

    def run(spark, d):
        verdict = Guard(spark, {"orders_view": orders_view(spark, d)}).validate(statement)
        if not verdict.ok:
            raise ValueError(f"{statement}: {verdict.issues}")
        return verdict.df

    return run


DAY = "CAST(o_orderdate AS DATE)"
#: Statements with functions of the accepted dialect, and DuckDB's way to say the same.
DIALECT = {
    "sql_total": ("SELECT client, total(round(amount)) AS t, total(round(amount)) FILTER (WHERE amount < 0) AS none FROM orders_view GROUP BY client", "SELECT o_custkey AS client, sum(round(o_totalprice)) AS t, 0.0::DOUBLE AS none FROM orders GROUP BY 1"),
    "sql_iif": ("SELECT id, iif(amount > 100000, 'big', ifnull(nullif(status, 'O'), 'open')) AS size FROM orders_view", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS size FROM orders"),
    "sql_strftime": ("SELECT strftime('%Y-%m', day) AS month, strftime('%d.%m.%Y %H', day, '+1 day') AS next, count(*) AS n FROM orders_view GROUP BY 1, 2", f"SELECT strftime({DAY}, '%Y-%m') AS month, strftime({DAY} + INTERVAL 1 DAY, '%d.%m.%Y %H') AS next, count(*) AS n FROM orders GROUP BY 1, 2"),
    "sql_date": (
        "SELECT id, date(day, '-90 days') AS back, date(day, '+1 month') AS on_, date(day, 'start of month', '-1 day') AS before FROM orders_view",
        f"SELECT o_orderkey AS id, strftime({DAY} - INTERVAL 90 DAY, '%Y-%m-%d') AS back, strftime(date_trunc('month', {DAY}) + INTERVAL 1 MONTH + INTERVAL (day({DAY}) - 1) DAY, '%Y-%m-%d') AS on_, strftime(date_trunc('month', {DAY}) - INTERVAL 1 DAY, '%Y-%m-%d') AS before FROM orders",
    ),
    "sql_group_concat": ("SELECT client, group_concat(DISTINCT status) AS every, group_concat(status, ';') FILTER (WHERE status = 'F') AS f FROM orders_view GROUP BY client", "SELECT o_custkey AS client, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS every, string_agg(o_orderstatus, ';') FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1"),
    "sql_glob": ("SELECT id, priority GLOB '[1-3]-*' AS high, glob('?-LOW', priority) AS low, status LIKE 'f' AS f FROM orders_view", "SELECT o_orderkey AS id, o_orderpriority GLOB '[1-3]-*' AS high, o_orderpriority GLOB '?-LOW' AS low, lower(o_orderstatus) = 'f' AS f FROM orders"),
    "sql_division": ("SELECT id, id / 7 AS whole, (id + 1) / 2 * 3 AS chain, amount / 4 AS real, id / 0 AS none, id % 7 AS rest FROM orders_view", "SELECT o_orderkey AS id, (o_orderkey // 7)::DOUBLE AS whole, ((o_orderkey + 1) // 2)::DOUBLE * 3 AS chain, o_totalprice / 4 AS real, NULL::DOUBLE AS none, o_orderkey % 7 AS rest FROM orders"),
    "sql_text": ("SELECT id, substr(priority, 0, 3) AS a, substr(priority, -3, 2) AS b, substring(priority, 3) AS c, trim(priority, '1W') AS d, ltrim(priority, '12345-') AS e, instr(priority, '-') AS f, upper(lower(status)) AS g, length(priority) AS h FROM orders_view",
                 "SELECT o_orderkey AS id, substr(o_orderpriority, 1, 2) AS a, substr(right(o_orderpriority, 3), 1, 2) AS b, substr(o_orderpriority, 3) AS c, trim(o_orderpriority, '1W') AS d, ltrim(o_orderpriority, '12345-') AS e, CAST(instr(o_orderpriority, '-') AS INT) AS f, o_orderstatus AS g, CAST(length(o_orderpriority) AS INT) AS h FROM orders"),
    "sql_extremes": ("SELECT id, max(id, client) AS high, min(id, client, 100) AS low, max(id, nullif(client, client)) AS none, round(amount, 1) AS r, abs(-id) AS p, coalesce(nullif(status, 'F'), '-') AS s FROM orders_view", "SELECT o_orderkey AS id, greatest(o_orderkey, o_custkey) AS high, least(o_orderkey, o_custkey, 100) AS low, NULL::BIGINT AS none, round(o_totalprice, 1) AS r, o_orderkey AS p, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_orderstatus END AS s FROM orders"),
    "sql_average": ("SELECT client, avg(id) AS a, count(DISTINCT status) AS n FROM orders_view GROUP BY client", "SELECT o_custkey AS client, avg(o_orderkey) AS a, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1"),
}


def number_grounding(spark, d):
    got = [(a, ",".join(grounding.validate(a, ["investments"], [(1234.5,)]).reasons)) for a in ANSWERS]
    return spark.createDataFrame(got, "answer string, reasons string")


def term_audit(spark, d):
    kept, left = routing.terms("What did client A1 say about hedging costs in the last meeting?", ("client A1",))
    return spark.createDataFrame([(",".join(kept), ",".join(left))], "kept string, left_out string")


def date_relation(spark, d):
    return spark.createDataFrame([(q, ":".join(routing.date_relation(q) or ())) for q in RELATIONS], "question string, relation string")


def requested_fields(spark, d):
    return spark.createDataFrame([(q, ",".join(routing.requested_fields(q))) for q in FIELDS], "question string, fields string")


def citation_check(spark, d):
    got = [(a, ",".join(grounding.citations(a, ["investments"], {7: "2024-01-02"})[1])) for a in CITATIONS]
    return spark.createDataFrame(got, "answer string, issues string")


def resolver(spark, d):
    told = spark.createDataFrame(NAMED, "etype string, form string, source string, value string, said string")
    parts = [(e, f, s, told.where((F.col("etype") == e) & (F.col("form") == f) & (F.col("source") == s)).select("value", "said")) for e, f, s in dict.fromkeys(n[:3] for n in NAMED)]
    members = spark.createDataFrame([("investments", 7, "A12345"), ("meetings", 7, "C12345")], "source string, group_id int, client string")
    return resolution.Resolver(resolution.dictionary(parts).cache(), members)


def resolve_names(spark, d):
    known = resolver(spark, d)
    got = [(t, f"{r.status}:{r.canonical or ''}:{r.rule}") for t in NAMES for r in [known.resolve(t)]]
    return spark.createDataFrame(got, "said string, resolution string")


def question_mentions(spark, d):
    known = resolver(spark, d)
    return spark.createDataFrame([(q, ",".join(m.text for m in known.in_question(q))) for q in MENTIONED], "question string, mentions string")


def entity_gates(spark, d):
    known = resolver(spark, d)
    got = [(q, resolution.gate(known.in_question(q.partition(": ")[2]), q.partition(":")[0]).outcome) for q in GATED]
    return spark.createDataFrame(got, "question string, outcome string")


def derived_terms(spark, d):
    got = [(q, "|".join((",".join(a.terms), ",".join(a.phrases), a.day or "", "actions" if a.actions else ""))) for q in DERIVED for a in [retrieval.asked(q)]]
    return spark.createDataFrame(got, "question string, derived string")


QUERIES = {
    "resolve_names": (resolve_names, values(NAMES, "said", "resolution")),
    "question_mentions": (question_mentions, values(MENTIONED, "question", "mentions")),
    "entity_gates": (entity_gates, values(GATED, "question", "outcome")),
    "derived_terms": (derived_terms, values(DERIVED, "question", "derived")),
    "date_relation": (date_relation, values(RELATIONS, "question", "relation")),
    "requested_fields": (requested_fields, values(FIELDS, "question", "fields")),
    "citation_check": (citation_check, values(CITATIONS, "answer", "issues")),
    "route_questions": (route_questions, values(ROUTED, "question", "route")),
    "intent_questions": (intent_questions, values(INTENTS, "question", "intent")),
    "guard_verdicts": (guard_verdicts, values(STATEMENTS, "statement", "verdict")),
    "guard_execute": (guard_execute, "SELECT o_custkey AS client, count(*) AS n, true AS truncated FROM orders GROUP BY 1 ORDER BY n DESC, client LIMIT 50"),
    "single_object": (single_object, values(SINGLE, "statement", "issues")),
    "number_grounding": (number_grounding, values(ANSWERS, "answer", "reasons")),
    "term_audit": (term_audit, "SELECT 'hedging,costs' AS kept, 'what,did,say,about,in,the,last,meeting' AS left_out"),
}
QUERIES |= {name: (guarded(statement), sql) for name, (statement, sql) in DIALECT.items()}
