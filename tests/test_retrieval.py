"""Entities, gates and meeting retrieval on small fixtures."""

import pytest
from pyspark.sql import functions as F

from evq.operators import search_index, vectors
from evq.plans import resolution as R
from evq.plans import retrieval, routing


@pytest.fixture(scope="module")
def resolver(spark):
    def frame(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    clients = [("A12345", "Client_A12345"), ("B12345", "Client_B12345"), ("A1", "Client_A1")]
    parts = [
        ("client", "client_id", "investments", frame([(c, c) for c, _ in clients], "value string, said string")),
        ("client", "client_name", "investments", frame(clients, "value string, said string")),
        ("client", "client_id", "meetings", frame([("C12345", "C12345"), ("A12345", "A12345")], "value string, said string")),
        ("client", "client_id", "performance", frame([("A12345", "A12345")], "value string, said string")),
        ("deal_id", "deal_id", "investments", frame([("DL100001", "DL100001")], "value string, said string")),
        ("deal_name", "of_deal", "investments", frame([("DL100001", "North Harbour I"), ("DL100001", "North Harbour II")], "value string, said string")),
        ("rm", "account_rm", "investments", frame([("Ann Lee", "Ann Lee"), ("Ann Lee Moss", "Ann Lee Moss")], "value string, said string")),
        ("attendee", "attendee", "meetings", frame([("Ann Lee", "Ann Lee"), *((f"Quinn {i:02d}", f"Quinn {i:02d}") for i in range(14))], "value string, said string")),
        ("company", "company", "meetings", frame([("Blue Fir", "Blue Fir")], "value string, said string")),
    ]
    members = frame([("investments", 7, "A12345"), ("meetings", 7, "A12345"), ("meetings", 7, "C12345"), ("investments", 8, "B12345")], "source string, group_id int, client string")
    return R.Resolver(R.dictionary(parts).cache(), members)


def test_typed_and_untyped(resolver):
    cases = {
        ("A12345", "client"): ("resolved", "A12345", "exact"), ("client_a12345", "client"): ("resolved", "A12345", "normalized"), ("A99999", "client"): ("not_found", None, "no_match"),
        ("12345", None): ("ambiguous", None, "numeric_suffix"), ("99999", "client"): ("not_found", None, "numeric_suffix"), ("group 7", None): ("resolved", "7", "exact"), ("Group #8", None): ("resolved", "8", "exact"),
        ("group 9", "group"): ("not_found", None, "no_match"), ("DL100001", None): ("resolved", "DL100001", "exact"), ("ann  LEE", "rm"): ("resolved", "Ann Lee", "normalized"), ("ann.lee@x.org", "rm"): ("not_found", None, "non_authoritative"),
        ("Lee", "rm"): ("ambiguous", None, "partial"), ("Blue Fir", None): ("not_found", None, "meeting_text"), ("Quinn", None): ("ambiguous", None, "partial"), ("Zed", None): ("not_found", None, "no_match"), ("D00001", None): ("not_found", None, "no_match"),
    }
    got = {k: resolver.resolve(*k) for k in cases}
    assert {k: (r.status, r.canonical, r.rule) for k, r in got.items()} == cases
    assert [v for _, v in got["12345", None].candidates] == ["A12345", "B12345", "C12345"]
    assert len(got["Quinn", None].candidates) == 10 and got["Quinn", None].more == 4 and got["Quinn", None].contexts == (("attendee", 14),) and got["Quinn", None].text_only
    assert got["A12345", "client"].sources == ("investments", "meetings", "performance") and got["A12345", "client"].forms == ("client_id",)
    assert got["group 7", None].detail("membership_differs") == "true" and got["Group #8", None].detail("membership_differs") == "false"
    assert got["ann  LEE", "rm"].detail("also") == "attendee" and got["D00001", None].etype == "client"


def test_mentions(resolver):
    got = resolver.in_question("Did Ann Lee Moss of group 7 meet client A12345, D77777 or 12345 on private equity? Ask x@y.org")
    assert [(m.text, m.resolution.status) for m in got] == [("Ann Lee Moss", "resolved"), ("group 7", "resolved"), ("client A12345", "resolved"), ("D77777", "not_found"), ("12345", "ambiguous"), ("x@y.org", "not_found")]
    assert resolver.capitalised("What did Mister Grey say to Blue Fir about Private Equity?") == ["Mister Grey"]


def test_gates(resolver):
    def gate(q, source, search=False):
        g = R.gate(resolver.in_question(q), source, search)
        return g.outcome, g.code

    assert gate("total of A12345", "investments") == ("open", "")
    assert gate("total of C12345", "investments") == ("no_data", "no_data_for_entity")
    assert gate("total of B12345", "performance") == ("no_data", "no_data_for_entity")
    assert gate("AUM of Ann Lee Moss", "performance") == ("no_data", "not_in_source")
    assert gate("meetings of Ann Lee Moss", "meetings") == ("unsupported", "rm_meeting_link")
    assert gate("meetings on DL100001", "meetings") == ("unsupported", "deal_not_in_meetings") and gate("meetings on DL100001", "meetings", True)[0] == "open"
    assert gate("meetings of 12345", "meetings") == ("clarification_needed", "ambiguous_entity") and gate("meetings of D77777", "meetings") == ("entity_not_found", "entity_not_found")
    assert gate("meetings with Blue Fir", "meetings")[0] == "open" and gate("records of Blue Fir", "investments")[0] == "entity_not_found"
    assert R.gate(resolver.in_question("group 7 and A12345"), "investments").constraints == (("group_id", "7"), ("client_id", "A12345"))
    assert [R.evidence_state(o) for o in ("ok", "no_meeting_data", "no_terms", "unsupported_rm", "timeout")] == ["evidence", "no_data", "clarification", "unsupported", "error"]
    assert R.applied_rules("performance", ["performance_latest"]) == ("multiples_as_numbers", "latest_of_each_client", "read_only_one_source")


@pytest.fixture(scope="module")
def meetings(spark, tmp_path_factory):
    rows = [(i, "A12345" if i < 6 else "C12345", 7, f"2024-01-{i:02d}", t, a) for i, (t, a) in enumerate([
        ("Hedging costs came up. Refinancing was put off.", "send hedging paper"), ("Café visit, nothing on costs.", None), ("Café again: hedging, hedging.", None), ("Pricing of the fund.", "call about pricing"),
        ("Pricing of the fund.", None), ("Pricing of the fund.", None), ("Hedging for others.", None)], 1)]
    df = spark.createDataFrame(rows, "id int, client_id string, group_id int, day string, text string, actions string")
    path = str(tmp_path_factory.mktemp("index"))
    assert search_index.read(spark, path) is None
    search_index.write(df, "id", ["text", "actions"], path, 2)
    return retrieval.Search(search_index.read(spark, path), df, "id", {"text": 1.0, "actions": 0.1}, "text", "actions")


def test_retrieval(meetings, resolver, spark):
    def ask(q, **more):
        return meetings.retrieve(q, resolver.in_question(q), **more)

    got = ask("What did A12345 say about hedging?")
    assert got.outcome == "ok" and [h["id"] for h in got.hits] == [3, 1] and (got.filtered, got.matched, got.fewer_than_k) == (5, 2, True)
    assert got.hits[1]["matched"] == ["hedging"] and got.hits[1]["fields"] == ["text", "actions"] and [h["rank"] for h in got.hits] == [1, 2] and "[[" in got.hits[0]["snippet"]
    assert [h["id"] for h in ask("café").hits] == [3, 2] or {h["id"] for h in ask("café").hits} == {2, 3}
    assert [h["id"] for h in ask("pricing").hits][:3] and [h["id"] for h in ask('"pricing of the fund"').hits][-2:] != [4, 5]
    assert [h["id"] for h in ask('what of "of the fund"').hits] == [6, 5, 4]  # the newest first among equals
    assert [h["id"] for h in ask("List the meetings of A12345").hits] == [5, 4, 3, 2, 1] and ask("List the meetings of A12345").method == "day"
    assert [h["id"] for h in ask("What was said on 2024-01-04 about pricing?").hits] == [4]
    assert ask("action items on pricing").hits[0]["id"] == 4 and ask("action items on pricing").asked.actions
    outcomes = {"Which meetings?": "no_terms", "What did A12345 say about submarines?": "no_lexical_match", "What about hedging on 2031-01-01?": "no_meetings_for_filter", "What did 12345 say about hedging?": "clarification_needed",
                "What did D77777 say about hedging?": "entity_not_found", "What did B12345 say about hedging?": "no_meeting_data", "What did Ann Lee Moss say about hedging?": "unsupported_rm"}
    assert {q: ask(q).outcome for q in outcomes} == outcomes
    assert retrieval.Search(None, meetings.docs, "id", {}, "text").retrieve("x").outcome == "index_missing"
    with pytest.raises(ValueError):
        ask("hedging", k=51)
    assert [h["id"] for h in ask("x", query_text="the fund").hits] == [6, 5, 4] and ask("x", query_text="").outcome == "no_terms"
    assert search_index.disagreements(meetings.index, meetings.docs, F.when(F.col("id") == 1, 99).otherwise(F.lit(None))).where("id = 1").count() == 1


def test_hybrid(meetings, spark):
    rows = vectors.sentence_rows(meetings.docs, "id", "text")
    axis = {"hedging": 0, "pricing": 1, "costs": 2}

    def embed(text):
        v = [0.01] * 4
        for w in search_index.folded_tokens(text):
            v[axis.get(w, 3)] += 1.0
        return v

    told = spark.createDataFrame([(r[0], embed(r[0])) for r in rows.select("sentence").distinct().collect()], "sentence string, embedding array<double>")
    hybrid = retrieval.Hybrid(meetings, told, rows, embed)
    got = hybrid.retrieve("What was said about hedging?")
    assert got.status == "hybrid" and got.method == "rrf" and {h["id"] for h in got.hits} >= {1, 3, 7} and all(h["lexical_rank"] or h["semantic_rank"] == 1 for h in got.hits)

    def broken(text):
        raise TimeoutError

    down = retrieval.Hybrid(meetings, told, rows, broken).retrieve("What was said about hedging?")
    assert down.status == "lexical_only:TimeoutError" and down.outcome == "ok"
    assert hybrid.retrieve("Which meetings?").outcome == "no_terms"
    assert retrieval.merged_snippet("abc", "abc", 0.5) == "abc" and retrieval.merged_snippet("x", "Other text.", 0.8123) == 'x | semantic match (0.812): "Other text."'
    assert routing.route("What did they say in meetings?", ["client"], True).cues == ("client",)
