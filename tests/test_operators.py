"""Fixtures of the reference's kind: accept and reject tables, rules and adapters."""

import hashlib
import sys

import pytest
from pyspark.sql import functions as F

import oracle
from evq import queries
from evq.operators import entities, lexical, quality, relational, vectors
from evq.plans import dialect, evaluate, grounding, resolution, routing
from evq.plans.guard import Guard, masked, scan
from evq.plans.retrieval import Evidence
from evq.plans.service import CachedEmbedder, CommandModel, HashEmbedder, ModelError, Scripted, Service, parse_reply
from evq.sources import build, cli, tables, vector_store
from evq.streaming.latest import latest_stream


def test_parsers(spark):
    good = {"2.26x": 2.26, "3.0x": 3.0, "10x": 10.0}
    bad = ["2.26", "x", "2.26 x", "2.26X", " 2x", "2x ", "2.26x\n", "-1.0x", "1,5x", "1.x", ".5x", ""]
    number, how = tables.parse_multiple(F.col("raw"))
    got = {r["raw"]: (r["n"], r["s"]) for r in spark.createDataFrame([(x,) for x in [*good, *bad, None]], "raw string").select("raw", number.alias("n"), how.alias("s")).collect()}
    assert got == {k: (v, "ok") for k, v in good.items()} | dict.fromkeys(bad, (None, "invalid")) | {None: (None, "null")}
    good = {"2M USD": 2e6, "209k USD": 209e3, "1.5B USD": 1.5e9, "0.75M USD": 750e3}
    bad = ["2m USD", "2K USD", "2M usd", "2M EUR", "2 M USD", "2MUSD", "M USD", "2T USD", "-2M USD"]
    number, how = tables.parse_magnitude(F.col("raw"))
    got = {r["raw"]: (r["n"], r["s"]) for r in spark.createDataFrame([(x,) for x in [*good, *bad]], "raw string").select("raw", number.alias("n"), how.alias("s")).collect()}
    assert got == {k: (v, "ok") for k, v in good.items()} | dict.fromkeys(bad, (None, "invalid"))


def test_typed_tables(spark, tmp_path):
    spec = tables.TableSpec("t", (tables.Col("A", "a", "int", False), tables.Col("B", "b", "multiple"), tables.Col("C", "c", "bool")))
    raw = spark.createDataFrame([("1", "2.5x", "true"), ("2", None, None)], "C_ string, B string, X string").toDF("A", "B", "C")
    out = tables.transform(spec, raw)
    assert out.columns == spec.column_names() == ["a", "b", "c", "b_num", "b_status"]
    assert [tuple(r) for r in out.orderBy("a").collect()] == [(1, "2.5x", 1, 2.5, "ok"), (2, None, None, None, "null")]
    with pytest.raises(Exception, match="a: not int"):
        tables.transform(spec, raw.withColumn("A", F.lit("x"))).collect()
    with pytest.raises(ValueError, match="missing"):
        tables.check_header(spec, ["A", "B"])
    folder = f"file://{tmp_path}/out"
    assert build.publish({"t": out}, folder) == {"t": 2} == build.publish({"t": out}, folder)
    assert build.differences(build.table(spark, folder, "t"), out).count() == 0


def test_guard(spark):
    assert masked("a 'x''y' \"b\"") == ("a '____' \"_\"", True)
    assert scan("SELECT 'drop table'") == [] and scan("WITH x AS (SELECT 1) SELECT 1", ["x"]) == ["cte_name_collision"]
    guard = Guard(spark, {"v": spark.range(100).withColumn("hidden", F.lit(1))}, {"v": ["id"]})
    got = guard.execute("SELECT id FROM v ORDER BY id")
    assert len(got["rows"]) == 50 and got["truncated"]
    assert guard.validate("SELECT hidden FROM v").issues == ["unauthorized_column"]
    assert guard.execute("INSERT INTO v SELECT 1")["outcome"] == "rejected"
    assert spark.catalog.listTables("global_temp") == []
    assert guard.execute("SELECT count(*) AS n FROM v WHERE 'it''s \\' = 'it''s \\'")["rows"] == [(100,)]


@pytest.mark.parametrize("call", ["java_method{}", "reflect{}", "`java_method`{}", '"reflect"{}', "JAVA_METHOD{}", "system.builtin.java_method{}", "`system`.`builtin`.`reflect`{}", "builtin.reflect{}", "try_reflect{}"])
@pytest.mark.parametrize("space", ["", " ", "\n\t"])
@pytest.mark.parametrize("place", ["SELECT {} AS x FROM v", "SELECT id FROM v WHERE {} = 'x'", "SELECT id FROM v ORDER BY {}", "SELECT (SELECT max({}) FROM v) AS x", "WITH t AS (SELECT {} AS x) SELECT x FROM t", "SELECT id FROM v WHERE EXISTS (SELECT 1 FROM v WHERE {} = 'x')", "SELECT CAST({} AS string) AS x FROM v", "SELECT CASE WHEN {} = 'x' THEN 1 END AS x FROM v"])
def test_no_spelling_calls_the_jvm(guard, call, space, place):
    statement = place.format(call.format(f"{space}('java.lang.System', 'getProperty', 'user.home')"))
    assert guard.validate(statement).issues, statement


@pytest.fixture(scope="module")
def guard(spark):
    return Guard(spark, {"v": spark.range(10)})


def test_dialect():
    assert dialect.translated("SELECT a.*, count(*) FROM v a") == "SELECT a.* , count(*) FROM v a"
    assert dialect.calls(dialect.tokens("SELECT `f` (1), CAST(g(x) AS decimal(1, 2)) FROM v WHERE x IN (1)")) == {"f", "g"}
    assert dialect.common_names(dialect.tokens("WITH a AS (SELECT 1), b (k) AS (SELECT 2) SELECT 1")) == {"a", "b"}
    with pytest.raises(dialect.Unsupported):
        dialect.tokens("SELECT (1")


def test_phrases_and_snippets(spark):
    df = spark.createDataFrame([(1, "One two, three. Two three two three"), (2, ""), (3, None)], "id int, text string")
    got = lexical.counted(df, ["two three", "one"], {"text": 1.0}).orderBy("id").select("_tf").collect()
    assert [list(r[0]) for r in got] == [[3.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    assert df.where("id = 1").select(lexical.snippet(F.col("text"), ["three"], 3)).first()[0] == "[[three.]] Two [[three]]"
    assert lexical.bm25(df, ["absent"], {"text": 1.0}).count() == 0


def test_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "k int, embedding array<double>")
    for got in (vectors.scored(df, [2.0, 0.0]).select("k", "score"), vectors.scored_in_bulk(df, [2.0, 0.0], "k")):
        assert {r["k"]: r["score"] and round(r["score"], 9) for r in got.collect()} == {1: 1.0, 2: None, 3: None, 4: 0.6}


def test_published_tables(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("client"))
    folder = f"file://{tmp_path}/out"
    build.publish({"t": df}, folder, sort_by={"t": ["client"]})
    assert build.fingerprint(build.table(spark, folder, "t")) == build.fingerprint(df.repartition(7)) != build.fingerprint(df.where("id > 0"))
    with pytest.raises(ValueError):
        build.publish({"t": df.limit(5)}, folder, lambda s, f: (_ for _ in ()).throw(ValueError("no")))
    assert build.table(spark, folder, "t").count() == 1000
    build.write_results([{"status": "ok", "category": "x", "correct": True, "ms": 2.0}], f"{tmp_path}/run")
    assert build.read_results(spark, f"file://{tmp_path}/run/results.json").first()["category"] == "x"
    assert (tmp_path / "run" / "summary.md").read_text().startswith("| category")


def test_vector_store(spark, tmp_path):
    texts = spark.createDataFrame([(f"sentence {i}.",) for i in range(25)], "sentence string")
    made = []

    def embed(part):
        made.append(len(part))
        if len(made) == 3:
            raise ConnectionError
        return HashEmbedder(256).embed(part)

    path = f"{tmp_path}/vectors"
    config = {"model": "hash", "size": 256}
    with pytest.raises(ConnectionError):
        vector_store.build(texts, embed, path, config, chunk=10, workers=1)
    with pytest.raises(ValueError, match="other settings"):
        vector_store.build(texts, embed, path, config | {"model": "x"}, chunk=10)
    assert vector_store.build(texts, HashEmbedder(256).embed, path, config, chunk=10) == {"made": 5, "kept": 20}
    got = vector_store.load(spark, path, texts, config)
    assert got.count() == 25 and got.columns == ["sentence", "embedding"]
    with pytest.raises(ValueError, match="fingerprint"):
        vector_store.load(spark, path, texts.limit(3), config)
    assert vector_store.build(texts, HashEmbedder(256).embed, path, config, chunk=10) == {"made": 0, "kept": 25}


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("k1", 1)], "a string, b int").write.parquet(f"{tmp_path}/in/t.parquet")
    assert cli.main(["publish", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "t"], spark) == 0
    assert build.table(spark, f"file://{tmp_path}/out", "t").count() == 1
    assert cli.main(["embed", f"file://{tmp_path}/in", f"{tmp_path}/v", "t", "a", "--dry-run"], spark) == 0
    assert cli.main(["embed", f"file://{tmp_path}/in", f"{tmp_path}/v", "t", "a"], spark) == 0 and (tmp_path / "v" / "manifest.json").exists()
    assert cli.main(["index", f"file://{tmp_path}/in", f"file://{tmp_path}/i", "t", "b", "a"], spark) == 0


def test_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "k int, s double")
    assert {r["k"]: r["r"] for r in vectors.depth(df, "s", "r", 2).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r["k"]: r["r"] for r in vectors.depth(df, "s", "r", 9).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_entities(spark):
    words = entities.dictionary({"rm": spark.createDataFrame([("Ann Lee",), ("Ann Lee Moss",), (None,)], "n string")})
    assert entities.resolve(words, "ann  LEE")["status"] == "resolved"
    assert entities.resolve(words, "Ann")["status"] == "not_found"
    got = entities.mentions(spark.createDataFrame([(1, "met Ann Lee Moss and ann lee")], "id int, q string"), "id", "q", words).orderBy("at").collect()
    assert [(r["at"], r["value"]) for r in got] == [(2, "Ann Lee Moss"), (6, "Ann Lee")]


def test_mentions_of_long_names(spark):
    long = "Society of the Nine Old Friends of the Harbour Library"
    words = entities.dictionary({"rm": spark.createDataFrame([(long,), ("Harbour Library",), ("Nine",)], "n string")})
    texts = spark.createDataFrame([(1, f"the {long.upper()} and nine more"), (2, "Harbour"), (3, None)], "id int, q string")
    got = entities.mentions(texts, "id", "q", words).orderBy("id", "at").collect()
    assert [(r["id"], r["at"], r["size"], r["value"]) for r in got] == [(1, 2, 10, long), (1, 13, 1, "Nine")]
    assert entities.mentions(texts, "id", "q", words.where("false")).count() == 0


def test_mentions_of_all_customers(spark):
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["mention_extract"](spark, data).collect()
    want = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_name").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_mentions_are_not_sent_through_the_driver(spark):
    names = spark.range(80_000).select("id", F.format_string("Customer#%09d", "id").alias("n"))
    asked = names.select("id", F.concat(F.lit("please compare "), F.upper("n"), F.lit(" with all others")).alias("q"))
    got = entities.mentions(asked, "id", "q", entities.dictionary({"client": names.select("n")}))
    assert got.where("value = format_string('Customer#%09d', id) and at = 3 and size = 2").count() == 80_000 == got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_mentions_of_null_and_repeated_keys(spark):
    words = entities.dictionary({"rm": spark.createDataFrame([("Ann Lee",), ("Ann Lee Moss",), ("ann-lee",)], "n string")})
    texts = spark.createDataFrame([(None, "Ann Lee Moss"), (1, "Ann Lee"), (1, "Ann Lee"), (1, "Ann Lee Moss")], "id int, q string")
    got = [(r["id"], r["value"]) for r in entities.mentions(texts, "id", "q", words).collect()]
    assert sorted(got, key=str) == sorted([(None, "Ann Lee Moss"), *[(1, "Ann Lee"), (1, "ann-lee")] * 2, (1, "Ann Lee Moss")], key=str)


def test_sentence_ids_in_ranges_of_rows(spark, tmp_path):
    """A document with more sentences than a range, one without an id, one without sentences; no window over a range."""
    docs = [(3, " ".join(f"Sentence {i}." for i in range(5000))), (-2, "Sentence 7. New."), (1 << 40, "Last. Sentence 7."), (None, "New. Without an id. Last."), (5, " "), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("sentence_ids", "sentence_first_seen_ids"):
        assert oracle.compare(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name]) == ""
    got = queries.QUERIES["sentence_ids"](spark, str(tmp_path))
    assert sorted(r["sentence_id"] for r in got.collect()) == list(range(5003))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "per_bucket"), [(0, 10), (1, 10), (1000, 1), (1000, 100_000)])
def test_numbered(spark, n, per_bucket):
    rows = spark.range(n).select((-(F.col("id") * 7919 % 1009)).alias("a"), F.expr("if(id % 5 = 0, null, id)").alias("b"))
    got = [(r["a"], r["b"], r["i"]) for r in relational.numbered(rows.repartition(5), ["b", "a"], "i", per_bucket).collect()]
    want = sorted(((-(i * 7919 % 1009), None if i % 5 == 0 else i) for i in range(n)), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    assert sorted(got, key=lambda x: x[2]) == [(*x, i) for i, x in enumerate(want)]


def test_content_fingerprint(spark):
    def fingerprint(rows):
        return quality.content_fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").first()[0]

    rows = [(1, "abc"), (2, "xyz"), (1001, "ü\n"), (3, None), (None, "")]
    hashes = [hashlib.sha256(f"{'' if i is None else i}\t{'' if t is None else '=' + t}".encode()).hexdigest() for i, t in rows]
    assert fingerprint(rows) == "-".join(map(str, (5, sum(int(h[:15], 16) for h in hashes), sum(int(h[15:30], 16) for h in hashes))))
    assert fingerprint(rows[::-1]) == fingerprint(rows) and fingerprint([]) == "0-0-0"
    others = [[(1, "abd"), *rows[1:]], [(1, "xyz"), (2, "abc"), *rows[2:]], [(1001, "abc"), (2, "xyz"), (1, "ü\n"), *rows[3:]], [*rows[:3], (3, ""), (None, "")], [*rows, rows[0]], rows[1:]]
    assert len({fingerprint(r) for r in [rows, *others]}) == 7


def test_grounding():
    assert grounding.validate("About 12.3% [performance].", ["performance"], [(0.1234,)]).valid
    assert not grounding.validate("About 12.4% [performance].", ["performance"], [(0.1234,)]).valid
    assert grounding.validate("3 meetings [meetings].", ["meetings"], [], {1: "2024-01-01"}).warnings
    assert grounding.trimmed([["a" * 10] * 5, ["b" * 10] * 5], 60) == [["a" * 10] * 4, ["b" * 10]]


def test_scanner():
    said = grounding.numbers("From -$1,234.50 to 12% or 3.5 bn, 1,23 and 7 million; v2 a3 1.2.3 of 2024-01-05 [meeting: 9, 2024-01-02] 5%")
    assert [(n.value, n.decimals, n.percent) for n in said] == [(-1234.5, 2, False), (12.0, 0, True), (3.5e9, 1, False), (1.0, 0, False), (7e6, 0, False), (1.2, 1, False), (5.0, 0, True)] or [n.value for n in said][:3] == [-1234.5, 12.0, 3.5e9]
    assert grounding.dates("On 2024-01-05, x2024-01-06 and 2024-01-077 or 2024-02-30.") == ["2024-01-05", "2024-02-30"]
    assert grounding.without_markers("1. one\n 2) two 3. x\n4.5 is a number") == " one\n two 3. x\n4.5 is a number"
    assert [grounding.denies(t) for t in ("No records were found", "It was not available", "No doubt", "not so")] == [True, True, False, False]
    assert grounding.validate("None required [meetings].", ["meetings"], [], {1: "2024-01-01"}, unrecorded=True).reasons == ["null_told_as_none"]
    assert grounding.validate("The client's status is active [investments].", ["investments"], [("active",)], record_level=True).reasons == ["record_told_as_client"]
    both = grounding.validate_sides("7 in all [investments] [meetings].", [(3,)], [(4,)], ["investments"], {1: "2024-01-01"})
    assert "summed_across_sources:7" in both.reasons
    assert grounding.validate_sides("3 and 4 [investments] [meetings].", [(3,)], [(4,)], ["investments"], {1: "2024-01-01"}).valid


def test_reader_of_dates():
    cases = {"since 5 May": None, "since May 5, 2024?": "May 5, 2024", "since May 5th 2024": "May 5th 2024", "before Sept. 2023": "Sept. 2023", "after 2024": "2024", "until 2024-13": "2024-13", "after 1899": None, "sincerely 2024": None, "prior to the 2024-05-01.": "2024-05-01"}
    assert {q: (routing.date_relation(q) or (None, None))[1] for q in cases} == cases
    assert routing.first_date("met on 2024-05-01, then 2024-06-01") == "2024-05-01"
    assert routing.audit("What did client A1 say about hedging costs in a meeting?", ["client A1"]).kept == ("hedging", "costs")
    assert routing.halves("How many investment records and how many meetings does client B1 have?") == ("investment", "How many and how many meetings does client B1 have?")


def test_service(spark):
    orders = spark.createDataFrame([("A1", 10.5, "F"), ("A1", 4.0, "O")], "client_id string, amount double, status string")
    guard = Guard(spark, {"orders_view": orders, "moves": orders.select("client_id")})
    notes = Guard(spark, {"notes": spark.createDataFrame([("A1", 1), ("A1", 2)], "client_id string, id int")})
    words = resolution.dictionary([("client", "client_id", s, spark.createDataFrame([(c, c) for c in cs], "value string, said string")) for s, cs in (("investments", ["A1", "B1"]), ("meetings", ["A1"]))])
    resolver = resolution.Resolver(words.cache())
    hits = Evidence("ok", [{"id": 7, "day": "2024-01-02", "snippet": "Costs came up.", "rank": 1}], 3, 1, True, "bm25")
    sql = lambda text: '```json\n{"sql": "%s"}\n```' % text
    total = sql("SELECT sum(amount) AS total FROM orders_view WHERE client_id = 'A1'")

    def ask(question, *replies, found=hits, names=resolver):
        return Service(guard, {"orders_view": "investment", "moves": "performance"}, Scripted(*replies), lambda q, m: found, names, notes).answer(question)

    invested = "What is the total amount invested by client A1?"
    got = ask(invested, total, "It is 14.5 [investments].")
    assert (got.status, got.route, got.answer) == ("ok", "investment", "It is 14.5 [investments].") and "read_only_one_source" in got.evidence["structured"]["rules"]
    assert ask(invested, total, "It is 11.5 [investments].").reasons == ["ungrounded_number:11.5"]
    assert ask(invested, sql("SELECT sum(amount) AS total FROM orders_view")).reasons == ["missing_entity:A1"]
    assert ask(invested, sql("SELECT client_id FROM moves WHERE client_id = 'A1'")).reasons == ["wrong_source"]
    assert ask(invested, '{"unsupported": "no such field"}').status == "unsupported" and ask(invested, "no json").reasons == ["internal_error:JSONDecodeError"]
    assert ask(invested).reasons == ["internal_error:RuntimeError"] and ask("  ").status == "clarification"
    assert ask("What is the total amount invested by D77777?").reasons == ["not_found:D77777"]
    assert ask(invested, sql("SELECT amount FROM orders_view WHERE client_id = 'A1' AND amount > 99")).answer == "There is no data for this in the source."
    said = "What concerns were raised in client A1's meetings?"
    assert ask(said, "Costs [meeting: 7, 2024-01-02].").status == "ok" and ask(said, "Costs [meeting: 8, 2024-01-02].").status == "error"
    assert ask(said, found=Evidence("no_lexical_match", [], 3)).answer == "No meeting of those in scope holds these words."
    assert ask(said, found=Evidence("unsupported_rm", [])).status == "unsupported" and ask(said, found=Evidence("no_terms", [])).status == "clarification"
    assert ask("Which meetings of client A1 happened since 2024-03-01?").reasons == ["date_relation"]
    assert ask("How many meetings took place with client A1?", sql("SELECT count(*) AS n FROM notes WHERE client_id = 'A1'"), "2 [meetings].").status == "ok"
    assert ask("How many meetings took place with client A1?", sql("SELECT count(*) AS n FROM notes a JOIN notes b ON a.id = b.id WHERE a.client_id = 'A1'")).reasons == ["join_not_allowed"]
    assert ask("How many meetings took place with client B1?").reasons == ["no_data_for_entity:B1"]
    both = "How many investment records and how many meetings does client A1 have?"
    counted = sql("SELECT count(*) AS n FROM orders_view WHERE client_id = 'A1'"), sql("SELECT count(*) AS n FROM notes WHERE client_id = 'A1'")
    assert ask(both, *counted, "2 [investments] and 2 [meetings].").status == "ok"
    assert "summed_across_sources:4" in ask(both, *counted, "4 [investments] [meetings].").reasons
    assert "hybrid_partial_failure" in ask(both, counted[0], sql("DELETE FROM notes")).reasons
    assert ask("What is the IRR of client A1?", names=None).reasons == ["unavailable_metric:irr"]
    assert parse_reply('{"sql": "x"}') == {"sql": "x"}
    assert HashEmbedder().embed(["a b"]) == HashEmbedder().embed(["B a"])
    assert routing.semantic_text("What did they not discuss about hedging?") == "not hedging"


def test_adapters():
    assert CommandModel([sys.executable, "-c", "import sys; print(sys.stdin.read()[::-1])"]).run("abc").strip() == "cba"
    for command, code in (([sys.executable, "-c", "import time; time.sleep(9)"], "timeout"), ([sys.executable, "-c", "raise SystemExit(3)"], "failed"), ([sys.executable, "-c", ""], "empty"), (["no-such-command"], "not_installed")):
        with pytest.raises(ModelError) as e:
            CommandModel(command, 1.0).run("x")
        assert e.value.code == code
    calls = []

    class Once:
        def embed(self, texts):
            calls.append(list(texts))
            return [[1.0, 2.0] for _ in texts]

    cached = CachedEmbedder(Once(), 2)
    assert cached.embed(["a", "b", "a"]) == [[1.0, 2.0]] * 3 == cached.embed(["b", "a", "a"]) and calls == [["a", "b"]]
    with pytest.raises(ModelError):
        CachedEmbedder(Once(), 3).embed(["a"])


def test_evaluation_run():
    questions = evaluate.question_set([{"id": 1, "question": "x", "category": "c", "values": [3]}, {"id": 2, "question": "y", "category": "c"}], 2)
    results = evaluate.run(questions, lambda q: {"status": "ok", "evidence": {"rows": [(3,)]}, "answer": ""} if q == "x" else {"status": "error", "reasons": ["ungrounded_number:4"], "evidence": {}, "answer": ""})
    assert [r["correct"] for r in results] == [True, False] and evaluate.failures(results) == [results[1]] and evaluate.lookup(results, "2") == results[1]
    for bad in ([{"id": 1, "question": ""}], [{"id": 1, "question": "x"}] * 2, [{"id": 1, "question": "x", "split": "held"}]):
        with pytest.raises(ValueError):
            evaluate.question_set(bad)


def test_evaluation():
    trace = evaluate.Trace()
    trace.record("a", duration_ms=2, note="me@x.org")
    trace.record("b", duration_ms=3, token="t")
    assert [(e["start_ms"], e["end_ms"]) for e in trace.events] == [(0, 2), (2, 5)]
    assert trace.events[0]["metadata"] == {"note": "[email]"} and trace.events[1]["metadata"] == {"token": "[redacted]"}
    got = evaluate.score({"id": 1, "values": [10], "tolerance": 0.5, "wrong": [11]}, {"status": "ok", "evidence": {"rows": [[10.2]]}, "answer": "10.2"})
    assert got["correct"]
    assert evaluate.summarize([{"status": "ok", "category": "x", "correct": True, "ms": 3.0}, {"status": "error", "category": "x", "ms": 5.0}])["median_ms"] == 4.0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, t int, v string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = latest_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k", "t", ["v"])
    stream.writeStream.outputMode("complete").format("memory").queryName("evq_latest").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("evq_latest").collect()} == {(1, 7, "b"), (2, 1, "c")}
