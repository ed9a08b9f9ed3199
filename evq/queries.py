"""One query for each operator, with SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.functions import text as X
from evq.operators import entities as E
from evq.operators import lexical as L
from evq.operators import quality as Q
from evq.operators import relational as R
from evq.operators import search_index as I
from evq.operators import vectors as V
from evq.sources import tables as S
from evq.sources.build import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DEC = "decimal(18,2)"
TERMS = ("clown", "moron", "worthless")
FIELDS = {"text": 1.0, "source": 0.1}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def money(c: str):  # exact sums, whatever the order of addition
    return F.col(c).cast(DEC)


# --- sources, projections, views -------------------------------------------------------------------------------

PROPS = "replace(replace(props, '{\"k\": ', ''), '}', '')"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(raw, '[0-9]+(\\.[0-9]+)?x') THEN CAST(regexp_extract(raw, '^([0-9.]+)x', 1) AS DOUBLE) END AS num, CASE WHEN raw IS NULL THEN 'null' WHEN regexp_full_match(raw, '[0-9]+(\\.[0-9]+)?x') THEN 'ok' ELSE 'invalid' END AS status FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN {PROPS} ELSE {PROPS} || '.5x' END AS raw FROM events)")
def parse_suffix_value(spark, d):
    k = F.expr(PROPS)
    raw = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 5 == 0, k).otherwise(F.concat(k, F.lit(".5x"))))
    num, how = S.parse_multiple(F.col("raw"))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", num.alias("num"), how.alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN CAST(p_size AS DOUBLE) * CASE p_size % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1e9 END END AS usd, CASE WHEN p_size % 4 < 3 THEN 'ok' ELSE 'invalid' END AS status FROM part")
def parse_magnitude(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("k USD", "M USD", "B USD", "T USD"))), F.col("p_size") % 4 + 1))
    usd, how = S.parse_magnitude(F.col("raw"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", usd.alias("usd"), how.alias("status"))


@query("SELECT o_orderkey AS record_id, o_custkey AS client_id, o_orderstatus AS record_status, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS record_date, o_orderpriority AS manager FROM orders")
def typed_projection(spark, d):
    return S.transform(S.ORDERS, table(spark, d, "orders").select(*(c.source for c in S.ORDERS.cols)))


@query("SELECT 'orders' AS table_name, m.name AS column_name, d.column_name AS source_column, 'stored' AS kind FROM (DESCRIBE orders) d JOIN (VALUES ('o_orderkey', 'record_id'), ('o_custkey', 'client_id'), ('o_orderstatus', 'record_status'), ('o_totalprice', 'amount'), ('o_orderdate', 'record_date'), ('o_orderpriority', 'manager')) m(source, name) ON m.source = d.column_name")
def lineage_rows(spark, d):
    declared = {c.source for c in S.ORDERS.cols}
    S.check_header(S.ORDERS, [c for c in table(spark, d, "orders").columns if c in declared])
    return S.lineage_frame(spark, S.ORDERS)


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'purchase'")
def client_view(spark, d):
    return R.only(table(spark, d, "events"), F.col("event_type") != "purchase", ["event_id", "user_id", "value"])


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def group_view(spark, d):
    return R.only(table(spark, d, "events"), F.col("event_type") == "purchase", ["event_id", "value"])


@query("SELECT doc_id, lang, source, CASE WHEN n_chars >= 100 THEN n_chars END AS n_chars FROM documents")
def metadata_view(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 100, F.col("n_chars")).alias("n_chars"))


@query("SELECT e.user_id, e.event_id, e.value FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) l ON e.user_id = l.user_id AND e.ts = l.m")
def latest_per_client(spark, d):
    return R.latest(table(spark, d, "events").select("user_id", "event_id", "value", "ts"), "user_id", "ts").select("user_id", "event_id", "value")


@query("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m') DESC) = 1")
def latest_with_ties(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return R.latest(o, "o_custkey", "month")


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY user_id")
def latest_one_row(spark, d):
    return R.latest_one(table(spark, d, "events"), "user_id", ["ts"], ["event_id"]).select("user_id", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13) AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' AND o_orderstatus = 'O'")
def filter_scope(spark, d):
    return table(spark, d, "orders").where(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13) & (F.col("o_orderdate") >= F.expr("timestamp_ntz'1994-01-01'")) & (F.col("o_orderdate") <= F.expr("timestamp_ntz'1997-12-31'")) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand GLOB '*#[1-3]?' AND p_type LIKE '%L'")
def glob_and_suffix(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").rlike(r"\A.*#[1-3].\z") & F.col("p_type").endswith("L")).select("p_partkey", "p_name")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_recorded' ELSE 'recorded' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_state(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.lit("recorded").alias("state"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("state", F.lit("not_recorded")).alias("state"))


@query("SELECT q AS metric, EXISTS (SELECT 1 FROM (DESCRIBE lineitem) WHERE column_type = 'DOUBLE' AND column_name = 'l_' || q) AS available FROM (VALUES ('discount'), ('extendedprice'), ('quantity'), ('tax'), ('margin'), ('shipdate'), ('orderkey')) t(q)")
def metric_availability(spark, d):
    known = {f.name.removeprefix("l_") for f in table(spark, d, "lineitem").schema if f.dataType.typeName() == "double"}
    return spark.createDataFrame([(m, m in known) for m in ("discount", "extendedprice", "quantity", "tax", "margin", "shipdate", "orderkey")], "metric string, available boolean")


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_clients FROM orders")
def count_rows_vs_distinct(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_clients"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority")
def sum_by_record_attr(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("amount"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY l_returnflag")
def currency_safe_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(money("l_extendedprice")).cast("double").alias("amount"))


@query("SELECT coalesce(sum(o_totalprice), 0.0) AS total, sum(o_totalprice) AS plain FROM orders WHERE o_orderkey < 0")
def total_or_zero(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(X.total(F.col("o_totalprice")).alias("total"), F.sum("o_totalprice").alias("plain"))


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY o_custkey ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey LIMIT 20")
def topn_ranked(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s")).orderBy(F.desc("s"), "o_custkey").limit(20).select("o_custkey", F.col("s").cast("double").alias("amount"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def extreme_with_row(spark, d):
    return table(spark, d, "orders").agg(F.max(F.struct("o_totalprice", -F.col("o_orderkey"))).alias("m")).select((-F.col("m").getField("col2")).alias("o_orderkey"), "m.o_totalprice")


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders")
def date_range(spark, d):
    return table(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def distinct_values(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
def attribute_vocabulary(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query("SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM customer GROUP BY c_nationkey")
def group_concat_sorted(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("m")).select("c_nationkey", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (toxic = 1 AND quality = 1) AS toxic_good FROM labels")
def conditional_counts(spark, d):
    return table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("toxic_good"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def median_latency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) WHERE trim(word) <> '' GROUP BY word")
def explode_count(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("word")).where(F.trim("word") != "").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS n_non_ascii, count(*) AS n FROM documents")
def dq_non_ascii(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("text").rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"), F.count("*").alias("n"))


@query("SELECT concat_ws('-', count(*), coalesce(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), 0), coalesce(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)), 0)) AS fingerprint FROM (SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), '') || chr(9) || coalesce('=' || text, '')) AS h FROM documents)")
def source_fingerprint(spark, d):
    return Q.content_fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'")).groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"), F.count("*").alias("n"))


# --- joins and sets ------------------------------------------------------------------------------------------------


@query("SELECT p.p_partkey, p.p_name, l.n FROM part p JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey WHERE p.p_name = (SELECT min(p_name) FROM part)")
def exact_name_match(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    name = p.agg(F.min("p_name")).first()[0]
    return p.where(F.col("p_name") == name).join(l.groupBy("l_partkey").agg(F.count("*").alias("n")), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "n")


@query("SELECT p_brand, count(DISTINCT p_name) AS n_values FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) > 1")
def id_multi_name(spark, d):
    return R.functional_violations(table(spark, d, "part"), "p_brand", "p_name")


@query("SELECT coalesce(o.k, e.k) AS k, o.n_orders, e.n_events FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) o FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) e ON o.k = e.k")
def aggregate_then_combine(spark, d):
    o, e = table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "events").withColumnRenamed("user_id", "k")
    return R.combined(o, e, "k", [F.count("*").alias("n_orders")], [F.count("*").alias("n_events")])


@query("SELECT CAST(sum(o.n * e.n) AS BIGINT) AS joined_rows FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) e ON o.k = e.k")
def row_multiplication_guard(spark, d):
    o, e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a")), table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("b"))
    return o.join(e, "k").agg(F.sum(F.col("a") * F.col("b")).alias("joined_rows"))


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.m, []) <> coalesce(s.m, []) AS differs FROM (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_custkey)) AS m FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, list_sort(list(DISTINCT s_suppkey)) AS m FROM supplier GROUP BY 1) s ON c.k = s.k")
def membership_differs(spark, d):
    return E.membership(table(spark, d, "customer"), "c_nationkey", "c_custkey", table(spark, d, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_union(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey").union(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_nationkey < 9 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_intersect(spark, d):
    return table(spark, d, "customer").where("c_nationkey < 9").select("c_custkey").intersect(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both FROM (SELECT DISTINCT c_custkey AS k, 1 AS a FROM customer) x FULL JOIN (SELECT DISTINCT o_custkey AS k, 1 AS b FROM orders) y ON x.k = y.k")
def set_equality(spark, d):
    return R.set_report(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_in(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def anti_not_in(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT o.o_orderkey FROM orders o WHERE o.o_orderdate <> (SELECT max(i.o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_max(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("evq_orders")
    return spark.sql("SELECT o.o_orderkey FROM evq_orders o WHERE o.o_orderdate <> (SELECT max(i.o_orderdate) FROM evq_orders i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT c.k, c.g AS a, s.g AS b FROM (SELECT DISTINCT c_custkey AS k, c_nationkey AS g FROM customer) c JOIN (SELECT DISTINCT s_suppkey AS k, s_nationkey AS g FROM supplier) s ON c.k = s.k AND c.g <> s.g")
def theta_disagreement(spark, d):
    return Q.disagreement(table(spark, d, "customer"), "c_custkey", "c_nationkey", table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query("WITH RECURSIVE w(start, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT w.start, n.n_nationkey, w.depth + 1 FROM w JOIN nation n ON n.n_nationkey = w.node // 3 WHERE w.node > 0) SELECT start, node, depth FROM w")
def recursive_group_walk(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("evq_nation")
    walk = "SELECT n_nationkey AS start, n_nationkey AS node, 0 AS depth FROM evq_nation UNION ALL SELECT w.start, n.n_nationkey, w.depth + 1 FROM w JOIN evq_nation n ON n.n_nationkey = w.node div 3 WHERE w.node > 0"
    return spark.sql(f"WITH RECURSIVE w(start, node, depth) AS ({walk}) SELECT start, node, depth FROM w")


# --- windows -------------------------------------------------------------------------------------------------------


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n FROM events")
def win_row_number(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(by_user()).alias("n"))


RANKED = "OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m'))"


def by_month():
    return Window.partitionBy("o_orderpriority").orderBy(F.date_format("o_orderdate", "yyyy-MM"))


@query(f"SELECT o_orderkey, CAST(rank() {RANKED} AS INT) AS n FROM orders")
def win_rank(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(by_month()).alias("n"))


@query(f"SELECT o_orderkey, CAST(dense_rank() {RANKED} AS INT) AS n FROM orders")
def win_dense_rank(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.dense_rank().over(by_month()).alias("n"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, d):
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(by_user()).alias("before"), F.lead("event_id").over(by_user()).alias("after"))


@query("SELECT event_id, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, d):
    w = by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.first("event_id").over(w).alias("first"), F.last("event_id").over(w).alias("last"))


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM events")
def trace_running_time(spark, d):
    w = by_user().rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.sum(money("value")).over(w).cast("double").alias("running"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, length(text), text ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), text) AS n FROM conversations) WHERE used <= 1600 OR n = 1")
def evidence_trim(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", F.length("text"), "text")
    kept = c.select("conv_id", "turn", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"), F.row_number().over(w).alias("n"))
    return kept.where("used <= 1600 or n = 1").select("conv_id", "turn")


# --- data quality --------------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS n_bad, count(*) AS n FROM customer")
def dq_format(spark, d):
    return Q.format_violations(table(spark, d, "customer"), "c_name", r"Customer#[0-9]{9}")


@query("SELECT count(DISTINCT c_mktsegment) AS n_plain, count(DISTINCT upper(trim(c_mktsegment))) AS n_folded FROM customer")
def dq_case_dupes(spark, d):
    return Q.case_duplicates(table(spark, d, "customer"), "c_mktsegment")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def dq_fd(spark, d):
    return R.functional_violations(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM events)) AS only_a, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT o_custkey FROM orders)) AS only_b, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)) AS in_both")
def dq_population(spark, d):
    return R.set_report(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("SELECT o_orderkey FROM orders o JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE abs(CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(s, 0)) > 0.01")
def dq_non_additive(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("s"))
    return table(spark, d, "orders").join(parts, "o_orderkey").where(F.abs(money("o_totalprice") - F.coalesce("s", F.lit(0))) > 0.01).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def dq_order_violation(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) FILTER ((o_orderstatus = 'F') <> (o_orderdate < TIMESTAMP '1995-06-17')) AS n_bad FROM orders")
def dq_biconditional(spark, d):
    return Q.biconditional(table(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.expr("timestamp_ntz'1995-06-17'"))


@query("SELECT CAST(2 * count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS n_differences, count(*) AS n FROM orders")
def dq_roundtrip(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    again = rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).select(F.from_json("j", rows.schema).alias("r")).select("r.*")
    return Q.round_trip(rows, again.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.col("o_orderstatus"))))


@query("SELECT n_per_key, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n_per_key FROM orders GROUP BY 1) GROUP BY 1")
def dq_rows_per_key(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_per_key")).groupBy("n_per_key").agg(F.count("*").alias("n_keys"))


@query("SELECT c_custkey FROM customer WHERE c_name <> 'Customer#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0')")
def dq_derived_name(spark, d):
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") % 100).cast("string"), 9, "0"))
    return table(spark, d, "customer").where(F.col("c_name") != name).select("c_custkey")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM (SELECT o_custkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1)")
def dq_latest_ties(spark, d):
    return R.latest(table(spark, d, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"))


# --- lexical retrieval ---------------------------------------------------------------------------------------------

TOK = "regexp_extract_all(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
TEXT_TOK, SOURCE_TOK = TOK.format("text"), TOK.format("source")


def index(spark, d):
    return I.index_of(spark, f"{d}/documents.parquet", "doc_id", ["text", "source"])


@query(f"SELECT count(*) AS n, sum(len({TEXT_TOK}) + len({SOURCE_TOK}))::BIGINT AS tokens FROM documents")
def search_index(spark, d):
    found = index(spark, d)
    return spark.createDataFrame([(found.n, round(found.n * found.mean))], "n long, tokens long")


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, field, term, count(*) AS tf, min(pos) AS first FROM (SELECT doc_id, 'text' AS field, unnest({TEXT_TOK}) AS term, unnest(range(len({TEXT_TOK}))) AS pos FROM documents UNION ALL SELECT doc_id, 'source', unnest({SOURCE_TOK}), unnest(range(len({SOURCE_TOK}))) FROM documents) GROUP BY ALL")
def postings(spark, d):
    field = F.element_at(F.array(F.lit("text"), F.lit("source")), (F.floor(F.col("p") / I.FIELD) + 1).cast("int"))
    rows = index(spark, d).rows.select("doc_id", "term", F.explode("at").alias("p")).withColumn("field", field)
    return rows.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"), F.min(F.col("p") % I.FIELD).cast("long").alias("first"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TEXT_TOK}) AS term FROM documents) GROUP BY term")
def corpus_stats(spark, d):
    return index(spark, d).rows.where(F.exists("at", lambda p: p < I.FIELD)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT count(*) AS n FROM (SELECT doc_id, len({TEXT_TOK}) + len({SOURCE_TOK}) AS n FROM documents) WHERE n < 0")
def dq_index_tokens(spark, d):
    fold = F.lower(F.concat_ws(" ", "text", "source"))  # sharp s is one letter in either form, so the counts agree
    return I.disagreements(index(spark, d), table(spark, d, "documents"), F.regexp_count(fold, F.lit(X.TOKEN))).agg(F.count("*").alias("n"))


def bm25_sql(scope: str = "TRUE", top: str = "") -> str:
    tf = [f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) + 0.1 * len(list_filter(s, lambda x: x = '{w}'))" for w in TERMS]
    cols = ", ".join(f"{e} AS tf{i}" for i, e in enumerate(tf))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS d{i}" for i in range(len(TERMS)))
    parts = " + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / average))" for i in range(len(TERMS)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"WITH a AS (SELECT doc_id, lang, n_chars, {TEXT_TOK} AS t, {SOURCE_TOK} AS s FROM documents), b AS (SELECT doc_id, lang, n_chars, len(t) + len(s) AS size, {cols} FROM a), c AS (SELECT count(*) AS n, avg(size) AS average, {stats} FROM b) SELECT doc_id, round({parts}, 6) AS bm25 FROM b, c WHERE ({hit}) AND {scope} {top}"


def scored(spark, d, scope=None):
    return index(spark, d).bm25(TERMS, FIELDS, scope).withColumn("bm25", F.round("bm25", 6))


@query(bm25_sql())
def bm25_or(spark, d):
    return scored(spark, d).select("doc_id", "bm25")


@query(bm25_sql())
def bm25_scan(spark, d):
    """The same without an index: one pass over the texts."""
    folded = F.pandas_udf(lambda s: s.str.normalize("NFC").str.casefold(), "string")
    return L.bm25(table(spark, d, "documents").withColumn("text", folded("text")), TERMS, FIELDS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(bm25_sql("lang = 'en' AND n_chars > 500"))
def bm25_scoped(spark, d):
    return scored(spark, d, table(spark, d, "documents").where("lang = 'en' AND n_chars > 500")).select("doc_id", "bm25")


@query(f"SELECT row_number() OVER (ORDER BY bm25 DESC, doc_id % 7 DESC, doc_id) AS position, doc_id, bm25 FROM ({bm25_sql()}) ORDER BY position LIMIT 20")
def bm25_top(spark, d):
    """The newest first among equal scores: the day of a document stands in for its date."""
    rows = scored(spark, d).select("doc_id", "bm25")
    top = rows.orderBy(F.desc("bm25"), F.desc(F.col("doc_id") % 7), "doc_id").limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("bm25"), F.desc(F.col("doc_id") % 7), "doc_id")).alias("position"), "doc_id", "bm25")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TEXT_TOK}, ' ') || ' ', ' of the ')")
def phrase_match(spark, d):
    return index(spark, d).places("of the", 0, {"text": 1.0}).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_filter(['clown', 'moron', 'worthless'], lambda w: list_contains({TEXT_TOK}, w)), ',') AS matched FROM documents WHERE list_has_any({TEXT_TOK}, ['clown', 'moron', 'worthless'])")
def matched_fields(spark, d):
    rows = index(spark, d).bm25(TERMS, {"text": 1.0})
    return rows.select("doc_id", F.array_join(F.transform("matched", lambda q: F.element_at(F.array(*map(F.lit, TERMS)), q + 1)), ",").alias("matched"))


@query(f"SELECT count(*) AS filtered, count(*) FILTER (list_has_any({TEXT_TOK}, ['clown', 'moron', 'worthless'])) AS matched, count(*) FILTER (list_has_any({TEXT_TOK}, ['clown', 'moron', 'worthless'])) < 20 AS fewer_than_k FROM documents WHERE lang = 'en'")
def filtered_matched_counts(spark, d):
    scope = table(spark, d, "documents").where("lang = 'en'")
    hits = index(spark, d).bm25(TERMS, {"text": 1.0}, scope).select("doc_id", F.lit(1).alias("hit"))
    return scope.select("doc_id").join(hits, "doc_id", "left").agg(F.count("*").alias("filtered"), F.count("hit").alias("matched"), (F.count("hit") < 20).alias("fewer_than_k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_listing(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query()
def snippet(spark, d):
    return L.bm25(table(spark, d, "documents"), TERMS, {"text": 1.0}).select("doc_id", L.snippet(F.col("text"), TERMS).alias("snippet"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g') AS text FROM documents")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redacted(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(len(n) AS INT) AS n_numbers, CAST(round(coalesce(list_sum(list_filter(n, lambda x: x < 1000000)), 0) * 1000) AS BIGINT) AS thousandths, list_max(n) AS most FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM documents)")
def number_extract(spark, d):
    said = F.round(F.aggregate(F.filter("n", lambda x: x < 1_000_000), F.lit(0.0), lambda s, x: s + x) * 1000).cast("long")
    return table(spark, d, "documents").select("doc_id", X.numbers(F.col("text")).alias("n")).select("doc_id", F.size("n").alias("n_numbers"), said.alias("thousandths"), F.array_max("n").alias("most"))


# --- vectors and fusion --------------------------------------------------------------------------------------------

SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(pos - 1 AS INT) AS pos, sentence FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENT} AS s FROM documents))")
def sentences(spark, d):
    return V.sentence_rows(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT sentence, count(*) AS n_rows FROM (SELECT unnest({SENT}) AS sentence FROM documents) GROUP BY sentence")
def sentence_dedupe(spark, d):
    return V.sentence_rows(table(spark, d, "documents"), "doc_id", "text").groupBy("sentence").agg(F.count("*").alias("n_rows"))


@query(f"WITH r AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENT} AS s FROM documents)) SELECT sentence, doc_id, CAST(pos AS INT) AS pos, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) AS n, count(*) OVER (PARTITION BY sentence) AS n_rows FROM r) WHERE n = 1")
def sentence_first_seen_ids(spark, d):
    return V.first_seen(V.sentence_rows(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def query_vector(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
COS = f"SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV}), 6) AS score FROM embeddings"


def vector_scores(spark, d):
    return V.scored(table(spark, d, "embeddings"), query_vector(spark, d)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"{COS} ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return vector_scores(spark, d).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"SELECT vec_id, score FROM ({COS})")
def cosine_bulk(spark, d):
    return V.scored_in_bulk(table(spark, d, "embeddings"), query_vector(spark, d), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT label, score, vec_id FROM ({COS}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def best_per_key(spark, d):
    return V.best_per(vector_scores(spark, d), "label", "score", "vec_id")


@query("SELECT doc_id, CAST(rank() OVER (PARTITION BY lang ORDER BY n_chars DESC) AS INT) AS rank FROM documents")
def competition_rank(spark, d):
    return R.competition_rank(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", by=["lang"]).select("doc_id", "rank")


DEEP = f"SELECT vec_id AS doc_id, CAST(rank() OVER (ORDER BY score DESC) AS INT) AS semantic_rank FROM ({COS}) QUALIFY rank() OVER (ORDER BY score DESC) <= 50"
LEX = f"SELECT doc_id, CAST(rank() OVER (ORDER BY bm25 DESC) AS INT) AS lexical_rank FROM ({bm25_sql()}) QUALIFY rank() OVER (ORDER BY bm25 DESC) <= 50"
FUSED = f"SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, lexical_rank, semantic_rank, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 12) AS rrf FROM ({LEX}) l FULL JOIN ({DEEP}) s ON l.doc_id = s.doc_id"
BEST = f"{FUSED} ORDER BY rrf DESC, lexical_rank ASC NULLS LAST, doc_id LIMIT 20"


def semantic_side(spark, d):
    return V.depth(vector_scores(spark, d).select(F.col("vec_id").alias("doc_id"), "score"), "score", "semantic_rank").select("doc_id", "semantic_rank")


def lexical_side(spark, d):
    return V.depth(bm25_or(spark, d), "bm25", "lexical_rank").select("doc_id", "lexical_rank")


@query(DEEP)
def depth_cut(spark, d):
    return semantic_side(spark, d)


@query(FUSED)
def rrf_fuse(spark, d):
    return V.fused(lexical_side(spark, d), semantic_side(spark, d), "doc_id")


@query(BEST)
def fused_topk(spark, d):
    return V.top(rrf_fuse(spark, d), "doc_id")


@query(f"SELECT * FROM ({BEST}) WHERE lexical_rank IS NOT NULL OR semantic_rank = 1")
def evidence_select(spark, d):
    return V.selected(fused_topk(spark, d))


@query(f"SELECT doc_id, lexical_rank, round(1.0::DOUBLE / (60 + lexical_rank), 12) AS rrf FROM ({LEX}) ORDER BY rrf DESC, lexical_rank, doc_id LIMIT 20")
def lexical_only_fallback(spark, d):
    return V.top(lexical_side(spark, d).withColumn("rrf", V.rrf(F.col("lexical_rank"))), "doc_id")


# --- entities ------------------------------------------------------------------------------------------------------

DICT = "SELECT 'client' AS etype, c_name AS value, count(*) AS n FROM customer GROUP BY c_name UNION ALL SELECT 'part', p_name, count(*) FROM part GROUP BY p_name UNION ALL SELECT 'nation', n_name, count(*) FROM nation GROUP BY n_name"


def dictionary(spark, d):
    return E.dictionary({"client": table(spark, d, "customer").select("c_name"), "part": table(spark, d, "part").select("p_name"), "nation": table(spark, d, "nation").select("n_name")})


@query(DICT)
def entity_dictionary(spark, d):
    return dictionary(spark, d).select("etype", "value", "n")


@query(f"SELECT etype, value FROM ({DICT}) WHERE value = 'Customer#000000007'")
def exact_lookup(spark, d):
    return E.exact(dictionary(spark, d), "Customer#000000007").select("etype", "value")


NORM = "array_to_string(regexp_extract_all(lower(value), '[\\p{L}\\p{N}]+'), ' ')"


@query(f"SELECT etype, value FROM ({DICT}) WHERE {NORM} = 'customer 000000007'")
def normalized_lookup(spark, d):
    return E.normalized(dictionary(spark, d), "  CUSTOMER 000000007 ").select("etype", "value")


@query(f"SELECT etype, value FROM ({DICT}) WHERE contains(' ' || {NORM} || ' ', ' 000000007 ')")
def partial_match(spark, d):
    return E.partial(dictionary(spark, d), "000000007").select("etype", "value")


@query("SELECT c_name FROM customer WHERE right(c_name, 2) = '42'")
def numeric_suffix(spark, d):
    return E.suffixed(table(spark, d, "customer"), "c_name", "42").select("c_name")


@query(f"SELECT etype, value FROM ({DICT}) WHERE starts_with(value, 'Customer#0000000') ORDER BY etype, value LIMIT 10")
def ambiguity_cap(spark, d):
    return E.candidates(dictionary(spark, d).where(F.col("value").startswith("Customer#0000000"))).select("etype", "value")


@query("SELECT c.c_custkey, n.c_name AS value FROM customer c JOIN (SELECT DISTINCT c_name FROM customer) n ON lower(n.c_name) = lower(c.c_name)")
def mention_extract(spark, d):
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("please compare "), F.upper("c_name"), F.lit(" with all others")).alias("question"))
    return E.mentions(asked, "c_custkey", "question", dictionary(spark, d).where("etype = 'client'")).select("c_custkey", "value")


# --- catalog, numbering, lookups, sentences with vectors -----------------------------------------------------------


@query("SELECT 'customer' AS table_name, column_name FROM (DESCRIBE customer) UNION ALL SELECT 'orders', column_name FROM (DESCRIBE orders) UNION ALL SELECT 'nation', column_name FROM (DESCRIBE nation)")
def dq_catalog(spark, d):
    found = [(t, c) for t in ("customer", "orders", "nation") for c in table(spark, d, t).columns]
    return spark.createDataFrame(found, "table_name string, column_name string")


@query(f"WITH r AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENT} AS s FROM documents)), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) = 1) SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS sentence_id, doc_id, CAST(pos AS INT) AS pos FROM f")
def sentence_ids(spark, d):
    seen = V.first_seen(V.sentence_rows(table(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "pos")
    return R.numbered(seen, ["doc_id", "pos"], "sentence_id", 2000)


@query(f"SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN ({BEST}) b ON b.doc_id = d.doc_id")
def point_lookups(spark, d):
    """What is shown of the final hits: one join on at most twenty ids."""
    return table(spark, d, "documents").join(F.broadcast(fused_topk(spark, d).select("doc_id")), "doc_id").select("doc_id", "lang", "n_chars")


SENT_VEC = f"SELECT doc_id, pos, score FROM (SELECT doc_id, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, {SENT} AS s FROM documents)) r JOIN ({COS}) v ON v.vec_id = (r.doc_id * 7 + r.pos) % (SELECT count(*) FROM embeddings)"


@query(f"SELECT doc_id, score, CAST(pos AS INT) AS pos FROM ({SENT_VEC}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1")
def best_sentence(spark, d):
    """Sentences meet their vectors, whose scores are made once each."""
    rows = V.sentence_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos")
    n = table(spark, d, "embeddings").count()
    scored_ = rows.withColumn("vec_id", (F.col("doc_id") * 7 + F.col("pos")) % n).join(vector_scores(spark, d).select("vec_id", "score"), "vec_id")
    return V.best_per(scored_, "doc_id", "score", "pos")


@query(f"SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS lexical, (SELECT count(DISTINCT doc_id) FROM ({SENT_VEC}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS semantic")
def scope_agrees(spark, d):
    """Both sides of a hybrid search see one scope."""
    scope = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    inside = V.sentence_rows(table(spark, d, "documents").join(scope, "doc_id", "left_semi"), "doc_id", "text").select("doc_id").distinct()
    return spark.createDataFrame([(scope.count(), inside.count())], "lexical long, semantic long")


from evq import controls  # noqa: E402

for _name, (_f, _sql) in controls.QUERIES.items():
    QUERIES[_name] = _f
    ORACLES[_name] = _sql
