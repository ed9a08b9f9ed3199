"""A read-only SQL surface: text checks, then allow-lists on the parsed and the analyzed plan, then capped execution."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from evq.plans import dialect

# The functions a statement may use, and the statements it may not contain.
FUNCTIONS = frozenset("count sum avg min max total round abs coalesce nullif ifnull iif lower upper length substr substring trim ltrim rtrim instr date strftime group_concat like glob row_number rank dense_rank lag lead first_value last_value".split())
FORBIDDEN = "insert update delete drop alter create attach detach pragma vacuum reindex replace truncate merge grant revoke set reset cache uncache refresh add load use explain describe show transform reflect java_method".split()
#: What the translation writes for them.
WRITTEN = FUNCTIONS | frozenset("if typeof listagg date_format date_trunc trunc date_add add_months day current_date current_timestamp make_dt_interval least greatest between ilike rlike".split())
#: Nodes of a plan that only read, by class; everything else is refused.
PARSED = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias OneRowRelation LocalRelation UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition UnresolvedInlineTable".split())
ANALYZED = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias OneRowRelation LocalRelation View Window WithCTE CTERelationDef CTERelationRef UnionLoop UnionLoopRef".split())
EXPRESSIONS = frozenset("""
    Literal TypedNullLiteral AttributeReference OuterReference Alias Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual
    In InSet InSubquery ListQuery ScalarSubquery Exists Between With CommonExpressionDef CommonExpressionRef IsNull IsNotNull CaseWhen If
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat Like ILike RLike Contains StartsWith EndsWith
    AggregateExpression Count Sum Average Min Max ListAgg First Last WindowExpression WindowSpecDefinition SpecifiedWindowFrame
    UnboundedPreceding UnboundedFollowing CurrentRow RowNumber Rank DenseRank Lag Lead SortOrder
    Round Abs Coalesce NullIf Nvl Lower Upper Length Substring StringTrim StringTrimBoth StringTrimLeft StringTrimRight StringInstr Least Greatest TypeOf
    DateFormatClass ParseToDate TruncDate TruncTimestamp DateAdd AddMonths DayOfMonth CurrentDate CurrentTimestamp MakeDTInterval TimestampAddInterval TimeAdd DateAddInterval
""".split())
LIKES = frozenset("Like ILike RLike Contains StartsWith EndsWith".split())
ROW_CAP, DEADLINE = 50, 10.0


@dataclass
class Verdict:
    issues: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    joins: bool = False
    literals: list[str] = field(default_factory=list)
    df: DataFrame | None = field(default=None, repr=False)

    @property
    def ok(self) -> bool:
        return not self.issues


def masked(sql: str) -> tuple[str, bool]:
    """The statement with quoted text blanked out, and whether all quotes close."""
    out, i = [], 0
    closers = {"'": "'", '"': '"', "`": "`", "[": "]"}
    while i < len(sql):
        c = sql[i]
        if c in closers:
            j = i + 1
            while True:
                j = sql.find(closers[c], j)
                if j < 0:
                    return "".join(out), False
                if c != "[" and sql[j + 1 : j + 2] == c:
                    j += 2
                    continue
                break
            out.append(c + "_" * (j - i - 1) + closers[c])
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), True


def bare(sql: str) -> str:
    return sql.strip().rstrip(";").strip()


def scan(sql: str, reserved: Iterable[str] = ()) -> list[str]:
    """Issues that the text alone shows."""
    if not sql or not bare(sql):
        return ["empty_sql"]
    text, closed = masked(sql)
    issues = [] if closed else ["unbalanced_quotes"]
    low = text.lower()
    if "--" in low or "/*" in low or "*/" in low:
        issues.append("comment_not_allowed")
    if ";" in low.strip().rstrip(";"):
        issues.append("multiple_statements")
    if not re.match(r"\s*(select|with)\b", low):
        issues.append("not_a_select")
    if re.search(rf"\b(?:{'|'.join(FORBIDDEN)})\b(?!\s*\()", low):
        issues.append("forbidden_keyword")
    if closed:
        try:
            items = dialect.tokens(bare(sql))
        except dialect.Unsupported:
            return issues
        if dialect.common_names(items) & {r.lower() for r in reserved}:
            issues.append("cte_name_collision")
        if dialect.likened(items, "deal_name"):
            issues.append("like_on_deal_name")
    return issues


def nodes(plan, gateway, stop: frozenset[str] = frozenset()) -> Iterator[tuple[str, object, bool]]:
    """Class name, node and whether it is a plan, for a plan with its expressions and their subqueries; what is below
    a class in stop is left out."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName().rstrip("$")
        is_plan = is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        yield name, node, is_plan
        if name in stop:
            continue
        below = [node.children()] + ([node.expressions()] if is_plan else []) + [node.innerChildren()]
        found = [seq.apply(i) for seq in below for i in range(seq.size())]
        if not is_plan and is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            found.append(node.plan())
        waiting += [x for x in found if is_instance_of(gateway, x, "org.apache.spark.sql.catalyst.trees.TreeNode")]


class Guard:
    """Statements over named views only, in a session that has no other table.

    Names of functions are allow-listed as they are written, in the parsed plan and, with every other expression, by
    class in the analyzed plan, so no spelling brings in another one. What is executed is the plan that was checked.
    """

    def __init__(self, spark: SparkSession, views: Mapping[str, DataFrame], columns: Mapping[str, Iterable[str]] | None = None):
        self.parent, self.session = spark, spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.views = {name: df.select(*columns[name]) if columns and name in columns else df for name, df in views.items()}
        for name, df in self.views.items():
            table = f"evq_{uuid.uuid4().hex}"
            df.createOrReplaceGlobalTempView(table)
            try:
                self.session.table(f"global_temp.{table}").createOrReplaceTempView(name)
            finally:
                spark.catalog.dropGlobalTempView(table)

    def validate(self, sql: str) -> Verdict:
        verdict = Verdict(scan(sql, self.views))
        if verdict.issues:
            return verdict
        gateway, known = self.session.sparkContext._gateway, {v.lower() for v in self.views}
        try:
            items = dialect.tokens(bare(sql))
            verdict.functions = sorted(dialect.calls(items) - dialect.common_names(items))
            if set(verdict.functions) - FUNCTIONS:
                verdict.issues.append("unauthorized_function")
                return verdict
            spark_sql = dialect.render(items)
            if len(spark_sql) > 100_000:
                raise dialect.Unsupported("too_long")
        except dialect.Unsupported as e:
            verdict.issues.append(str(e))
            return verdict
        try:
            parsed = self.session._jsparkSession.sessionState().sqlParser().parsePlan(spark_sql)
        except Exception:
            verdict.issues.append("syntax_error")
            return verdict
        ctes, read = dialect.common_names(items), set()
        for name, node, is_plan in nodes(parsed, gateway):
            if name == "UnresolvedRelation":
                parts = node.multipartIdentifier()
                read.add(".".join(parts.apply(i).lower() for i in range(parts.size())))
            elif name == "UnresolvedFunction":
                parts = node.nameParts()
                if parts.size() != 1 or parts.apply(0).lower() not in WRITTEN:
                    verdict.issues.append("unauthorized_function")
            elif is_plan and name not in PARSED:
                verdict.issues.append("unauthorized_table" if "TableValued" in name else "unauthorized_statement")
        verdict.tables = sorted(read - ctes)
        if set(verdict.tables) - known:
            verdict.issues.append("unauthorized_table")
        if not verdict.issues:
            self._analyzed(spark_sql, verdict, gateway, known)
        verdict.issues = list(dict.fromkeys(verdict.issues))
        return verdict

    def _analyzed(self, spark_sql: str, verdict: Verdict, gateway, known: set[str]) -> None:
        try:
            df = self.session.sql(spark_sql)
            plan = df._jdf.queryExecution().analyzed()
        except Exception as e:
            said = str(e)
            verdict.issues.append("unauthorized_column" if "UNRESOLVED_COLUMN" in said else "unauthorized_table" if "TABLE_OR_VIEW_NOT_FOUND" in said else "analysis_error")
            return
        for name, node, is_plan in nodes(plan, gateway, frozenset({"View"})):
            if is_plan:
                verdict.joins |= name == "Join"
                if name not in ANALYZED or (name == "View" and node.desc().identifier().table().lower() not in known):
                    verdict.issues.append("unauthorized_table")
            elif name not in EXPRESSIONS:
                verdict.issues.append("unauthorized_function")
            elif name == "Literal" and node.value() is not None:
                verdict.literals.append(str(node.toString()))
            elif name in LIKES and any(node.references().toSeq().apply(i).name().lower() == "deal_name" for i in range(node.references().size())):
                verdict.issues.append("like_on_deal_name")
        if not verdict.issues:
            verdict.df = df

    def execute(self, sql: str, cap: int = ROW_CAP, deadline: float = DEADLINE) -> dict:
        """outcome ok with columns, rows (at most cap) and truncated; or the issues; or timeout. Never tried again."""
        return self.run(self.validate(sql), cap, deadline)

    def run(self, verdict: Verdict, cap: int = ROW_CAP, deadline: float = DEADLINE) -> dict:
        """The same for a statement that validate() has judged."""
        if not verdict.ok:
            return {"outcome": "rejected", "issues": verdict.issues, "rows": [], "columns": [], "truncated": False, "tables": verdict.tables}
        tag, late = f"guard-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.session.interruptTag(tag)

        timer = threading.Timer(deadline, stop)
        self.session.addTag(tag)
        timer.start()
        try:
            rows = verdict.df.limit(cap + 1).collect()
            return {"outcome": "ok", "issues": [], "columns": verdict.df.columns, "rows": [tuple(r) for r in rows[:cap]], "truncated": len(rows) > cap, "tables": verdict.tables}
        except Exception as e:
            return {"outcome": "timeout" if late.is_set() else "failed", "issues": [type(e).__name__], "rows": [], "columns": [], "truncated": False, "tables": verdict.tables}
        finally:
            timer.cancel()
            self.session.removeTag(tag)


def source_issues(tables: Iterable[str], families: Mapping[str, str], route: str | None = None) -> list[str]:
    """cross_source where tables of several families meet; wrong_source where they aren't the route's."""
    found = {families[t] for t in tables if t in families}
    return (["cross_source"] if len(found) > 1 else []) + (["wrong_source"] if route and found - {route} else [])


def literal_issues(verdict: Verdict, values: Iterable[str]) -> list[str]:
    """missing_entity where a resolved name is in no literal of the analyzed statement."""
    return [f"missing_entity:{v}" for v in values if str(v) not in verdict.literals]


def single_object_issues(verdict: Verdict) -> list[str]:
    """For aggregates over one object: no join, however it is written, and one table."""
    return ["join_not_allowed"] if verdict.joins or len(verdict.tables) > 1 else []
