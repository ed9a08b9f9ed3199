"""Declared tables: strict typed projection with parse-status columns, header checks, lineage and DDL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"text": "string", "int": "bigint", "real": "double", "bool": "int", "date": "string", "multiple": "string", "magnitude": "string"}
#: What the suffixes of a magnitude stand for.
SCALES = {"k": 1e3, "M": 1e6, "B": 1e9}


@dataclass(frozen=True)
class Col:
    source: str
    name: str
    kind: str
    nullable: bool = True
    note: str = ""


@dataclass(frozen=True)
class TableSpec:
    name: str
    cols: tuple[Col, ...]

    def derived(self) -> list[tuple[str, str, str]]:
        """name, type and origin of the columns that parsing adds."""
        out = []
        for c in self.cols:
            if c.kind == "multiple":
                out += [(f"{c.name}_num", "double", c.name), (f"{c.name}_status", "string", c.name)]
            if c.kind == "magnitude":
                out += [(f"{c.name}_usd", "double", c.name), (f"{c.name}_status", "string", c.name)]
        return out

    def column_names(self) -> list[str]:
        return [c.name for c in self.cols] + [d[0] for d in self.derived()]

    def date_columns(self) -> list[str]:
        return [c.name for c in self.cols if c.kind == "date"]

    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c.name}` {KINDS[c.kind]}" for c in self.cols) + "".join(f", `{n}` {t}" for n, t, _ in self.derived()))

    def ddl(self) -> str:
        return f"CREATE TABLE {self.name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.struct())}) USING parquet"

    def lineage(self) -> list[tuple[str, str, str, str]]:
        """table, column, source column, stored or derived."""
        return [(self.name, c.name, c.source, "stored") for c in self.cols] + [(self.name, n, o, "derived") for n, _, o in self.derived()]


def status(raw: Column, pattern: str) -> Column:
    """null, ok or invalid; the whole string has to match (no line feed may follow)."""
    return F.when(raw.isNull(), "null").when(raw.rlike(rf"\A{pattern}\z"), "ok").otherwise("invalid")


def parse_multiple(raw: Column) -> tuple[Column, Column]:
    """2.26x -> 2.26; number and status."""
    how = status(raw, r"[0-9]+(\.[0-9]+)?x")
    return F.when(how == "ok", F.regexp_extract(raw, r"\A([0-9.]+)x", 1).try_cast("double")), how


def parse_magnitude(raw: Column) -> tuple[Column, Column]:
    """209k USD -> 209000.0, exact by decimals; number and status."""
    how = status(raw, r"[0-9]+(\.[0-9]+)?[kMB] USD")
    scale = F.lit(None).cast("decimal(20,0)")
    for k, v in SCALES.items():
        scale = F.when(F.regexp_extract(raw, r"([kMB]) USD", 1) == k, F.lit(int(v)).cast("decimal(20,0)")).otherwise(scale)
    number = F.regexp_extract(raw, r"\A([0-9.]+)", 1).try_cast("decimal(18,6)")
    return F.when(how == "ok", (number * scale).cast("double")), how


def check_header(spec: TableSpec, columns: Sequence[str]) -> None:
    """The columns are those of the spec, in any order, none twice."""
    if len(set(columns)) != len(columns):
        raise ValueError(f"{spec.name}: duplicate columns")
    if missing := sorted({c.source for c in spec.cols} - set(columns)):
        raise ValueError(f"{spec.name}: missing {missing}")
    if more := sorted(set(columns) - {c.source for c in spec.cols}):
        raise ValueError(f"{spec.name}: unexpected {more}")


def converted(c: Col) -> Column:
    """A strict conversion: a value that doesn't fit its kind fails the job with column and value."""
    raw = F.col(f"`{c.source}`")
    kind = KINDS[c.kind]
    if c.kind == "date":
        value = F.when(raw.cast("string").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}( 00:00:00)?\z"), F.substring(raw.cast("string"), 1, 10)).otherwise(raw.cast("string"))
    elif c.kind == "bool":
        value = raw.try_cast("boolean").cast("int")
    else:
        value = raw.try_cast(kind)
    if c.kind == "real":
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    bad = raw.isNotNull() & value.isNull()
    if not c.nullable:
        bad = bad | raw.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{c.name}: not {c.kind}: "), F.coalesce(raw.cast("string"), F.lit("null"))))).otherwise(value).alias(c.name)


def transform(spec: TableSpec, raw: DataFrame) -> DataFrame:
    """The typed table: stored columns in the spec's order, then the derived ones."""
    check_header(spec, raw.columns)
    out = raw.select(*(converted(c) for c in spec.cols))
    for c in spec.cols:
        if c.kind in ("multiple", "magnitude"):
            number, how = (parse_multiple if c.kind == "multiple" else parse_magnitude)(F.col(c.name))
            out = out.withColumns({f"{c.name}_{'num' if c.kind == 'multiple' else 'usd'}": number, f"{c.name}_status": how})
    return out.select(*spec.column_names())


def assert_equal_columns(df: DataFrame, a: str, b: str) -> None:
    """The duplicate of a column says the same in every row."""
    if not df.where(~F.col(a).eqNullSafe(F.col(b))).isEmpty():
        raise ValueError(f"{a} and {b} differ")


def lineage_frame(spark: SparkSession, *specs: TableSpec) -> DataFrame:
    return spark.createDataFrame([row for s in specs for row in s.lineage()], "table_name string, column_name string, source_column string, kind string")


ORDERS = TableSpec("orders", (Col("o_orderkey", "record_id", "int", False), Col("o_custkey", "client_id", "int", False), Col("o_orderstatus", "record_status", "text"), Col("o_totalprice", "amount", "real"), Col("o_orderdate", "record_date", "date"), Col("o_orderpriority", "manager", "text")))
