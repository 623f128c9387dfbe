"""Schema inference, validation, and alignment of drifting inputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DriftError, SchemaError, ValidationFailed
from ..functions.values import as_float, display, family, quoted, safe_pattern, sql_text, trimmed
from .project import coerced

KINDS = ("bool", "int", "float", "string", "date", "datetime")
TYPES: dict[str, T.DataType] = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    kind: str = "string"
    nullable: bool = True
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] | None = None
    pattern: str | None = None

    def field(self) -> T.StructField:
        limits = {k: v for k, v in (("max_length", self.max_length), ("min", self.minimum), ("max", self.maximum), ("enum", self.allowed and list(self.allowed)), ("pattern", self.pattern)) if v is not None}
        return T.StructField(self.name, TYPES[self.kind], self.nullable, limits)


def column_kind(kind: T.DataType) -> str:
    found = family(kind)
    if found == "number":
        return "float" if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else "int"
    return {"time": "datetime", "other": "string"}.get(found, found)


def cell_text(c: Column, null_values: Sequence[str] = ()) -> Column:
    """Trimmed text of a raw cell; empty cells and the named null texts are null."""
    t = trimmed(c)
    gone = F.char_length(t) == 0
    return F.when(~(gone | t.isin(*null_values) if null_values else gone), t)


def cell_kind(t: Column) -> Column:
    """Kind of a trimmed raw cell: bool, int, float or string; null for none. 1 and 0 are integers."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(F.lower(t).isin("true", "yes", "false", "no"), "bool")
        .when(t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull(), "int")
        .when(t.rlike(number) | F.lower(t).rlike(r"^[+-]?(inf|infinity|nan)$"), "float")
        .otherwise("string")
    )


def promote(counts: dict[str, int]) -> str:
    """The type of a column from how often each kind occurs: the most frequent, then promotion rules."""
    seen = {k for k, n in counts.items() if n}
    if not seen:
        return "string"
    if len(seen) == 1:
        return next(iter(seen))
    if {"int", "float"} <= seen:
        return "float"
    if "string" in seen:
        return "string"
    if {"datetime", "date"} <= seen:
        return "datetime"
    return max(sorted(seen), key=lambda k: counts[k])


def infer_schema(df: DataFrame, sample: int | None = 1000, raw: bool = False, null_values: Sequence[str] = ()) -> list[ColumnSchema]:
    """Types of columns by vote over the first ``sample`` rows (None: all), in one aggregate.

    ``raw`` treats text columns as unparsed cells; otherwise each column votes with its own type.
    """
    part = df if sample is None else df.limit(sample)
    votes = []
    for i, f in enumerate(df.schema):
        c = quoted(f.name)
        if raw and family(f.dataType) == "string":
            t = cell_text(c, null_values)
            votes += [F.count_if(cell_kind(t) == k).alias(f"v{i}_{k}") for k in KINDS] + [F.count_if(t.isNull()).alias(f"v{i}_null")]
        else:
            own = column_kind(f.dataType)
            votes += [(F.count(c) if k == own else F.lit(0)).alias(f"v{i}_{k}") for k in KINDS] + [F.count_if(c.isNull()).alias(f"v{i}_null")]
    if not votes:
        return []
    row = part.agg(*votes).first()
    return [ColumnSchema(f.name or f"column_{i}", promote({k: row[f"v{i}_{k}"] for k in KINDS}), nullable=row[f"v{i}_null"] > 0) for i, f in enumerate(df.schema)]


def inferred_table(df: DataFrame, sample: int | None = 1000, raw: bool = False) -> DataFrame:
    """The inferred schema as a table: position, name, kind, nullable."""
    rows = [(i, c.name, c.kind, c.nullable) for i, c in enumerate(infer_schema(df, sample, raw))]
    return df.sparkSession.createDataFrame(rows, "position int, name string, kind string, nullable boolean")


def typed(df: DataFrame, schema: Sequence[ColumnSchema], null_values: Sequence[str] = ()) -> DataFrame:
    """Raw text columns parsed to their types; a cell that its column's type can't hold becomes null."""
    out = []
    for s in schema:
        t = cell_text(quoted(s.name), null_values)
        if s.kind == "bool":
            value = F.when(F.lower(t).isin("true", "yes"), True).when(F.lower(t).isin("false", "no"), False)
        elif s.kind == "float":
            value = t.try_cast("double")
        else:
            value = coerced(t, T.StringType(), s.kind) if s.kind != "string" else t
        out.append(value.alias(s.name))
    return df.select(*out)


def fits(kind: T.DataType, wanted: str) -> bool:
    own = column_kind(kind)
    return own == wanted or (own, wanted) in (("int", "float"), ("date", "datetime")) or isinstance(kind, T.NullType)


def violations(df: DataFrame, schema: Sequence[ColumnSchema], index: str) -> DataFrame:
    """Every broken rule: row, column and message, one row each. A null breaks only the null rule.

    Columns are matched by position; ``index`` numbers the rows and isn't checked. Lengths are in bytes.
    """
    names = [c for c in df.columns if c != index]
    found: list[Column] = []
    for i, s in enumerate(schema):
        if i >= len(names):
            if not s.nullable:
                found.append(F.struct(F.lit(i).alias("position"), F.lit(s.name).alias("column"), F.lit("null value in a column that is not nullable").alias("message")))
            continue
        c, kind = quoted(names[i]), df.schema[names[i]].dataType
        number, text = as_float(c, kind), display(c, kind)
        rules: list[tuple[Column, str]] = []
        if not s.nullable:
            rules.append((c.isNull(), "null value in a column that is not nullable"))
        if not fits(kind, s.kind):
            rules.append((c.isNotNull(), f"expected {s.kind}, found {column_kind(kind)}"))
        if s.max_length is not None and family(kind) == "string":
            rules.append((F.octet_length(c) > s.max_length, f"longer than {s.max_length}"))
        if s.minimum is not None:
            rules.append((number < s.minimum, f"below the minimum of {s.minimum:g}"))
        if s.maximum is not None:
            rules.append((number > s.maximum, f"above the maximum of {s.maximum:g}"))
        if s.allowed is not None:
            rules.append((c.isNotNull() & ~text.isin(*s.allowed), "not an allowed value"))
        if s.pattern is not None and safe_pattern(s.pattern) and family(kind) == "string":
            rules.append((~c.rlike(s.pattern), f"doesn't match {s.pattern}"))
        found += [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(i).alias("position"), F.lit(s.name).alias("column"), F.lit(m).alias("message"))) for bad, m in rules]
    if not found:
        return df.select(quoted(index).alias("row"), F.lit(0).alias("position"), F.lit("").alias("column"), F.lit("").alias("message")).limit(0)
    errors = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(quoted(index).alias("row"), F.explode(errors).alias("e")).select("row", "e.position", "e.column", "e.message")


def validate(df: DataFrame, schema: Sequence[ColumnSchema], index: str, strict: bool = False) -> DataFrame:
    """The violations; with ``strict`` the first one is raised instead."""
    found = violations(df, schema, index)
    if strict:
        first = found.orderBy("row", "position").first()
        if first is not None:
            raise ValidationFailed(f"row {first['row']}, column {first['column']}: {first['message']}")
    return found


def apply_schema(df: DataFrame, schema: Sequence[ColumnSchema], index: str | None = None, strict: bool = False, as_sql: bool = False) -> DataFrame:
    """Strict: the table if it's valid. Otherwise columns are coerced, by position.

    ``as_sql`` gives columns of strings the text of a cast in SQL, not the display text (ten decimals, null as '').
    """
    if strict:
        if index is None:
            raise SchemaError("strict validation needs a row index")
        validate(df, schema, index, strict=True)
        return df
    names = [c for c in df.columns if c != index]
    kinds = {n: s.kind for n, s in zip(names, schema, strict=False)}
    text = sql_text if as_sql else display
    return df.select(*[coerced(quoted(c), df.schema[c].dataType, kinds[c], text).alias(c) if c in kinds else quoted(c) for c in df.columns])


def align(df: DataFrame, target: Sequence[ColumnSchema], fail_on_missing: bool = False, fail_on_extra: bool = False) -> DataFrame:
    """Columns in the target's order under its names, matched without case; missing ones null, extra ones dropped."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    wanted = {s.name.lower() for s in target}
    missing, extra = [s.name for s in target if s.name.lower() not in have], [c for c in df.columns if c.lower() not in wanted]
    if fail_on_missing and missing:
        raise DriftError(f"missing columns: {', '.join(missing)}")
    if fail_on_extra and extra:
        raise DriftError(f"unexpected columns: {', '.join(extra)}")
    return df.select(*[quoted(have[s.name.lower()]).alias(s.name) if s.name.lower() in have else F.lit(None).cast(TYPES[s.kind]).alias(s.name) for s in target])
