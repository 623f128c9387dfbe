"""Conditional expressions like ``age >= 18 ? 'Adult' : 'Minor'`` compiled to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, FormulaError
from .values import as_float, display, quoted

#: Tried in this order; the first that occurs splits the condition.
OPERATORS = (">=", "<=", ">", "<", "==", "!=")


def _field(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name.strip().lower()), None)


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def _unquoted(text: str) -> str | None:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else None


def _value(df: DataFrame, text: str) -> Column:
    """A quoted text, a number, true or false, or a field; an unknown name is null."""
    plain = _unquoted(text)
    if plain is not None:
        return F.lit(plain)
    text = text.strip()
    if text in ("true", "false"):
        return F.lit(text == "true")
    for kind in (int, float):
        try:
            return F.lit(kind(text))
        except ValueError:
            pass
    field = _field(df, text)
    return quoted(field) if field else F.lit(None).cast("string")


def ternary(df: DataFrame, expression: str) -> Column:
    """The column of the expression. Orders compare numbers, with 0 for null and text; equality compares
    texts as they are shown. Field names are found without case; an unknown field in the condition fails."""
    if "?" not in expression:
        return _value(df, expression)
    condition, _, rest = expression.partition("?")
    yes, colon, no = rest.partition(":")
    if not colon:
        raise FormulaError("a conditional needs ':'")
    op = next((o for o in OPERATORS if o in condition), None)
    if op is None:
        raise FormulaError(f"no comparison in {condition!r}")
    left, _, right = condition.partition(op)
    field = _field(df, left)
    if field is None:
        raise ColumnNotFound(f"no field {left.strip()!r}")
    c, kind = quoted(field), df.schema[field].dataType
    if op in ("==", "!="):
        text = _unquoted(right)
        same = display(c, kind) == F.lit(right.strip() if text is None else text)
        test = same if op == "==" else ~same
    else:
        number, bound = F.coalesce(as_float(c, kind), F.lit(0.0)), F.lit(_number(right.strip()))
        test = {">=": number >= bound, "<=": number <= bound, ">": number > bound, "<": number < bound}[op]
    a, b = _value(df, yes), _value(df, no)
    return F.when(test, a).otherwise(b)
