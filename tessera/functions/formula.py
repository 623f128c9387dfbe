"""Spreadsheet formulas compiled to columns.

Row formulas (``=A1+B1*C1``) refer to columns by letter; row digits are ignored. A value that isn't a
number counts as 0, division by zero gives null, and any arithmetic gives a double; a lone reference
keeps its type. Parentheses and a leading sign are understood. Column formulas (``=SUM(A)``) run over
all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FormulaError
from .values import as_float, quoted

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<ref>\$?[A-Za-z]+\$?\d*)|(?P<op>[-+*/()]))")
_COLUMN = re.compile(r"^(SUM|AVERAGE|MIN|MAX)\(\s*\$?([A-Za-z]+)\$?\d*(?:\s*:\s*\$?([A-Za-z]+)\$?\d*)?\s*\)$", re.I)


def normalised(formula: str) -> str:
    """Without the leading sign or the ODS prefix; ``[.A1]`` is read as ``A1``."""
    text = formula.strip()
    if text.lower().startswith(("oooc:=", "of:=")):
        text = text[text.index("=") :]
    text = re.sub(r"\[\.([^\]]*)\]", lambda m: m[1].replace(".", ""), text)
    return text[1:].strip() if text.startswith("=") else text


def column_index(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


class _Parser:
    """Recursive descent over the four operations; * and / bind tighter, all go left to right."""

    def __init__(self, text: str, df: DataFrame) -> None:
        self.df, self.at, self.tokens = df, 0, []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-"):
            op, right = self.take()[1], self.product()
            left = left + right if op == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.factor()
        while self.peek() in ("*", "/"):
            op, right = self.take()[1], self.factor()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def factor(self) -> Column:
        kind, text = self.take()
        if kind == "number":
            return F.lit(float(text))
        if kind == "ref":
            return reference(self.df, text)
        if text == "-":
            return -self.factor()
        if text == "+":
            return self.factor()
        if text == "(":
            inner = self.sum()
            if self.take()[1] != ")":
                raise FormulaError("a parenthesis isn't closed")
            return inner
        raise FormulaError(f"unexpected {text!r}")


def reference(df: DataFrame, text: str) -> Column:
    """A cell as a number; columns outside the table and values that aren't numbers are 0."""
    i = column_index(re.sub(r"[$\d]", "", text))
    if i >= len(df.columns):
        return F.lit(0.0)
    return F.coalesce(as_float(quoted(df.columns[i]), df.schema[i].dataType), F.lit(0.0))


def row_formula(df: DataFrame, formula: str) -> Column:
    """The column that a row formula stands for."""
    text = normalised(formula)
    if re.fullmatch(r"\$?[A-Za-z]+\$?\d*", text):
        i = column_index(re.sub(r"[$\d]", "", text))
        return quoted(df.columns[i]) if i < len(df.columns) else F.lit(None)
    parser = _Parser(text, df)
    if not parser.tokens:
        raise FormulaError("empty formula")
    out = parser.sum()
    if parser.peek() is not None:
        raise FormulaError(f"unexpected {parser.peek()!r}")
    return out


def column_formula(df: DataFrame, formula: str) -> Column:
    """The aggregate that ``=SUM(A)``, ``=AVERAGE(A)``, ``=MIN(A)`` or ``=MAX(A)`` stands for.

    Nulls and text count as 0 in sums and averages, and as nothing in minima and maxima. A range over
    several columns takes the values of all of them.
    """
    m = _COLUMN.match(normalised(formula))
    if not m:
        raise FormulaError(f"unknown formula {formula!r}")
    first, last = column_index(m[2]), column_index(m[3] or m[2])
    numbers = [as_float(quoted(df.columns[i]), df.schema[i].dataType) for i in range(min(first, last), max(first, last) + 1) if i < len(df.columns)]
    if not numbers:
        return F.lit(None).cast("double")
    total = F.coalesce(sum((F.sum(F.coalesce(x, F.lit(0.0))) for x in numbers), F.lit(0.0)), F.lit(0.0))
    name = m[1].upper()
    if name == "SUM":
        return total
    if name == "AVERAGE":
        return F.try_divide(total, F.count(F.lit(1)) * len(numbers))
    pick = [(F.min if name == "MIN" else F.max)(F.nanvl(x, F.lit(None).cast("double"))) for x in numbers]
    return pick[0] if len(pick) == 1 else (F.least if name == "MIN" else F.greatest)(*pick)
