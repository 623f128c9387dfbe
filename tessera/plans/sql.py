"""SQL over tables: the engine's own dialect, and a small compatible one for a single table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, SqlError
from ..functions.values import equals, orders, quoted


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Full SQL; tables are named by keyword and visible to this statement only."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def typed_literal(text: str) -> object:
    """A literal as bool, int, float or text, tried in that order; quotes are taken off texts."""
    text = text.strip().rstrip(";").strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


@dataclass(frozen=True)
class SimpleQuery:
    """``SELECT a, b [FROM t] [WHERE c op value]`` over one table; the table's name is not looked at.

    Names are found without case. All words after the operator are the value. Numbers compare as numbers
    whatever their type; an operator that isn't one of = != > >= < <= keeps no rows.
    """

    columns: tuple[str, ...]
    where: tuple[str, str, object] | None = None

    @staticmethod
    def parse(sql: str) -> SimpleQuery:
        words = sql.split()
        if not words or words[0].lower() != "select":
            raise SqlError("a query starts with SELECT")
        lower = [w.lower().rstrip(";") for w in words]
        end = next((i for i, w in enumerate(lower) if w in ("from", "where")), len(words))
        columns = tuple(x.strip() for w in words[1:end] for x in w.rstrip(";").split(",") if x.strip())
        if not columns:
            raise SqlError("no columns are selected")
        where = None
        if "where" in lower:
            rest = words[lower.index("where") + 1 :]
            if len(rest) >= 3:
                where = (rest[0], rest[1], typed_literal(" ".join(rest[2:])))
        return SimpleQuery(columns, where)

    def execute(self, df: DataFrame) -> DataFrame:
        names: dict[str, str] = {}
        for c in df.columns:
            names.setdefault(c.lower(), c)

        def find(name: str) -> str:
            if name.lower() not in names:
                raise ColumnNotFound(f"no column {name!r}")
            return names[name.lower()]

        if self.where:
            name, op, value = self.where
            name = find(name)
            c, kind = quoted(name), df.schema[name].dataType
            if op in ("=", "!="):
                same = equals(c, kind, value)
                df = df.filter(same if op == "=" else ~same)
            elif op in (">", ">=", "<", "<="):
                df = df.filter(orders(c, kind, op, value, booleans=True))
            else:
                df = df.filter(F.lit(False))
        return df.select("*") if self.columns == ("*",) else df.select(*[quoted(find(c)) for c in self.columns])
