"""apply_schema against its SQL on balances whose display text differs from SQL's."""

import duckdb
import numpy as np
from tessera.operators.schema import ColumnSchema, apply_schema
from tessera.queries import QUERIES, SQL


def test_apply_schema_equals_sql_on_odd_balances(spark, tmp_path):
    drawn = np.random.default_rng(5).uniform(-1000, 10000, 500).tolist()
    odd = [-0.0, 0.0, -0.004, -4e-11, 5e-324, 2.0**-44, 1e-5, 0.0001, 0.1 + 0.2, 1 / 3, 99999.995, 123456789012.34, 4503599627370495.5, 1234567890123456789.0, -(2.0**63), -5.0, 0.01, None, *drawn]
    rows = [(None if i == 3 else i, None if i % 7 == 0 else i % 25, x) for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = duck.sql(SQL["apply_schema"]).fetchall()
    got = [tuple(r) for r in QUERIES["apply_schema"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sql_text_of_other_kinds(spark):
    df = spark.createDataFrame([(0.1, float("inf"), "", True), (-0.0, 2.0**63, None, None), (None, float("nan"), "x", False)], "f float, d double, s string, b boolean")
    out = apply_schema(df, [ColumnSchema(c) for c in df.columns], as_sql=True).collect()
    assert [tuple(r) for r in out] == [("0.1", "inf", "", "true"), ("0", "9.223372036854776e+18", None, None), (None, "nan", "x", "false")]


def test_display_text_stays_the_default(spark):
    df = spark.createDataFrame([(1 / 3,), (-0.0,), (None,)], "x double")
    assert [r.x for r in apply_schema(df, [ColumnSchema("x")]).collect()] == ["0.3333333333", "-0", ""]
