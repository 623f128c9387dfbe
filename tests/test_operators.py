import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera import errors
from tessera.functions.formula import column_formula, row_formula
from tessera.functions.metrics import Metrics, observed
from tessera.functions.plugins import from_table, row_schema, to_table, transform_column
from tessera.functions.ternary import ternary
from tessera.functions.values import display
from tessera.operators.aggregate import AggregateSpec, aggregate
from tessera.operators.clean import CleanRule, clean
from tessera.operators.dedup import bloom_filter, bloom_shape, first_rows
from tessera.operators.diff import diff_keyed, diff_positional, diff_totals
from tessera.operators.filters import ColumnFilter, filter_rows
from tessera.operators.fuzzy import fuzzy_left_join, levenshtein_similarity
from tessera.operators.mask import decrypted, encrypt_columns, mask_column, plain_float
from tessera.operators.pivot import pivot
from tessera.operators.project import add_column, coerce_column, rename_columns, select_columns
from tessera.operators.schema import ColumnSchema, align, apply_schema, infer_schema, validate, violations
from tessera.operators.sort import SortKey, page, sort_rows
from tessera.plans.pipeline import Pipeline
from tessera.plans.sql import SimpleQuery

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Alice", 30, 85.0), ("Bob", 25, 92.0), ("Charlie", 35, 78.0), ("Diana", 28, 95.0)], "name string, age long, score double").cache()


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def names_of(df, *filters):
    return sorted(values(filter_rows(df, list(filters)), "name"))


def test_filters(spark, people):
    assert names_of(people, ColumnFilter("age", "eq", 30)) == ["Alice"]
    assert names_of(people, ColumnFilter("age", "gt", 50)) == []
    assert names_of(people, ColumnFilter("name", "contains", "li")) == ["Alice", "Charlie"]
    assert names_of(people, ColumnFilter("age", "contains", "3")) == []
    assert names_of(people, ColumnFilter("name", "regex", "^[AB]"), ColumnFilter("age", "lt", 30)) == ["Bob"]
    assert names_of(people, ColumnFilter("name", "regex", "([")) == []
    assert names_of(people, ColumnFilter("name", "eq", 30)) == []
    assert len(names_of(people, ColumnFilter("name", "not_eq", 30))) == 4
    assert len(names_of(people, ColumnFilter(9, "is_null"))) == 4
    with pytest.raises(errors.ConfigError):
        filter_rows(people, [ColumnFilter("age", "about", 3)])


def test_null_logic(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, ""), (3, 6, "x")], "id long, v long, s string")
    ids = lambda f: sorted(values(filter_rows(df, [f]), "id"))
    assert ids(ColumnFilter("v", "not_eq", 5)) == [1, 3]
    assert ids(ColumnFilter("v", "eq", None)) == [1]
    assert ids(ColumnFilter("v", "gt", None)) == []
    assert ids(ColumnFilter("v", "gte", 5)) == [2, 3]
    assert ids(ColumnFilter("s", "is_null")) == [1]
    assert ids(ColumnFilter("s", "starts_with", "")) == [2, 3]


def test_booleans_have_no_order(spark):
    df = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert filter_rows(df, [ColumnFilter("b", "gt", False)]).count() == 0
    assert SimpleQuery.parse("SELECT b FROM t WHERE b > false").execute(df).count() == 1


def test_projection(people):
    df = select_columns(people, [2, "name", 7])
    assert df.columns == ["score", "name", ""]
    assert values(select_columns(people, [0, 0]).toDF("a", "b").orderBy("a"), "a", "b")[0] == ("Alice", "Alice")
    assert rename_columns(people, [("age", "years"), ("age", "x"), ("AGE", "y")]).columns == ["name", "years", "score"]
    assert add_column(people, "senior", F.col("age") >= 30).columns[-1] == "senior"
    with pytest.raises(errors.ColumnNotFound):
        select_columns(people, ["nobody"])


def test_display(spark):
    df = spark.createDataFrame([(True, 100.0, 1.5, 0.0, 10, None, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), bytearray(b"abc"))], T.StructType([T.StructField(n, t) for n, t in zip("abcdefghi", (T.BooleanType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.StringType(), T.TimestampNTZType(), T.DateType(), T.BinaryType()), strict=True)]))
    row = df.select(*[display(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert list(row) == ["TRUE", "100", "1.5", "0", "10", "", "2024-01-02 03:04:05", "2024-01-02", "<3 bytes>"]


def test_coercion(spark):
    df = spark.createDataFrame([("42", "yes", "2024-05-01", "2024-01-01T10:00:00+02:00"), (" 42 ", "no", "31/12/2023", "2024-01-01 10:00:00"), ("4.5", "1", "2024-13-01", "later"), (None, None, None, None)], "i string, b string, d string, t string")
    out = coerce_column(coerce_column(coerce_column(coerce_column(df, "i", "int"), "b", "bool"), "d", "date"), "t", "datetime").collect()
    assert [r.i for r in out] == [42, None, None, None]
    assert [r.b for r in out] == [True, False, True, None]
    assert [r.d for r in out] == [dt.date(2024, 5, 1), dt.date(2023, 12, 31), None, None]
    assert [r.t for r in out] == [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 10), None, None]
    nums = spark.createDataFrame([(1e30,), (2.9,), (-2.9,), (None,)], "x double")
    assert values(coerce_column(nums, "x", "int"), "x") == [None, 2, -2, None]
    assert values(coerce_column(nums, "x", "string"), "x")[1:] == ["2.9", "-2.9", ""]


def test_aggregates(spark):
    df = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("A", 30.0), ("C", 40.0)], "key string, value double")
    specs = [AggregateSpec("value", op, op) for op in ("sum", "count", "avg", "min", "max")] + [AggregateSpec("key", "count_distinct", "d")]
    assert tuple(aggregate(df, specs).first()) == (100.0, 4, 25.0, 10.0, 40.0, 3)
    assert tuple(aggregate(df.limit(0), specs).first()) == (0.0, 0, None, None, None, 0)
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "value double")
    assert tuple(aggregate(nan, [AggregateSpec("value", "max", "m"), AggregateSpec("value", "min", "n")]).first()) == (1.0, 1.0)
    assert aggregate(df, [AggregateSpec("key", "max", "m"), AggregateSpec("key", "sum", "s")]).first()["m"] is None


def test_pivot(spark):
    df = spark.createDataFrame([("2021", "Apple", 100), ("2021", "Orange", 150), ("2022", "Apple", 200), (None, "Apple", 1), ("2022", None, 1)], "Year string, Product string, Sales long")
    out = pivot(df, "Year", "Product", "Sales")
    assert out.columns == ["Year", "Apple", "Orange"]
    assert [tuple(r) for r in out.collect()] == [("2021", 100.0, 150.0), ("2022", 200.0, None)]
    assert [tuple(r) for r in pivot(df, 0, 1, 2, filters=[ColumnFilter("Sales", "gte", 160)]).collect()] == [("2022", 200.0)]
    assert [tuple(r) for r in pivot(df, "Year", "Product", "Product", "count").collect()] == [("2021", 1.0, 1.0), ("2022", 1.0, None)]
    assert pivot(df.limit(0), "Year", "Product", "Sales").count() == 0


@pytest.mark.parametrize("descending,first,want", [(False, True, [None, 1, 3]), (False, False, [1, 3, None]), (True, True, [3, 1, None]), (True, False, [None, 3, 1])])
def test_sort_nulls(spark, descending, first, want):
    df = spark.createDataFrame([(3,), (None,), (1,)], "v long")
    assert values(sort_rows(df, [SortKey("v", descending, first)]), "v") == want


@quick
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.text("ab", max_size=2)), max_size=12))
def test_sort_like_python(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a long, b string")
    got = values(sort_rows(df, [SortKey("a", nulls_first=True), SortKey("b", descending=True)], ["i"]), "i")
    by_b = sorted(range(len(rows)), key=lambda i: rows[i][1], reverse=True)
    assert got == sorted(by_b, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))


def test_page(people):
    assert values(page(people, [SortKey("age")], 1, 2), "name") == ["Diana", "Alice"]


def test_dedup(spark):
    df = spark.createDataFrame([(0, "ID1"), (1, "ID2"), (2, "ID1"), (3, None), (4, None)], "i long, id string")
    assert sorted(values(first_rows(df, "id", ["i"]), "i")) == [0, 1, 3, 4]
    dates = spark.createDataFrame([(0, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 1))], "i long, d date")
    assert first_rows(dates, "d", ["i"]).count() == 2
    assert bloom_shape(1000, 0.01) == (9586, 7)
    bloom = bloom_filter(df, "id", 100, 0.01)
    assert bloom.mightContain("ID1") and not bloom.mightContain("absent")


def test_fuzzy(spark):
    left = spark.createDataFrame([("Bob", "Engineering"), ("Eve", None), ("Max", "zzz")], "employee string, dept string")
    right = spark.createDataFrame([(1, "Engineering Dept", "R&D"), (2, "Engineering Dept", "late")], "i long, ref string, department string")
    out = fuzzy_left_join(left, right, "dept", "ref", 0.6, ["i"])
    assert out.columns == ["employee", "dept", "i", "department"]
    assert sorted(map(tuple, out.collect())) == [("Bob", "Engineering", 1, "R&D"), ("Eve", None, None, None), ("Max", "zzz", None, None)]
    pairs = spark.createDataFrame([("Alice", "Alice"), ("Alice", "Alic"), ("Alice", "Bob"), ("", "")], "a string, b string")
    assert values(pairs.select(levenshtein_similarity(F.col("a"), F.col("b")).alias("s")), "s") == [1.0, 0.8, 0.0, 1.0]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@quick
@given(st.lists(st.text("abé", max_size=6), max_size=6), st.lists(st.text("abé", max_size=6), max_size=6), st.sampled_from([0.3, 0.5, 0.75, 1.0]))
def test_fuzzy_brute_force(spark, left, right, threshold):
    a = spark.createDataFrame(list(enumerate(left)), "l long, k string")
    b = spark.createDataFrame(list(enumerate(right)), "r long, k string")
    got = dict(map(tuple, fuzzy_left_join(a, b, "k", "k", threshold, ["r"]).select("l", "r").collect()))
    for i, x in enumerate(left):
        best = [(-(1 - brute_distance(x, y) / max(len(x), len(y)) if x or y else 1.0), j) for j, y in enumerate(right)]
        best = [p for p in best if -p[0] >= threshold]
        assert got[i] == (min(best)[1] if best else None)


def test_diff(spark):
    left = spark.createDataFrame([(0, 1, "Alice"), (1, 2, "Bob"), (2, None, "N")], "_row long, id long, name string")
    right = spark.createDataFrame([(0, 1, "Alice Smith"), (1, 3, "Charlie"), (2, None, "N")], "_row long, id long, name string")
    report = diff_keyed(left, right, "id", "_row")
    totals = diff_totals(left, right, report).first().asDict()
    assert totals == {"left_rows": 3, "right_rows": 3, "added": 1, "deleted": 1, "modified": 1, "unchanged": 1}
    change = report.filter("kind = 'modified'").first()
    assert change.row_index == 0 and [tuple(c) for c in change.cells] == [(1, "Alice", "Alice Smith")]
    assert sorted(values(report, "kind", "row_index")) == [("added", 1), ("deleted", 1), ("modified", 0), ("unchanged", 2)]
    by_row = diff_positional(left, right, "_row")
    assert sorted(values(by_row, "kind", "row_index")) == [("modified", 0), ("modified", 1), ("unchanged", 2)]
    twice = spark.createDataFrame([(0, 1, "old"), (1, 1, "Alice Smith")], "_row long, id long, name string")
    assert values(diff_keyed(twice, right, "id", "_row").filter("kind = 'unchanged'"), "row_index") == [1]
    assert diff_keyed(left, left, "id", "_row").filter("kind <> 'unchanged'").count() == 0


def test_clean(spark):
    df = spark.createDataFrame([("  john.doe@example.com  ", "123-456-7890", "123-45-6789", "4111 1111 1111 1234", "a\t b c"), ("ab@x.org", "nope", None, "x", " ")], "email string, phone string, ssn string, card string, s string")
    rules = [CleanRule("email", "trim"), CleanRule("email", "mask_email"), CleanRule("phone", "mask_phone"), CleanRule("ssn", "mask_ssn"), CleanRule("card", "mask_card"), CleanRule("s", "collapse")]
    assert [tuple(r) for r in clean(df, rules).collect()] == [("j***e@example.com", "***-***-7890", "***-**-6789", "****-****-****-1234", "a b c"), ("*@x.org", "nope", None, "x", "")]
    assert values(clean(df, [CleanRule("phone", "replace", r"(\d+)-(\d+)", "${2}.$1")]), "phone")[0] == "456.123-7890"
    assert values(clean(df, [CleanRule("phone", "replace", "([", "x")]), "phone")[0] == "123-456-7890"
    assert values(clean(df, [CleanRule("phone", "replace", "nope", r"a\b")]), "phone")[1] == r"a\b"


def test_masks(spark):
    df = spark.createDataFrame([("secret", 7, 2.5, True), ("é", None, None, None)], "s string, i int, d double, b boolean")
    assert values(mask_column(df, "s", "redact"), "s") == ["******", "**"]
    assert values(mask_column(df, "s", "redact", chars=True), "s") == ["******", "*"]
    assert values(mask_column(df, "i", "redact"), "i") == [0, None]
    assert values(mask_column(df, "b", "hash"), "b") == [True, None]
    hello = spark.createDataFrame([("hello",), ("sensitive",)], "s string")
    assert values(mask_column(hello, "s", "hash"), "s")[0] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert values(mask_column(hello, "s", "partial", left=2, right=2, char="X"), "s") == ["heXlo", "seXXXXXve"]
    assert values(mask_column(hello, "s", "partial", left=3, right=2), "s")[0] == "hello"


def test_plain_float(spark):
    df = spark.createDataFrame([(3.0,), (0.1,), (1e20,), (-1.5e-7,), (1.25e10,), (123456789.125,)], "d double")
    assert values(df.select(plain_float(F.col("d")).alias("t")), "t") == ["3", "0.1", "100000000000000000000", "-0.00000015", "12500000000", "123456789.125"]


def test_encryption(spark):
    df = spark.createDataFrame([("Alice",), (None,), ("x" * 100,)], "ssn string")
    key, iv = b"\x42" * 32, b"\x24" * 16
    sealed = encrypt_columns(df, ["ssn"], key, iv)
    assert values(sealed, "ssn")[1] is None and values(sealed, "ssn")[0] != "Alice"
    assert values(sealed.select(decrypted(F.col("ssn"), key, iv).alias("s")), "s") == values(df, "ssn")


def test_validation(spark):
    df = spark.createDataFrame([(0, 30, "user", "test@example.com"), (1, 15, "manager", "invalid-email"), (2, None, "user", "é@b.cd")], "_row long, age long, role string, email string")
    rules = [ColumnSchema("age", "int", minimum=18, maximum=65), ColumnSchema("role", allowed=("admin", "user")), ColumnSchema("email", pattern=r"^.+@.+\..+$", max_length=16)]
    found = violations(df, rules, "_row").orderBy("row", "position").collect()
    assert [(r.row, r.column) for r in found] == [(1, "age"), (1, "role"), (1, "email")]
    with pytest.raises(errors.ValidationFailed):
        validate(df, [ColumnSchema("age", "int", nullable=False)], "_row", strict=True)
    wrong = violations(df.select("_row", F.lit("x").alias("age")), [ColumnSchema("age", "int")], "_row")
    assert wrong.count() == 3
    assert values(apply_schema(spark.createDataFrame([("Alice", "30", "yes")], "a string, b string, c string"), [ColumnSchema("a"), ColumnSchema("b", "int"), ColumnSchema("c", "bool")]), "b", "c") == [(30, True)]


def test_inference_and_drift(spark):
    df = spark.createDataFrame([("Alice", "30", "1.5", "1", ""), ("Bob", "25", "2", "x", " "), ("C", None, "3", "2", None)], "n string, i string, f string, m string, e string")
    assert [(s.kind, s.nullable) for s in infer_schema(df, raw=True)] == [("string", False), ("int", True), ("float", False), ("string", False), ("string", True)]
    drift = spark.createDataFrame([(30, 80000, "Alice")], "AGE long, salary long, Name string")
    target = [ColumnSchema("name"), ColumnSchema("age", "int"), ColumnSchema("country")]
    assert [tuple(r) for r in align(drift, target).collect()] == [("Alice", 30, None)]
    for flags in ({"fail_on_missing": True}, {"fail_on_extra": True}):
        with pytest.raises(errors.DriftError):
            align(drift, target, **flags)


def test_formulas(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0, "t"), (20.0, 0.0, 1.0, "u"), (30.0, 1.0, None, "v")], "a double, b double, c double, t string")
    get = lambda f: values(df.select(row_formula(df, f).alias("x")), "x")
    assert get("=A1+B1*C1") == [20.0, 20.0, 30.0]
    assert get("=A1/B1-C1") == [0.0, None, 30.0]
    assert get("oooc:=[.A1]+[.B1]") == [15.0, 20.0, 31.0]
    assert get("=-(A1-B1)*2+D1+Z9") == [-10.0, -40.0, -58.0]
    assert get("=D7") == ["t", "u", "v"]
    batch = lambda f: df.agg(column_formula(df, f).alias("x")).first()[0]
    assert [batch(f"={n}(A)") for n in ("SUM", "AVERAGE", "MIN", "MAX")] == [60.0, 20.0, 10.0, 30.0]
    assert batch("=AVERAGE(C1:C9)") == 1.0 and batch("=MIN(D)") is None
    for bad in ("=A1+", "=(A1", "=A1 B1", "=", "=A1+#"):
        with pytest.raises(errors.FormulaError):
            row_formula(df, bad)
    with pytest.raises(errors.FormulaError):
        column_formula(df, "=MEDIAN(A)")


def test_ternary(spark):
    df = spark.createDataFrame([("Bob", 20, None), ("Alice", 15, "x")], "name string, age long, z string")
    get = lambda e: values(df.select(ternary(df, e).alias("x")), "x")
    assert get("AGE >= 18 ? 'Adult' : 'Minor'") == ["Adult", "Minor"]
    assert get("name == 'Bob' ? age : 0") == [20, 0]
    assert get("z < 1 ? 'low' : 'high'") == ["low", "low"]
    with pytest.raises(errors.ColumnNotFound):
        ternary(df, "nobody > 1 ? 1 : 2")
    with pytest.raises(errors.FormulaError):
        ternary(df, "age > 1 ? 1")


def test_simple_sql(spark):
    df = spark.createDataFrame([("Alice", 30, True), ("Bob", 25, False), ("Charlie", 35, True)], "name string, age long, active boolean")
    run = lambda q: SimpleQuery.parse(q).execute(df)
    assert run("SELECT name FROM t WHERE age >= 30").count() == 2
    assert run("SELECT Name,Age FROM t WHERE active = true").columns == ["name", "age"]
    assert run("SELECT * FROM t WHERE name = 'Bob'").count() == 1
    assert run("SELECT * FROM t WHERE age = 30.0").count() == 1
    assert run("SELECT * FROM t WHERE age ~ 30").count() == 0
    assert run("SELECT * FROM t WHERE age").count() == 3
    with pytest.raises(errors.ColumnNotFound):
        run("SELECT nobody FROM t")
    with pytest.raises(errors.SqlError):
        run("DELETE FROM t")


def test_pipeline(people):
    assert Pipeline().filter("age", "gte", 30).apply(people).count() == 2
    assert values(Pipeline().sort_by("score", descending=True).filter("score", "gte", 80).apply(people), "name") == ["Diana", "Bob", "Alice"]
    # Filters see values before they are masked, computed columns see them after.
    out = Pipeline().add_column("n", F.length("name")).mask("name", "redact").filter("name", "eq", "Bob").rename("name", "who").apply(people)
    assert [tuple(r) for r in out.collect()] == [("***", 25, 92.0, 3)]
    assert Pipeline().filter("age", "gt", 99).apply(people).count() == 0


def test_plugins(spark):
    from dataclasses import dataclass

    @dataclass
    class Person:
        name: str
        age: int
        active: bool | None = None

    df = spark.createDataFrame([(10, 2.5, "x")], "i long, d double, s string")
    assert values(transform_column(df, "i", lambda s: s * 2), "i") == [20]
    assert values(transform_column(df, "d", lambda s: s * 2), "d") == [5.0]
    assert values(transform_column(df, "s", lambda s: s * 2), "s") == ["x"]
    assert row_schema(Person).fieldNames() == ["name", "age", "active"]
    assert list(from_table(to_table(spark, [Person("Bob", 25, True)], Person), Person)) == [Person("Bob", 25, True)]


def test_metrics(spark):
    m = Metrics()
    m.add("rows", 5)
    with m.timed("read"):
        pass
    assert "tessera_rows_total 5" in m.text() and "tessera_read_seconds_count 1" in m.text()
    df, seen = observed(spark.range(7), "r")
    df.collect()
    assert seen.get["rows"] == 7
