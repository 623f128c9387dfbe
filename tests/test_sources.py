import datetime as dt
import io
import json as jsonlib
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera import errors
from tessera.config import Chart, ConditionalFormat, FileFormat, ReaderConfig, WriterConfig
from tessera.operators.schema import ColumnSchema
from tessera.sources import columnar, crypto, csv, delta, export, json, kafka, ods, report, sqltext, storage, xlsx, zipfix
from tessera.sources.convert import csv_to_workbook, fuzzy_join_files, load, workbook_to_csv
from tessera.sources.rows import with_row_index
from tessera.sources.sniff import sniff
from tessera.sources.workbook import read_workbook, sheets, workbook_bytes, write_workbook

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cell = st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=6)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def put(tmp_path):
    def write(name, text, encoding="utf-8"):
        p = tmp_path / name
        p.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
        return str(p)

    return write


def test_csv_typing(spark, put):
    path = put("a.csv", "name,age,ok,x,none\nAlice,30,true,1.5,\nBob, 25 ,No,2,NA\n")
    df = csv.read_csv(spark, path, ReaderConfig(null_values=("NA",)))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "boolean", "double", "string"]
    assert rows(df) == [("Alice", 30, True, 1.5, None), ("Bob", 25, False, 2.0, None)]


def test_csv_options(spark, put):
    path = put("b.csv", "junk\nmore,junk,here\na;b;c\n1;2;3\n4;5;6\n7;8;9\n")
    config = ReaderConfig(skip_rows=2, delimiter=";")
    assert rows(csv.read_csv(spark, path, config)) == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert rows(csv.read_csv(spark, path, config.but(max_rows=2, columns=(2, 0)))) == [(3, 1), (6, 4)]
    assert csv.read_csv(spark, path, config.but(column_names=("b",))).columns == ["b"]
    assert csv.read_csv(spark, path, config.but(has_header=False)).columns == ["column_0", "column_1", "column_2"]
    tabs = put("c.tsv", "a\tb\n1\tx y\n")
    assert rows(load(spark, tabs)) == [(1, "x y")]
    assert csv.read_csv(spark, put("empty.csv", "")).columns == []


def test_csv_quoting_and_encodings(spark, put):
    path = put("q.csv", 'a,b\n"x, y","line\none"\n"say ""hi""",z\n')
    assert rows(csv.read_csv(spark, path, ReaderConfig(multi_line=True))) == [("x, y", "line\none"), ('say "hi"', "z")]
    latin = put("l.csv", "a,b\ncafé,1\n", "cp1252")
    assert rows(csv.read_csv(spark, latin, ReaderConfig(encoding="latin1"))) == [("café", 1)]
    assert rows(csv.read_csv(spark, put("m.csv", "a,b\n€5,1\n", "cp1252"), ReaderConfig(encoding="latin1"))) == [("€5", 1)]
    assert rows(csv.read_csv(spark, put("j.csv", "a,b\nテスト,1\n", "shift_jis"), ReaderConfig(encoding="shiftjis"))) == [("テスト", 1)]
    wide = put("w.csv", "a,b\ncafé,1\n", "utf-16-le")
    assert rows(csv.read_csv(spark, wide, ReaderConfig(encoding="utf-16le"))) == [("café", 1)]
    assert rows(csv.read_csv(spark, put("bom.csv", "﻿a,b\n1,2\n"))) == [(1, 2)]
    assert csv.read_csv(spark, put("bom2.csv", "﻿a,b\n1,2\n")).columns == ["a", "b"]


def test_csv_bad_rows(spark, put):
    path = put("bad.csv", "a,b\n1,2\n3\n4,5\n")
    with pytest.raises(Exception):
        csv.read_csv(spark, path, ReaderConfig(infer_types=False)).collect()
    assert csv.read_csv(spark, path, ReaderConfig(mode="DROPMALFORMED", infer_types=False)).collect()[-1][0] == "4"
    assert rows(csv.read_csv(spark, path, ReaderConfig(mode="PERMISSIVE")))[1] == (3, None)


def test_csv_splits_lose_nothing(spark, tmp_path):
    path = tmp_path / "large.csv"
    with path.open("w") as f:
        f.write("index,value\n")
        f.writelines(f"{i},value number {i} padded to be long enough for several splits\n" for i in range(60_000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        df = csv.read_csv(spark, str(path), schema=[ColumnSchema("index", "int"), ColumnSchema("value")])
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.count("*"), F.sum("index"), F.countDistinct("index")).first()[:] == (60_000, sum(range(60_000)), 60_000)
        numbered = with_row_index(df, scan=True)
        assert numbered.filter("_row <> index").count() == 0
        turned = with_row_index(df.repartition(8).orderBy(F.desc("index")))
        assert turned.filter("_row + index <> 59999").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_bytes(spark):
    df = csv.read_csv_bytes(spark, b"name;age\nA;1\nB;2\n")
    assert rows(df) == [("A", 1), ("B", 2)]
    with pytest.raises(errors.CsvError):
        csv.read_csv_bytes(spark, b"a,b\n1,2\n3\n")


def test_csv_writer(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q', " s", True, 1.50), ("line\nend", None, "x", False, 2.0)], "a string, b string, c string, d boolean, e double")
    assert csv.to_csv_text(df) == 'a,b,c,d,e\n"a,b","q""q"," s",TRUE,1.5\n"line\nend",,x,FALSE,2\n'
    assert csv.to_csv_text(df.limit(1), WriterConfig(line_end="\r\n", header=False)) == '"a,b","q""q"," s",TRUE,1.5\r\n'
    path = str(tmp_path / "out")
    csv.write_csv(df, path)
    back = csv.read_csv(spark, path, ReaderConfig(multi_line=True, sniff=False))
    assert sorted(rows(back), key=str)[0][0] == "a,b"


@quick
@given(st.lists(st.tuples(st.integers(-9, 9), cell), min_size=1, max_size=5))
def test_csv_text_roundtrip(spark, data):
    import csv as standard

    df = spark.createDataFrame(data, "i long, t string")
    text = csv.to_csv_text(df)
    assert [tuple(r) for r in standard.reader(io.StringIO(text, newline=""))][1:] == [(str(i), t) for i, t in data]


def test_sniffing():
    assert sniff("name;age\nAlice;30\n").delimiter == ";"
    assert sniff("a\tb\n1\t2\n").delimiter == "\t"
    found = sniff("'a'|'b'\n1|2\n")
    assert (found.delimiter, found.quote, found.has_header) == ("|", "'", True)
    assert sniff('a,b\n"x\\"y",2\n').escape == "\\"
    assert not sniff("1,2\n3,4\n").has_header
    with pytest.raises(errors.ConfigError):
        sniff(b"")


def test_config():
    assert FileFormat.from_path("/x/a.XLSX") is FileFormat.XLSX and FileFormat.from_extension("tab") is FileFormat.TSV
    for bad in ({"columns": (0,), "column_names": ("a",)}, {"memory_limit": 50_000}, {"delimiter": ";;"}, {"mode": "LOOSE"}, {"skip_rows": -1}):
        with pytest.raises(errors.ConfigError):
            ReaderConfig(**bad).validate()
    with pytest.raises(errors.ConfigError):
        FileFormat.from_path("a.doc")


def test_json(spark, put):
    path = put("a.jsonl", '{"name":"Alice","age":30,"x":{"k":[1]}}\n{"name":"Bob","age":25}\n')
    assert rows(json.read_json(spark, path)) == [(30, "Alice", '{"k":[1]}'), (25, "Bob", None)]
    assert rows(json.read_json(spark, path, ReaderConfig(column_names=("name", "nope")))) == [("Alice", None), ("Bob", None)]
    array = put("a.json", '[{"a":1},\n{"a":2}]')
    assert rows(json.read_json(spark, array, array=True)) == [(1,), (2,)]
    with pytest.raises(Exception):
        json.read_json(spark, put("bad.jsonl", '{"a":1}\n7 8\n')).collect()


def test_parquet_and_arrow(spark, tmp_path):
    df = spark.createDataFrame([("Alice", 30, dt.datetime(2024, 1, 1, 1, 1, 1, 123456)), ("Bob", None, None)], "name string, age long, t timestamp_ntz")
    path = str(tmp_path / "p")
    columnar.write_parquet(df.coalesce(1), path)
    assert rows(columnar.read_parquet(spark, path)) == rows(df)
    assert columnar.read_parquet(spark, path, ReaderConfig(columns=(1,))).columns == ["age"]
    assert [r.type for r in columnar.parquet_columns(spark, path).orderBy("position").collect()] == ["string", "bigint", "timestamp_ntz"]
    file, stream = columnar.arrow_bytes(df), columnar.arrow_bytes(df, stream=True)
    assert file[:6] == b"ARROW1" and b"ARROW1" not in stream[:6]
    import pyarrow as pa

    assert pa.ipc.open_stream(stream).read_all().num_rows == 2
    parts = columnar.arrow_parts(df.coalesce(1)).collect()
    assert pa.ipc.open_stream(bytes(parts[0].content)).read_all().num_rows == 2
    columnar.write_arrow(df, str(tmp_path / "a.arrow"))
    assert rows(load(spark, str(tmp_path / "a.arrow"))) == rows(df)


def test_serial_dates():
    get = xlsx.serial_to_datetime
    assert get(1) == dt.datetime(1900, 1, 1) and get(59) == dt.datetime(1900, 2, 28) and get(61) == dt.datetime(1900, 3, 1)
    assert get(45292) == dt.datetime(2024, 1, 1) and get(45292.5).hour == 12 and get(0, True) == dt.datetime(1904, 1, 1)
    assert get(45291.999999999) == dt.datetime(2024, 1, 1)
    assert get(-1) is None
    for d in (dt.datetime(1900, 1, 1), dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1), dt.datetime(2024, 1, 1, 18)):
        assert get(xlsx.datetime_to_serial(d)) == d


@pytest.mark.parametrize("code,date", [("yyyy-mm-dd", True), ("dd/mm/yyyy hh:mm", True), ("[h]:mm:ss", True), ("#,##0.00", False), ("0%", False), ("General", False), ('"day" 0', False), ("[Red]0.0", False), ("mmm", True)])
def test_date_codes(code, date):
    assert xlsx.is_date_code(code) is date


def test_columns_by_letter():
    assert [xlsx.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(xlsx.column_letters(i) + "7") == i for i in range(0, 20_000, 37))


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_workbook_roundtrip(spark, tmp_path, kind):
    df = spark.createDataFrame([("Alice", 30, 1.5, True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 12, 30)), (" b  <&\n> ", -25, None, False, None, None), (None, 7, 2.0, None, dt.date(1999, 1, 1), dt.datetime(2000, 1, 1, 1, 0))], "name string, age long, x double, ok boolean, d date, t timestamp_ntz")
    path = str(tmp_path / f"a.{kind}")
    assert write_workbook(df, path) == 3
    back = read_workbook(spark, path).orderBy("_row").drop("_row")
    assert back.dtypes == df.dtypes
    assert rows(back) == rows(df)
    assert sheets(spark, path).first().name == "Sheet1"


@quick
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), cell.filter(bool)), min_size=1, max_size=4))
def test_workbook_text_roundtrip(spark, data):
    clean = [(i, xlsx._clean(t) or "x") for i, t in data]
    for writer, reader in ((xlsx.XlsxWriter, xlsx.Workbook), (ods.OdsWriter, ods.Workbook)):
        out = io.BytesIO()
        w = writer(out, ["i", "t"])
        for r in clean:
            w.write(list(r))
        w.finish()
        book = reader(out.getvalue())
        got = [cells for _, cells in book.rows(book.sheets[0][1])][1:]
        assert [(int(c[0][1]), c[1][1]) for c in got] == clean


def test_workbook_options(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(10_000)], "i long, n string, x double")
    path = str(tmp_path / "big.xlsx")
    config = WriterConfig(freeze_header=True, auto_filter=True, auto_width=True, merge=("A1:B1",), formats=(ConditionalFormat(2, 5, 10, "FF0000"), ConditionalFormat(2, None, 5, "00FF00")), chart=Chart("bar", "T", 0, 2), template="financial", sheet_name="A & B")
    assert write_workbook(df, path, config, order=["i"]) == 10_000
    book = zipfile.ZipFile(path)
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    for part in ('state="frozen"', "<autoFilter", '<mergeCell ref="A1:B1"/>', "<cols>", "<drawing"):
        assert part in sheet
    assert "barChart" in book.read("xl/charts/chart1.xml").decode()
    back = read_workbook(spark, path, ReaderConfig(sheet="A & B"))
    assert back.count() == 10_000 and back.agg(F.sum("i")).first()[0] == sum(range(10_000))
    assert read_workbook(spark, path, ReaderConfig(max_rows=5, columns=(0,))).count() == 5
    with pytest.raises(errors.WorkbookError):
        read_workbook(spark, path, ReaderConfig(sheet="none"))


@pytest.mark.parametrize("name,values", [("professional", ("1F4E79", "FFFFFF", "DAEEF3", "Calibri", True, True)), ("financial", ("2C3E50", "F1C40F", "ECF0F1", "Arial", True, True)), ("dashboard", ("34495E", "ECDBBA", "F7F9FC", "Segoe UI", True, False))])
def test_style_templates(spark, tmp_path, name, values):
    import datetime as dt

    fill, ink, stripe, font, frozen, filtered = values
    t = xlsx.TEMPLATES[name]
    assert (t.header_fill, t.header_text, t.stripe, t.font, t.freeze_header, t.auto_filter) == values and t.header_bold
    df = spark.createDataFrame([(1, 2.5, dt.date(2024, 1, 31))], "i long, x double, d date")
    write_workbook(df, str(tmp_path / "t.xlsx"), WriterConfig(template=name), order=["i"])
    book = zipfile.ZipFile(tmp_path / "t.xlsx")
    styles, sheet = book.read("xl/styles.xml").decode(), book.read("xl/worksheets/sheet1.xml").decode()
    assert all(f"FF{c}" in styles for c in (fill, ink, stripe)) and f'name val="{font}"' in styles and t.date_format in styles
    assert ("frozen" in sheet) == frozen and ("<autoFilter" in sheet) == filtered
    back = read_workbook(spark, str(tmp_path / "t.xlsx")).first()
    assert (back.i, back.x, str(back.d)[:10]) == (1, 2.5, "2024-01-31")
    assert xlsx.custom_template(font="Mono", header_bold=False).font == "Mono"


def test_chart_frame_has_its_own_size(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    write_workbook(df, str(tmp_path / "c.xlsx"), WriterConfig(chart=Chart("pie", "T", 0, 1)), order=["k"])
    from xml.etree import ElementTree as ET

    root = ET.fromstring(zipfile.ZipFile(tmp_path / "c.xlsx").read("xl/drawings/drawing1.xml"))
    ext = next(e for e in root.iter() if e.tag.endswith("}ext"))
    assert (int(ext.get("cx")), int(ext.get("cy"))) == xlsx.CHART_SIZE and any(e.tag.endswith("}oneCellAnchor") for e in root.iter())


def test_stream_sinks_and_exact_distinct_counts(spark, tmp_path):
    from tessera.operators.aggregate import AggregateSpec
    from tessera.streaming import file_stream, running_aggregate, to_each, to_files, to_table

    df = spark.createDataFrame([(i % 3, i % 1000) for i in range(5000)], "k long, v long")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: file_stream(spark, str(tmp_path / "in"), df.schema)
    to_files(stream(), str(tmp_path / "out"), str(tmp_path / "c1"), by=["k"]).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5000
    seen = []
    to_each(stream(), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sum(n for _, n in seen) == 5000
    to_table(running_aggregate(stream(), [AggregateSpec("v", "count_distinct", "d")], ["k"]), "exact", "complete", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.d for r in spark.table("exact").collect()} == {k: len({i % 1000 for i in range(5000) if i % 3 == k}) for k in range(3)}


def test_row_numbers_over_many_partitions(spark):
    from tessera.sources.rows import with_row_index

    df = spark.range(0, 1000, 1, 37)
    rows = with_row_index(df).collect()
    assert sorted(r._row for r in rows) == list(range(1000)) and all(r._row == r.id for r in rows)


def test_no_folder_of_our_own_on_a_cluster(monkeypatch):
    from tessera.sources import scratch

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            applicationId, master = "app-of-a-cluster", "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    with pytest.raises(errors.ConfigError):
        scratch.shared_folder(Fake)


def make_xlsx(sheets, strings=(), styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
    return out.getvalue()


def test_xlsx_cells(spark, tmp_path):
    strings = ["<si><t>head</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r></si>"]
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="20"/></cellXfs></styleSheet>'
    one = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>c</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>45292</v></c></row><row r="5"><c r="A5" t="e"><v>#DIV/0!</v></c><c r="B5" t="b"><v>1</v></c></row>'
    two = '<row r="1"><c r="A1" t="str"><v>x</v></c></row><row r="2"><c r="A2"><v>3.15</v></c></row>'
    path = tmp_path / "m.xlsx"
    path.write_bytes(make_xlsx({"One": one, "Two": two}, strings, styles))
    df = read_workbook(spark, str(path)).orderBy("_row")
    assert df.columns == ["_row", "head", "column_1", "c"]
    assert rows(df) == [(0, "rich", None, dt.date(2024, 1, 1)), (1, "#DIV/0!", True, None)]
    blank = read_workbook(spark, str(path), ReaderConfig(include_empty_rows=True))
    assert blank.count() == 3
    assert rows(read_workbook(spark, str(path), ReaderConfig(sheet=1)).drop("_row")) == [(3.15,)]
    every = read_workbook(spark, str(path), ReaderConfig(all_sheets=True))
    assert sorted(r._sheet for r in every.collect()) == ["One", "One", "Two"]
    assert [r.name for r in sheets(spark, str(path)).orderBy("position").collect()] == ["One", "Two"]


def test_ods_cells():
    assert ods.duration_seconds("PT12H30M00S") == 45_000 and ods.duration_seconds("P1DT1S") == 86_401 and ods.duration_seconds("x") is None
    get = ods.cell_value
    assert get({"v}value-type": "float", "v}value": "3"}, "") == ("int", "3")
    assert get({"v}value-type": "percentage", "v}value": "0.5"}, "") == ("float", "0.5")
    assert get({"v}value-type": "boolean", "v}boolean-value": "true"}, "") == ("bool", "TRUE")
    assert get({"v}value-type": "date", "v}date-value": "2024-01-01T10:00:00"}, "") == ("datetime", "2024-01-01 10:00:00")
    assert get({"v}value-type": "time", "v}time-value": "PT12H30M00S"}, "") == ("time", "12:30:00")
    assert get({}, "") == ("null", None)
    body = '<a xmlns:table="t" xmlns:text="x" xmlns:office="o"><table:table table:name="S"><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="string" table:number-columns-repeated="2"><text:p>hi</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row></table:table></a>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", body)
    book = ods.Workbook(out.getvalue())
    assert list(book.rows("0")) == [(0, [("string", "hi")] * 2), (1, [("string", "hi")] * 2)]


def test_zip_repair(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 100)
        z.writestr("b.txt", "world")
    data = out.getvalue()
    assert zipfix.repaired(data) == data
    fixed = zipfile.ZipFile(io.BytesIO(zipfix.repaired(data[:-10])))
    assert fixed.read("a.txt") == b"hello " * 100 and fixed.read("b.txt") == b"world"
    assert zipfix.rescue(b"PK\x03\x04short") == {}
    book, _ = workbook_bytes(spark.createDataFrame([(1,)], "a long"), FileFormat.XLSX)
    assert xlsx.Workbook(book[:-30]).sheets[0][0] == "Sheet1"


def test_encrypted_workbook(spark, tmp_path):
    data, _ = workbook_bytes(spark.createDataFrame([(i, "x" * 50) for i in range(300)], "a long, b string"), FileFormat.XLSX)
    sealed = crypto.encrypt_workbook(spark, data, "pässword", spin=1000)
    assert crypto.is_encrypted(sealed) and not crypto.is_encrypted(data)
    assert crypto.decrypt_workbook(spark, sealed, "pässword") == data
    with pytest.raises(errors.EncryptionError):
        crypto.decrypt_workbook(spark, sealed, "wrong")
    path = tmp_path / "e.xlsx"
    path.write_bytes(sealed)
    assert read_workbook(spark, str(path), ReaderConfig(password="pässword")).count() == 300
    with pytest.raises(errors.WorkbookError):
        read_workbook(spark, str(path))


@pytest.mark.parametrize("size", [1, 5000, 200_000, 9_000_000])
def test_compound_files(size):
    streams = {"EncryptionInfo": b"i" * 100, "EncryptedPackage": bytes(range(256)) * (size // 256 + 1)}
    back = crypto.read_compound(crypto.write_compound(streams))
    assert back["EncryptedPackage"][: len(streams["EncryptedPackage"])] == streams["EncryptedPackage"]
    assert back["EncryptionInfo"][:100] == streams["EncryptionInfo"]


def test_sql_text(spark):
    df = spark.createDataFrame([("O'Hara", 30, None, bytearray(b"\x01\xff"), 1.5, dt.date(2024, 1, 1)), ("Bob", 25, True, None, 3.0, None)], "name string, age long, ok boolean, b binary, x double, d date")
    assert sqltext.insert_statement(df.select("name", "age"), "users", ["age"]).first()[0] == "INSERT INTO users (name, age) VALUES\n('Bob', 25),\n('O''Hara', 30);\n"
    assert sqltext.insert_statement(df.limit(0), "users", ["age"]).first()[0] == ""
    assert [r[0] for r in sqltext.insert_rows(df).collect()] == ["('O''Hara', 30, NULL, '\\x01ff', 1.5, '2024-01-01')", "('Bob', 25, TRUE, NULL, 3, NULL)"]
    script = sqltext.copy_script(spark.createDataFrame([("a,b", None), ("x", 1)], "t string, n long"), "t")
    assert script == "COPY t (t, n) FROM STDIN WITH (FORMAT csv, HEADER false, NULL 'NULL');\n\"a,b\",NULL\nx,1\n\\.\n"


def test_report(spark):
    page = report.html_report(spark.createDataFrame([(101, "<b>Widget"), (102, "x")], "ID long, Name string"), "T & T", max_rows=1)
    for part in ("<th>ID</th>", "<td>101</td>", "&lt;b&gt;Widget", "T &amp; T", "The first 1 rows"):
        assert part in page


def test_delta(spark, tmp_path):
    path, df = str(tmp_path / "d"), spark.createDataFrame([("Alice", 30)], "name string, age long")
    assert delta.write_delta(df, path) == 0 and delta.write_delta(df, path) == 1
    log = (tmp_path / "d/_delta_log/00000000000000000000.json").read_text().splitlines()
    kinds = [next(iter(jsonlib.loads(x))) for x in log]
    assert kinds[:3] == ["commitInfo", "protocol", "metaData"] and set(kinds[3:]) == {"add"}
    assert delta.read_delta(spark, path).count() == 2 and delta.read_delta(spark, path, 0).count() == 1
    with pytest.raises(errors.SourceError):
        delta.read_delta(spark, str(tmp_path / "none"))


def test_storage(spark, tmp_path):
    uri = f"file://{tmp_path}/o.bin"
    storage.write_object(spark, uri, b"abc")
    assert storage.read_object(spark, uri) == b"abc"
    up = storage.MultipartUpload(spark, uri)
    with pytest.raises(errors.SourceError):
        up.complete()
    with pytest.raises(errors.SourceError):
        up.upload_part(b"")
    up.upload_part(b"one")
    up.upload_part(b"two")
    assert up.complete() == 6 and storage.read_object(spark, uri) == b"onetwo"


def test_kafka(spark):
    df = spark.createDataFrame([(1, "x", None)], "i long, s string, n string")
    messages = kafka.to_messages(df, "i")
    assert rows(messages) == [("1", '{"i":1,"s":"x","n":null}')]
    assert rows(kafka.from_messages(messages, df.schema)) == rows(df)
    options = kafka.options("h:1", "t", kafka.Credentials("u", 'p"w', "SCRAM-SHA-512"), 100)
    assert options["maxOffsetsPerTrigger"] == "100" and "ScramLoginModule" in options["kafka.sasl.jaas.config"] and '\\"' in options["kafka.sasl.jaas.config"]
    if not kafka.available(spark):
        with pytest.raises(errors.ConnectorMissing):
            kafka.publish(df, "h:1", "t")


def test_conversion(spark, put, tmp_path):
    source = put("c.csv", "a,b\n1,x\n2,\n")
    book = str(tmp_path / "c.xlsx")
    assert csv_to_workbook(spark, source, book) == 2
    target = str(tmp_path / "back.csv")
    assert workbook_to_csv(spark, book, target) == 2
    assert (tmp_path / "back.csv").read_text() == "a,b\n1,x\n2,\n"


def test_streaming_window(spark, tmp_path):
    from tessera.operators.aggregate import AggregateSpec
    from tessera.streaming import file_stream, running_dedup, to_table, windowed

    data = [(dt.datetime(2024, 1, 1, 0, m), m % 2, float(m)) for m in range(30)]
    df = spark.createDataFrame(data, "t timestamp, k long, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema)
    run = to_table(windowed(stream, "t", "10 minutes", [AggregateSpec("v", "sum", "s")]), "w_out", "complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.s for r in spark.table("w_out").orderBy("start").collect()] == [45.0, 145.0, 245.0]
    run = to_table(running_dedup(file_stream(spark, str(tmp_path / "in"), df.schema).select("t", "k"), ["k"], "t", "1 day"), "d_out", "append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("d_out").count() == 2


def test_encrypted_ods(spark, tmp_path):
    data, _ = workbook_bytes(spark.createDataFrame([(i, "é" * 40) for i in range(200)], "a long, b string"), FileFormat.ODS)
    sealed = crypto.encrypt_ods(spark, data, "pw", iterations=500)
    assert crypto.ods_is_encrypted(sealed) and not crypto.ods_is_encrypted(data) and not crypto.ods_is_encrypted(b"no")
    with pytest.raises(errors.EncryptionError):
        crypto.decrypt_ods(spark, sealed, "wrong")
    path = tmp_path / "e.ods"
    path.write_bytes(sealed)
    df = read_workbook(spark, str(path), ReaderConfig(password="pw"))
    assert df.count() == 200 and df.filter("a = 7").first().b == "é" * 40
    with pytest.raises(errors.WorkbookError):
        read_workbook(spark, str(path))


def test_exports(spark):
    df = spark.createDataFrame([(1, 1.5, True, "x", dt.date(2024, 1, 1)), (2, float("nan"), None, None, None)], "i long, d double, b boolean, s string, t date")
    assert export.to_dicts(df)[0] == {"i": 1, "d": 1.5, "b": True, "s": "x", "t": "2024-01-01"}
    assert export.to_column_dict(df)["t"] == ["2024-01-01", None] and export.to_column_dict(df.limit(0)) == {}
    assert [jsonlib.loads(r[0]) for r in export.json_objects(df).collect()][1] == {"i": 2, "d": 0.0, "b": None, "s": None, "t": None}
    assert export.to_grid(df.select("i"))["columnDefs"] == [{"headerName": "i", "field": "i", "sortable": True, "filter": True}]
    assert export.to_dicts(df.select("i").toDF(""))[0] == {"col_0": 1}


def test_fuzzy_join_of_files(spark, put):
    left, right = put("l.csv", "employee,dept\nBob,Engineering\n"), put("r.csv", "ref,department\nEngineering Dept,R&D\nEngineering Dept,late\n")
    assert rows(fuzzy_join_files(spark, left, right, "dept", "ref", 0.6)) == [("Bob", "Engineering", "R&D")]


def test_catalog(spark, tmp_path):
    delta.write_delta(spark.range(3), str(tmp_path / "t"))
    delta.sync_catalog(spark, str(tmp_path / "t"), "synced")
    assert spark.sql("SELECT count(*) FROM synced").first()[0] == 3
