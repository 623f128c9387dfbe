"""Delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ReaderConfig, WriterConfig
from ..functions.values import display, quoted
from ..operators.schema import ColumnSchema, infer_schema, typed
from .rows import with_row_index
from .sniff import Dialect, sniff

#: Names by which encodings are asked for. What is called Latin-1 is Windows-1252 in practice.
ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "auto": "UTF-8", "latin1": "windows-1252", "latin-1": "windows-1252", "windows-1252": "windows-1252", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "shiftjis": "Shift_JIS", "shift_jis": "Shift_JIS"}
#: The bytes in which Windows-1252 differs from ISO 8859-1, as the parser reads them and as they are meant.
_READ = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_MEANT = bytes(map(ord, _READ)).decode("cp1252")


def dialect(spark: SparkSession, path: str, config: ReaderConfig) -> Dialect:
    """The dialect: as configured, and where it isn't, as sniffed from the first lines."""
    found = Dialect(has_header=config.has_header)
    if config.sniff and (config.delimiter is None or config.quote is None) and ENCODINGS.get(config.encoding.lower(), config.encoding) in ("UTF-8", "windows-1252"):
        lines = [r[0] for r in spark.read.text(path).limit(20).collect()]
        if lines:
            found = sniff("\n".join(lines))
    elif path.endswith((".tsv", ".tab")):
        found = Dialect(delimiter="\t")
    return Dialect(config.delimiter or found.delimiter, config.quote or found.quote, config.escape or found.escape, config.has_header)


def _options(d: Dialect, config: ReaderConfig) -> dict[str, str]:
    encoding = ENCODINGS.get(config.encoding.lower(), config.encoding)
    # With a backslash as escape, doubled quotes would be read as two; the quote itself is the default.
    out = {
        "sep": d.delimiter, "quote": d.quote, "escape": d.escape or d.quote, "encoding": "ISO-8859-1" if encoding == "windows-1252" else encoding, "mode": config.mode, "header": "false", "inferSchema": "false",
        "multiLine": str(config.multi_line or encoding not in ("UTF-8", "windows-1252")).lower(), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\u0000", "emptyValue": "",
    }
    return out | ({"comment": config.comment} if config.comment else {})


def read_csv(spark: SparkSession, path: str, config: ReaderConfig | None = None, schema: list[ColumnSchema] | None = None) -> DataFrame:
    """A table from delimited text, read in parallel splits.

    Cells are read as text and each column gets one type: the given schema's, or the one that all rows vote for
    (the first ``inference_sample_size``, if the configuration names a number). Trimmed empty cells and ``null_values`` are null. Rows of
    another width follow ``mode``: FAILFAST raises, DROPMALFORMED drops them, PERMISSIVE pads or cuts.
    Rows are skipped before the header. ``columns`` and ``column_names`` prune headers and cells alike.
    """
    config = (config or ReaderConfig()).validate()
    d = dialect(spark, path, config)
    options = _options(d, config)
    if options["encoding"] == "Shift_JIS":
        # The engine's own list of character sets is short; this admits all that the JVM has.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if config.skip_rows:
        # The rows to skip may have any width, so lines are numbered before they are parsed.
        lines = with_row_index(spark.read.text(path), scan=True).filter(F.col("_row") >= config.skip_rows)
        head = lines.orderBy("_row").limit(1).collect()
        names = _names(spark, head[0]["value"] if head else "", options, d.has_header)
        body = lines.filter(F.col("_row") > config.skip_rows) if d.has_header else lines
        parsed = body.select("_row", F.from_csv("value", ", ".join(f"`c{i}` string" for i in range(len(names))), {k: v for k, v in options.items() if k not in ("header", "inferSchema", "multiLine", "encoding")} | {"mode": "FAILFAST" if config.mode == "FAILFAST" else "PERMISSIVE"}).alias("r"))
        raw = parsed.orderBy("_row").select("r.*").toDF(*names) if config.max_rows is not None else parsed.select("r.*").toDF(*names)
    else:
        head = spark.read.options(**options | {"mode": "PERMISSIVE"}).csv(path).limit(1).collect()
        width = len(head[0]) if head else 0
        first = [x or "" for x in head[0]] if head else []
        names = _headers(first) if d.has_header else [f"column_{i}" for i in range(width)]
        if not names:
            return spark.createDataFrame([], T.StructType([]))
        fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(fields).options(**options | {"header": str(d.has_header).lower(), "enforceSchema": "true"}).csv(path)
    if options["encoding"] == "ISO-8859-1":
        raw = raw.select(*[F.translate(quoted(c), _READ, _MEANT).alias(c) for c in raw.columns])
    return _finish(raw, config, schema)


def read_csv_bytes(spark: SparkSession, data: bytes, config: ReaderConfig | None = None) -> DataFrame:
    """A table from text in memory."""
    config = (config or ReaderConfig()).validate()
    text = data.decode({"windows-1252": "cp1252"}.get(ENCODINGS.get(config.encoding.lower(), config.encoding), config.encoding if config.encoding.lower() != "auto" else "utf-8")).removeprefix("\ufeff")
    found = sniff(text) if config.sniff and text else Dialect()
    d = Dialect(config.delimiter or found.delimiter, config.quote or found.quote, config.escape or found.escape, config.has_header)
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=d.delimiter, quotechar=d.quote, escapechar=d.escape if d.escape != d.quote else None, doublequote=True))
    rows = [r for r in rows if r][config.skip_rows :]
    names = _headers(rows[0]) if d.has_header and rows else [f"column_{i}" for i in range(len(rows[0]) if rows else 0)]
    body = rows[1:] if d.has_header else rows
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    width = len(names)
    if config.mode == "FAILFAST" and any(len(r) != width for r in body):
        from ..errors import CsvError

        raise CsvError("a row has another width than the header")
    kept = [tuple((r + [None] * width)[:width]) for r in body if config.mode != "DROPMALFORMED" or len(r) == width]
    return _finish(spark.createDataFrame(kept, T.StructType([T.StructField(n, T.StringType()) for n in names])), config, None)


def _headers(first: list[str]) -> list[str]:
    out: list[str] = []
    for i, x in enumerate(first):
        name = x.strip().removeprefix("\ufeff") or f"column_{i}"
        out.append(name if name not in out else f"{name}_{i}")
    return out


def _names(spark: SparkSession, line: str, options: dict[str, str], header: bool) -> list[str]:
    import csv

    first = next(csv.reader([line], delimiter=options["sep"], quotechar=options["quote"]), [])
    return _headers(first) if header else [f"column_{i}" for i in range(len(first))]


def _finish(raw: DataFrame, config: ReaderConfig, schema: list[ColumnSchema] | None) -> DataFrame:
    if config.column_names is not None:
        raw = raw.select(*[quoted(c) for c in config.column_names])
    elif config.columns is not None:
        raw = raw.select(*[quoted(raw.columns[i]) for i in config.columns if i < len(raw.columns)])
    if config.max_rows is not None:
        raw = raw.limit(config.max_rows)
    if schema is None and not config.infer_types:
        schema = [ColumnSchema(c) for c in raw.columns]
    elif schema is None:
        schema = infer_schema(raw, config.inference_sample_size, raw=True, null_values=config.null_values)
    return typed(raw, schema, config.null_values)


def csv_field(c: Column, config: WriterConfig) -> Column:
    """A field, quoted if it holds the delimiter, the quote or a line end, or starts or ends with a space."""
    q = config.quote
    needs = c.contains(config.delimiter) | c.contains(q) | c.contains("\n") | c.contains("\r") | c.startswith(" ") | c.endswith(" ")
    return F.when(needs, F.concat(F.lit(q), F.replace(c, F.lit(q), F.lit(q + q)), F.lit(q))).otherwise(c)


def csv_lines(df: DataFrame, config: WriterConfig | None = None) -> DataFrame:
    """Each row as one line of text, in the column ``value``."""
    config = config or WriterConfig()
    fields = [csv_field(display(quoted(f.name), f.dataType), config) for f in df.schema]
    return df.select(F.concat_ws(config.delimiter, *fields).alias("value"))


def csv_header(df: DataFrame, config: WriterConfig | None = None) -> str:
    config = config or WriterConfig()
    special = (config.delimiter, config.quote, "\n", "\r")
    q = config.quote
    return config.delimiter.join(q + c.replace(q, q + q) + q if any(x in c for x in special) or c != c.strip(" ") else c for c in df.columns)


def write_csv(df: DataFrame, path: str, config: WriterConfig | None = None, mode: str = "overwrite") -> None:
    """Part files in a folder, each with a header if the configuration has one."""
    config = config or WriterConfig()
    shown = df.select(*[display(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])
    options = {"sep": config.delimiter, "quote": config.quote, "escape": config.quote, "escapeQuotes": "true", "lineSep": config.line_end, "header": str(config.header).lower(), "encoding": config.encoding, "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if len(config.line_end) > 1 or config.encoding.upper() != "UTF-8":
        options.pop("lineSep")
    if len(config.line_end) > 1:
        lines = csv_lines(df, config)
        lines.write.mode(mode).option("lineSep", config.line_end).text(path)
        return
    shown.write.mode(mode).options(**options).csv(path)


def to_csv_text(df: DataFrame, config: WriterConfig | None = None) -> str:
    """The whole table as text on the driver."""
    config = config or WriterConfig()
    lines = [r[0] for r in csv_lines(df, config).toLocalIterator()]
    return "".join(x + config.line_end for x in ([csv_header(df, config)] if config.header else []) + lines)
