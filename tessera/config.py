"""Reader and writer settings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from pathlib import PurePosixPath

from .errors import ConfigError

MIN_MEMORY = 1 << 20


class FileFormat(Enum):
    CSV = "csv"
    TSV = "tsv"
    XLSX = "xlsx"
    ODS = "ods"
    JSON = "json"
    PARQUET = "parquet"
    ARROW = "arrow"

    @staticmethod
    def from_extension(extension: str) -> FileFormat:
        known = {
            "csv": FileFormat.CSV, "tsv": FileFormat.TSV, "tab": FileFormat.TSV, "xlsx": FileFormat.XLSX, "ods": FileFormat.ODS, "json": FileFormat.JSON, "jsonl": FileFormat.JSON,
            "ndjson": FileFormat.JSON, "parquet": FileFormat.PARQUET, "arrow": FileFormat.ARROW,
        }
        found = known.get(extension.lower().lstrip("."))
        if found is None:
            raise ConfigError(f"no reader for the extension {extension!r}")
        return found

    @staticmethod
    def from_path(path: str) -> FileFormat:
        return FileFormat.from_extension(PurePosixPath(path).suffix)


@dataclass(frozen=True)
class ReaderConfig:
    """How a source is read. ``skip_rows`` counts rows before the header, ``max_rows`` data rows."""

    has_header: bool = True
    delimiter: str | None = None
    quote: str | None = None
    escape: str | None = None
    comment: str | None = None
    encoding: str = "UTF-8"
    null_values: tuple[str, ...] = ()
    skip_rows: int = 0
    max_rows: int | None = None
    columns: tuple[int, ...] | None = None
    column_names: tuple[str, ...] | None = None
    sheet: str | int | None = None
    all_sheets: bool = False
    infer_types: bool = True
    inference_sample_size: int | None = None  # None: all rows vote
    include_empty_rows: bool = False
    mode: str = "FAILFAST"
    multi_line: bool = False
    sniff: bool = True
    password: str | None = None
    memory_limit: int = 256 << 20

    def validate(self) -> ReaderConfig:
        if self.columns is not None and self.column_names is not None:
            raise ConfigError("columns and column_names exclude each other")
        if self.memory_limit < MIN_MEMORY:
            raise ConfigError("memory_limit is under 1 MB")
        if self.delimiter is not None and len(self.delimiter) != 1:
            raise ConfigError("the delimiter is one character")
        if self.skip_rows < 0 or (self.max_rows is not None and self.max_rows < 0):
            raise ConfigError("row counts can't be negative")
        if self.mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ConfigError(f"unknown mode {self.mode!r}")
        return self

    def but(self, **changes) -> ReaderConfig:
        return replace(self, **changes).validate()


@dataclass(frozen=True)
class ConditionalFormat:
    """Colour of cells whose value lies between the bounds; the first rule that matches counts."""

    column: int
    minimum: float | None = None
    maximum: float | None = None
    color: str = "FFFF00"


@dataclass(frozen=True)
class Chart:
    kind: str  # bar, line or pie
    title: str
    category_column: int
    value_column: int


@dataclass(frozen=True)
class WriterConfig:
    delimiter: str = ","
    quote: str = '"'
    line_end: str = "\n"
    header: bool = True
    sheet_name: str = "Sheet1"
    freeze_header: bool = False
    auto_filter: bool = False
    auto_width: bool = False
    merge: tuple[str, ...] = ()
    formats: tuple[ConditionalFormat, ...] = ()
    chart: Chart | None = None
    template: str = "none"
    encoding: str = "UTF-8"

    def but(self, **changes) -> WriterConfig:
        return replace(self, **changes)
