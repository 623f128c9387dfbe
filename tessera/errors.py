"""Exceptions, each with a numeric code by group: 1xx I/O, 2xx parsing, 3xx schema, 4xx limits, 5xx use."""

from __future__ import annotations


class EngineError(Exception):
    code = 500


class SourceError(EngineError):
    code = 100


class FormatError(EngineError):
    code = 200


class CsvError(FormatError):
    code = 201


class WorkbookError(FormatError):
    code = 202


class JsonError(FormatError):
    code = 203


class FormulaError(FormatError):
    code = 210


class SqlError(FormatError):
    code = 211


class SchemaError(EngineError):
    code = 300


class ValidationFailed(SchemaError):
    code = 301


class DriftError(SchemaError):
    code = 302


class MemoryLimit(EngineError):
    code = 400


class ConfigError(EngineError):
    code = 501


class ColumnNotFound(EngineError):
    code = 502


class EncryptionError(EngineError):
    code = 503


class ConnectorMissing(EngineError):
    code = 504
