"""Guessing the dialect of delimited text from its first lines."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import fmean, pvariance

from ..errors import ConfigError

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 10


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    has_header: bool = True


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return "_" not in text


def has_header(lines: list[str], delimiter: str) -> bool:
    """A first line without numbers above lines with some; or without any digit above other lines."""
    if len(lines) < 2:
        return False
    first = [x.strip() for x in lines[0].split(delimiter)]
    rest = [x.strip() for line in lines[1:] for x in line.split(delimiter)]
    if not any(map(_is_number, first)) and any(map(_is_number, rest)):
        return True
    return not any(ch.isnumeric() for x in first for ch in x)


def sniff(sample: str | bytes) -> Dialect:
    """The delimiter that occurs often and evenly, the more frequent quote, an escape if there are backslashes."""
    text = sample.decode("utf-8", "replace") if isinstance(sample, bytes) else sample
    if not text:
        raise ConfigError("an empty sample has no dialect")
    lines = text.removeprefix("\ufeff").splitlines()[:SAMPLE_LINES]
    best, top = ",", 0.0
    for d in DELIMITERS:
        counts = [line.count(d) for line in lines]
        score = fmean(counts) / (1 + pvariance(counts)) if counts else 0.0
        if score > top:
            best, top = d, score
    return Dialect(best, "'" if text.count("'") > text.count('"') else '"', "\\" if "\\" in text else None, has_header(lines, best))
