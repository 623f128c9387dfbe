"""Cleaning and anonymising text columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.values import column, family, quoted, safe_pattern, trimmed

#: The shapes that are masked, anchored at both ends.
EMAIL = r"(?i)^([a-z0-9._%+-]+)@([a-z0-9.-]+\.[a-z]{2,})$"
PHONE = r"^\+?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
CARD = r"^[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}$"


def mask_email(c: Column) -> Column:
    """f***l@domain, or *@domain for a name of two characters at most; other text with one @ keeps what follows it."""
    user, domain = F.regexp_extract(c, EMAIL, 1), F.regexp_extract(c, EMAIL, 2)
    short = F.concat(F.lit("*@"), domain)
    long = F.concat(F.substring(user, 1, 1), F.lit("***"), F.substring(user, -1, 1), F.lit("@"), domain)
    one = F.char_length(c) - F.char_length(F.replace(c, F.lit("@"), F.lit(""))) == 1
    other = F.when(one, F.concat(F.lit("***@"), F.substring_index(c, "@", -1))).otherwise(c)
    return F.when(c.rlike(EMAIL), F.when(F.char_length(user) <= 2, short).otherwise(long)).otherwise(other)


def _last_four(c: Column, shape: str, front: str) -> Column:
    return F.when(c.rlike(shape), F.concat(F.lit(front), F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(4)))).otherwise(c)


def mask_phone(c: Column) -> Column:
    return _last_four(c, PHONE, "***-***-")


def mask_ssn(c: Column) -> Column:
    return _last_four(c, SSN, "***-**-")


def mask_card(c: Column) -> Column:
    return _last_four(c, CARD, "****-****-****-")


def collapse(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"(?U)\s+", " ")


def replace_pattern(c: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; ``${name}`` and ``$1`` refer to groups; an invalid pattern changes nothing."""
    if not safe_pattern(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern)):
        return c
    java = re.sub(r"\(\?P<", "(?<", pattern)
    return F.regexp_replace(c, F.lit(java), F.lit(re.sub(r"\$\{(\d+)\}", r"$\1", replacement.replace("\\", "\\\\"))))


STRATEGIES = {"trim": trimmed, "collapse": collapse, "upper": F.upper, "lower": F.lower, "mask_email": mask_email, "mask_phone": mask_phone, "mask_ssn": mask_ssn, "mask_card": mask_card}


@dataclass(frozen=True)
class CleanRule:
    at: str | int
    strategy: str
    pattern: str = ""
    replacement: str = ""


def clean(df: DataFrame, rules: Sequence[CleanRule]) -> DataFrame:
    """Rules in order, one projection; only text columns are touched."""
    now = {c: quoted(c) for c in df.columns}
    for r in rules:
        name, _, kind = column(df, r.at)
        if family(kind) != "string":
            continue
        if r.strategy == "replace":
            now[name] = replace_pattern(now[name], r.pattern, r.replacement)
        elif r.strategy in STRATEGIES:
            now[name] = STRATEGIES[r.strategy](now[name])
        else:
            raise ConfigError(f"unknown strategy {r.strategy!r}")
    return df.select(*[v.alias(k) for k, v in now.items()])
