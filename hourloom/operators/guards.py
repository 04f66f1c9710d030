"""Checks on feature tables before a model sees them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leakage_guard(df: DataFrame, columns: Iterable[str], target: str, suspicious: Iterable[str] = (), allow: Iterable[str] = ()) -> None:
    """Raise for columns that are missing, are the target, or match a suspicious pattern of names."""
    allowed, wanted = set(allow), list(columns)
    missing = sorted(set(wanted) - set(df.columns))
    patterns = [re.compile(p, re.IGNORECASE) for p in suspicious]
    leaky = sorted(c for c in wanted if c not in allowed and (c == target or any(p.search(c) for p in patterns)))
    if missing or leaky:
        raise ValueError(f"missing columns {missing}, leaking columns {leaky}")


def all_null_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns without any value, in one pass."""
    names = list(columns)
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if one[i] == 0]


def assert_computable(df: DataFrame, columns: Iterable[str], allow: Iterable[str] = ()) -> None:
    empty = sorted(set(all_null_columns(df, columns)) - set(allow))
    if empty:
        raise ValueError(f"columns without any value: {empty}")
