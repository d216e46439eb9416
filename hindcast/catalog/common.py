"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(name: str, alias: str | None = None) -> Column:
    """A timestamp as text, so that results compare without time-zone doubts."""
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def num(c: Column | str, digits: int = 8) -> Column:
    """A rounded double: enough digits to tell errors from summation order."""
    return F.round(c, digits) if isinstance(c, Column) else F.round(F.col(c), digits).alias(c)
