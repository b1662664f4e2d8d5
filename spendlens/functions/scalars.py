"""Scalar column functions (O-52..56 and helpers shared by the operators).

All are built-in Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Money is summed as an exact decimal so the result does not depend on partitioning
# or summation order; cast back to double at the end.
MONEY = "decimal(18,4)"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: ColumnOrName) -> Column:
    return col(c).cast(MONEY)


def money_sum(c: ColumnOrName, weight: ColumnOrName | None = None) -> Column:
    """Exact sum of a money column, optionally with an integer row multiplicity."""
    v = money(c)
    if weight is not None:
        v = v * col(weight)
    return v


def elapsed_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """O-53: whole elapsed days (floor of the duration), not a calendar-date difference.

    23:00 -> 01:00 next day is 0 days; ``datediff`` would give 1.
    """
    return F.timestamp_diff("DAY", col(start), col(end))


def parse_timestamp(c: ColumnOrName, fmt: str | None = None, strict: bool = True) -> Column:
    """O-52: string -> timestamp without time zone. Strict raises on malformed input
    (ANSI mode); ``strict=False`` yields null instead."""
    if strict:
        return F.to_timestamp_ntz(col(c), F.lit(fmt)) if fmt else col(c).cast("timestamp_ntz")
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz") if fmt else F.try_to_timestamp(col(c)).cast(
        "timestamp_ntz"
    )


def log_target(c: ColumnOrName) -> Column:
    """O-54: log1p transform of the target."""
    return F.log1p(col(c))


def from_log_target(c: ColumnOrName) -> Column:
    """O-54: inverse of ``log_target``."""
    return F.expm1(col(c))


def line_total(price: ColumnOrName = "price", multiplier: ColumnOrName = "order_item_id") -> Column:
    """O-07: ``total_price = price * order_item_id`` as the source defines it (the
    multiplier is the line's sequence number; pass another column to change it)."""
    return col(price) * col(multiplier)


def flag(cond: Column) -> Column:
    """O-56: boolean -> 0/1 integer."""
    return cond.cast("int")


def hash_unit(key: ColumnOrName, seed: int | str, start: int = 1) -> Column:
    """A value in [0, 2^32) from the md5 of ``key || seed``; same rows in every engine
    that has md5, and independent of partitioning (unlike ``randomSplit``)."""
    h = F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(str(seed)))), start, 8)
    return F.conv(h, 16, 10).cast("bigint")


def hash_sql(key_sql: str, seed: int | str, start: int = 1) -> str:
    """DuckDB form of ``hash_unit`` for oracles."""
    return f"cast(concat('0x', substr(md5(concat(cast({key_sql} as varchar), '{seed}')), {start}, 8)) as bigint)"
