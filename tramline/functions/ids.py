"""Identifiers and times as every operator reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around an identifier (fixed values).
BLANKS = " \t\r\n "


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare(c: Column | str) -> Column:
    """Without surrounding blanks."""
    return F.btrim(as_column(c), F.lit(BLANKS))


def normal_id(c: Column | str) -> Column:
    """Without surrounding blanks, in capitals."""
    return F.upper(bare(c))


def micros(c: Column | str) -> Column:
    """Epoch microseconds of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(as_column(c).cast("timestamp"))


def seconds(c: Column | str) -> Column:
    """Epoch seconds, cut to the whole second."""
    return F.unix_seconds(as_column(c).cast("timestamp"))


def floor_div(c: Column, by: int) -> Column:
    """Whole quotient towards minus infinity, exact for long values."""
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by))
