"""Dates to and from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions.text import to_column


def parse_date(c: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Text to timestamp; text that does not fit the format gives null."""
    return F.try_to_timestamp(to_column(c), F.lit(fmt))


def parse_date_text(c: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """As :func:`parse_date`, written out as ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.date_format(parse_date(c, fmt), "yyyy-MM-dd HH:mm:ss")


def format_date(c: Column | str, fmt: str = "dd-MM-yyyy") -> Column:
    """Date or timestamp to text, by calendar year."""
    return F.date_format(to_column(c), fmt)
