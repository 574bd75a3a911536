"""Scalar functions of the programs, as Columns. Strings are bytes: lengths count bytes, lower case is ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP_WORDS = ("a", "are", "is", "in", "it", "that", "this", "and", "to", "of", "so", "will", "can", "which", "for", "on", "an", "with", "the", "-")


def split(text: Column | str, pattern: str = "[ \t\n]") -> Column:
    return F.split(text, pattern)


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def byte_length(text: Column | str) -> Column:
    return F.octet_length(text)


def parse_float(text: Column | str) -> Column:
    """Raises on malformed input (ANSI)."""
    return F.col(text).cast("double") if isinstance(text, str) else text.cast("double")


def nth(array: Column | str, i: int) -> Column:
    return (F.col(array) if isinstance(array, str) else array).getItem(i)


def squared_distance(xs: list[Column], ys: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(xs[1:], ys[1:])), (xs[0] - ys[0]) * (xs[0] - ys[0]))


def exact_sum(c: Column | str) -> Column:
    """Sum of money: decimals, so the order of rows does not matter."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")
