"""Expressions on article records held as MAP<STRING, ARRAY<STRING>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_fields(fields: Column, required: list[str]) -> Column:
    """Every required tag is a key of the record."""
    wanted = F.array(*[F.lit(name) for name in required])
    return F.size(F.array_except(wanted, F.map_keys(fields))) == 0


def first_value(fields: Column, tag: str) -> Column:
    """First value of a possibly repeated tag; NULL when absent."""
    return F.get(fields[tag], F.lit(0))
