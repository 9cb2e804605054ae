"""Counters: one pre-aggregated pass that counts rows of many kinds for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def times_asked(kind: Column, kinds: list[str]) -> Column:
    """How often a bag of kinds asks for a row's kind: one that is named twice counts twice."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in kinds]), lambda k: k == kind)) if kinds else F.lit(0)


def count(rows: DataFrame, keys: list[str], counted: dict[str, Column]) -> DataFrame:
    """Sums of each counter by key; a counter is a number per row, or a condition."""
    numbers = [F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counted.items()]
    return rows.select(*keys, *numbers).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counted])


def any_of(rows: DataFrame, keys: list[str], condition: Column, name: str) -> DataFrame:
    """Whether any row of a key meets a condition."""
    return rows.groupBy(*keys).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias(name))


def distinct_members(rows: DataFrame, keys: list[str], member: str, name: str) -> DataFrame:
    """How many different members each key has."""
    return rows.groupBy(*keys).agg(F.count_distinct(member).alias(name))
