"""Positional operators: first rows, take-while, nearest preceding row, roll-ups over paths, ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, save


def first_by(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of each key's first row; pre-aggregated, no sort."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def take_while(rows: DataFrame, keys: list[str], order: list[str], stop: Column) -> DataFrame:
    """Rows of each key before the first for which ``stop`` holds; rows that tie with it in the order go too.

    The first stop of a key is a pre-aggregated minimum, so no window runs over a key's rows."""
    place = F.struct(*order)
    at = rows.where(stop).groupBy(*keys).agg(F.min(place).alias("__stop"))
    return rows.join(at, keys, "left").where(F.col("__stop").isNull() | (place < F.col("__stop"))).drop("__stop")


def take_while_all(rows: DataFrame, order: list[str], stop: Column) -> DataFrame:
    """Rows before the first, in the order of the whole table, for which ``stop`` holds.

    The first stop is one row, found by partial minima and compared with each row: no global window."""
    place = F.struct(*order)
    first = rows.where(stop).agg(F.min(place).alias("__first"))
    return rows.join(F.broadcast(first)).where(F.col("__first").isNull() | (place < F.col("__first"))).drop("__first")


def nearest_preceding(rows: DataFrame, keys: list[str], order: str, match: Column, value: str, name: str) -> DataFrame:
    """``rows`` with the value of the latest earlier row of the key for which ``match`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(match, F.col(value)), ignorenulls=True).over(w))


def ordered_text(rows: DataFrame, keys: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """One text per key: its rows' texts in order."""
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(said, lambda x: x["t"]), separator).alias(text))


def path_prefixes(path: Column) -> Column:
    """All folders of a path, the path itself last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directory_rollup(rows: DataFrame, path: Column, **sums: Column) -> DataFrame:
    """Sums for each folder over everything below it."""
    spread = rows.select(F.explode(path_prefixes(path)).alias("dir"), *[c.alias(n) for n, c in sums.items()])
    return spread.groupBy("dir").agg(*[F.sum(n).cast("long").alias(n) for n in sums])


def enclosing(rows: DataFrame, id_col: str, parent_col: str, match: Column, value: str, name: str, default: str | None = None, rounds: int = 64) -> DataFrame:
    """(id, name): the value of the nearest row, itself included, up its chain of parents for which ``match`` holds; ``default`` if there is none.

    Chains are halved in each round (a row takes over where its ancestor points), so a tree of depth d takes log d rounds; only rows still
    on their way are joined. Null ids and parents that don't exist end a chain; a chain that goes in circles is an error."""
    state = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.when(match, F.lit(None)).otherwise(F.col(parent_col)).alias("up"), F.when(match, F.col(value)).alias("v"))
    state = save(state, "chains")
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            out = state.select(F.col("i").alias(id_col), F.coalesce("v", F.lit(default)).alias(name))
            return out
        above = state.select(F.col("i").alias("up"), F.col("up").alias("next"), F.col("v").alias("found"))
        going = state.where("up is not null").join(above, "up", "left").select("i", F.col("next").alias("up"), F.col("found").alias("v"))
        before, state = state, save(state.where("up is null").unionByName(going), "chains")
        discard(before)
    raise ValueError("chains of parents go in circles")
