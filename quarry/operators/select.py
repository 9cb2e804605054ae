"""Row selection: catalogue, files, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def select_repos(catalog: DataFrame, language: str, min_size: int, min_stars: int, project_count: int, order_col: str = "row_no", alive: str | None = None) -> DataFrame:
    """The first ``project_count`` + 1 rows, in file order, that match language, size and stars (and are alive, if a column tells).

    The limit takes one row more than its setting says. It becomes a top-k by the order column, which keeps few rows per task."""
    hit = (F.col("language") == language) & (F.col("size") >= min_size) & (F.col("stars") >= min_stars)
    rows = catalog.where(hit if alive is None else hit & F.col(alive))
    return rows.orderBy(order_col).limit(project_count + 1)


def file_stats(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """``sources`` with loc and nonstd_includes; no shuffle."""
    return sources.withColumn("loc", T.loc(F.col(text_col)).cast("long")).withColumn("nonstd_includes", T.foreign_headers(F.col(text_col)).cast("long"))


def passing_files(sources: DataFrame, min_loc: int, max_loc: int, use_nonstd: bool = False) -> DataFrame:
    """Files within the bounds of lines and, unless ``use_nonstd``, with allowed headers only. Unreadable files (null text) don't pass."""
    rows = file_stats(sources.where(F.col("text").isNotNull())).where(F.col("loc").between(min_loc, max_loc))
    return rows if use_nonstd else rows.where("nonstd_includes = 0")


def distinct_values(rows: DataFrame, key: str, values: Column, name: str) -> DataFrame:
    """(key, name): the different values of an array column in each row, without a shuffle; null values are left out."""
    return rows.select(key, F.explode(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))).alias(name))


def standard_headers(sources: DataFrame) -> DataFrame:
    """(path, header): standard headers a file includes, each once."""
    return distinct_values(sources, "path", T.headers(F.col("text")), "header").where(F.col("header").isin(T.STANDARD_HEADERS))


def header_basenames(sources: DataFrame) -> DataFrame:
    """(path, header): the file names of all headers a file includes, each once, standard or not."""
    names = F.transform(T.headers(F.col("text")), lambda h: F.element_at(F.split(h, "/"), -1))
    return distinct_values(sources, "path", names, "header")


def matching(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in ``others``: what is removed, what is called."""
    return rows.join(others.select(*keys), keys, "left_semi")


def missing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys don't occur in ``others``: what is kept, what isn't called, what isn't declared."""
    return rows.join(others.select(*keys), keys, "left_anti")
