"""Shared helpers: size-checked broadcasts, tables by name, rows without some ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, save, scratch_dir

__all__ = ["BROADCAST_BYTES", "SPACE", "ascii_lower", "discard", "drop_ids", "maybe_broadcast", "save", "scratch_dir", "table"]

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its counted rows times their
#: width stay below this.
BROADCAST_BYTES = 32 << 20


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if it is provably small, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id (null included) isn't in ``gone``; ``gone`` is a written table of ids."""
    ids = gone.select(F.col(id_col).alias("__gone"))
    ids = maybe_broadcast(ids, gone.count(), 32)
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")
