"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b) of longs: the smallest vertex of its component.

    A round is two pre-aggregated passes over the edges; long chains shrink by about half in it. Each
    round's edges are written to the shared folder, so lineage stays short, and the ones before are deleted. Edges that haven't settled after ``rounds`` are an error.

    Defined results: edges with a null end and loops don't count; repeated edges are one; no edges give no rows; other columns aren't read."""
    now = common.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        # large star: a vertex's larger neighbours move to its smallest neighbour
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        # small star: a vertex and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "w")).alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        before, now = now, common.save(small, "edges")
        common.discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if mark == new:
            return now.groupBy("u").agg(F.min("w").alias("root")).withColumnRenamed("u", "v")
        mark = new
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
