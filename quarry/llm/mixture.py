"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the mix has ``share`` times all words. Sources in code-point order (null last) weigh
   ``weights``, repeating. A target stops at ``max_epochs`` times its source's size; what a source
   can't take is shared again by weight until none is above.
2. Seats: the mix is cut into equal blocks of ``block_words`` words. Sources get blocks by the highest
   quotients target / (2 * seats + 1); within a source its shards (documents dealt by a seeded hash,
   about ``shard_words`` words each) get their integer quotas in the same way, by shard size.
3. Selection: inside a shard the documents lie in seeded random order, as one stream of words cut into
   blocks. A quota of q blocks takes whole passes first and then the first blocks of the seeded
   order; a document's share is what its words overlap, so it never exceeds ``max_epochs`` passes.

Highest quotients aren't found seat by seat: the seats at a common divisor come in closed form, the
divisor by bisection, and only the last few seats from a heap, so 10^11 blocks cost no more than 10.
Only one row per source reaches the driver (``MAX_SOURCES`` at most, checked); shards are apportioned
on executors, ``MAX_SHARDS`` to a source.

Defined results: a null or empty text has size 0 and taken 0; a null source is a source of its own; repeated
rows are separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

MAX_SOURCES = 1_000_000
MAX_SHARDS = 65_536


def targets(sizes: list[int], weights: list[int], share: Fraction, max_epochs: int) -> list[Fraction]:
    """Words wanted of each source: by weight, at most ``max_epochs`` times its size, the excess reshared."""
    left, out = Fraction(sum(sizes)) * share, [Fraction(0)] * len(sizes)
    # Sources fill in the order of size over weight: one pass over them reshares all excess.
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(sizes[i], weights[i]), i))
    weight = sum(weights)
    for i in order:
        out[i] = min(Fraction(max_epochs * sizes[i]), left * weights[i] / weight)
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 * got + 1), none above its cap; ties go to the first."""
    seats = min(seats, sum(caps))

    def at(x: float) -> list[int]:
        return [min(c, int(w * x + 0.5)) for w, c in zip(weights, caps)]

    low, high = 0.0, 1.0
    if not any(weights) or not seats:
        return [0] * len(weights)
    while sum(at(high)) < seats and high < 1e30:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(at(mid)) <= seats else (low, mid)
    got = at(low) if sum(at(low)) <= seats else [0] * len(weights)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if g < c and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), max_epochs: int = 2, block_words: int = 16, shard_words: int = 1 << 17, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, shard."""
    spark = docs.sparkSession
    ship(spark)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = common.save(rows.withColumn("key", key).withColumn("draw", F.xxhash64("doc_id", F.lit(seed))), "sizes")

    totals = rows.groupBy("key").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not totals:
        return rows.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("shard"))
    totals = sorted((t["key"], t["words"]) for t in totals)
    sizes = [n for _, n in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, max_epochs)
    shards = [min(MAX_SHARDS, -(-n // shard_words)) or 1 for n in sizes]
    plan = spark.createDataFrame([(k, n, float(g), s) for (k, n), g, s in zip(totals, goal, shards)], "key string, source_size long, target double, shards long")
    placed = rows.join(common.maybe_broadcast(plan, len(sizes), 64), "key").withColumn("shard", F.pmod(F.col("draw"), F.col("shards")))

    by_shard = common.save(placed.groupBy("key", "shard").agg(F.sum("size").alias("words")), "shards")
    blocks = F.ceil(F.col("words") / block_words) * max_epochs
    caps = {r["key"]: r["caps"] for r in by_shard.groupBy("key").agg(F.sum(blocks).cast("long").alias("caps")).collect()}
    seats = sainte_lague([float(g) for g in goal], round(sum(goal) / block_words), [caps[k] for k, _ in totals])
    full = [g == max_epochs * n for g, n in zip(goal, sizes)]
    seats = [caps[k] if f else s for (k, _), s, f in zip(totals, seats, full)]
    wanted = spark.createDataFrame([(k, s) for (k, _), s in zip(totals, seats)], "key string, seats long")

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        words = group["words"].tolist()
        got = sainte_lague([float(w) for w in words], int(group["seats"].iloc[0]), [max_epochs * -(-w // block_words) for w in words])
        return pd.DataFrame({"key": group["key"], "shard": group["shard"], "quota": [min(q * block_words, max_epochs * w) for q, w in zip(got, words)], "words": words})

    quota = by_shard.join(common.maybe_broadcast(wanted, len(sizes), 64), "key").groupBy("key").applyInPandas(quotas, "key string, shard long, quota long, words long")
    stream = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(stream))
    passes = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0)
    rest = F.col("quota") - F.col("passes") * F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("end"), F.col("rest")) - (F.col("end") - F.col("size")))
    taken = laid.join(quota, ["key", "shard"]).withColumn("passes", passes).withColumn("rest", rest)
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), "shard")
