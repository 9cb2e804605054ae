"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``docs``. The decontamination stage goes by the text's SHA-256, not by
doc_id. The near-duplicate stage goes by doc_id: it keeps rows with a null id, and where a doc_id repeats, all its rows go with one that is a near copy.

Defined results: null and empty texts count as empty: they aren't toxic unless a text without features is, one of them stays, they match no
other text and no benchmark item, and the mix takes nothing of them. Of equal texts the smallest doc_id stays (a null one sorts last; of
rows that repeat doc_id and text one), of linked ones the smallest doc_id of their component. Empty tables give no rows. Further columns stay as they are
until the last stage; names that begin with ``__`` are the stages' own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, exact_dedup, mixture, ngram_join, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of ``docs``, doesn't predict to be toxic."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_column(docs, model, name="__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one that gives the group its id."""
    found = common.save(ngram_join.ngram_join(docs), "near")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).where("doc_id is not null").select("doc_id").distinct()
    return common.drop_ids(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    keyed = docs.withColumn("__key", F.sha2("text", 256))
    found = decontaminate.contaminated(keyed, common.table(spark, sf_dir, "benchmark"), id_col="__key")
    leaks = common.save(found.where("doc_id is not null").select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return common.drop_ids(keyed, leaks, "__key").drop("__key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words it takes of each: doc_id, source, size, source_size, target, taken, shard."""
    return mixture.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The toxicity classifier can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
