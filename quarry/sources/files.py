"""Sources: the repository catalogue, source trees, lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "path string, text string"


def read_catalog(spark: SparkSession, path: str, schema: str = "repository string, language string, size int, stars int") -> DataFrame:
    """Rows of a CSV catalogue with a header; its columns are matched by name, further ones ignored, bad numbers null. ``row_no`` follows the file's order."""
    names = [f.split()[0] for f in schema.split(",")]
    raw = spark.read.csv(path, header=True)
    typed = [F.col(n).try_cast(f.split()[1]).alias(n) for n, f in zip(names, schema.split(","))]
    return raw.select(F.monotonically_increasing_id().alias("row_no"), *typed)


def _named(spark: SparkSession, path: str) -> Column:
    """The path column of files below ``path``: that folder as it was given (the last part of an absolute one), then the place in it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath().rstrip("/")
    shown = path.strip("/") if not re.match(r"/|[a-z][a-z0-9+.-]*:", path) else full.rpartition("/")[2]
    at = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z][a-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    inside = F.when(F.startswith(at, F.lit(full + "/")), F.substring(at, len(full) + 2, 1 << 20)).otherwise("")
    return F.when(inside == "", F.lit(shown)).otherwise(F.concat(F.lit(f"{shown}/" if shown else ""), inside))


def read_sources(spark: SparkSession, path: str, suffix: str = ".c") -> DataFrame:
    """(path, text) of the files below ``path`` whose names end in ``suffix``; none if there is no such folder. Paths begin with the folder as given."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], SOURCES)
    if not fs.getFileStatus(hadoop).isDirectory() and not path.endswith(suffix):
        return spark.createDataFrame([], SOURCES)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(_named(spark, path).alias("path"), F.col("value").alias("text"))


def stream_sources(spark: SparkSession, path: str, suffix: str = ".c") -> DataFrame:
    """The same as a stream of files as they arrive."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(_named(spark, path).alias("path"), F.col("value").alias("text"))


def lines(sources: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """One row per line, numbered from 1. A text's last line break doesn't begin another line."""
    text = F.regexp_replace(F.col(text_col), r"\n\z", "")
    return sources.select(*(keys or ("path",)), F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")
