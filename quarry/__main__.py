"""``python -m quarry filter|transform|full <config> <sources> <out>`` runs a stage over a folder of C files and writes the files it makes below ``out``;
``python -m quarry select <config> <catalogue.csv> <out>`` writes the repositories to fetch as a CSV table."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .operators import select
from .plans import stages
from .sources.files import read_catalog, read_sources
from .storage import save


def echo(outputs: DataFrame, config: settings.Config, most: int = 20) -> None:
    """What debugging prints: the settings, and the first files made (their texts from level 1 on)."""
    print(*settings.describe(config), sep="\n")
    shown = outputs.select("out_path", "text" if config.debug_level > 0 else F.lit("").alias("text"))
    for path, text in shown.orderBy("out_path").limit(most).collect():
        print(f"== {path}", *([text] if text else []), sep="\n")


def main(argv: list[str]) -> int:
    args = argparse.ArgumentParser(prog="quarry", description=__doc__)
    args.add_argument("stage", choices=["select", "filter", "transform", "full"])
    for name in ("config", "sources", "out"):
        args.add_argument(name)
    args.add_argument("--debug", action="store_true", help="print settings and outputs")
    args.add_argument("--language", default="C")
    args.add_argument("--min-size", type=int, default=100)
    args.add_argument("--min-stars", type=int, default=0)
    args.add_argument("--count", type=int, default=15)
    got = args.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    config = settings.load(got.config)
    if got.stage == "select":
        rows = select.select_repos(read_catalog(spark, got.sources), got.language, got.min_size, got.min_stars, got.count)
        rows.drop("row_no").write.mode("overwrite").option("header", True).csv(got.out)
        return 0
    run = {"filter": stages.run_filter, "transform": stages.run_transform, "full": stages.run_full}[got.stage]
    outputs = save(run(read_sources(spark, got.sources), config), "outputs")
    stages.write_outputs(outputs, got.out, config)
    if got.debug:
        echo(outputs, config)
    if "compiles" in outputs.columns:
        print("attempted {}, compile {}".format(*stages.summary(outputs).first()))
    else:
        print(f"{outputs.count()} files")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
