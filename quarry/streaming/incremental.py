"""The filter stage over files as they arrive. Not a capability of the batch stages' model: a convenience over the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.stages import run_filter
from ..sources.files import stream_sources


def filter_arriving(spark: SparkSession, path: str, out: str, config: Config, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends (path, text, out_path) of passing files to the table ``out``, each file once.

    A batch that is run again after a failure overwrites its own folder, so its rows don't appear twice."""

    def one(batch: DataFrame, number: int) -> None:
        run_filter(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream_sources(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
