"""Structured Streaming over folders of article CSV or JSON Lines. Beyond parity: the batch plans on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.schemas import ARTICLE
from textloom.sources.files import CSV


def article_drops(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New CSV files of a folder; here columns stand in ARTICLE's order, as a stream needs its schema beforehand."""
    return spark.readStream.schema(ARTICLE).options(**CSV).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def first_seen(stream: DataFrame, key: str = "url", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key is new; with a time column, state is kept for the delay only."""
    return stream.dropDuplicates([key]) if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch through a batch plan, appended as JSON Lines below its own batch folder: a batch that runs again replaces itself."""

    def step(rows: DataFrame, number: int) -> None:
        plan(rows).write.mode("overwrite").json(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts by window and key of a stream or a table; late rows count up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
