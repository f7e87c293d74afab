"""Images that arrive as a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..dataset import SCHEMAS


def arriving(spark: SparkSession, path: str, table: str = "images") -> DataFrame:
    """Rows of a table from JSON files as they appear in a folder."""
    return spark.readStream.schema(SCHEMAS[table]).json(path)


def first_seen(images: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each image; a repeat within the time is dropped, and state of older ones is forgotten."""
    return images.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["imagefile"])


def append(images: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table, and ends when that is written."""
    return images.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
