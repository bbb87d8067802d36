"""Fold results as a stream: files that workers drop into a folder are taken in as they come, each once.

The store is append-only, so a micro-batch is one append; readers take the latest version of a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import store


def arriving(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def take_in(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come to the store, then stops; called again, it goes on where it was."""

    def batch(df: DataFrame, _: int) -> None:
        store.append(df, path)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
