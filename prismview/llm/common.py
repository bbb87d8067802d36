"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as in the pattern [^\x20\x09-\x0D]+.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where none is set, in a local session."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints", "prismview")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker gets at once, by rows and by bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    """A number for each row that differs for rows of one doc_id with different texts, in the order of doc_id, null last."""
    number = "decimal(19,0)"
    key = F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)).cast(number) * F.lit(1 << 60).cast(number)
    return (key + F.xxhash64(text.cast("string")).bitwiseAND(F.lit((1 << 60) - 1)).cast(number)).cast("decimal(38,0)")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches(rows: dict[str, list], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows from columns in the order of schema."""
    cols = [pa.array(rows[f.name], f.type) for f in schema]
    n = len(cols[0])
    for at in range(0, n, size):
        yield pa.RecordBatch.from_arrays([c.slice(at, size) for c in cols], schema=schema)


def unused(rows: DataFrame, stem: str) -> str:
    """A name that no column of rows has, in any case of letters."""
    taken = {c.lower() for c in rows.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name
