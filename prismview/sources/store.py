"""The store of fold results and its companions, as Parquet folders any executor can reach.

A fold is appended, never changed; readers take the latest version of each (configuration, fold). Runs resume by an anti-join with what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("model").parquet(path)


def latest(stored: DataFrame, version: str = "version") -> DataFrame:
    """The last version of each configuration and fold; of rows of one version always the same one."""
    w = Window.partitionBy("config_key", "fold").orderBy(F.desc(version), F.xxhash64(*(c for c in stored.columns if c != version)))
    return stored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def load(spark: SparkSession, path: str, config_key: str | None = None) -> DataFrame:
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return latest(rows.where(F.col("config_key") == config_key) if config_key else rows)


def pending(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs (config_key, fold) of which no result is stored."""
    return jobs.join(stored.select("config_key", "fold").distinct(), ["config_key", "fold"], "left_anti")


def status_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("model", "status").agg(F.count("*").alias("n"))


def stamp_differences(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """key, stored, expected where a store's stamp (key, value) differs from what is expected."""
    want = meta.sparkSession.createDataFrame([*expected.items()], "key string, expected string")
    return want.join(meta.select("key", F.col("value").alias("stored")), "key", "left").where(~F.col("stored").eqNullSafe(F.col("expected")))


RESCUE = T.StructType([T.StructField(n, t) for n, t in (("label", T.StringType()), ("view_tag", T.StringType()), ("k", T.IntegerType()), ("base_seed", T.LongType()), ("canonical_failed", T.BooleanType()), ("rescued_attempt", T.IntegerType()), ("n_class_points", T.IntegerType()))])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; lines that can't be parsed are left out, and a missing file is an empty log."""
    try:
        return spark.read.schema(RESCUE).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RESCUE)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends lines of JSON in the form of RESCUE."""
    rows.select(*RESCUE.names).write.mode("append").json(path)


def rescues(results: DataFrame) -> DataFrame:
    """The starts among fold results that needed another seed, in the form of RESCUE."""
    return results.select(F.explode("rescues").alias("r")).select("r.*")


PART = ("model", "k0", "k1", "eta")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unwritten(jobs: DataFrame, path: str) -> DataFrame:
    """Jobs whose configuration has no part yet: what a resumed run has to do."""
    spark = jobs.sparkSession
    if not exists(spark, path):
        return jobs
    # eta comes back from the names of folders
    done = read_parts(spark, path).select(*PART).distinct()
    done = done.select("model", F.col("k0").cast("int").alias("k0"), F.col("k1").cast("int").alias("k1"), F.col("eta").cast("double").alias("eta"))
    return jobs.join(done, [*PART], "left_anti")


def write_part(rows: DataFrame, path: str) -> None:
    """Trajectories and tails: a folder per configuration; configurations that are there already stay as they are."""
    unwritten(rows, path).write.mode("append").partitionBy(*PART).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)
