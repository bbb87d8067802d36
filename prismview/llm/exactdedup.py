"""Exact dedup against a persistent index of digests, in Parquet tables bucketed and sorted by digest.

An index is a folder that driver and executors share. It holds
  members  the rows of each batch with their digests, in a folder for each batch,
  seen     of each batch every digest once, with the number of its rows and the best of them: largest doc_id, then row,
  texts    of every digest the row that stays: that of the first batch that had it.
seen and texts have the same buckets, one file a bucket and batch, so the anti-join of a batch with the index and the report of group sizes
merge sorted buckets without a shuffle. Adding a batch shuffles its distinct digests once; texts themselves are never shuffled.

A batch that is added again under its name changes nothing: what was written of it is used, so a run that was killed goes on where it stopped.

Texts are equal if identical after lower-casing A-Z only. Null text: as the empty text, which is a text like others. Null doc_id: less than all
others. Ties: of rows equal in text and doc_id one stays. Repeated rows: one of them stays at most. Very long texts: hashed whole. Extra columns, whatever
their names: not read by the report, kept by without_copies. Empty table: no rows. Hot groups: digests with more than a share of all rows are at most
MOST_HOT, so they are broadcast; no task meets more rows of one digest than that share.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Digests with more than a 4096th of all rows: no more than 4096 can have that many, which bounds what is broadcast.
MOST_HOT = 4096
SEEN = "digest BINARY, n BIGINT, best_id BIGINT, best_row BIGINT, batch STRING"
TEXTS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


def normalised(text: Column) -> Column:
    """text with A-Z lower-cased; where all is ASCII that is what lower() does, and faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


@dataclass(frozen=True)
class Index:
    """The index in a folder, registered in the session's catalogue."""

    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int | None = None) -> Index:
        """The index in path, made if there is none. buckets: of a new index, the shuffle partitions unless given; later it is what the folder says."""
        path = path.rstrip("/")
        about = f"{path}/about"
        if not exists(spark, f"{about}/_SUCCESS"):
            spark.createDataFrame([(buckets or common.partitions(spark),)], "buckets int").coalesce(1).write.mode("overwrite").parquet(about)
        index = cls(spark, path, spark.read.schema("buckets int").parquet(about).first()[0])
        for name, columns in (("seen", SEEN), ("texts", TEXTS)):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {index.name(name)} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'")
            spark.catalog.refreshTable(index.name(name))
        return index

    def name(self, table: str) -> str:
        return f"digests_{md5(self.path.encode()).hexdigest()}_{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name(table))

    def members(self, batch: str) -> DataFrame:
        return self.spark.read.schema("doc_id long, row long, digest binary, part int").parquet(f"{self.path}/members/{batch}")

    def add(self, documents: DataFrame, batch: str, part: Column | None = None, parts: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds a batch of documents. batch: its name, a plain word. part: rows with 0 there are put in first, then those with 1, and so on below parts; one scan reads them all."""
        if not exists(self.spark, f"{self.path}/members/{batch}/_SUCCESS"):
            # row numbers are written, so they don't change when something is computed again
            rows = documents.select(documents[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(documents[text_col]).alias("digest"), (F.lit(0) if part is None else part).alias("part"))
            rows.write.mode("overwrite").parquet(f"{self.path}/members/{batch}")
        for k in range(parts):
            name, of_part = f"{batch}.{k}", F.col("batch") == f"{batch}.{k}"
            if self.table("seen").where(of_part).isEmpty():
                distinct = self.members(batch).where(F.col("part") == k).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
                distinct = distinct.select("digest", "n", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"), F.lit(name).alias("batch"))
                self.append(distinct.repartition(self.buckets, "digest"), "seen")
            if self.table("texts").where(of_part).isEmpty():
                new = self.table("seen").where(of_part).join(self.table("texts").hint("merge"), "digest", "left_anti")
                self.append(new.select("digest", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"), "batch"), "texts")

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_row, batch of the row that stays, and group_size; merged bucket by bucket."""
        sizes = self.table("seen").groupBy("digest").agg(F.sum("n").alias("group_size"))
        return self.table("texts").join(sizes.hint("merge"), "digest")

    def hot(self) -> DataFrame:
        """The groups with more than a MOST_HOT-th of all rows, kept once computed."""
        total = self.table("seen").agg(F.sum("n")).first()[0] or 0
        return common.checkpointed(self.groups().where(F.col("group_size") * MOST_HOT > total))

    def report(self, batch: str) -> DataFrame:
        """Every row of the batch: doc_id, keep_id, group_size, kept, text_sha256."""
        rows, groups, hot = self.members(batch), self.groups(), F.broadcast(self.hot())
        cold = rows.join(hot, "digest", "left_anti").repartition(self.buckets, "digest").join(groups.hint("merge"), "digest")
        out = rows.join(hot, "digest").unionByName(cold)
        kept = (F.col("row") == F.col("keep_row")) & (F.concat(F.lit(f"{batch}."), "part") == F.col("batch"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def without_copies(self, documents: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Of documents, which were added as batch (in any parts), the rows that stay, with all their columns."""
        digest_, keep, rank = (common.unused(documents, x) for x in ("digest", "keep", "rank"))
        rows = documents.withColumn(digest_, digest(documents[text_col]))
        of_batch = F.col("batch").startswith(f"{batch}.")
        own = self.table("texts").where(of_batch).select(F.col("digest").alias(digest_), F.col("keep_id").alias(keep))
        # of a hot group all rows but those of the right id go before the shuffle
        hot = self.hot().select(F.col("digest").alias(digest_), F.col("keep_id").alias(keep), of_batch.alias(rank))
        rows = rows.join(F.broadcast(hot), digest_, "left").where(F.col(rank).isNull() | F.col(rank) & F.col(id_col).cast("long").eqNullSafe(F.col(keep))).drop(keep, rank)
        rows = rows.repartition(self.buckets, digest_).join(own.hint("merge"), digest_).where(F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
        first = F.row_number().over(Window.partitionBy(digest_).orderBy(digest_))
        return rows.withColumn(rank, first).where(F.col(rank) == 1).select(*documents.columns)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def dedup(documents: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Every document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest doc_id stays.

    The documents are put in by two parts, larger ids first, so that the second meets an index that is not empty; where the cut lies changes no result. path: where
    the index shall lie, a new folder unless given.
    """
    spark = documents.sparkSession
    index = Index.at(spark, path or common.shared_path(spark, "digests"), buckets)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    middle = documents.agg(F.percentile_approx(at, 0.5, 100)).first()[0] or 0
    index.add(documents, "all", F.when(at > middle, 0).otherwise(1), 2)
    return index.report("all")
