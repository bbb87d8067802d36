"""Readers of views and targets, sinks of results, samples and synthetic bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, normalize, ranks


@dataclass
class Bundle:
    points: DataFrame
    raw: DataFrame
    normalized: DataFrame
    views: tuple[str, ...]


def read_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    """A view from Parquet: i, j, d."""
    return spark.read.parquet(path).select(F.lit(view).alias("view"), F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.col("d").cast("double").alias("d"))


def read_views(spark: SparkSession, folder: str) -> DataFrame:
    """All views of a folder with one sub-folder view=... each."""
    return spark.read.parquet(folder).select(F.col("view").cast("string").alias("view"), F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.col("d").cast("double").alias("d"))


def view_paths(spark: SparkSession, folder: str, names: tuple[str, ...], prefix: str = "dissimilarity_") -> dict[str, str]:
    """The path of each view: the entry of the folder that begins with prefix and holds the view's name. None or several for a name is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    entries = [str(e.getPath()) for e in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    found = {n: [e for e in entries if e.rsplit("/", 1)[-1].startswith(prefix) and n in e.rsplit("/", 1)[-1].removeprefix(prefix)] for n in names}
    if wrong := {n: len(e) for n, e in found.items() if len(e) != 1}:
        raise ValueError(f"each view needs one entry {prefix}...; found: {wrong}")
    if len({e[0] for e in found.values()}) < len(names):
        raise ValueError("one entry holds the names of several views")
    return {n: e[0] for n, e in found.items()}


def load_aligned(spark: SparkSession, folder: str, names: tuple[str, ...], target: str, id_col: str, label_col: str) -> Bundle:
    """Views and target of a folder, checked, cut to common ids and normalised."""
    views = [read_view(spark, path, name) for name, path in view_paths(spark, folder, names).items()]
    for v in views:
        alignment.check(v.where("i <> j"))
    return bundle(views, read_target(spark, target, id_col, label_col), names)


def read_by_view(spark: SparkSession, folder: str) -> DataFrame:
    """Result tables in sub-folders of any name, which becomes the column view."""
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)
    inner = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
    return rows.select("*", F.url_decode(inner).alias("view"))


def read_preferred(spark: SparkSession, whole: str, parts: list[str]) -> DataFrame:
    """The whole table if it is there, else its parts together; columns that a part lacks are null."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(whole)
    out = spark.read.parquet(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def read_target(spark: SparkSession, path: str, id_col: str, label_col: str) -> DataFrame:
    """id, pos (the order of ids) and y; exactly the named columns, unique ids."""
    rows = spark.read.parquet(path)
    if missing := {id_col, label_col} - set(rows.columns):
        raise ValueError(f"the target lacks {sorted(missing)}")
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y"))
    alignment.check_target(rows)
    numbered = ranks.row_numbers(rows.withColumn("_all", F.lit(0)), "_all", "id")
    return numbered.select("id", (F.col("n") - 1).alias("pos"), "y")


def with_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Adds positions and labels of both points."""
    a = points.select(F.col("id").alias("i"), F.col("pos").alias("pi"), F.col("y").alias("yi"))
    b = points.select(F.col("id").alias("j"), F.col("pos").alias("pj"), F.col("y").alias("yj"))
    return pairs.where("i <> j").join(a, "i").join(b, "j").select("view", "i", "j", "pi", "pj", "yi", "yj", "d")


def bundle(views: list[DataFrame], points: DataFrame, names: tuple[str, ...]) -> Bundle:
    kept, pairs = alignment.align(views, points)
    raw = with_points(pairs, kept)
    return Bundle(kept, raw, normalize.robust(raw), names)


def subsample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points by the order of a hash, the same for any partitioning."""
    return points.orderBy(F.md5(F.concat_ws("|", "id", F.lit(str(seed)))), "id").limit(n)


def synthetic_points(spark: SparkSession, m: int = 120, seed: int = 0, gaps: tuple[float, ...] = (2.4, 1.3, 0.6), dims: int = 8) -> DataFrame:
    """id, pos, y, and per view normal coordinates whose class means are a gap apart."""
    rows = spark.range(m, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("y"))
    for v, gap in enumerate(gaps):
        rows = rows.withColumn(f"x{v}", F.array(*((F.randn(seed * 1000 + v * 100 + k) + (F.col("y") * gap if k == 0 else 0.0)) for k in range(dims))))
    return rows


def synthetic_bundle(spark: SparkSession, m: int = 120, seed: int = 0) -> Bundle:
    points = synthetic_points(spark, m, seed)
    joined = points.alias("a").join(points.alias("b"), F.col("a.pos") != F.col("b.pos"))

    def gap(v: int):
        return F.sqrt(F.aggregate(F.zip_with(f"a.x{v}", f"b.x{v}", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    names = ("wide", "middle", "narrow")
    d = F.explode(F.array(*(F.struct(F.lit(n).alias("view"), gap(v).alias("d")) for v, n in enumerate(names)))).alias("z")
    raw = joined.select(d, F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.pos").alias("pi"), F.col("b.pos").alias("pj"), F.col("a.y").alias("yi"), F.col("b.y").alias("yj")).select("z.view", "i", "j", "pi", "pj", "yi", "yj", "z.d")
    return Bundle(points.select("id", "pos", "y"), raw, normalize.robust(raw), names)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, id_columns: tuple[str, ...] = ("CustomerCode", "id")) -> DataFrame:
    """CSV of a known schema; whatever the id is called, it comes out as customer_id."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    for c in id_columns:
        if c in rows.columns and "customer_id" not in rows.columns:
            rows = rows.withColumnRenamed(c, "customer_id")
    return rows
