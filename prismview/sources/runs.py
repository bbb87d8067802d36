"""Fold results made from the embeddings without training, by hashes, so that any engine makes the same rows.

They hold failed folds, a configuration that lacks one, and folds stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash24
from ..operators.evaluation import stratified_folds
from .fixtures import VIEWS, embedding_points

N_SPLITS = 5


def configurations(spark: SparkSession) -> DataFrame:
    """config_key, model, k0, k1, eta."""
    rows = [(f"{m}|{a}|{b}|{e}", m, a, b, float(e)) for m in ("global", "label") for a in (2, 3) for b in (2, 3) for e in ("0.01", "0.02", "0.05")]
    return spark.createDataFrame(rows, "config_key string, model string, k0 int, k1 int, eta double")


def stored(spark: SparkSession) -> DataFrame:
    """config_key, fold, version, status and the configuration; a fold stored again has a higher version."""
    key, fold = F.col("config_key"), F.col("fold")
    rows = configurations(spark).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(N_SPLITS)))).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.where(~((fold == 5) & (hash24(key, F.lit("drop")) % 7 == 0)) & ((F.col("version") == 1) | ((fold == 1) & (hash24(key, F.lit("dup")) % 3 == 0))))
    return rows.withColumn("status", F.when(hash24(key, F.lit("status"), fold) % 40 == 0, "degenerate").otherwise("ok"))


def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stored() with va_idx, y_true, y_pred (arrays over the fold's points by position) and a_sq (weights by label)."""
    points = stratified_folds(embedding_points(spark, sf_dir).select("id", "pos", "y"), N_SPLITS)
    right = hash24(F.col("config_key"), F.col("id"), F.col("version")) % 100 < 60 + 3 * F.col("k0") + F.col("k1")
    rows = stored(spark).join(points, "fold").withColumn("p", F.when(right, F.col("y")).otherwise(1 - F.col("y")))
    keys = ["config_key", "model", "k0", "k1", "eta", "fold", "version", "status"]
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "y", "p"))).alias("z"))

    def part(label: int):
        raw = F.array(*((hash24(F.col("config_key"), F.col("fold"), F.lit(str(label)), F.lit(str(v))) % 100 + 1).cast("double") for v in range(len(VIEWS))))
        total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
        return F.transform(raw, lambda x: x / total)

    a_sq = F.when(F.col("model") == "label", F.array(part(0), part(1))).otherwise(F.array(part(-1)))
    return out.select(*keys, F.col("z.pos").alias("va_idx"), F.col("z.y").alias("y_true"), F.col("z.p").alias("y_pred"), a_sq.alias("a_sq"))


def single_view_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, id, y_true, y_pred, correct: out-of-fold predictions of each view."""
    points = embedding_points(spark, sf_dir).select("id", "pos", "y").withColumn("view", F.explode(F.array(*map(F.lit, VIEWS))))
    right = hash24(F.lit("sv"), F.col("view"), F.col("id")) % 100 < 65
    rows = points.withColumn("y_pred", F.when(right, F.col("y")).otherwise(1 - F.col("y")))
    return rows.select("view", "id", F.col("y").alias("y_true"), "y_pred", (F.col("y") == F.col("y_pred")).cast("int").alias("correct"))


def fixed_profile_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, id, correct: predictions with fixed weights."""
    points = embedding_points(spark, sf_dir).select("id").withColumn("profile", F.explode(F.array(F.lit("corner"), F.lit("uniform"))))
    return points.select("profile", "id", (hash24(F.lit("fx"), F.col("profile"), F.col("id")) % 100 < 70).cast("int").alias("correct"))
