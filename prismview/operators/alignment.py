"""Alignment and validation of views in long form (view, i, j, d) with their points (id, pos, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_ids(views: list[DataFrame], points: DataFrame | None = None) -> DataFrame:
    """The ids that every view, and the target if given, has."""
    sets = [v.select(F.col("i").alias("id")).distinct() for v in views] + ([points.select("id").distinct()] if points is not None else [])
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), sets)


def align(views: list[DataFrame], points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points in their own order and the pairs of all views, both cut to the common ids."""
    ids = common_ids(views, points)
    kept = points.join(ids, "id", "left_semi")
    pairs = reduce(DataFrame.unionByName, views)
    pairs = pairs.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi")
    return kept, pairs


def missing_ids(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids that a view lacks."""
    return wanted.select("id").join(view.select(F.col("i").alias("id")).distinct(), "id", "left_anti")


def labels_of(ids: DataFrame, points: DataFrame) -> DataFrame:
    """ids (id) with their labels y; an id without a label is an error."""
    known = points.where(F.col("y").isNotNull()).select("id", F.col("y").cast("int").alias("y"))
    if lacking := [r["id"] for r in ids.select("id").join(known, "id", "left_anti").limit(5).collect()]:
        raise ValueError(f"no label for {lacking}")
    return ids.join(known, "id")


def problems(view: DataFrame) -> DataFrame:
    """One row of counts that are all zero for a square matrix with unique, finite cells (diagonal left out)."""
    n = F.count_distinct("i")
    cells = view.groupBy("i", "j").agg(F.count("*").alias("c"), F.max(F.when(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")), 1).otherwise(0)).alias("bad"))
    return cells.agg((n * (n - 1) - F.count("*")).alias("missing_cells"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("duplicate_cells"), F.sum("bad").alias("bad_cells"))


def check(view: DataFrame) -> None:
    """Raises ValueError unless problems() are none."""
    row = problems(view).first()
    if any(row):
        raise ValueError(f"not a square matrix of finite distances: {row.asDict()}")


def check_target(points: DataFrame) -> None:
    if points.groupBy("id").count().where("count > 1").take(1) or points.where(F.col("y").isNull() | F.col("id").isNull()).take(1):
        raise ValueError("ids of the target must be unique and its labels set")


def renamed_views(pairs: DataFrame, names: dict[str, str]) -> DataFrame:
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return pairs.withColumn("view", F.coalesce(lookup[F.col("view")], F.col("view")))


def upper(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return pairs.where("pi < pj")


def fold_blocks(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Pairs with a fold and a part: train (neither point in the fold) or valid (i in it, j not). folds: id, fold."""
    a, b = folds.select(F.col("id").alias("i"), F.col("fold").alias("fi")), folds.select(F.col("id").alias("j"), F.col("fold").alias("fj"))
    joined = pairs.join(a, "i").join(b, "j")
    every = folds.select("fold").distinct()
    out = joined.join(F.broadcast(every), F.col("fj") != F.col("fold"))
    return out.withColumn("part", F.when(F.col("fi") == F.col("fold"), "valid").otherwise("train")).drop("fi", "fj")
