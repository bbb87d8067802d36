"""Whole runs: structure, points, performance, repeated evaluation. Each writes its tables under a folder as Parquet and skips what is there."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, crossview, evaluation, normalize, ranks, search, structure, trainer
from ..session import checkpointed


def written(spark: SparkSession, folder: str, tables: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Each table, computed and written unless an earlier run has done so."""
    out = {}
    for name, make in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def structural(pairs: DataFrame, points: DataFrame, views: tuple[str, ...], folder: str, k: int = 10, n_perm: int = 50, q: float = 0.10) -> dict[str, DataFrame]:
    """Structure of every view and the comparison of views, on raw distances; the distribution report on normalised ones."""
    spark = pairs.sparkSession
    pairs = checkpointed(pairs)  # every part reads them
    wide = normalize.stacked(pairs, views)
    return written(
        spark,
        folder,
        {
            "summary": lambda: structure.structural_summary(pairs, k),
            "points": lambda: structure.point_table(pairs, k),
            "purity_baseline": lambda: structure.purity_baseline(pairs, points, k, n_perm),
            "distribution": lambda: structure.distribution_report(normalize.robust(pairs)),
            "pearson": lambda: crossview.pearson(wide, views),
            "spearman": lambda: crossview.spearman(pairs, views),
            "overlap": lambda: crossview.overlap_means(pairs, k),
            "overlap_points": lambda: crossview.neighbour_overlap(pairs, k),
            "agreement": lambda: crossview.agreement(wide, pairs, views, q),
        },
    )


def pointwise(structure_points: DataFrame, predictions: DataFrame, views: tuple[str, ...], folder: str, measure: str = "knn_purity") -> dict[str, DataFrame]:
    spark = structure_points.sparkSession
    joined = analysis.linked(structure_points, predictions)
    wide = analysis.wide(joined, views)
    return written(
        spark,
        folder,
        {
            "joined": lambda: joined,
            "wide": lambda: wide,
            "by_correctness": lambda: analysis.by_correctness(joined),
            "dominance": lambda: analysis.dominance_groups(wide, views),
            "alignment": lambda: analysis.structure_alignment(wide, views, measure),
            "complementarity": lambda: analysis.complementarity(wide, views),
            "crosstab": lambda: analysis.dominance_crosstab(wide, views, measure),
        },
    )


def single_views(spark: SparkSession, views: np.ndarray, y: np.ndarray, folds: np.ndarray, names: tuple[str, ...], k_pairs: list[tuple[int, int]], rounds: int) -> DataFrame:
    """The best numbers of prototypes for each view alone: view, k0, k1 and metrics. Each view is a corner of the weights, held."""
    jobs = search.single_grid(spark, names, k_pairs)
    scored = search.evaluate(spark, jobs.drop("profile"), views, y, folds, rounds).join(F.broadcast(jobs.select("config_key", F.col("profile").alias("view"))), "config_key")
    return evaluation.ranked(scored, "view", "balanced_accuracy").where("rank = 1").drop("rank")


def fixed_profiles(spark: SparkSession, profiles: dict[str, list[float]], views: np.ndarray, y: np.ndarray, folds: np.ndarray, k0: int, k1: int, rounds: int) -> DataFrame:
    """Out-of-fold predictions with weights held: profile, va_idx, y_true, y_pred, correct."""
    jobs = search.profile_jobs(spark, profiles, k0, k1)
    results = trainer.train(spark, trainer.with_folds(jobs.drop("profile"), int(folds.max())), views, y, folds, rounds)
    rows = evaluation.exploded(results).join(F.broadcast(jobs.select("config_key", "profile")), "config_key")
    return rows.select("profile", "va_idx", "y_true", "y_pred", (F.col("y_true") == F.col("y_pred")).cast("int").alias("correct"))


def repeated(spark: SparkSession, winners: DataFrame, points: DataFrame, views: np.ndarray, y: np.ndarray, seeds: list[int], n_splits: int, rounds: int) -> DataFrame:
    """Correctness of each point over repeats of the winners (model, k0, k1, eta), each with folds dealt anew; linked by position."""
    jobs = winners.select("model", "k0", "k1", "eta").withColumn("v_init", F.lit(None).cast("array<double>"))
    jobs = jobs.withColumn("config_key", search.config_key())
    out = None
    for seed in seeds:  # a handful of frames, not of rows
        rows = evaluation.stratified_folds(points.select("id", "pos", "y"), n_splits, seed).orderBy("pos").select("fold").collect()
        part = trainer.train(spark, trainer.with_folds(jobs, n_splits), views, y, np.array([r["fold"] for r in rows]), rounds)
        out = part if out is None else out.unionByName(part)
    return search.correct_rates(out)


def repeated_and_linked(spark: SparkSession, winners: DataFrame, points: DataFrame, structure_points: DataFrame, views: np.ndarray, y: np.ndarray, seeds: list[int], n_splits: int, rounds: int, folder: str) -> dict[str, DataFrame]:
    """repeated(), written, and linked to the structure of each point."""
    rates = written(spark, folder, {"correct_rates": lambda: repeated(spark, winners, points, views, y, seeds, n_splits, rounds)})["correct_rates"]
    # positions among the points trained on, in the order of pos
    place = ranks.row_numbers(points.withColumn("_all", F.lit(0)), "_all", "pos").select("id", (F.col("n") - 1).cast("int").alias("va_idx"))
    linked = structure_points.join(place.join(rates, "va_idx"), "id")
    return written(spark, folder, {"linked_rates": lambda: linked}) | {"correct_rates": rates}


def single_view_run(spark: SparkSession, views: np.ndarray, y: np.ndarray, folds: np.ndarray, names: tuple[str, ...], k_pairs: list[tuple[int, int]], rounds: int, folder: str) -> dict[str, DataFrame]:
    """The best numbers of prototypes of each view and its out-of-fold predictions: a table for each view, of which a resumed run makes those that are lacking."""
    tables: dict[str, Callable[[], DataFrame]] = {}
    for n, name in enumerate(names):
        corner = {name: [float(n == m) for m in range(len(names))]}

        def best(corner=corner) -> DataFrame:
            jobs = [search.profile_jobs(spark, corner, *k) for k in k_pairs]
            all_jobs = jobs[0]
            for j in jobs[1:]:
                all_jobs = all_jobs.unionByName(j)
            return search.best_per_model(search.evaluate(spark, all_jobs.drop("profile"), views, y, folds, rounds), "balanced_accuracy")

        def oof(corner=corner, name=name) -> DataFrame:
            k = spark.read.parquet(f"{folder.rstrip('/')}/best_{name}").first()
            return fixed_profiles(spark, corner, views, y, folds, k["k0"], k["k1"], rounds)

        tables |= {f"best_{name}": best, f"oof_{name}": oof}
    return written(spark, folder, tables)


def performance(spark: SparkSession, fold_results: DataFrame, single: DataFrame, fixed: DataFrame, folder: str, n_splits: int) -> dict[str, DataFrame]:
    """How well single views (view, balanced_accuracy, ...), the searched models and fixed weights (profile, y_true, y_pred) predict: the pooled metrics of all
    configurations without failed folds, the best of each model, and all blocks together."""

    def pooled() -> DataFrame:
        good = evaluation.config_status(fold_results, n_splits).where("status = 'ok'").select("config_key")
        return evaluation.pooled_metrics(fold_results, "config_key", "model", "k0", "k1", "eta").join(good, "config_key", "left_semi")

    tables = written(spark, folder, {"pooled": pooled})

    def blocks() -> DataFrame:
        def block(rows: DataFrame, kind: str, name: str) -> DataFrame:
            return rows.select(F.lit(kind).alias("block"), F.col(name).alias("name"), "balanced_accuracy", "recall")

        multi = search.best_per_model(tables["pooled"])
        return analysis.performance(block(single, "single", "view"), block(multi, "multi", "model"), block(evaluation.metrics(evaluation.confusion(fixed, "profile")), "fixed", "profile"))

    return tables | written(spark, folder, {"performance": blocks})


def with_sidecar(oof: DataFrame, sidecar: DataFrame, run: str, *columns: str) -> DataFrame:
    """Out-of-fold rows with a run's attributes, which its sidecar repeats on every fold's row."""
    first = sidecar.groupBy(run).agg(*(F.min_by(c, "fold").alias(c) for c in columns))
    return oof.join(first, run, "left")
