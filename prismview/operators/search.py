"""Search over configurations: grids, winners, refinement, repeated evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources import store
from . import blocks, evaluation, trainer


def config_key(version: str = "1") -> F.Column:
    """Key of a job frame's row; holds the weights it starts from and a version of the mathematics."""
    start = F.when(F.col("v_init").isNull(), "-").otherwise(F.concat_ws(",", F.transform("v_init", lambda x: x.cast("string"))))
    return F.concat_ws("|", "model", "k0", "k1", F.col("eta").cast("string"), start, F.lit(version))


def grid(spark: SparkSession, k_pairs: list[tuple[int, int]], etas: list[float], models: tuple[str, ...] = ("global", "label")) -> DataFrame:
    """Every combination; three short lists, so the product is small."""
    rows = [(m, a, b, float(e)) for m in models for a, b in k_pairs for e in etas]
    out = spark.createDataFrame(rows, "model string, k0 int, k1 int, eta double").withColumn("v_init", F.lit(None).cast("array<double>"))
    return out.withColumn("config_key", config_key()).orderBy("model", "k0", "k1", "eta")


def feasible(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """The jobs that ask for no more prototypes than the classes 0 and 1 have points."""
    n = points.agg(F.sum((F.col("y") == 0).cast("long")).alias("_n0"), F.sum((F.col("y") == 1).cast("long")).alias("_n1"))
    return jobs.join(F.broadcast(n), (F.col("k0") <= F.col("_n0")) & (F.col("k1") <= F.col("_n1"))).drop("_n0", "_n1")


def profile_jobs(spark: SparkSession, profiles: dict[str, list[float]], k0: int, k1: int) -> DataFrame:
    """Jobs with weights held: learning rate 0, starting from the root of a mixture."""
    rows = [("global", k0, k1, 0.0, [x**0.5 for x in mix], name) for name, mix in profiles.items()]
    out = spark.createDataFrame(rows, "model string, k0 int, k1 int, eta double, v_init array<double>, profile string")
    return out.withColumn("config_key", config_key())


def single_grid(spark: SparkSession, names: tuple[str, ...], k_pairs: list[tuple[int, int]]) -> DataFrame:
    """Jobs for each view alone, with all numbers of prototypes: the corner of the weights, held. profile: the view."""
    corners = {n: [float(n == m) for m in names] for n in names}
    out = profile_jobs(spark, corners, *k_pairs[0])
    for k in k_pairs[1:]:
        out = out.unionByName(profile_jobs(spark, corners, *k))
    return out


def with_prefix(rows: DataFrame, prefix: str, column: str = "model") -> DataFrame:
    """The rows whose name begins with prefix."""
    return rows.where(F.col(column).startswith(prefix))


def derived_seed(base: F.Column, view: F.Column, label: F.Column) -> F.Column:
    """A seed below 2 ** 32 from the SHA-256 digest of base, view and label."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", base.cast("string"), view, label.cast("string")), 256), 1, 8), 16, 10).cast("long")


def top_per_model(results: DataFrame, n: int, metric: str = "bal_acc") -> DataFrame:
    return evaluation.ranked(results.where(F.col(metric).isNotNull()), "model", metric).where(F.col("rank") <= n)


def best_per_model(results: DataFrame, metric: str = "bal_acc") -> DataFrame:
    return top_per_model(results, 1, metric).drop("rank")


def refined(winners: DataFrame, etas: list[float], k_radius: int = 1, eta_radius: int = 1, k_min: int = 3, k_max: int = 10) -> DataFrame:
    """The neighbourhood of winners (model, k0, k1, eta) in prototypes and on the grid of learning rates."""
    rates = winners.sparkSession.createDataFrame([(n, float(e)) for n, e in enumerate(sorted(etas))], "at int, eta double")
    here = winners.select("model", "k0", "k1", "eta").join(F.broadcast(rates), "eta").withColumnRenamed("at", "centre").drop("eta")
    near = here.join(F.broadcast(rates), F.abs(F.col("at") - F.col("centre")) <= eta_radius)

    def around(c: str):
        return F.explode(F.sequence(F.greatest(F.col(c) - k_radius, F.lit(k_min)), F.least(F.greatest(F.col(c) + k_radius, F.lit(k_min)), F.lit(k_max))))

    return near.select("model", around("k0").alias("k0"), "k1", "eta").select("model", "k0", around("k1").alias("k1"), "eta").distinct()


Progress = Callable[[int, int, float, float], None]


def rescue_log(path: str) -> str:
    """Where the starts that needed another seed are logged, of the store in path."""
    return f"{path.rstrip('/')}_rescues"


def fitted(spark: SparkSession, jobs: DataFrame, views, y, folds, rounds: int) -> DataFrame:
    """Fold results of jobs over a tensor, or over columns (blocks.Blocks) where views are such."""
    if isinstance(views, blocks.Blocks):
        return blocks.train(views, jobs, folds, rounds)
    return trainer.train(spark, jobs, views, y, folds, rounds)


def trained(spark: SparkSession, jobs: DataFrame, views, y, folds, rounds: int, path: str | None = None, wave: int | None = None, progress: Progress | None = None, n_splits: int | None = None) -> DataFrame:
    """Fold results of all jobs. With a path they are appended to the store there, and only jobs that it lacks are fitted.

    Jobs are fitted and stored in waves, by default of four jobs for each core, so a run that is killed loses one wave and goes on behind it. After each, progress is told
    the fits done, those of the run, its seconds, and those left at that rate. Starts that needed another seed go to rescue_log(path).
    """
    jobs = trainer.with_folds(jobs, n_splits or int(folds.max()))
    if path is None:
        return checkpointed(fitted(spark, jobs, views, y, folds, rounds))
    wanted = jobs.select("config_key", "fold")
    todo = store.pending(jobs, store.load(spark, path)) if store.exists(spark, path) else jobs
    size = wave or max(64, 4 * spark.sparkContext.defaultParallelism)
    number = F.floor((F.row_number().over(Window.orderBy("config_key", "fold")) - 1) / size)  # jobs are few; their fits are the work
    todo = checkpointed(todo.withColumn("_wave", number))
    of, done, began = todo.count(), 0, time.monotonic()
    for n in range(-(-of // size)):
        part = todo.where(F.col("_wave") == n).drop("_wave")
        results = checkpointed(fitted(spark, part, views, y, folds, rounds).withColumn("version", F.lit(1)))
        store.append(results, path)
        rescues = store.rescues(results)
        if not rescues.isEmpty():
            store.append_log(rescues, rescue_log(path))
        done += min(size, of - done)
        if progress:
            seconds = time.monotonic() - began
            progress(done, of, seconds, seconds / done * (of - done))
    return store.load(spark, path).join(wanted, ["config_key", "fold"], "left_semi").drop("version")


def evaluate(spark: SparkSession, jobs: DataFrame, views, y, folds, rounds: int, path: str | None = None) -> DataFrame:
    """Pooled metrics of each job whose folds all went well, and the seconds of its fits. path: a store to resume from; results of other rounds need another one."""
    n_splits = int(folds.max())
    results = trained(spark, jobs, views, y, folds, rounds, path)
    good = evaluation.config_status(results, n_splits).where("status = 'ok'").select("config_key")
    pooled = evaluation.pooled_metrics(results, "config_key", "model", "k0", "k1", "eta")
    seconds = results.groupBy("config_key").agg(F.sum("seconds").alias("seconds"))
    return pooled.join(good, "config_key", "left_semi").join(seconds, "config_key")


def staged(spark: SparkSession, views, y, folds, k_pairs: list[tuple[int, int]], etas: list[float], rounds: tuple[int, int, int], top: int = 2, path: str | None = None) -> DataFrame:
    """Coarse grid, then the winners' neighbourhood, then the finalists with all rounds: config_key, stage and metrics. path: a folder with a store for each stage, to resume from."""

    def at(stage: int) -> str | None:
        return path and f"{path.rstrip('/')}/stage{stage}"

    first = evaluate(spark, grid(spark, k_pairs, etas), views, y, folds, rounds[0], at(1))
    near = refined(top_per_model(first, top), etas, k_min=min(min(p) for p in k_pairs)).withColumn("v_init", F.lit(None).cast("array<double>"))
    second = evaluate(spark, near.withColumn("config_key", config_key()), views, y, folds, rounds[1], at(2))
    last = top_per_model(second, top).select("model", "k0", "k1", "eta").withColumn("v_init", F.lit(None).cast("array<double>"))
    third = evaluate(spark, last.withColumn("config_key", config_key()), views, y, folds, rounds[2], at(3))
    parts = [r.withColumn("stage", F.lit(n)) for n, r in enumerate((first, second, third), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def correct_rates(fold_results: DataFrame) -> DataFrame:
    """Of each point over all runs: how often it was predicted, how often rightly, and the majority (ties and no votes: 0)."""
    rows = evaluation.exploded(fold_results)
    out = rows.groupBy("va_idx").agg(F.count("*").alias("n_valid"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hits"), F.sum(F.when(F.col("y_pred") == 1, 1).otherwise(-1)).alias("votes"))
    return out.select("va_idx", "n_valid", (F.col("hits") / F.col("n_valid")).alias("correct_rate"), (F.col("votes") > 0).cast("int").alias("pred_majority"))


def deduplicated(results: DataFrame, *order: str) -> DataFrame:
    """One row per key: the first by the given order."""
    w = Window.partitionBy("config_key").orderBy(*order)
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
