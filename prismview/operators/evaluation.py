"""Folds, metrics and pooled out-of-fold evaluation.

predictions: rows with y_true and y_pred (binary, 1 positive) and whatever they are grouped by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import ranks


def stratified_folds(points: DataFrame, n_splits: int, seed: int = 42) -> DataFrame:
    """points with fold 1..n_splits: each class dealt out in the order of a hash of the id."""
    out = ranks.row_numbers(points, "y", F.md5(F.concat_ws("|", "id", F.lit(str(seed)))), "id")
    return out.withColumn("fold", ((F.col("n") - 1) % n_splits + 1).cast("int")).drop("n")


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1

    def n(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    return predictions.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(~t & ~p).alias("tn"), n(t & ~p).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, recall of either class, precision, F1, macro F1, MCC, and balanced accuracy in two readings: over both
    classes, an absent one counting 0 (balanced_accuracy), and over the classes that occur (bal_acc). 0 on zero denominators."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    labels = (tp + fn + fp > 0).cast("int") + (tn + fp + fn > 0).cast("int")
    return counts.withColumns(
        {
            "acc": ratio(tp + tn, tp + tn + fp + fn),
            "recall": recall,
            "specificity": specificity,
            "precision": precision,
            "f1": f1,
            "balanced_accuracy": (recall + specificity) / 2,
            "bal_acc": ratio(recall + specificity, present),
            "f1_macro": ratio(f1 + f0, labels),
            "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )


def label_confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """y_true, y_pred and n: how often each label was predicted as each, for any number of labels."""
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def label_metrics(counts: DataFrame, *by: str) -> DataFrame:
    """acc, bal_acc (mean recall of the labels that occur) and f1_macro (mean F1 of the labels that occur or are predicted), from label_confusion()."""
    n, hit = F.col("n"), F.col("y_true") == F.col("y_pred")
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("label"), n.alias("own"), F.lit(0).cast("long").alias("said")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("own"), n.alias("said")))).alias("s"), F.when(hit, n).otherwise(0).alias("hits"))
    labels = sides.groupBy(*by, "s.label").agg(F.sum("s.own").alias("own"), F.sum("s.said").alias("said"), (F.sum("hits") / 2).alias("hits"))
    f1 = ratio(2 * F.col("hits"), (F.col("own") + F.col("said")).cast("double"))
    recall = F.when(F.col("own") > 0, F.col("hits") / F.col("own"))
    return labels.groupBy(*by).agg(ratio(F.sum("hits"), F.sum("own").cast("double")).alias("acc"), F.avg(recall).alias("bal_acc"), F.avg(f1).alias("f1_macro"))


def exploded(fold_results: DataFrame) -> DataFrame:
    """One row per validated point of the runs that went well."""
    ok = fold_results.where(F.col("status") == "ok")
    z = F.explode(F.arrays_zip("va_idx", "y_true", "y_pred")).alias("z")
    keys = [c for c in ("config_key", "model", "k0", "k1", "eta", "fold") if c in fold_results.columns]
    return ok.select(*keys, z).select(*keys, "z.va_idx", "z.y_true", "z.y_pred")


def pooled_metrics(fold_results: DataFrame, *by: str) -> DataFrame:
    """Metrics of all folds' predictions together, not the mean over folds."""
    return metrics(confusion(exploded(fold_results), *by))


def config_status(fold_results: DataFrame, n_splits: int) -> DataFrame:
    """One fold that failed makes a configuration fail; one with too few folds is incomplete."""
    n = F.count_distinct("fold")
    bad = F.sum(F.when(F.col("status") != "ok", 1).otherwise(0))
    good = F.sum(F.when(F.col("status") == "ok", 1).otherwise(0))
    out = fold_results.groupBy("config_key").agg(n.alias("n_folds"), good.alias("n_ok"), bad.alias("n_bad"))
    return out.withColumn("status", F.when(F.col("n_bad") > 0, "failed").when(F.col("n_folds") < n_splits, "incomplete").otherwise("ok"))


def ranked(frame: DataFrame, by: str, metric: str, key: str = "config_key") -> DataFrame:
    """frame with rank 1.. within by, best metric first, ties by key."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(metric), key)))


def with_metric(table: DataFrame, pooled: DataFrame, metric: str = "recall") -> DataFrame:
    """A table of configurations with one more of their pooled metrics; null where a configuration has none."""
    return table.join(pooled.select("config_key", metric), "config_key", "left")
