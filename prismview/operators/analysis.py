"""Tables that link structure to prediction.

structure: view, id and its measures. predictions: view, id, y_true, y_pred, correct. wide: one row per point with correct_<view> and <measure>_<view>.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_best, is_close, ratio


def linked(structure: DataFrame, predictions: DataFrame) -> DataFrame:
    return structure.join(predictions.select("view", "id", F.col("y_pred").alias("y_pred"), "correct"), ["view", "id"])


def wide(joined: DataFrame, views: tuple[str, ...], measures: tuple[str, ...] = ("correct", "knn_purity", "mu", "knn_mean")) -> DataFrame:
    """One row per point: the label (the first known, views in order) and every measure by view."""
    cols = [F.max(F.when(F.col("view") == v, F.col(m))).alias(f"{m}_{v}") for m in measures for v in views]
    labels = [F.max(F.when(F.col("view") == v, F.col("y"))) for v in sorted(views)]
    return joined.groupBy("id").agg(F.coalesce(*labels).alias("y"), *cols)


def inferred_views(frame: DataFrame, prefix: str = "correct_") -> tuple[str, ...]:
    return tuple(sorted(c.removeprefix(prefix) for c in frame.columns if c.startswith(prefix)))


def with_difficulty(joined: DataFrame) -> DataFrame:
    return joined.withColumn("difficulty", (1 - F.col("knn_purity")) + F.greatest(F.lit(0.0), -F.col("mu")))


def by_correctness(joined: DataFrame) -> DataFrame:
    """Mean measures of right and wrong predictions of each view."""
    m = ("knn_purity", "mu", "knn_mean", "difficulty")
    return with_difficulty(joined).groupBy("view", "correct").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in m))


def error_by_quantile(joined: DataFrame, measure: str, q: int = 5) -> DataFrame:
    """Error rate by bins of a measure between its quantiles: closed on the right, the least value in the first, equal edges merged; none below three distinct values."""
    rows = with_difficulty(joined)
    edges = rows.groupBy("view").agg(F.array_distinct(F.percentile(measure, F.array(*(F.lit(k / q) for k in range(q + 1))))).alias("edges"), F.count_distinct(measure).alias("values")).where("values >= 3")
    binned = rows.join(F.broadcast(edges), "view").withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col(measure))), F.lit(1)))
    return binned.groupBy("view", "bin").agg(F.count("*").alias("n"), F.avg((1 - F.col("correct")).cast("double")).alias("error"))


def dominance_label(views: tuple[str, ...]) -> Column:
    """The views that predict a point rightly, joined by +, or none."""
    names = F.concat_ws("+", *(F.when(F.col(f"correct_{v}") == 1, F.lit(v)) for v in sorted(views)))
    return F.when(names == "", "none").otherwise(names)


def dominance_groups(w: DataFrame, views: tuple[str, ...]) -> DataFrame:
    right = sum((F.coalesce(F.col(f"correct_{v}"), F.lit(0)) for v in views), F.lit(0))
    out = w.withColumn("dominance", dominance_label(views)).groupBy("dominance").agg(F.count("*").alias("n"), F.avg(right).alias("mean_correct"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


#: Measures of which the least value is the best.
SMALLEST = frozenset({"mu", "knn_mean", "d_plus"})


def structure_alignment(w: DataFrame, views: tuple[str, ...], measure: str = "knn_purity", smallest: bool | None = None) -> DataFrame:
    """By the structurally best view (the first of equals): how many points, and how often that view was right. smallest: whether the least value is the best, which the measure tells."""
    smallest = measure in SMALLEST if smallest is None else smallest
    best = first_best([(v, F.col(f"{measure}_{v}").cast("double")) for v in sorted(views)], smallest)
    right = F.lit(None).cast("int")
    for v in views:
        right = F.when(F.col("best") == v, F.col(f"correct_{v}")).otherwise(right)
    return w.withColumn("best", best).withColumn("right", right).groupBy("best").agg(F.count("*").alias("n"), F.avg("right").alias("best_correct"))


def complementarity(w: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """For every two views: points both predict rightly, only one, none, and the overlap of the right ones."""
    aggs = []
    for a, b in combinations(sorted(views), 2):
        x, y = F.coalesce(F.col(f"correct_{a}") == 1, F.lit(False)), F.coalesce(F.col(f"correct_{b}") == 1, F.lit(False))
        aggs += [F.sum(c.cast("long")).alias(f"{a}|{b}|{n}") for n, c in (("both", x & y), ("only_a", x & ~y), ("only_b", ~x & y), ("neither", ~x & ~y))]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f"`{a}|{b}|{n}`").alias(n) for n in ("both", "only_a", "only_b", "neither"))) for a, b in combinations(sorted(views), 2)]
    out = w.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("jaccard", ratio(F.col("both").cast("double"), (F.col("both") + F.col("only_a") + F.col("only_b")).cast("double")))


def performance(*blocks: DataFrame) -> DataFrame:
    """Blocks (block, name, balanced_accuracy, ...) together, with the difference to the best single view; best first."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    top = out.where("block = 'single'").agg(F.max("balanced_accuracy").alias("_top"))
    return out.join(F.broadcast(top)).withColumn("delta", F.col("balanced_accuracy") - F.col("_top")).drop("_top")


def gain_loss(profiles: DataFrame, w: DataFrame, views: tuple[str, ...], best_view: str) -> DataFrame:
    """Of each profile, points won and lost against any view, the best one and each one, and the net."""
    rows = profiles.join(w.select("id", *(F.coalesce(f"correct_{v}", F.lit(0)).alias(f"c_{v}") for v in views)), "id")
    any_view = F.greatest(*(F.col(f"c_{v}") for v in views)) if len(views) > 1 else F.col(f"c_{views[0]}")
    against = {"any": any_view, "best": F.col(f"c_{best_view}")} | {v: F.col(f"c_{v}") for v in views}
    aggs = [F.sum(((F.col("correct") == right) & (c == 1 - right)).cast("long")).alias(f"{n}_{name}") for name, c in against.items() for n, right in (("gain", 1), ("loss", 0))]
    out = rows.groupBy("profile").agg(*aggs)
    return out.withColumns({f"net_{n}": F.col(f"gain_{n}") - F.col(f"loss_{n}") for n in against})


def dominance_crosstab(w: DataFrame, views: tuple[str, ...], measure: str = "knn_purity") -> DataFrame:
    """Predictive against structural dominance: all, none, one view, or several; rows and columns are fixed, absent ones 0."""
    vs = sorted(views)
    right = F.concat_ws("+", *(F.when(F.col(f"correct_{v}") == 1, F.lit(v)) for v in vs))
    n_right = sum((F.coalesce(F.col(f"correct_{v}"), F.lit(0)) for v in vs), F.lit(0))
    prediction = F.when(n_right == len(vs), "all").when(n_right == 0, "none").when(n_right == 1, right).otherwise("several")
    top = F.greatest(*(F.col(f"{measure}_{v}") for v in vs))
    tied = sum(((F.abs(F.col(f"{measure}_{v}") - top) <= 1e-8 + 1e-5 * F.abs(top)).cast("int") for v in vs), F.lit(0))
    structural = F.when(tied > 1, "tied").otherwise(first_best([(v, F.col(f"{measure}_{v}").cast("double")) for v in vs]))
    columns = [*vs, "tied"]
    counts = w.select(prediction.alias("prediction"), structural.alias("structural")).groupBy("prediction").pivot("structural", columns).count()
    order = w.sparkSession.createDataFrame([(n, x) for n, x in enumerate([*vs, "all", "several", "none"])], "place int, prediction string")
    return order.join(F.broadcast(counts), "prediction", "left").na.fill(0, columns).select("place", "prediction", *(F.col(c).cast("long").alias(f"n_{c}") for c in columns))


def profile_dominance(w: DataFrame, profiles: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """By dominance group: how many points each profile predicts rightly, with the difference to the group's size, and a total."""
    d = w.select("id", dominance_label(views).alias("dominance"))
    size = d.groupBy("dominance").agg(F.count("*").alias("size"))
    hits = d.join(profiles, "id").groupBy("dominance", "profile").agg(F.sum("correct").alias("hits")).join(F.broadcast(size), "dominance")
    total = hits.groupBy("profile").agg(F.sum("hits").alias("hits"), F.sum("size").alias("size")).withColumn("dominance", F.lit("total"))
    out = hits.unionByName(total.select("dominance", "profile", "hits", "size"))
    return out.select("dominance", "profile", F.format_string("%d (%+d)", F.col("hits").cast("long"), (F.col("hits") - F.col("size")).cast("long")).alias("cell"))


def five_numbers(joined: DataFrame, measure: str) -> DataFrame:
    """Quartiles and whiskers (1.5 times the quartile distance, cut to the data) by view and correctness."""
    q = joined.groupBy("view", "correct").agg(F.percentile(measure, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    inner = joined.join(F.broadcast(q), ["view", "correct"]).where((F.col(measure) >= low) & (F.col(measure) <= high))
    ends = inner.groupBy("view", "correct").agg(F.min(measure).alias("whisker_low"), F.max(measure).alias("whisker_high"))
    return q.join(ends, ["view", "correct"]).select("view", "correct", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "whisker_low", "whisker_high")


def share_at(c: Column, value: float) -> Column:
    return F.avg(is_close(c, value).cast("double"))


def purity_ranking(summary: DataFrame, measure: str = "purity_mean") -> DataFrame:
    """The views, the purest first: view, the measure and its rank."""
    return summary.select("view", measure, F.row_number().over(Window.orderBy(F.desc(measure), "view")).alias("rank"))


def as_table(rows: DataFrame, value: str, views: tuple[str, ...], a: str = "a", b: str = "b") -> DataFrame:
    """A measure of pairs of views as a table: one row and one column for each view, null where there is no value."""
    return rows.groupBy(a).pivot(b, list(views)).agg(F.first(value)).orderBy(a)
