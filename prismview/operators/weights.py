"""View weights of fold results: long and wide forms, groups, profiles, and how they move."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, entropy, first_best, mixture
from ..session import checkpointed


def weights_long(fold_results: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """config_key, model, eta, fold, label (null for one vector for all), view, w."""
    ok = fold_results.where((F.col("status") == "ok") & F.col("a_sq").isNotNull())
    names = F.array(*map(F.lit, views))
    rows = ok.select("config_key", "model", "eta", "fold", F.size("a_sq").alias("n"), F.posexplode("a_sq").alias("label", "a"))
    rows = rows.withColumn("label", F.when(F.col("n") > 1, F.col("label")))
    return rows.select("config_key", "model", "eta", "fold", "label", F.posexplode("a").alias("v", "w")).select("config_key", "model", "eta", "fold", "label", names[F.col("v")].alias("view"), "w")


def winner_weights(fold_results: DataFrame, winners: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """The mean weight of each view and label over the folds of the winners (config_key): model, label, view, w."""
    rows = weights_long(fold_results, views).join(F.broadcast(winners.select("config_key")), "config_key", "left_semi")
    return rows.groupBy("model", "label", "view").agg(F.avg(F.round("w", 9)).alias("w"))


def weights_wide(fold_results: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """One row per vector: w_<view>, dominant (the first of equals), max_weight, entropy of its maximum."""
    ok = fold_results.where((F.col("status") == "ok") & F.col("a_sq").isNotNull())
    rows = ok.select("config_key", "model", "eta", "fold", F.size("a_sq").alias("n"), F.posexplode("a_sq").alias("label", "a")).withColumn("label", F.when(F.col("n") > 1, F.col("label"))).drop("n")
    cols = {f"w_{v}": F.col("a")[k] for k, v in enumerate(views)}
    rows = rows.withColumns(cols | {"entropy": entropy(F.col("a")), "max_weight": F.array_max("a"), "dominant": first_best([(v, F.col("a")[k]) for k, v in enumerate(views)])})
    return rows.drop("a")


def weight_means(wide: DataFrame, views: tuple[str, ...], *by: str) -> DataFrame:
    """Mean weights of each group and how often each view dominates."""
    means = [F.avg(f"w_{v}").alias(f"mean_{v}") for v in views]
    counts = [F.sum((F.col("dominant") == v).cast("long")).alias(f"dominant_{v}") for v in views]
    return wide.groupBy(*by).agg(*means, *counts, F.avg("entropy").alias("entropy"))


def weight_class(wide: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """near_uniform, single, a mix of two, or mixed, by the sorted weights."""
    s = F.reverse(F.array_sort(F.array(*(F.col(f"w_{v}") for v in views))))
    kind = F.when(s[0] <= 0.45, "near_uniform").when(s[0] >= 0.80, "single").when(s[0] + s[1] >= 0.85, "mix").otherwise("mixed")
    return wide.withColumn("weight_class", kind)


def label_distance(wide: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """Euclidean distance of the two labels' weights for each configuration and fold."""
    rows = wide.where("label is not null").groupBy("config_key", "eta", "fold")
    a = {v: (F.max(F.when(F.col("label") == 0, F.col(f"w_{v}"))), F.max(F.when(F.col("label") == 1, F.col(f"w_{v}")))) for v in views}
    out = rows.agg(*(c.alias(f"{v}{n}") for v, pair in a.items() for n, c in enumerate(pair)))
    total = sum(((F.col(f"{v}0") - F.col(f"{v}1")) * (F.col(f"{v}0") - F.col(f"{v}1")) for v in views), F.lit(0.0))
    return out.select("config_key", "eta", "fold", F.sqrt(total).alias("label_distance"))


def shares(rows: DataFrame, within: list[str], value: str) -> DataFrame:
    """n and share of each value within groups."""
    counts = rows.groupBy(*within, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def shares_wide(rows: DataFrame, within: list[str], value: str, values: list[str]) -> DataFrame:
    return shares(rows, within, value).groupBy(*within).pivot(value, values).agg(F.first("share")).na.fill(0.0)


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"))


def value_percent(rows: DataFrame, value: str) -> DataFrame:
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(value, "n", (F.col("n") * 100 / F.col("total")).alias("percent"))


def fold_accuracy(fold_results: DataFrame) -> DataFrame:
    """fold_results with balanced accuracy of each fold, from its own arrays."""
    z = F.arrays_zip("y_true", "y_pred")

    def recall(label: int):
        n = F.size(F.filter(z, lambda x: x["y_true"] == label))
        return n, F.size(F.filter(z, lambda x: (x["y_true"] == label) & (x["y_pred"] == label))) / n

    (n1, r1), (n0, r0) = recall(1), recall(0)
    present = (n1 > 0).cast("int") + (n0 > 0).cast("int")
    return fold_results.withColumn("balanced_accuracy", (F.coalesce(r1, F.lit(0.0)) + F.coalesce(r0, F.lit(0.0))) / present)


def above_quantile(rows: DataFrame, metric: str, q: float) -> DataFrame:
    bound = rows.agg(F.percentile(metric, F.lit(q)).alias("_q"))
    return rows.join(F.broadcast(bound)).where(F.col(metric) >= F.col("_q")).drop("_q")


def cluster_profiles(wide: DataFrame, views: tuple[str, ...], k: int = 3, seed: int = 0, inits: int = 10) -> DataFrame:
    """wide with cluster and its distance to the centre: the best of several k-means runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[f"w_{v}" for v in views], outputCol="_x").transform(wide)
    data = checkpointed(data)  # each start of k-means passes over it many times
    models = [KMeans(k=k, seed=seed + n, featuresCol="_x", predictionCol="cluster").fit(data) for n in range(inits)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = [c.tolist() for c in best.clusterCenters()]
    own = F.array(*(F.array(*map(F.lit, c)) for c in centres))[F.col("cluster")]
    gap = sum(((F.col(f"w_{v}") - own[n]) * (F.col(f"w_{v}") - own[n]) for n, v in enumerate(views)), F.lit(0.0))
    return best.transform(data).withColumn("distance", F.sqrt(gap)).drop("_x")


def cluster_cores(clustered: DataFrame, views: tuple[str, ...], fraction: float = 0.2) -> DataFrame:
    """Of each cluster the closest share (one at least): its mean weights, size and dominant view, largest first."""
    w = Window.partitionBy("cluster")
    order = [c for c in ("distance", "config_key", "fold", "label") if c in clustered.columns]
    near = clustered.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    core = near.where(F.col("r") <= F.greatest(F.floor(F.col("n") * fraction), F.lit(1)))
    out = core.groupBy("cluster").agg(F.max("n").alias("size"), *(F.avg(f"w_{v}").alias(v) for v in views))
    return out.withColumn("dominant", first_best([(v, F.col(v)) for v in views])).orderBy(F.desc("size"), "cluster")


def fixed_profiles(cores: DataFrame, views: tuple[str, ...]) -> dict[str, list[float]]:
    """The corners, the uniform mixture, and the clusters' centres as mixtures; clusters are few."""
    n = len(views)
    out = {f"only_{v}": [float(k == i) for k in range(n)] for i, v in enumerate(views)} | {"uniform": [1 / n] * n}
    for r in cores.select("cluster", mixture(F.array(*views)).alias("m")).collect():
        out[f"cluster_{r['cluster']}"] = list(r["m"])
    return out


def drift(snapshots: DataFrame, *run: str) -> DataFrame:
    """Snapshots (run, checkpoint, protos, a_sq) with entropy, weight drift and prototype turnover against the checkpoint before."""
    w = Window.partitionBy(*run).orderBy("checkpoint")
    flat = F.flatten("a_sq")
    before, protos = F.lag(flat).over(w), F.lag("protos").over(w)
    gap = F.sqrt(F.aggregate(F.zip_with(flat, before, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    turnover = 1 - F.size(F.array_intersect("protos", protos)) / F.size(F.array_union("protos", protos))
    return snapshots.select(*run, "checkpoint", "loss", entropy(F.col("a_sq")[0]).alias("entropy"), gap.alias("weight_drift"), F.when(protos.isNotNull(), turnover).alias("proto_drift"))


def scopes(snapshots: DataFrame, *run: str) -> DataFrame:
    """The mixture of each scope (global, or one for each label) at each checkpoint: run, checkpoint, scope, weights, entropy."""
    each = snapshots.select(*run, "checkpoint", F.size("a_sq").alias("_n"), F.posexplode("a_sq").alias("_s", "w"))
    name = F.when(F.col("_n") == 1, "global").otherwise(F.concat(F.lit("label"), F.col("_s").cast("string")))
    return each.select(*run, "checkpoint", name.alias("scope"), mixture(F.col("w")).alias("weights"), entropy(F.col("w")).alias("entropy"))


def replayed(snapshots: DataFrame, wide: DataFrame, points: DataFrame, *run: str) -> DataFrame:
    """What the states of snapshots (run, checkpoint, protos by position, a_sq) predict for every point: run, checkpoint, i, y, y_pred.

    A prototype is measured with its own label's weights, where there are several; ties go to the first prototype. wide has the distances to the prototypes.
    """
    protos = snapshots.select(*run, "checkpoint", "a_sq", F.posexplode("protos").alias("k", "pj"))
    labels = points.select(F.col("pos").alias("pj"), F.col("y").alias("yk"))
    protos = protos.join(labels, "pj").withColumn("w", F.col("a_sq")[F.when(F.size("a_sq") > 1, F.col("yk")).otherwise(0)]).drop("a_sq")
    far = wide.select("i", "pi", "yi", "pj", "d").join(F.broadcast(protos), "pj").withColumn("dc", dot(F.col("w"), F.col("d")))
    best = far.groupBy(*run, "checkpoint", "i", "pi", F.col("yi").alias("y")).agg(F.min(F.struct("dc", "k", "yk")).alias("b"))
    return best.select(*run, "checkpoint", "i", "y", F.col("b.yk").alias("y_pred"))


def at_checkpoints(snapshots: DataFrame, checkpoints: list[int], *run: str) -> DataFrame:
    """The snapshot each checkpoint falls on; beyond the last one, the last."""
    last = snapshots.groupBy(*run).agg(F.max("snapshot").alias("_last"))
    wanted = last.withColumn("checkpoint", F.explode(F.array(*map(F.lit, checkpoints)))).withColumn("snapshot", F.least("checkpoint", "_last")).drop("_last")
    return wanted.join(snapshots, [*run, "snapshot"])


def paired_change(values: DataFrame, a: int, b: int, metric: str, *by: str) -> DataFrame:
    """Change of a metric between two checkpoints, paired by fold: mean, sample deviation, number."""
    wide = values.where(F.col("checkpoint").isin(a, b)).groupBy(*by, "fold").agg(F.max(F.when(F.col("checkpoint") == a, F.col(metric))).alias("x"), F.max(F.when(F.col("checkpoint") == b, F.col(metric))).alias("y"))
    d = wide.where("x is not null and y is not null").withColumn("d", F.col("y") - F.col("x"))
    return d.groupBy(*by).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.count("*").alias("n"))
