"""Structure of one view: distributions, neighbourhoods, margins. All work on long pairs, for every view at once.

Neighbourhood operators group by point before any window, so that views with many equal distances collapse first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import describe, margin, ratio
from . import ranks
from .alignment import upper

#: The shares at which a distribution is reported, by name in thousandths.
QUANTILES = (0.0, 0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)


def basic_checks(pairs: DataFrame) -> DataFrame:
    """n, asymmetry, and extremes, mean and population deviation over the whole matrix with its zero diagonal."""
    n = F.count_distinct("i").cast("long")
    sums = pairs.groupBy("view").agg(n.alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    mirrored = pairs.select("view", F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b"), "d").groupBy("view", "a", "b").agg((F.max("d") - F.min("d")).alias("gap")).groupBy("view").agg(F.max("gap").alias("sym_max_abs_diff"))
    return checked(sums, mirrored)


def checked(sums: DataFrame, mirrored: DataFrame) -> DataFrame:
    """basic_checks from its parts: view, n, lo, hi, s and ss of all cells, and view, sym_max_abs_diff."""
    cells = F.col("n") * F.col("n")
    mean = F.col("s") / cells
    return sums.join(mirrored, "view").select("view", "n", "sym_max_abs_diff", F.least("lo", F.lit(0.0)).alias("d_min"), F.greatest("hi", F.lit(0.0)).alias("d_max"), mean.alias("d_mean"), F.sqrt(F.greatest(F.col("ss") / cells - mean * mean, F.lit(0.0))).alias("d_std"))


def moments(counts: DataFrame) -> DataFrame:
    """view, mean and population deviation (std) of values d that stand c times; deviations are taken from the mean, so nothing cancels."""
    mean = counts.groupBy("view").agg((F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean"))
    gap = F.col("d") - F.col("mean")
    return counts.join(F.broadcast(mean), "view").groupBy("view").agg(F.max("mean").alias("mean"), F.sqrt(F.sum(F.col("c") * gap * gap) / F.sum("c")).alias("std"))


def distribution(pairs: DataFrame) -> DataFrame:
    """Quantiles, mean, population deviation and their ratio, over unordered pairs."""
    return distribution_of(ranks.value_counts(upper(pairs), "view", "d"))


def distribution_of(counts: DataFrame) -> DataFrame:
    out = moments(counts).join(ranks.percentiles(counts, "view", "d", QUANTILES), "view")
    return out.select("view", *(F.col("q")[k].alias(f"q{round(x * 1000):03d}") for k, x in enumerate(QUANTILES)), "mean", "std", ratio(F.col("std"), F.col("mean")).alias("cv"))


def row_means(pairs: DataFrame) -> DataFrame:
    """Mean distance of each point, its own zero included."""
    return pairs.groupBy("view", "i").agg((F.sum("d") / (F.count("*") + 1)).alias("row_mean"))


def row_mean_summary(pairs: DataFrame) -> DataFrame:
    return row_mean_description(row_means(pairs))


def row_mean_description(means: DataFrame) -> DataFrame:
    return means.groupBy("view").agg(*describe("row_mean", "row_mean"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each point, ties by position: rank from 1."""
    return first_by_distance(pairs, k)


def first_by_distance(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("view", "i").orderBy("d", "pj")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_means(pairs: DataFrame, k: int) -> DataFrame:
    return nearest(pairs, k).groupBy("view", "i").agg(F.avg("d").alias("knn_mean"))


def knn_mean_summary(pairs: DataFrame, k: int) -> DataFrame:
    return knn_mean_description(knn_means(pairs, k))


def knn_mean_description(means: DataFrame) -> DataFrame:
    return means.groupBy("view").agg(F.avg("knn_mean").alias("knn_mean"), F.stddev_pop("knn_mean").alias("knn_std"))


def intrinsic_dimension(pairs: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Two-nearest-neighbour estimate: one over the mean log ratio of the second to the first distance."""
    return dimension_of(nearest(pairs, 2), eps)


def dimension_of(near: DataFrame, eps: float = 1e-12) -> DataFrame:
    two = near.groupBy("view", "i").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("r2"))
    kept = two.where((F.col("r1") > eps) & (F.col("r2") > F.col("r1")))
    return kept.groupBy("view").agg(F.count("*").alias("n_used"), (1 / F.avg(F.log(F.col("r2") / F.col("r1")))).alias("intrinsic_dim"))


def class_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("y").agg(F.count("*").alias("n"))


def intra_inter(pairs: DataFrame) -> DataFrame:
    same = F.col("yi") == F.col("yj")
    intra, inter = F.when(same, F.col("d")), F.when(~same, F.col("d"))
    out = upper(pairs).groupBy("view").agg(F.avg(intra).alias("intra_mean"), F.stddev_pop(intra).alias("intra_std"), F.avg(inter).alias("inter_mean"), F.stddev_pop(inter).alias("inter_std"))
    return out.withColumn("separation", ratio(F.col("inter_mean"), F.col("intra_mean")))


def margins(pairs: DataFrame, skip_zero: bool = False) -> DataFrame:
    """d_plus, d_minus and mu of each point. skip_zero: zero distances count only where there is nothing else."""
    same, d = F.col("yi") == F.col("yj"), F.col("d")

    def least(mine):
        whole = F.min(F.when(mine, d))
        return F.coalesce(F.min(F.when(mine & (d > 0), d)), whole) if skip_zero else whole

    out = pairs.groupBy("view", "i", F.col("yi").alias("y")).agg(least(same).alias("d_plus"), least(~same).alias("d_minus"))
    return out.withColumn("mu", margin(F.col("d_plus"), F.col("d_minus")))


def margin_summary(pairs: DataFrame, skip_zero: bool = False) -> DataFrame:
    return margin_description(margins(pairs, skip_zero))


def margin_description(rows: DataFrame) -> DataFrame:
    mu = F.col("mu")
    return rows.groupBy("view").agg(*describe("mu", "mu"), F.avg((mu < 0).cast("double")).alias("frac_negative"), F.avg((mu == 0).cast("double")).alias("frac_zero"))


def tie_groups(pairs: DataFrame, k: int) -> DataFrame:
    """For each point and distinct distance: how many others stand there (c), how many of them share its class (same),
    and the weight of each: 1 below the k-th distance, an equal share of what is left at it, 0 beyond."""
    g = pairs.groupBy("view", "i", "d").agg(F.count("*").alias("c"), F.sum((F.col("yi") == F.col("yj")).cast("int")).alias("same"))
    return tie_weights(g, k)


def tie_weights(g: DataFrame, k: int) -> DataFrame:
    """g (view, i, d, c, same) with w; of groups beyond the k-th distance none need be there."""
    before = F.coalesce(F.sum("c").over(Window.partitionBy("view", "i").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("w", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(k) - before) / F.col("c"))))


def knn_purity(pairs: DataFrame, k: int) -> DataFrame:
    """Share of its own class among the k nearest of each point; ties at the k-th distance are shared."""
    return tie_groups(pairs, k).groupBy("view", "i").agg(purity_of(k))


def purity_of(k: int) -> Column:
    return (F.sum(F.col("same") * F.col("w")) / k).alias("knn_purity")


def neighbour_weights(pairs: DataFrame, k: int) -> DataFrame:
    """The weights by pair: they add up to k for each point."""
    g = tie_groups(pairs, k).where("w > 0").select("view", "i", "d", "w")
    return pairs.join(g, ["view", "i", "d"])


def permuted_labels(points: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """perm, id, y: labels dealt anew. The order of a hash of id and permutation says whose label a point gets."""
    perms = points.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("perm"))
    spread = points.select("id", "pos", "y").join(F.broadcast(perms))
    takes = ranks.row_numbers(spread, "perm", F.md5(F.concat_ws("|", "id", "perm", F.lit(str(seed)))), "pos").select("perm", "id", F.col("n").alias("r"))
    gives = ranks.row_numbers(spread.select("perm", "pos", "y"), "perm", "pos").select("perm", "y", F.col("n").alias("r"))
    return takes.join(gives, ["perm", "r"]).select("perm", "id", "y")


#: Permutations in one number: as many bits as stay positive.
WORD = 63


def label_words(points: DataFrame, n_perm: int, seed: int = 0) -> tuple[DataFrame, int]:
    """id and words, an array of numbers: bit p % WORD of words[p // WORD * planes + b] is bit b of the number of the label that permutation p gives the point. And planes."""
    labels = points.select("y").distinct()
    planes = max(1, (labels.count() - 1).bit_length())
    numbered = labels.select("y", (F.row_number().over(Window.orderBy("y")) - 1).alias("_n"))
    rows = permuted_labels(points, n_perm, seed).join(F.broadcast(numbered), "y")
    bit = F.expr(f"shiftleft(1L, perm % {WORD})")
    words = [F.bit_or(F.when((F.floor(F.col("perm") / WORD) == w) & (F.shiftright("_n", b) % 2 == 1), bit).otherwise(F.lit(0).cast("long"))) for w in range(-(-n_perm // WORD)) for b in range(planes)]
    return rows.groupBy("id").agg(F.array(*words).alias("words")), planes


def purity_baseline(pairs: DataFrame, points: DataFrame, k: int, n_perm: int, seed: int = 0) -> DataFrame:
    """Mean purity against that of permuted labels: mean, population deviation, and the z score.

    A point carries its labels of all permutations as bits, so a weighted pair stays one row: the bits in which its two points differ say in which permutations it is a hit.
    """
    n = points.count()
    words, planes = label_words(points, n_perm, seed)
    a, b = words.select(F.col("id").alias("i"), F.col("words").alias("wa")), words.select(F.col("id").alias("j"), F.col("words").alias("wb"))
    rows = neighbour_weights(pairs, k).select("view", "i", "j", "w").join(a, "i").join(b, "j")

    def differ(word: int):
        out = F.lit(0).cast("long")
        for plane in range(word * planes, (word + 1) * planes):
            out = out.bitwiseOR(F.col("wa")[plane].bitwiseXOR(F.col("wb")[plane]))
        return out

    rows = rows.select("view", "w", *(differ(x).alias(f"x{x}") for x in range(-(-n_perm // WORD))))
    hits = [F.sum(F.when(F.col(f"x{p // WORD}").bitwiseAND(F.lit(1 << p % WORD)) == 0, F.col("w")).otherwise(0.0)) / F.lit(float(k * n)) for p in range(n_perm)]
    runs = rows.groupBy("view").agg(F.array(*hits).alias("p")).select("view", F.explode("p").alias("p"))
    return baseline_of(knn_purity(pairs, k), runs)


def baseline_of(purity: DataFrame, runs: DataFrame) -> DataFrame:
    """purity_baseline from its parts: view, i, knn_purity of the points, and view, p of each permutation."""
    base = runs.groupBy("view").agg(F.avg("p").alias("baseline_mean"), F.stddev_pop("p").alias("baseline_std"))
    own = purity.groupBy("view").agg(F.avg("knn_purity").alias("purity_mean"))
    return own.join(base, "view").withColumn("z", (F.col("purity_mean") - F.col("baseline_mean")) / (F.col("baseline_std") + 1e-12))


def zero_distances(pairs: DataFrame) -> DataFrame:
    rate = upper(pairs).groupBy("view").agg(F.avg((F.col("d") == 0).cast("double")).alias("zero_rate"))
    return rate.join(zeros_description(pairs.groupBy("view", "i").agg(F.sum((F.col("d") == 0).cast("long")).alias("zeros"))), "view")


def zeros_description(zeros: DataFrame) -> DataFrame:
    z = F.col("zeros")
    return zeros.groupBy("view").agg(F.avg("zeros").alias("zeros_mean"), F.stddev_samp("zeros").alias("zeros_std"), F.max("zeros").alias("zeros_max"), F.avg((z >= 1).cast("double")).alias("frac_any"), F.avg((z >= 10).cast("double")).alias("frac_ten"))


def distinct_values(pairs: DataFrame, show: int = 30) -> DataFrame:
    """The first and the last distinct distances: view, n_unique, side (head or tail), place (from 1, from that end) and d."""
    return value_ends(upper(pairs).where("d is not null").select("view", "d").distinct(), show)


def value_ends(values: DataFrame, show: int = 30) -> DataFrame:
    v = ranks.row_numbers(values.select("view", "d"), "view", "d")
    n = v.groupBy("view").agg(F.count("*").alias("n_unique"))
    v = v.join(F.broadcast(n), "view").withColumn("back", F.col("n_unique") - F.col("n") + 1)
    ends = F.explode(F.array(F.struct(F.lit("head").alias("side"), F.col("n").alias("place")), F.struct(F.lit("tail").alias("side"), F.col("back").alias("place")))).alias("e")
    return v.where((F.col("n") <= show) | (F.col("back") <= show)).select("view", "n_unique", ends, "d").where(F.col("e.place") <= show).select("view", "n_unique", "e.side", "e.place", "d")


def point_table(pairs: DataFrame, k: int) -> DataFrame:
    """view, id, y, mu, d_plus, d_minus, knn_purity, knn_mean."""
    m = margins(pairs)
    return m.join(knn_purity(pairs, k), ["view", "i"]).join(knn_means(pairs, k), ["view", "i"]).select("view", F.col("i").alias("id"), "y", "mu", "d_plus", "d_minus", "knn_purity", "knn_mean")


def purity_summary(pairs: DataFrame, k: int) -> DataFrame:
    return purity_description(knn_purity(pairs, k))


def purity_description(purity: DataFrame) -> DataFrame:
    return purity.groupBy("view").agg(F.avg("knn_purity").alias("purity_mean"), F.stddev_pop("knn_purity").alias("purity_std"))


def class_balance(pairs: DataFrame) -> DataFrame:
    """Points of each class by view."""
    own = pairs.select("view", "i", "yi").distinct()
    return own.groupBy("view").agg(F.sum((F.col("yi") == 0).cast("long")).alias("n_class0"), F.sum((F.col("yi") == 1).cast("long")).alias("n_class1"))


def structural_summary(pairs: DataFrame, k: int, n_perm: int = 50) -> DataFrame:
    """One row per view with all characteristics: checks, distribution, rows, neighbourhoods, classes, margins (plain and robust), purity and its permutation baseline,
    zeros and distinct values.

    pairs are read once for each part, so they should be stored.
    """
    points = pairs.select(F.col("i").alias("id"), F.col("pi").alias("pos"), F.col("yi").alias("y")).distinct()
    return summary_of(
        basic_checks(pairs),
        distribution(pairs),
        row_mean_summary(pairs),
        knn_mean_summary(pairs, k),
        intrinsic_dimension(pairs),
        class_balance(pairs),
        intra_inter(pairs),
        margin_summary(pairs),
        robust_named(margin_summary(pairs, True)),
        purity_summary(pairs, k),
        baseline_named(purity_baseline(pairs, points, k, n_perm)),
        zero_distances(pairs),
        upper(pairs).groupBy("view").agg(F.count_distinct("d").alias("n_unique")),
    )


def robust_named(robust: DataFrame) -> DataFrame:
    return robust.select("view", *(F.col(c).alias(f"robust_{c}") for c in robust.columns if c != "view"))


def baseline_named(baseline: DataFrame) -> DataFrame:
    return baseline.select("view", F.col("baseline_mean").alias("purity_baseline_mean"), F.col("baseline_std").alias("purity_baseline_std"), F.col("z").alias("purity_z"))


def summary_of(*parts: DataFrame) -> DataFrame:
    """structural_summary from its parts, each with one row per view."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "view", "left")
    return out


def distribution_report(pairs: DataFrame) -> DataFrame:
    """Mean, population deviation, median, outer deciles and the share of distances at 1, of normalised views."""
    return report_of(ranks.value_counts(upper(pairs), "view", "d"))


def report_of(counts: DataFrame) -> DataFrame:
    at_one = F.when(F.abs(F.col("d") - 1) <= 1e-12 + 1e-5, F.col("c")).otherwise(0)
    share = counts.groupBy("view").agg((F.sum(at_one) / F.sum("c")).alias("share_one"))
    out = moments(counts).join(ranks.percentiles(counts, "view", "d", (0.1, 0.5, 0.9)), "view").join(share, "view")
    return out.select("view", "mean", "std", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"), "share_one")
