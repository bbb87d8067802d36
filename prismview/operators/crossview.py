"""Comparison of views over the same points. wide: pairs with d as an array in the order of views."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .alignment import upper
from .structure import nearest



def pearson(wide: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """a, b, r for all ordered pairs of views, over unordered pairs of points: one pass."""
    cols = {v: F.col("d")[k] for k, v in enumerate(views)}
    aggs = {(a, b): F.corr(cols[a], cols[b]) for a, b in combinations(views, 2)}
    one = upper(wide).agg(*(c.alias(f"{a}|{b}") for (a, b), c in aggs.items()))
    return by_two(one, views)


def by_two(one: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """A row with a column a|b for each two views as rows for all ordered ones: a, b, r."""
    aggs = set(combinations(views, 2))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else F.col(f"`{a}|{b}`" if (a, b) in aggs else f"`{b}|{a}`")).alias("r")) for a in views for b in views]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def average_ranks(pairs: DataFrame) -> DataFrame:
    """Long unordered pairs with d replaced by its rank in the view, ties getting their mean rank.

    Ranks come from counts of distinct values, dealt into ranges of values.
    """
    u = upper(pairs)
    counts = ranks.value_counts(u, "view", "d").select("view", "d", (F.col("before") + (F.col("c") + 1) / 2).alias("r"))
    return u.join(counts, ["view", "d"]).withColumn("d", F.col("r")).drop("r")


def spearman(pairs: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """Pearson's coefficient of the mean ranks."""
    ranked = average_ranks(pairs).groupBy("pi", "pj").pivot("view", list(views)).agg(F.first("d"))
    return pearson(ranked.select("pi", "pj", F.array(*(F.col(v) for v in views)).alias("d")), views)


def correlation_summary(corr: DataFrame) -> DataFrame:
    """Mean and greatest absolute coefficient of each view with the others."""
    return corr.where("a <> b").groupBy(F.col("a").alias("view")).agg(F.avg(F.abs("r")).alias("mean_abs"), F.max(F.abs("r")).alias("max_abs"))


def neighbour_overlap(pairs: DataFrame, k: int) -> DataFrame:
    """a, b, i, jaccard: overlap of each point's k nearest (ties by position) in two views."""
    return overlaps(nearest(pairs, k))


def overlaps(near: DataFrame) -> DataFrame:
    sets = near.groupBy("view", "i").agg(F.collect_set("pj").alias("s"))  # k elements each
    x, y = sets.select(F.col("view").alias("a"), "i", F.col("s").alias("sa")), sets.select(F.col("view").alias("b"), "i", F.col("s").alias("sb"))
    return x.join(y, "i").select("a", "b", "i", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("jaccard"))


def overlap_means(pairs: DataFrame, k: int) -> DataFrame:
    return neighbour_overlap(pairs, k).groupBy("a", "b").agg(F.avg("jaccard").alias("overlap"))


def overlap_summary(pairs: DataFrame, k: int) -> DataFrame:
    return overlap_description(overlap_means(pairs, k))


def overlap_description(means: DataFrame) -> DataFrame:
    o = means.where("a <> b")
    return o.groupBy(F.col("a").alias("view")).agg(F.avg("overlap").alias("mean"), F.min("overlap").alias("least"), F.max("overlap").alias("greatest"))


def thresholds(pairs: DataFrame, q: float = 0.10) -> DataFrame:
    """view, t: below it two points count as similar."""
    if not 0 < q < 1:
        raise ValueError("a quantile lies between 0 and 1")
    return limits_of(ranks.value_counts(upper(pairs), "view", "d"), q)


def limits_of(counts: DataFrame, q: float) -> DataFrame:
    return ranks.percentiles(counts, "view", "d", (q,)).select("view", F.col("q")[0].alias("t"))


def agreement(wide: DataFrame, pairs: DataFrame, views: tuple[str, ...], q: float = 0.10) -> DataFrame:
    """a, b, subset (all, same, diff), shares of pairs similar in both, in neither, in one only, and their number.

    One pass: every pair gives one row for all pairs and one for its class relation; views are columns.
    """
    t = thresholds(pairs, q).groupBy().pivot("view", list(views)).agg(F.first("t"))
    u = upper(wide).join(F.broadcast(t))  # one row
    u = u.select("yi", "yj", *((F.col("d")[k] <= F.col(v)).alias(f"s_{v}") for k, v in enumerate(views)))
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("yi") == F.col("yj"), "same").otherwise("diff"))).alias("subset")
    aggs = []
    for a, b in combinations(views, 2):
        x, y = F.col(f"s_{a}"), F.col(f"s_{b}")
        for name, c in (("agree_similar", x & y), ("agree_dissimilar", ~x & ~y), ("a_only", x & ~y), ("b_only", ~x & y)):
            aggs.append(F.avg(c.cast("double")).alias(f"{a}|{b}|{name}"))
    out = u.select(subset, *(f"s_{v}" for v in views)).groupBy("subset").agg(F.count("*").alias("n_pairs"), *aggs)
    return agreed(out, views)


def agreed(out: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """agreement from one row for each subset."""
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f"`{a}|{b}|{n}`").alias(n) for n in ("agree_similar", "agree_dissimilar", "a_only", "b_only"))) for a, b in combinations(views, 2)]
    return out.select("subset", "n_pairs", F.explode(F.array(*rows)).alias("x")).select("x.a", "x.b", "subset", "x.agree_similar", "x.agree_dissimilar", "x.a_only", "x.b_only", "n_pairs")


def disagreement(agreed: DataFrame, subset: str = "all") -> DataFrame:
    return agreed.where(F.col("subset") == subset).select("a", "b", (F.col("a_only") + F.col("b_only")).alias("disagreement"))
