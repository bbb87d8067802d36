"""Exact ranks, row numbers and percentiles of very large groups: ranges of values instead of one window for a group.

Values are dealt into ranges, each range adds up its counts, and the sums of the ranges before give each its offset. What is
broadcast is one row for each range and group, so its size is that of the shuffle partitions times the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running(rows: DataFrame, by: str, order: Sequence[Column | str], count: Column) -> DataFrame:
    """rows with before: the sum of count over the rows of their group (by) that stand before them in order, which must be total."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.withColumns({**dict(zip(names, keys, strict=True)), "_c": count.cast("long")})
    # kept, so that a row's range is the same wherever it is asked for
    ranged = checkpointed(rows.repartitionByRange(n, by, *names).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(by, "_part").agg(F.sum("_c").alias("_t"))
    offsets = totals.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(by, "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_w", F.coalesce(F.sum("_c").over(within), F.lit(0))).join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("before", F.col("_w") + F.col("_offset")).drop("_by", "_p", "_offset", "_w", "_part", "_c", *names)


def row_numbers(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """rows with n, from 1 within each group."""
    return running(rows, by, order, F.lit(1)).withColumn("n", F.col("before") + 1).drop("before")


def value_counts(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, c and before: how often each value stands in its group, and how many lesser ones; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    return running(counts, by, [value], F.col("c"))


def percentiles(counts: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """by and q, the exact percentiles of each group in the order of shares, between neighbours by their distance. counts: as value_counts() gives them."""
    totals = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("_n"))
    place = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    asked = F.array(*(F.struct(F.lit(k).alias("k"), F.floor(p).alias("lo"), F.ceil(p).alias("hi"), (p - F.floor(p)).alias("part")) for k, p in enumerate(place)))
    rows = counts.join(F.broadcast(totals.select("_by", asked.alias("_asked"))), F.col(by).eqNullSafe(F.col("_by")))

    def here(at: Column) -> Column:
        return (at >= F.col("before")) & (at < F.col("before") + F.col("c"))

    hit = rows.select(by, value, "before", "c", F.explode(F.filter("_asked", lambda t: here(t["lo"]) | here(t["hi"]))).alias("t"))
    ends = hit.groupBy(by, "t.k").agg(F.max(F.when(here(F.col("t.lo")), F.col(value))).alias("lo"), F.max(F.when(here(F.col("t.hi")), F.col(value))).alias("hi"), F.max("t.part").alias("part"))
    each = ends.select(by, "k", ((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi")).alias("x"))
    return each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_q")).select(by, F.transform("_q", lambda z: z["x"]).alias("q"))
