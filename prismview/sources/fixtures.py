"""Views of the driver's tables: several distances between the same entities, and a binary label.

points: id, pos, y and what the distances need. pairs: view, i, j, pi, pj, yi, yj, d for every ordered pair of
different points. The matrices this library is about hold all pairs, so their size is the square of the points'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = ("v1", "v2", "v3")
#: Points of which all pairs are made; beyond, take sources.matrices.subsample first. So many points are broadcast to the nested loop at most.
MOST_POINTS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signs(e: Column, first: int, last: int) -> Column:
    """The signs of components first..last (from 1) as bits."""
    bits = [F.when(F.element_at(e, k) > 0, F.lit(1 << (k - first))).otherwise(F.lit(0)) for k in range(first, last + 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the embeddings: signs of dimensions 1-8 and 9-32 as bits, dimensions 33-64 as doubles."""
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("long").alias("pos"), (F.col("label") % 2).cast("int").alias("y"), _signs(e, 1, 8).alias("s1"), _signs(e, 9, 32).alias("s2"), F.slice(e, 33, 32).cast("array<double>").alias("e3"))


def distances(a: str, b: str) -> list[Column]:
    """Sign Hamming distance, Jaccard distance of positive dimensions, and Euclidean distance to six places."""
    both, either = F.bit_count(F.col(f"{a}.s2").bitwiseAND(F.col(f"{b}.s2"))), F.bit_count(F.col(f"{a}.s2").bitwiseOR(F.col(f"{b}.s2")))
    squares = [(F.col(f"{a}.e3")[k] - F.col(f"{b}.e3")[k]) * (F.col(f"{a}.e3")[k] - F.col(f"{b}.e3")[k]) for k in range(32)]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return [
        F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) / F.lit(8.0),
        F.when(either == 0, F.lit(0.0)).otherwise(1 - both.cast("double") / either),
        F.floor(F.sqrt(total) * 1e6 + 0.5) / F.lit(1e6),
    ]


def wide_pairs(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """i, j, pi, pj, yi, yj and d, an array with one distance per view. One nested loop over the broadcast points, of which there may be most."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"all pairs of more than {most} points; take a sample first")
    return _distances(points, F.broadcast(points), F.col("a.pos") != F.col("b.pos"))


def cells_to(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """As wide_pairs, from every point to the chosen ones (a few, broadcast), themselves included."""
    return _distances(points, F.broadcast(chosen), F.lit(True))


def _distances(points: DataFrame, others: DataFrame, condition: Column) -> DataFrame:
    d = F.array(*distances("a", "b"))
    spark = points.sparkSession
    # a small file is one partition, and the loop would be one task
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    joined = points.repartition(n, "pos").alias("a").join(others.alias("b"), condition)
    return joined.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.pos").alias("pi"), F.col("b.pos").alias("pj"), F.col("a.y").alias("yi"), F.col("b.y").alias("yj"), d.alias("d"))


def long_pairs(wide: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """One row per view: view, i, j, pi, pj, yi, yj, d."""
    return wide.select(F.explode(F.arrays_zip(F.array(*map(F.lit, views)).alias("view"), F.col("d").alias("d"))).alias("z"), "i", "j", "pi", "pj", "yi", "yj").select("z.view", "i", "j", "pi", "pj", "yi", "yj", "z.d")


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_pairs(wide_pairs(embedding_points(spark, sf_dir)))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: id, pos, y (balance above the median), nation, region, spend (the total of their orders, 0 without any) and products (kinds of brand and type bought, as numbers)."""
    customer, orders, nation, lineitem, part = (table(spark, sf_dir, n) for n in ("customer", "orders", "nation", "lineitem", "part"))
    spend = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    kinds = part.groupBy("p_brand", "p_type").agg(F.xxhash64("p_brand", "p_type").alias("kind"))  # equal kinds, equal numbers
    bought = orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey).select("o_custkey", "l_partkey").distinct()
    bought = bought.join(part, bought.l_partkey == part.p_partkey).join(F.broadcast(kinds), ["p_brand", "p_type"])
    products = bought.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("kind").alias("products"))  # as many as there are kinds, at most
    rows = customer.join(spend, customer.c_custkey == spend.o_custkey, "left").join(products, customer.c_custkey == products.key, "left").join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    middle = customer.agg(F.percentile("c_acctbal", F.lit(0.5)).alias("middle"))
    rows = rows.join(F.broadcast(middle))
    return rows.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("long").alias("pos"), (F.col("c_acctbal") > F.col("middle")).cast("int").alias("y"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce("products", F.array().cast("array<bigint>")).alias("products"))


def customer_pairs(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """Long pairs of customers in the views place (0 one nation, 0.5 one region, else 1), products (Jaccard distance) and spend (of logarithms)."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"all pairs of more than {most} points; take a sample first")
    spark = points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    j = points.repartition(n, "pos").alias("a").join(F.broadcast(points).alias("b"), F.col("a.pos") != F.col("b.pos"))
    place = F.when(F.col("a.nation") == F.col("b.nation"), 0.0).when(F.col("a.region") == F.col("b.region"), 0.5).otherwise(1.0)
    both = F.size(F.array_intersect("a.products", "b.products"))
    either = F.size("a.products") + F.size("b.products") - both
    products = F.when(either == 0, 0.0).otherwise(1 - both / either)
    spend = F.floor(F.abs(F.log1p("a.spend") - F.log1p("b.spend")) * 1e6 + 0.5) / 1e6
    wide = j.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.pos").alias("pi"), F.col("b.pos").alias("pj"), F.col("a.y").alias("yi"), F.col("b.y").alias("yj"), F.array(place, products, spend).alias("d"))
    return long_pairs(wide, ("place", "products", "spend"))
