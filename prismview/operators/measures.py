"""The tables of structure, crossview and prototypes from tiles (operators.tiles) instead of from a row for each pair. Same columns, same values."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, margin, ratio
from ..session import checkpointed
from ..sources.fixtures import cells_to
from . import blocks, crossview, normalize, ranks, structure, trainer
from .tiles import VIEWS, Agreed, Asymmetry, Between, Combined, Counts, Hits, Least, Moments, Nearest, Normalised, RankSums, RowSums, Ties, Tiles, Zeros, view_name


def row_sums(t: Tiles) -> DataFrame:
    """view, i, pi, n, total, squares, least, greatest: of each point's distances to the others."""
    rows = t.fold(RowSums()).groupBy("pos", "view").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("ss").alias("squares"), F.min("lo").alias("least"), F.max("hi").alias("greatest"))
    return t.named(rows).withColumnRenamed("pos", "pi")


def view_counts(t: Tiles) -> DataFrame:
    return row_sums(t).groupBy("view").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.max("greatest").alias("greatest"))


def basic_checks(t: Tiles) -> DataFrame:
    sums = row_sums(t).groupBy("view").agg(F.count_distinct("i").alias("n"), F.min("least").alias("lo"), F.max("greatest").alias("hi"), F.sum("total").alias("s"), F.sum("squares").alias("ss"))
    gaps = t.fold(Asymmetry()).groupBy("view").agg(F.max("gap").alias("sym_max_abs_diff")).withColumn("view", view_name())
    return structure.checked(sums, gaps)


def row_means(t: Tiles) -> DataFrame:
    return row_sums(t).groupBy("view", "i").agg((F.sum("total") / (F.sum("n") + 1)).alias("row_mean"))


def margins(t: Tiles, skip_zero: bool = False) -> DataFrame:
    def least(c: str):
        x = F.min(c)
        if skip_zero:
            x = F.least(F.min(f"{c}_above"), F.when(F.min(f"{c}_above") == float("inf"), F.min(c)))
        return F.when(x < float("inf"), x)

    rows = t.named(t.fold(Least(skip_zero))).groupBy("view", "i", F.col("y").cast("int").alias("y")).agg(least("own").alias("d_plus"), least("other").alias("d_minus"))
    return rows.withColumn("mu", margin(F.col("d_plus"), F.col("d_minus")))


def tie_groups(t: Tiles, k: int) -> DataFrame:
    rows = t.named(t.fold(Ties(k))).groupBy("view", "i", "d").agg(F.sum("c").alias("c"), F.sum("same").alias("same"))
    return structure.tie_weights(rows, k).where("w > 0")


def neighbour_weight_sums(t: Tiles, k: int) -> DataFrame:
    return tie_groups(t, k).groupBy("view", "i").agg(F.sum(F.col("c") * F.col("w")).alias("total"), F.sum("c").alias("n"))


def knn_means(groups: DataFrame, k: int) -> DataFrame:
    """From tie groups: as many of each as there is room for before the k-th."""
    taken = F.round(F.col("c") * F.col("w"))
    return groups.groupBy("view", "i").agg((F.sum(F.col("d") * taken) / F.sum(taken)).alias("knn_mean"))


def point_table(t: Tiles, k: int) -> DataFrame:
    g = tie_groups(t, k)
    both = g.groupBy("view", "i").agg(structure.purity_of(k), (F.sum(F.col("d") * F.round(F.col("c") * F.col("w"))) / F.sum(F.round(F.col("c") * F.col("w")))).alias("knn_mean"))
    return margins(t).join(both, ["view", "i"]).select("view", F.col("i").alias("id"), "y", "mu", "d_plus", "d_minus", "knn_purity", "knn_mean")


def nearest(t: Tiles, k: int) -> DataFrame:
    return structure.first_by_distance(t.named(t.fold(Nearest(k))), k)


def overlap_means(t: Tiles, k: int) -> DataFrame:
    return crossview.overlaps(nearest(t, k)).groupBy("a", "b").agg(F.avg("jaccard").alias("overlap"))


def intra_inter(t: Tiles) -> DataFrame:
    sums = t.fold(Moments())
    rows = sums.select("own", "n", F.posexplode(F.array(*(F.struct(F.col(f"s{v}").alias("s"), F.col(f"ss{v}").alias("ss")) for v in range(3)))).alias("view", "z")).groupBy("view", "own").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.ss").alias("ss")).where("n > 0")
    mean = F.col("s") / F.col("n")
    rows = rows.select("view", "own", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    parts = [F.max(F.when(F.col("own") == own, F.col(c))).alias(f"{name}_{c}") for name, own in (("intra", True), ("inter", False)) for c in ("mean", "std")]
    out = rows.groupBy(view_name().alias("view")).agg(*parts)
    return out.withColumn("separation", ratio(F.col("inter_mean"), F.col("intra_mean")))


def pearson(t: Tiles) -> DataFrame:
    names = ["n", *(f"{c}{v}" for v in range(3) for c in ("s", "ss")), "p01", "p02", "p12"]
    one = t.fold(Moments()).agg(*(F.sum(c).alias(c) for c in names))

    def spread(v: int):
        return F.col(f"ss{v}") / F.col("n") - (F.col(f"s{v}") / F.col("n")) * (F.col(f"s{v}") / F.col("n"))

    def r(a: int, b: int):
        return (F.col(f"p{a}{b}") / F.col("n") - (F.col(f"s{a}") / F.col("n")) * (F.col(f"s{b}") / F.col("n"))) / F.sqrt(spread(a) * spread(b))

    return crossview.by_two(one.select(*(F.when(F.col("n") > 0, r(a, b)).alias(f"{VIEWS[a]}|{VIEWS[b]}") for a, b in combinations(range(3), 2))), VIEWS)


def value_counts(t: Tiles) -> DataFrame:
    """As ranks.value_counts over unordered pairs."""
    counts = t.fold(Counts()).groupBy(view_name().alias("view"), "d").agg(F.sum("c").alias("c"))
    return ranks.running(counts, "view", ["d"], F.col("c"))


def agreement(t: Tiles, q: float = 0.10) -> DataFrame:
    limits = {r["view"]: r["t"] for r in crossview.limits_of(value_counts(t), q).collect()}  # one row a view
    codes = t.fold(Agreed([limits.get(v, -1.0) for v in VIEWS])).groupBy("own", "code").agg(F.sum("c").alias("c"))
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("own"), "same").otherwise("diff"))).alias("subset")
    near = [F.col("code").bitwiseAND(F.lit(1 << v)) > 0 for v in range(3)]
    rows = codes.select(subset, "code", "c")
    aggs = [
        (F.sum(F.when(x, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"{VIEWS[a]}|{VIEWS[b]}|{name}")
        for a, b in combinations(range(3), 2)
        for name, x in (("agree_similar", near[a] & near[b]), ("agree_dissimilar", ~near[a] & ~near[b]), ("a_only", near[a] & ~near[b]), ("b_only", ~near[a] & near[b]))
    ]
    return crossview.agreed(rows.where("c > 0").groupBy("subset").agg(F.sum("c").alias("n_pairs"), *aggs), VIEWS)


def spearman(t: Tiles) -> DataFrame:
    """Ranks of the two coarse views are few (9 and 181 values) and go to the tasks; those of v3 meet the sums by its values."""
    coarse: list[dict[float, tuple[int, float]]] = [{}, {}]
    for r in t.fold(Counts(True)).groupBy("view", "d").agg(F.sum("c").alias("c")).orderBy("view", "d").collect():
        coarse[r["view"]][r["d"]] = (r["c"], sum(c for c, _ in coarse[r["view"]].values()) + (r["c"] + 1) / 2)
    n = sum(c for c, _ in coarse[0].values())
    middle = (n + 1) / 2
    centred = [{d: r - middle for d, (_, r) in x.items()} for x in coarse]
    spread = [sum(c * (r - middle) ** 2 for c, r in x.values()) for x in coarse]
    sums = checkpointed(t.fold(RankSums((centred[0], centred[1]))).groupBy("d").agg(F.sum("c").alias("c"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")))
    ranked = ranks.running(sums.where("d >= 0").withColumn("view", F.lit("v3")), "view", ["d"], F.col("c"))
    r = F.col("before") + (F.col("c") + 1) / 2 - F.lit(middle)
    one = ranked.agg(F.sum(r * F.col("r1")).alias("p02"), F.sum(r * F.col("r2")).alias("p12"), F.sum(F.col("c") * r * r).alias("s2")).crossJoin(F.broadcast(sums.where("d < 0").agg(F.sum("r1").alias("p01"))))
    size = [F.lit(float(spread[0])), F.lit(float(spread[1])), F.col("s2")]
    return crossview.by_two(one.select(*((F.col(f"p{a}{b}") / F.sqrt(size[a] * size[b])).alias(f"{VIEWS[a]}|{VIEWS[b]}") for a, b in combinations(range(3), 2))), VIEWS)


def combined(t: Tiles, a_sq: list[float]) -> DataFrame:
    """pi, total and least of the weighted distances."""
    return t.fold(Combined(a_sq, False)).where("n > 0").groupBy(F.col("pos").alias("pi")).agg(F.sum("s").alias("total"), F.min("lo").alias("least"))


def medoids(t: Tiles, a_sq: list[float], per_class: int) -> DataFrame:
    """As prototypes.medoids: one pass of tiles for the first of each class, then distances to the few chosen."""
    points = t.points.select("id", "pos", "y").distinct()
    own = t.fold(Combined(a_sq, True)).where("n_own > 0").groupBy("pos").agg(F.sum("own").alias("s")).join(points, "pos")
    chosen = checkpointed(own.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("s", "pos"))).where("r = 1").select("y", "id", F.lit(0).alias("n")))
    for n in range(1, per_class):
        ends = t.points.join(F.broadcast(chosen.select("id")), "id")
        sq = dot(F.array(*map(F.lit, a_sq)), F.col("d"))
        cells = cells_to(t.points, ends).where("yi = yj and pi <> pj").groupBy(F.col("yi").alias("y"), F.col("i").alias("id"), "pi").agg(F.min(sq * sq).alias("s"))
        far = cells.join(F.broadcast(chosen.select("id")), "id", "left_anti")
        nxt = far.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("s"), "pi"))).where("r = 1").select("y", "id", F.lit(n).alias("n"))
        chosen = checkpointed(chosen.unionByName(nxt))
    return chosen.select((F.row_number().over(Window.orderBy("y", "n")) - 1).cast("int").alias("k"), "id", "y")


def limits(t: Tiles) -> list[tuple[float, float]]:
    """lo and hi of each view, as normalize.bounds has them."""
    known = {r["view"]: (r["lo"], r["hi"]) for r in normalize.limits_of(value_counts(t)).collect()}  # one row a view
    return [known.get(v, (0.0, 0.0)) for v in VIEWS]


def normalised_sums(t: Tiles) -> DataFrame:
    """view, pi, total, at_one and at_zero of the normalised distances of each point."""
    rows = t.fold(Normalised(limits(t))).groupBy(view_name().alias("view"), F.col("pos").alias("pi"))
    return rows.agg(F.sum("s").alias("total"), F.sum("one").alias("at_one"), F.sum("zero").alias("at_zero"))


def zero_distances(t: Tiles) -> DataFrame:
    rows = t.named(t.fold(Zeros())).groupBy("view", "i").agg(F.sum("n").alias("n"), F.sum("zeros").alias("zeros"))
    rate = rows.groupBy("view").agg((F.sum("zeros") / F.sum("n")).alias("zero_rate"))
    return rate.join(structure.zeros_description(rows), "view")


def problems(t: Tiles) -> DataFrame | None:
    """As alignment.problems of v3: every cell is measured, and how often each is there follows from the points. None where there are no cells."""
    ids = t.points.groupBy("id").agg(F.count("*").alias("c"))
    m, once, n, squares = ids.agg(F.count("*"), F.count_if(F.col("c") == 1), F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
    if m < 2:
        return None
    cells = m * (m - 1)
    several = n * n - squares - cells  # rows beyond the first of a cell
    sums = t.fold(Between()).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return sums.select((F.lit(cells + several).cast("long") - F.col("n")).alias("missing_cells"), F.lit(cells - once * (once - 1)).cast("long").alias("duplicate_cells"), F.col("bad").alias("bad_cells"))


def fold_blocks(t: Tiles) -> DataFrame:
    """fold, part, n and mean v3 of alignment.fold_blocks; t: tiles of points whose label is their fold."""
    sums = t.fold(Between()).groupBy("ya", "yb").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = t.points.select(F.col("y").cast("int").alias("fold")).distinct()
    rows = sums.join(F.broadcast(every), F.col("yb") != F.col("fold")).withColumn("part", F.when(F.col("ya") == F.col("fold"), "valid").otherwise("train"))
    return rows.groupBy("fold", "part").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n") / 1e6).alias("mean")).where("n > 0")


def purity_baseline(t: Tiles, k: int, n_perm: int, groups: DataFrame | None = None) -> DataFrame:
    """As structure.purity_baseline: the first pass of tiles tells how far the neighbours of each point reach, the second adds up their weights by permutation.

    Workers get what is known of each point, some 60 bytes for 50 permutations, which pass the driver once.
    """
    groups = tie_groups(t, k) if groups is None else groups
    last = groups.groupBy("view", "i").agg(F.max(F.struct("d", "w")).alias("z")).groupBy("i").pivot("view", list(VIEWS)).agg(F.first("z"))
    words, planes = structure.label_words(t.points.select("id", "pos", "y"), n_perm)
    known = t.points.select("id", "pos").join(words, "id").join(last.withColumnRenamed("i", "id"), "id")
    known = known.select("pos", *(F.col(f"{v}.{c}").alias(f"{v}{c}") for c in "dw" for v in VIEWS), *(F.col("words")[i].alias(f"x{i}") for i in range(planes * -(-n_perm // structure.WORD)))).orderBy("pos").toArrow()
    col = {c: known.column(c).to_numpy() for c in known.column_names}
    sent = t.spark.sparkContext.broadcast((col["pos"], np.stack([col[f"{v}d"] for v in VIEWS]), np.stack([col[f"{v}w"] for v in VIEWS]), np.stack([col[c] for c in known.column_names if c[0] == "x"], 1)))
    runs = t.fold(Hits(sent, n_perm, structure.WORD, planes)).groupBy(view_name().alias("view"), "perm").agg((F.sum("w") / F.lit(float(k * t.n))).alias("p"))
    return structure.baseline_of(groups.groupBy("view", "i").agg(structure.purity_of(k)), runs)


def structural_summary(t: Tiles, k: int, n_perm: int = 50) -> DataFrame:
    """As structure.structural_summary, its counts and tie groups made once."""
    counts, groups = value_counts(t), tie_groups(t, k)
    purity = groups.groupBy("view", "i").agg(structure.purity_of(k))
    classes = t.points.select("id", "y").distinct().agg(*(F.count_if(F.col("y") == y).alias(f"n_class{y}") for y in (0, 1)))
    return structure.summary_of(
        basic_checks(t),
        structure.distribution_of(counts),
        structure.row_mean_description(row_means(t)),
        structure.knn_mean_description(knn_means(groups, k)),
        structure.dimension_of(nearest(t, 2)),
        t.spark.createDataFrame([(v,) for v in VIEWS], "view string").crossJoin(F.broadcast(classes)),
        intra_inter(t),
        structure.margin_description(margins(t)),
        structure.robust_named(structure.margin_description(margins(t, True))),
        structure.purity_description(purity),
        structure.baseline_named(purity_baseline(t, k, n_perm, groups)),
        zero_distances(t),
        counts.groupBy("view").agg(F.count("*").alias("n_unique")),
    )


def swap_scan(columns: blocks.Measured, points: DataFrame, protos: DataFrame, a_sq: list[float] | dict[int, list[float]], k: int) -> DataFrame:
    """As prototypes.swap_scan, with columns of the candidates computed by tasks. a_sq: squared weights, or those of each label; every label must have two prototypes and another label one."""
    known = points.select("id", "pos").orderBy("pos").toArrow()
    ids, y = known.column("id").to_pylist(), columns.y
    place = {i: n for n, i in enumerate(ids)}
    rows = protos.orderBy("k").collect()
    at, proto_y = np.array([place[r["id"]] for r in rows]), np.array([r["y"] for r in rows])
    labels = np.unique(y)
    w = np.array([a_sq[int(x)] for x in labels] if isinstance(a_sq, dict) else [a_sq])
    group = np.searchsorted(labels, y) if isinstance(a_sq, dict) else np.zeros(len(y), int)
    far = columns.columns(at)
    d = np.stack([far[int(j)] for j in at], 2)  # (V, n, K)
    dc = sum((w[group, v][:, None] * d[v] for v in range(len(d))), np.zeros(d.shape[1:]))
    own = y[:, None] == proto_y
    plus, minus = np.where(own, dc, np.inf), np.where(own, np.inf, dc)
    kp = plus.argmin(1)
    field = np.flatnonzero(kp == k)
    field = field[field != at[k]]
    dp, dm = plus.min(1), minus.min(1)
    loss = float(((dp - dm) / (dp + dm + trainer.EPS)).sum())
    rest = np.delete(np.arange(len(at)), k)
    deltas = columns.deltas(trainer.Scan(field, plus[:, rest].min(1), minus[:, rest].min(1), y == proto_y[k], w, group, None, loss))
    # numbers of points stand for them in the order of pos
    sent = columns.spark.createDataFrame(known.add_column(0, "j", [np.arange(len(ids), dtype=np.int32)]))
    return deltas.join(sent, "j").select(F.col("id").alias("candidate"), F.col("pos").alias("pc"), "delta")
