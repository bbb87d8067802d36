"""Single steps of the prototype learner in relational form.

wide: pairs with d as an array over views (other points only; the diagonal is zero). protos: k, id, y. weights: squared view weights
as an array, or one array per label. A prototype is at distance zero from its own point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS_LEARNER, Squash, dot, identity, l2_normalised, margin


def weights_literal(a_sq: list[float]) -> Column:
    return F.array(*map(F.lit, a_sq))


def combined(wide: DataFrame, a_sq: Column) -> DataFrame:
    """wide with dc, the weighted sum of the views."""
    return wide.withColumn("dc", dot(a_sq, F.col("d")))


def with_diagonal(wide: DataFrame, points: DataFrame, n_views: int) -> DataFrame:
    zero = F.array(*[F.lit(0.0)] * n_views)
    own = points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("pos").alias("pi"), F.col("pos").alias("pj"), F.col("y").alias("yi"), F.col("y").alias("yj"), zero.alias("d"))
    return wide.unionByName(own)


def medoids(wide: DataFrame, a_sq: Column, per_class: int) -> DataFrame:
    """Prototypes k, id, y: of each class the point with the least sum of squared distances to its class, then the farthest from those chosen, again and again.

    Prototypes are few (classes times per_class), so the chosen ones are broadcast in each round.
    """
    own = combined(wide.where("yi = yj"), a_sq).select("i", "j", "pi", "pj", F.col("yi").alias("y"), (F.col("dc") * F.col("dc")).alias("sq"))
    best = Window.partitionBy("y").orderBy("s", "pi")
    chosen = own.groupBy("y", "i", "pi").agg(F.sum("sq").alias("s")).withColumn("r", F.row_number().over(best)).where("r = 1").select("y", F.col("i").alias("id"), F.lit(0).alias("n"))
    for n in range(1, per_class):
        protos = F.broadcast(chosen.select(F.col("id").alias("j")))
        taken = F.broadcast(chosen.select(F.col("id").alias("i")))
        far = own.join(protos, "j").groupBy("y", "i", "pi").agg(F.min("sq").alias("s")).join(taken, "i", "left_anti")
        nxt = far.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("s"), "pi"))).where("r = 1").select("y", F.col("i").alias("id"), F.lit(n).alias("n"))
        chosen = chosen.unionByName(nxt)
    return chosen.select((F.row_number().over(Window.orderBy("y", "n")) - 1).cast("int").alias("k"), "id", "y")


def to_prototypes(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Distances from every point to every prototype: i, pi, yi, k, yk, d. cells: wide with its diagonal, or only what ends at prototypes."""
    p = F.broadcast(protos.select("k", F.col("id").alias("j"), F.col("y").alias("yk")))
    return cells.join(p, "j").select("i", "pi", "yi", "k", "yk", "d")


def assigned(cells: DataFrame, protos: DataFrame, a_sq: Column) -> DataFrame:
    """For each point its nearest own and nearest other prototype (ties: the lower k): i, pi, y, k_plus, d_plus, dv_plus, k_minus, d_minus, dv_minus."""
    d = to_prototypes(cells, protos).withColumn("dc", dot(a_sq, F.col("d")))

    def best(mine, side):
        first = F.min(F.when(mine, F.struct("dc", "k", "d")))
        return first.alias(side)

    own = F.col("yi") == F.col("yk")
    out = d.groupBy("i", "pi", F.col("yi").alias("y")).agg(best(own, "p"), best(~own, "m"))
    return out.select("i", "pi", "y", F.col("p.k").alias("k_plus"), F.col("p.dc").alias("d_plus"), F.col("p.d").alias("dv_plus"), F.col("m.k").alias("k_minus"), F.col("m.dc").alias("d_minus"), F.col("m.d").alias("dv_minus"))


def label_weights(by_label: dict[int, list[float]], label: Column) -> Column:
    out = F.lit(None).cast("array<double>")
    for y, a in by_label.items():
        out = F.when(label == y, weights_literal(a)).otherwise(out)
    return out


def predict_global(cells: DataFrame, protos: DataFrame, a_sq: Column) -> DataFrame:
    """i, y, y_pred: the label of the nearest prototype, the lower k on ties."""
    d = to_prototypes(cells, protos).withColumn("dc", dot(a_sq, F.col("d")))
    return d.groupBy("i", "pi", F.col("yi").alias("y")).agg(F.min(F.struct("dc", "k", "yk")).alias("b")).select("i", "y", F.col("b.yk").alias("y_pred"))


def predict_label(cells: DataFrame, protos: DataFrame, by_label: dict[int, list[float]]) -> DataFrame:
    """As predict_global, each prototype measured with its own label's weights; ties go to the lower label."""
    d = to_prototypes(cells, protos).withColumn("dc", dot(label_weights(by_label, F.col("yk")), F.col("d")))
    return d.groupBy("i", "pi", F.col("yi").alias("y")).agg(F.min(F.struct("dc", "yk")).alias("b")).select("i", "y", F.col("b.yk").alias("y_pred"))


def loss(assignment: DataFrame, phi: Squash = identity) -> DataFrame:
    return assignment.agg(F.sum(phi(margin(F.col("d_plus"), F.col("d_minus"), EPS_LEARNER))).alias("loss"), F.count("*").alias("n"))


def priorities(assignment: DataFrame, protos: DataFrame) -> DataFrame:
    """k, priority (sum of d_plus won less sum of d_minus won) and its rank, the greatest first."""
    plus = assignment.groupBy(F.col("k_plus").alias("k")).agg(F.sum("d_plus").alias("a"))
    minus = assignment.groupBy(F.col("k_minus").alias("k")).agg(F.sum("d_minus").alias("b"))
    out = protos.select("k").join(plus, "k", "left").join(minus, "k", "left").select("k", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("priority"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "k")))


def receptive_field(assignment: DataFrame, protos: DataFrame, k: int) -> DataFrame:
    """The points that prototype k wins, less its own: j and y_k, its label."""
    label = protos.where(F.col("k") == k).select(F.col("y").alias("y_k"), F.col("id").alias("id_k"))
    return assignment.where(F.col("k_plus") == k).join(F.broadcast(label), F.col("i") != F.col("id_k")).select(F.col("i").alias("j"), "y_k")


def swap_scan(cells: DataFrame, protos: DataFrame, a_sq: Column, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """The change of loss for moving prototype k to each other point of its receptive field: candidate, pc, delta.

    Without prototype k every point has a nearest own and other prototype; a candidate takes k's place in that minimum.
    cells must hold all that ends at prototypes; candidates (else cells) all that ends at the points of the receptive field.
    """
    a = assigned(cells, protos, a_sq)
    field = receptive_field(a, protos, k)
    d = to_prototypes(cells, protos).where(F.col("k") != k).withColumn("dc", dot(a_sq, F.col("d")))
    own = F.col("yi") == F.col("yk")
    without = d.groupBy("i", F.col("yi").alias("y")).agg(F.min(F.when(own, F.col("dc"))).alias("p"), F.min(F.when(~own, F.col("dc"))).alias("m"))
    moved = (cells if candidates is None else candidates).join(field, "j").select("i", F.col("j").alias("candidate"), F.col("pj").alias("pc"), "y_k", dot(a_sq, F.col("d")).alias("dc"))
    both = moved.join(without, "i").select("candidate", "pc", F.when(F.col("y") == F.col("y_k"), F.least("p", "dc")).otherwise(F.col("p")).alias("p"), F.when(F.col("y") == F.col("y_k"), F.col("m")).otherwise(F.least("m", "dc")).alias("m"))
    total = both.groupBy("candidate", "pc").agg(F.sum(margin(F.col("p"), F.col("m"), EPS_LEARNER)).alias("l"))
    return total.join(F.broadcast(loss(a).select("loss"))).select("candidate", "pc", (F.col("l") - F.col("loss")).alias("delta"))


def _gradient(a: Column, v: int) -> Column:
    den = F.col("d_plus") + F.col("d_minus") + EPS_LEARNER
    return F.sum(4 * a[v] * (F.col("dv_plus")[v] * F.col("d_minus") - F.col("dv_minus")[v] * F.col("d_plus")) / (den * den))


def weight_step(assignment: DataFrame, a: list[float], eta: float, *by: str) -> DataFrame:
    """The weights (not squared) after one step against the gradient of unit length, of unit length again. by: ("y",) for one step per label."""
    aw = weights_literal(a)
    g = assignment.groupBy(*by).agg(F.array(*(_gradient(aw, v) for v in range(len(a)))).alias("g"))
    length = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    step = F.zip_with(aw, F.transform("g", lambda x: x / length), lambda w, x: w - eta * x)
    return g.select(*by, l2_normalised(step).alias("a"))


def linear_weight_step(assignment: DataFrame, w: list[float], eta: float) -> DataFrame:
    """The older step on linear weights: direction of unit absolute sum, then projection on the simplex."""
    from ..functions.columns import simplex_projection

    den = F.col("d_plus") + F.col("d_minus") + EPS_LEARNER
    g = assignment.agg(F.array(*(F.sum((F.col("dv_plus")[v] * F.col("d_minus") - F.col("dv_minus")[v] * F.col("d_plus")) / (den * den)) for v in range(len(w)))).alias("g"))
    length = F.aggregate("g", F.lit(0.0), lambda s, x: s + F.abs(x)) + 1e-12
    step = F.zip_with(weights_literal(w), F.transform("g", lambda x: x / length), lambda a, x: a - eta * x)
    return g.select(step.alias("s")).select(simplex_projection(F.col("s")).alias("w"))
