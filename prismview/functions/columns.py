"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards of the margin's denominators: in the structure tables and in the learner.
EPS_STRUCTURE, EPS_LEARNER = 1e-12, 1e-5


def margin(d_plus: Column, d_minus: Column, eps: float = EPS_STRUCTURE) -> Column:
    """Relative distance difference: negative where the own class is nearer."""
    return (d_plus - d_minus) / (d_plus + d_minus + F.lit(eps))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def hash24(*parts: Column) -> Column:
    """A number below 2 ** 24 from the first hexadecimal digits of an MD5 digest; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 6), 16, 10).cast("long")


def is_close(a: Column, b: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - F.lit(b)) <= F.lit(atol + rtol * abs(b))


def against(a: Column, constant: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(x, constant) for each element x. A lambda would compute the constant for each of them; here it is computed once."""
    return F.zip_with(a, F.array_repeat(constant, F.size(a)), f)


def l2_normalised(a: Column) -> Column:
    """a / |a|; uniform where the norm vanishes."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return against(a, F.struct(norm.alias("n"), (F.lit(1.0) / F.sqrt(F.size(a).cast("double"))).alias("u")), lambda x, c: F.when(c["n"] < 1e-12, c["u"]).otherwise(x / c["n"]))


def mixture(a: Column) -> Column:
    """Non-negative parts that add up to 1; uniform where nothing is positive."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    return against(a, F.struct(total.alias("t"), (F.lit(1.0) / F.size(a)).alias("u")), lambda x, c: F.when(c["t"] > 0, F.greatest(x, F.lit(0.0)) / c["t"]).otherwise(c["u"]))


def simplex_projection(a: Column) -> Column:
    """The nearest point of the probability simplex: subtract the threshold of the sorted prefix that stays positive."""
    down = F.reverse(F.array_sort(a))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(0.0).alias("theta"))

    def longer(z: Column, x: Column) -> Column:
        # the shift that would make a prefix of the sorted values add up to 1
        shift = (z["sum"] + x - 1) / (z["k"] + 1)
        return F.struct((z["sum"] + x).alias("sum"), (z["k"] + 1).alias("k"), F.when(x > shift, shift).otherwise(z["theta"]).alias("theta"))

    return against(a, F.aggregate(down, start, longer)["theta"], lambda x, theta: F.greatest(x - theta, F.lit(0.0)))


def entropy(a: Column) -> Column:
    """Entropy of a mixture relative to its maximum; null where nothing is positive."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x > 0, -(x / total) * F.log(x / total)).otherwise(0.0))
    return F.when(total > 0, h / F.log(F.size(a).cast("double")))


def dot(weights: Column, d: Column) -> Column:
    return F.aggregate(F.zip_with(weights, d, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)


def first_best(values: Sequence[tuple[str, Column]], smallest: bool = False) -> Column:
    """The name of the greatest (or least) value; the first name wins ties. Null values never win."""
    worst = float("inf") if smallest else float("-inf")
    best_name, best = F.lit(None).cast("string"), F.lit(worst)
    for name, value in values:
        better = (value < best) if smallest else (value > best)
        best_name, best = F.when(better, F.lit(name)).otherwise(best_name), F.when(better, value).otherwise(best)
    return best_name


def describe(c: Column | str, prefix: str) -> list[Column]:
    """count, mean, sample deviation, extremes and quartiles."""
    c = F.col(c) if isinstance(c, str) else c
    quarter = [F.percentile(c, F.lit(q)).alias(f"{prefix}_{n}") for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return [F.count(c).alias(f"{prefix}_count"), F.avg(c).alias(f"{prefix}_mean"), F.stddev_samp(c).alias(f"{prefix}_std"), F.min(c).alias(f"{prefix}_min"), *quarter, F.max(c).alias(f"{prefix}_max")]


def identity(mu: Column) -> Column:
    return mu


Squash = Callable[[Column], Column]
