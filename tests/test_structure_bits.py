"""The permutation baseline with labels as bits, against the same sums one permutation after the other."""

import numpy as np
import pytest

from prismview.operators import structure


@pytest.mark.parametrize(("classes", "n_perm"), [(2, 5), (3, 70), (5, 64)])
def test_baseline_equals_single_permutations(spark, classes, n_perm):
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 6, (25, 3))
    ids, y = [f"p{i}" for i in range(25)], rng.integers(0, classes, 25)
    y[:classes] = range(classes)
    cells = [("v", ids[i], ids[j], i, j, int(y[i]), int(y[j]), float(abs(x[i] - x[j]).sum())) for i in range(25) for j in range(25) if i != j]
    pairs = spark.createDataFrame(cells, "view string, i string, j string, pi long, pj long, yi int, yj int, d double")
    points = spark.createDataFrame([(ids[i], i, int(y[i])) for i in range(25)], "id string, pos long, y int")
    weights = {(r["i"], r["j"]): r["w"] for r in structure.neighbour_weights(pairs, 4).collect()}
    labels = {(r["perm"], r["id"]): r["y"] for r in structure.permuted_labels(points, n_perm).collect()}
    runs = [sum(w for (i, j), w in weights.items() if labels[p, i] == labels[p, j]) / (4 * 25) for p in range(n_perm)]
    (r,) = structure.purity_baseline(pairs, points, 4, n_perm).collect()
    assert (r["baseline_mean"], r["baseline_std"]) == (pytest.approx(np.mean(runs)), pytest.approx(np.std(runs)))
    plan = structure.purity_baseline(pairs, points, 4, n_perm)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of the sums, not of pairs
