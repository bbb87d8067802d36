"""The learner against plain numpy, and what must hold of every fit."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismview.operators import trainer


def views(seed, m=40, n=3):
    rng = np.random.default_rng(seed)
    y = np.arange(m) % 2
    out = []
    for v in range(n):
        x = rng.standard_normal((m, 4)) + 2.0 * (n - v) * y[:, None] / n
        out.append(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)))
    return np.array(out), y


def naive_loss(fit):
    total = 0.0
    for i in range(len(fit.y)):
        a = fit.a[fit.group[i]] ** 2
        d = [(a * fit.views[:, i, p]).sum() for p in fit.protos]
        own = min(x for x, y in zip(d, fit.proto_y) if y == fit.y[i])
        other = min(x for x, y in zip(d, fit.proto_y) if y != fit.y[i])
        total += (own - other) / (own + other + 1e-5)
    return total


@pytest.mark.parametrize("by_label", [False, True])
@pytest.mark.parametrize("k", [1, 2, {0: 1, 1: 3}])
def test_best_state(by_label, k):
    v, y = views(1)
    fit = trainer.Fit(k, 20, 0.05, by_label).run(v, y)
    assert fit.loss == pytest.approx(min(h["loss"] for h in fit.history))
    assert fit.loss == pytest.approx(naive_loss(fit))
    assert np.allclose((fit.a**2).sum(1), 1)
    assert (fit.predict(v) == y).mean() > 0.8


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_scan_equals_trying_all(seed):
    v, y = views(seed, 16)
    fit = trainer.Fit(2, 0).run(v, y)
    metric = fit.metrics()
    state = fit.assign(metric)
    value = fit.value(*state[2:4])
    move = fit.first_improvement(metric, state, value)
    before = fit.protos.copy()
    for k in np.argsort(-(np.bincount(state[0], state[2], 4) - np.bincount(state[1], state[3], 4)), kind="stable"):
        deltas = {}
        for i in np.flatnonzero(state[0] == k):
            if i != before[k]:
                fit.protos = before.copy()
                fit.protos[k] = i
                deltas[int(i)] = fit.value(*fit.assign(metric)[2:4]) - value
        if deltas and min(deltas.values()) < -1e-12:
            assert move[0] == k and move[2] == pytest.approx(min(deltas.values()))
            return
    assert move is None or move[2] > -1e-9


def test_small_class_is_degenerate():
    v, y = views(2, 12)
    with pytest.raises(trainer.Degenerate):
        trainer.Fit(7, 5).run(v, y)


def test_failed_jobs_are_rows(spark):
    from prismview.operators import search

    v, y = views(3, 24)
    jobs = trainer.with_folds(search.grid(spark, [(2, 2), (30, 2)], [0.02], ("global",)), 3)
    rows = trainer.train(spark, jobs, v, y, np.arange(24) % 3 + 1, 5).collect()
    assert {(r["k0"], r["status"]) for r in rows} == {(2, "ok"), (30, "degenerate")}
    assert sum(len(r["va_idx"]) for r in rows if r["k0"] == 2) == 24


def test_neural_gas_starts(spark):
    from pyspark.sql import functions as F

    from prismview.operators import search

    v, y = views(4, 60)
    d = v.sum(0)
    members = np.flatnonzero(y == 0)
    got, tries = trainer.gas_prototypes(d, members, 4, 3, "a", 0)
    assert len(set(got)) == 4 and set(got) <= set(members.tolist()) and 0 <= tries < 8
    assert got == trainer.gas_prototypes(d, members, 4, 3, "a", 0)[0]
    # the points lie nearer to them than to points taken at random
    rng = np.random.default_rng(0)
    far = [d[np.ix_(members, rng.choice(members, 4, False))].min(1).mean() for _ in range(200)]
    assert d[np.ix_(members, got)].min(1).mean() < np.median(far)
    with pytest.raises(trainer.Degenerate):
        trainer.gas_prototypes(d, members[:3], 4)
    with pytest.raises(trainer.Degenerate):  # equal points have no distinct prototypes
        trainer.gas_prototypes(np.zeros((9, 9)), np.arange(9), 3)
    fit = trainer.Fit(2, 20, 0.05, seed=5).run(v, y)
    assert fit.loss == pytest.approx(naive_loss(fit)) and (fit.predict(v) == y).mean() > 0.8
    seeds = spark.range(3).select(search.derived_seed(F.col("id"), F.lit("v"), F.lit(1)).alias("s")).collect()
    assert [r["s"] for r in seeds] == [trainer.seed_of(i, "v", 1) for i in range(3)]


def test_weights_of_labels_as_a_job_column(spark):
    from pyspark.sql import functions as F

    from prismview.operators import search

    v, y = views(5, 30)
    jobs = search.grid(spark, [(1, 1)], [0.0], ("label",)).withColumn("v_init_per_label", F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))))
    rows = trainer.train(spark, trainer.with_folds(jobs, 2), v, y, np.arange(30) % 3 % 2 + 1, 3).collect()
    assert all(np.allclose(r["a_sq"], [[1, 0, 0], [0, 1, 0]]) and r["seconds"] > 0 for r in rows)


def test_trajectories_and_replay(spark):
    from prismview.operators import search, weights

    v, y = views(6, 36)
    folds = np.arange(36) // 2 % 3 + 1
    jobs = trainer.with_folds(search.grid(spark, [(2, 2)], [0.05]), 3)
    snaps = trainer.trajectories(spark, jobs, v, y, folds, 10, tail=5).persist()
    rows = snaps.collect()
    runs = {(r["config_key"], r["fold"]) for r in rows}
    assert len(runs) == 6
    for run in runs:
        own = sorted((r for r in rows if (r["config_key"], r["fold"]) == run), key=lambda r: r["snapshot"])
        fit, tail = [r for r in own if r["step"] != "tail"], [r for r in own if r["step"] == "tail"]
        assert [r["snapshot"] for r in own] == list(range(len(own))) and len(tail) == 6
        assert tail[0]["loss"] == pytest.approx(min(r["loss"] for r in fit)) and len({tuple(r["protos"]) for r in tail}) == 1
        assert all(np.allclose(np.sum(r["a_sq"], axis=1), 1) for r in own)
    last = weights.at_checkpoints(snaps.where("step <> 'tail'"), [0, 3, 10**6], "config_key", "fold")
    assert last.count() == 18
    top = {(r["config_key"], r["fold"]): r["snapshot"] for r in last.where("checkpoint = 1000000").collect()}
    assert all(top[run] == max(r["snapshot"] for r in rows if (r["config_key"], r["fold"]) == run and r["step"] != "tail") for run in runs)
    drift = weights.drift(last, "config_key", "fold").collect()
    assert all((r["weight_drift"] is None) == (r["checkpoint"] == 0) and 0 <= r["entropy"] <= 1 for r in drift)
    assert {r["scope"] for r in weights.scopes(last, "config_key", "fold").collect()} == {"global", "label0", "label1"}
    # what a state predicts, in relational form, against what the trainer measured
    points = spark.createDataFrame([(str(i), i, int(y[i])) for i in range(36)], "id string, pos long, y int")
    wide = spark.createDataFrame([(str(i), i, int(y[i]), j, [float(x) for x in v[:, i, j]]) for i in range(36) for j in range(36)], "i string, pi long, yi int, pj long, d array<double>")
    told = {(r["config_key"], r["fold"], r["checkpoint"], r["i"]): r["y_pred"] for r in weights.replayed(last, wide, points, "config_key", "fold").collect()}
    for r in last.collect():
        va = np.flatnonzero(folds == r["fold"])
        predicted = np.array([told[r["config_key"], r["fold"], r["checkpoint"], str(i)] for i in va])
        assert trainer.balanced(y[va], predicted) == pytest.approx((r["val_bal_acc"], r["val_recall"]))


def test_search_resumes(spark, tmp_path, monkeypatch):
    from prismview.operators import search

    v, y = views(7, 30)
    folds = np.arange(30) // 2 % 3 + 1
    path = str(tmp_path / "store")
    first = search.grid(spark, [(1, 1)], [0.02], ("global",))
    search.evaluate(spark, first, v, y, folds, 4, path).collect()
    fitted = []
    train = trainer.train
    monkeypatch.setattr(trainer, "train", lambda spark, jobs, *a: fitted.append({(r["config_key"], r["fold"]) for r in jobs.collect()}) or train(spark, jobs, *a))
    both = search.grid(spark, [(1, 1), (2, 2)], [0.02], ("global",))
    got = {r["config_key"]: r for r in search.evaluate(spark, both, v, y, folds, 4, path).collect()}
    assert len(got) == 2 and all(r["seconds"] > 0 for r in got.values())
    (done,) = fitted
    assert {k for k, _ in done} == set(got) - {r["config_key"] for r in first.collect()} and len(done) == 3
    search.evaluate(spark, both, v, y, folds, 4, path).collect()
    assert len(fitted) == 1
    plain = {r["config_key"]: r["bal_acc"] for r in search.evaluate(spark, both, v, y, folds, 4).collect()}
    assert plain == {k: r["bal_acc"] for k, r in got.items()}
    staged = search.staged(spark, v, y, folds, [(1, 1), (2, 2)], [0.02, 0.05], (2, 3, 4), 1, str(tmp_path / "staged")).collect()
    assert {r["stage"] for r in staged} == {1, 2, 3} and sum(r["stage"] == 3 for r in staged) == 2


def test_clusters_of_profiles(spark):
    from prismview.operators import weights

    rng = np.random.default_rng(3)
    rows = [(f"c{c}{i}", 1, *(np.eye(3)[c] * 0.9 + 0.1 / 3 + rng.uniform(-0.01, 0.01, 3)).tolist()) for c, n in ((0, 20), (1, 15), (2, 10)) for i in range(n)]
    wide = spark.createDataFrame(rows, "config_key string, fold int, w_a double, w_b double, w_c double")
    cores = [(r["size"], r["dominant"]) for r in weights.cluster_cores(weights.cluster_profiles(wide, ("a", "b", "c"), 3), ("a", "b", "c")).collect()]
    assert cores == [(20, "a"), (15, "b"), (10, "c")]
