"""Fits over stored columns against fits in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismview.operators import blocks, evaluation, search, trainer
from prismview.session import shared_path
from prismview.sources import store

from .test_learner import views


def stored(spark, v, y, gap=3):
    """Blocks of views (V, m, m); points stand at multiples of gap."""
    m = len(y)
    cells = [(gap * i, gap * j, v[:, i, j].tolist()) for i in range(m) for j in range(m) if i != j]
    points = spark.createDataFrame([(gap * i, int(c)) for i, c in enumerate(y)], "pos long, y int")
    return blocks.write(spark.createDataFrame(cells, "pi long, pj long, d array<double>"), points, shared_path(spark, "blocks"))


def plain(rows, *less):
    names = [c for c in rows.columns if c not in ("seconds", *less)]
    return sorted((tuple(np.round(np.array(x, float), 9).tolist() if c == "a_sq" else round(x, 7) if isinstance(x, float) else x for c, x in ((c, r[c]) for c in names)) for r in rows.collect()), key=str)


@pytest.mark.parametrize("model", ["global", "label"])
def test_results_equal_those_in_memory(spark, model):
    v, y = views(7, 40)
    folds, b = np.arange(40) % 3 + 1, stored(spark, v, y)
    jobs = trainer.with_folds(search.grid(spark, [(2, 2), (3, 1), (30, 2)], [0.05], (model,)), 3)
    got, want = blocks.train(b, jobs, folds, 25), trainer.train(spark, jobs, v, y, folds, 25)
    assert plain(got) == plain(want)
    assert {r["status"] for r in got.collect()} == {"ok", "degenerate"}


def test_trajectories_and_tails_equal_those_in_memory(spark):
    v, y = views(8, 30)
    folds, b = np.arange(30) // 2 % 2 + 1, stored(spark, v, y)
    jobs = trainer.with_folds(search.grid(spark, [(2, 2), (20, 1)], [0.05]), 2)
    assert plain(blocks.trajectories(b, jobs, folds, 10, tail=4)) == plain(trainer.trajectories(spark, jobs, v, y, folds, 10, tail=4))


def test_gas_starts_equal_those_in_memory(spark):
    v, y = views(9, 30)
    folds, b = np.arange(30) // 2 % 2 + 1, stored(spark, v, y)
    jobs = trainer.with_folds(search.grid(spark, [(2, 2)], [0.05], ("global",)), 2).withColumn("seed", F.lit(11).cast("long"))
    got, want = blocks.train(b, jobs, folds, 5), trainer.train(spark, jobs, v, y, folds, 5)
    assert plain(got) == plain(want) and {r["status"] for r in got.collect()} == {"ok"}


def test_columns_are_those_of_the_matrices(spark):
    v, y = views(10, 20)
    b = stored(spark, v, y)
    for j, column in b.columns(np.arange(20)).items():
        assert (column == v[:, :, j]).all()


def collapsing(seeds=range(40)):
    """Views and a seed whose neural gas collapses first and is rescued by a later attempt."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for s in seeds:
        try:
            if trainer.gas_prototypes(d, np.arange(12), 6, s, "all", 0)[1]:
                return d, s
        except trainer.Degenerate:
            continue
    raise AssertionError("no seed collapses")


def test_rescued_starts_are_logged(spark, tmp_path):
    d, seed = collapsing()
    far = np.full((12, 12), 9.0)
    v = np.block([[d, far], [far, d + 0.0]])[None]
    y = np.repeat([0, 1], 12)
    jobs = search.grid(spark, [(6, 1)], [0.05], ("global",)).withColumn("seed", F.lit(seed).cast("long"))
    # a fold without points, so that all of them train
    path = str(tmp_path / "runs")
    out = search.trained(spark, jobs, v, y, np.full(24, 2), 3, path, n_splits=1)
    assert [r["status"] for r in out.collect()] == ["ok"]
    (row,) = store.read_log(spark, search.rescue_log(path)).collect()
    assert (row["label"], row["k"], row["base_seed"], row["canonical_failed"], row["n_class_points"]) == ("0", 6, seed, True, 12)
    assert row["rescued_attempt"] >= 1


def test_a_killed_run_keeps_its_waves(spark, tmp_path, monkeypatch):
    v, y = views(3, 24)
    jobs, folds, path = search.grid(spark, [(1, 1), (2, 1), (1, 2), (2, 2)], [0.02], ("global",)), np.arange(24) // 2 % 2 + 1, str(tmp_path / "runs")
    append, waves, told = store.append, [], []

    def killed(rows, where):
        if len(waves) == 1:
            raise KeyboardInterrupt
        append(rows, where)
        waves.append(spark.read.parquet(where).count())

    monkeypatch.setattr(store, "append", killed)
    with pytest.raises(KeyboardInterrupt):
        search.trained(spark, jobs, v, y, folds, 5, path, wave=3)
    assert waves == [3]
    monkeypatch.setattr(store, "append", append)
    real, fitted = trainer.train, []
    monkeypatch.setattr(trainer, "train", lambda s, todo, *a: fitted.append(todo.count()) or real(s, todo, *a))
    out = search.trained(spark, jobs, v, y, folds, 5, path, wave=3, progress=lambda done, of, seconds, left: told.append((done, of, left >= 0)))
    assert out.count() == 8 and fitted == [3, 2]
    assert told == [(3, 5, True), (5, 5, True)]


def test_three_labels(spark):
    v, _ = views(12, 45)
    y = np.arange(45) % 3
    folds = np.arange(45) // 3 % 3 + 1
    jobs = trainer.with_folds(search.grid(spark, [(2, 2)], [0.05]), 3).withColumn("k", F.array(F.lit(2), F.lit(1), F.lit(3)))
    got = blocks.train(stored(spark, v, y), jobs, folds, 10)
    assert plain(got) == plain(trainer.train(spark, jobs, v, y, folds, 10))
    assert {(r["status"], len(r["protos"])) for r in got.collect()} == {("ok", 6)}
    wrong = jobs.withColumn("k", F.array(F.lit(2), F.lit(1)))
    assert {r["status"] for r in blocks.train(stored(spark, v, y), wrong, folds, 10).collect()} == {"failed"}


def test_label_metrics_with_labels_only_predicted(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 7), (2, 2)]
    counts = evaluation.label_confusion(spark.createDataFrame(rows, "y_true int, y_pred int"))
    assert sorted(map(tuple, counts.collect())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2), (1, 7, 1), (2, 2, 1)]
    r = evaluation.label_metrics(counts).first()
    assert r["acc"] == pytest.approx(4 / 6) and r["bal_acc"] == pytest.approx((1 / 2 + 2 / 3 + 1) / 3)
    assert r["f1_macro"] == pytest.approx((2 / 3 + 4 / 6 + 1 + 0) / 4)


def test_infeasible_jobs_go(spark):
    points = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "pos long, y int")
    jobs = search.grid(spark, [(2, 3), (7, 3), (8, 3), (2, 4)], [0.1], ("global",))
    assert {(r["k0"], r["k1"]) for r in search.feasible(jobs, points).collect()} == {(2, 3), (7, 3)}
    assert search.feasible(jobs, points.where("y = 2")).count() == 0
