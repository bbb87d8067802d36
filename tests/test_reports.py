"""Whole runs on a synthetic bundle with planted structure."""

import numpy as np

from prismview.operators import evaluation, normalize, trainer
from prismview.plans import reports
from prismview.sources import matrices


def test_runs(spark, tmp_path):
    b = matrices.synthetic_bundle(spark, 40, 2)
    raw, points = b.raw.persist(), b.points.persist()
    out = reports.structural(raw, points, b.views, str(tmp_path / "s"), 5, 3)
    purity = {r["view"]: r["purity_mean"] for r in out["summary"].collect()}
    assert purity["wide"] > purity["narrow"]
    base = {r["view"]: r for r in out["purity_baseline"].collect()}
    assert base["wide"]["purity_mean"] > base["wide"]["baseline_mean"]
    again = reports.written(spark, str(tmp_path / "s"), {"summary": lambda: 1 / 0})  # what is there isn't made again
    assert again["summary"].count() == 3

    wide = normalize.stacked(b.normalized, b.views)
    views, y = trainer.tensor(wide, points)
    folds = np.array([r["fold"] for r in evaluation.stratified_folds(points, 3).orderBy("pos").select("fold").collect()])
    best = {r["view"]: r for r in reports.single_views(spark, views, y, folds, b.views, [(1, 1), (2, 2)], 10).collect()}
    assert best["wide"]["balanced_accuracy"] >= 0.7 and set(best) == set(b.views)
    fixed = reports.fixed_profiles(spark, {"uniform": [1 / 3] * 3}, views, y, folds, 2, 2, 5)
    assert fixed.count() == 40
    winners = spark.createDataFrame([("global", 2, 2, 0.02), ("label", 2, 2, 0.02)], "model string, k0 int, k1 int, eta double")
    rates = reports.repeated(spark, winners, points, views, y, [1, 2], 3, 5).collect()
    assert len(rates) == 40 and all(r["n_valid"] == 4 for r in rates)
    assert np.mean([r["correct_rate"] for r in rates]) > 0.7

    names = spark.createDataFrame([(r["view"], "y") for r in best.values()], "view string, u string")
    predictions = points.crossJoin(names.select("view")).select("view", "id", points.y.alias("y_true"), points.y.alias("y_pred")).selectExpr("*", "1 as correct")
    tables = reports.pointwise(out["points"], predictions, b.views, str(tmp_path / "p"))
    assert [r["dominance"] for r in tables["dominance"].collect()] == ["+".join(sorted(b.views))]


def test_sidecar(spark):
    oof = spark.createDataFrame([("r", 1), ("r", 2)], "run string, id int")
    side = spark.createDataFrame([("r", 2, 9), ("r", 1, 5)], "run string, fold int, k0 int")
    assert {r["k0"] for r in reports.with_sidecar(oof, side, "run", "k0").collect()} == {5}
