"""Edge cases of the operators: ties, zero distances, constant views, missing ids, one-class folds, empty tables."""

import pytest
from pyspark.sql import functions as F

from prismview.operators import alignment, analysis, crossview, evaluation, normalize, structure, weights
from prismview.sources import matrices, store

LONG = "view string, i string, j string, pi long, pj long, yi int, yj int, d double"


def pairs(spark, dist, labels, view="a"):
    n = len(labels)
    return spark.createDataFrame([(view, str(i), str(j), i, j, labels[i], labels[j], float(dist(i, j))) for i in range(n) for j in range(n) if i != j], LONG)


def test_constant_view_normalises_to_zero(spark):
    p = pairs(spark, lambda i, j: 3.0, [0, 1, 0, 1])
    assert {r["d"] for r in normalize.robust(p).collect()} == {0.0}


def test_ties_at_the_kth_distance_share_the_rest(spark):
    p = pairs(spark, lambda i, j: 1.0, [0, 0, 0, 1, 1])
    got = {r["i"]: r["knn_purity"] for r in structure.knn_purity(p, 2).collect()}
    assert got["0"] == pytest.approx(0.5) and got["3"] == pytest.approx(0.25)
    sums = structure.neighbour_weights(p, 2).groupBy("i").agg(F.sum("w").alias("w")).collect()
    assert all(r["w"] == pytest.approx(2) for r in sums)


def test_zero_distances_fall_back(spark):
    p = pairs(spark, lambda i, j: 0.0 if {i, j} == {0, 1} else 2.0, [0, 0, 1])
    row = {r["i"]: r for r in structure.margins(p, True).collect()}
    assert row["0"]["d_plus"] == 0.0 and row["0"]["d_minus"] == 2.0 and row["2"]["d_plus"] is None
    zero = structure.zero_distances(p).first()
    assert zero["frac_any"] == pytest.approx(2 / 3) and zero["zero_rate"] == pytest.approx(1 / 3)


def test_missing_and_duplicate_cells(spark):
    p = pairs(spark, lambda i, j: i + j, [0, 1, 0])
    alignment.check(p)
    with pytest.raises(ValueError):
        alignment.check(p.where("not (i = '0' and j = '1')"))
    with pytest.raises(ValueError):
        alignment.check(p.unionByName(p.limit(1)))
    points = spark.createDataFrame([("0", 0, 0), ("7", 1, 1)], "id string, pos long, y int")
    assert [r["id"] for r in alignment.missing_ids(p, points).collect()] == ["7"]
    with pytest.raises(ValueError):
        alignment.check_target(points.unionByName(points))


def test_one_class_fold(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0)], "y_true int, y_pred int")
    m = evaluation.metrics(evaluation.confusion(rows)).first()
    assert m["balanced_accuracy"] == 0.25 and m["bal_acc"] == 0.5 and m["mcc"] == 0.0


def test_quantile_out_of_range(spark):
    with pytest.raises(ValueError):
        crossview.thresholds(pairs(spark, lambda i, j: 1.0, [0, 1]), 1.0)


def test_too_few_values_for_bins(spark):
    rows = spark.createDataFrame([("a", "1", 0.5, 0.1, 1.0, 1), ("a", "2", 0.5, 0.2, 1.0, 0)], "view string, id string, knn_purity double, mu double, knn_mean double, correct int")
    assert analysis.error_by_quantile(rows, "mu").count() == 0


def test_null_correctness_counts_as_wrong(spark):
    w = spark.createDataFrame([("1", 1, None), ("2", 1, 1), ("3", 0, None)], "id string, correct_a int, correct_b int")
    assert {r["dominance"]: r["n"] for r in analysis.dominance_groups(w, ("a", "b")).collect()} == {"a": 1, "a+b": 1, "none": 1}


def test_store_takes_the_latest_and_resumes(spark, tmp_path):
    schema = "config_key string, model string, fold int, version int, status string"
    path = str(tmp_path / "store")
    store.append(spark.createDataFrame([("c", "global", 1, 1, "failed")], schema), path)
    store.append(spark.createDataFrame([("c", "global", 1, 2, "ok")], schema), path)
    assert [r["status"] for r in store.load(spark, path, "c").collect()] == ["ok"]
    jobs = spark.createDataFrame([("c", 1), ("c", 2)], "config_key string, fold int")
    assert [r["fold"] for r in store.pending(jobs, store.load(spark, path)).collect()] == [2]


def test_stream_takes_each_file_once(spark, tmp_path):
    from prismview.streaming import fold_stream

    schema = "config_key string, model string, fold int, version int, status string"
    inbox, path, check = (str(tmp_path / x) for x in ("inbox", "store", "check"))
    for n in (1, 2):
        spark.createDataFrame([("c", "global", n, 1, "ok")], schema).write.mode("append").parquet(inbox)
        fold_stream.take_in(fold_stream.arriving(spark, inbox, schema), path, check).awaitTermination()
        assert spark.read.parquet(path).count() == n


def test_log_and_stamp(spark, tmp_path):
    assert store.read_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "log.jsonl").write_text('{"label": "0", "k": 3}\nnot json\n')
    assert store.read_log(spark, str(tmp_path / "log.jsonl")).count() == 1
    meta = spark.createDataFrame([("code", "1")], "key string, value string")
    assert store.stamp_differences(meta, {"code": "1"}).count() == 0
    assert store.stamp_differences(meta, {"code": "2", "data": "x"}).count() == 2


def test_bundles(spark):
    b = matrices.synthetic_bundle(spark, 30, 1)
    assert b.points.count() == 30 and b.normalized.where("d < 0 or d > 1").count() == 0
    assert matrices.subsample(b.points, 7).count() == 7
    assert matrices.subsample(b.points, 7).exceptAll(matrices.subsample(b.points.repartition(3), 7)).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LONG)
    assert structure.point_table(empty, 3).count() == 0
    assert normalize.robust(empty).count() == 0
    assert crossview.overlap_means(empty, 3).count() == 0
    assert weights.shares(spark.createDataFrame([], "a int, b int"), ["a"], "b").count() == 0


def test_folder_of_views(spark, tmp_path):
    cells = [(str(i), str(j), float(i + j)) for i in range(12) for j in range(12) if i != j]
    for name in ("place", "spend"):
        spark.createDataFrame(cells, "i string, j string, d double").write.parquet(str(tmp_path / "v" / f"dissimilarity_{name}_1.parquet"))
    spark.createDataFrame([(str(i), i % 2, "x") for i in range(11, -1, -1)], "code string, churn int, more string").write.parquet(str(tmp_path / "target"))
    b = matrices.load_aligned(spark, str(tmp_path / "v"), ("place", "spend"), str(tmp_path / "target"), "code", "churn")
    assert {r["view"]: r["count"] for r in b.raw.groupBy("view").count().collect()} == {"place": 132, "spend": 132}
    assert [r["id"] for r in b.points.orderBy("pos").collect()] == sorted(map(str, range(12)))
    with pytest.raises(ValueError):
        matrices.view_paths(spark, str(tmp_path / "v"), ("place", "products"))
    spark.createDataFrame(cells, "i string, j string, d double").write.parquet(str(tmp_path / "v" / "dissimilarity_place_2.parquet"))
    with pytest.raises(ValueError):
        matrices.view_paths(spark, str(tmp_path / "v"), ("place", "spend"))


def test_folders_of_results(spark, tmp_path):
    for name, extra in (("a b", ""), ("c", ", 1 as more")):
        spark.sql(f"select 1 as x{extra}").write.parquet(str(tmp_path / "r" / name))
    assert {(r["view"], r["more"]) for r in matrices.read_by_view(spark, str(tmp_path / "r")).collect()} == {("a b", None), ("c", 1)}
    parts = [str(tmp_path / "r" / n) for n in ("a b", "c")]
    assert matrices.read_preferred(spark, str(tmp_path / "whole"), parts).count() == 2
    spark.range(5).write.parquet(str(tmp_path / "whole"))
    assert matrices.read_preferred(spark, str(tmp_path / "whole"), parts).count() == 5


def test_parts_are_written_once(spark, tmp_path):
    schema = "model string, k0 int, k1 int, eta double, x int"
    path = str(tmp_path / "parts")
    store.write_part(spark.createDataFrame([("g", 2, 2, 0.02, 1)], schema), path)
    store.write_part(spark.createDataFrame([("g", 2, 2, 0.02, 9), ("g", 2, 2, 0.05, 2)], schema), path)
    assert sorted((r["eta"], r["x"]) for r in store.read_parts(spark, path).collect()) == [(0.02, 1), (0.05, 2)]
    log = str(tmp_path / "log")
    for n in range(2):
        store.append_log(spark.createDataFrame([("0", "v", n, 1, True, 2, 7)], store.RESCUE), log)
    assert sorted(r["k"] for r in store.read_log(spark, log).collect()) == [0, 1]
    tie = spark.createDataFrame([("c", 1, 1, "a"), ("c", 1, 1, "b")], "config_key string, fold int, version int, status string")
    assert store.latest(tie).collect() == store.latest(tie.orderBy(F.desc("status")).repartition(3)).collect()


def test_ranks_and_percentiles(spark):
    import numpy as np

    from prismview.operators import ranks

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 400)] + [("b", float(x)) for x in rng.standard_normal(301)] + [("c", 4.0), ("a", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = (0.0, 0.05, 0.33, 0.5, 0.95, 1.0)
    got = {r["g"]: r["q"] for r in ranks.percentiles(ranks.value_counts(df, "g", "x"), "g", "x", shares).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], shares).tolist())
    numbered = [r["n"] for r in ranks.row_numbers(df.where("g = 'b'"), "g", F.col("x")).orderBy("x").collect()]
    assert numbered == list(range(1, 302))
    assert ranks.percentiles(ranks.value_counts(df.limit(0), "g", "x"), "g", "x", shares).count() == 0


def test_too_many_points_are_refused(spark):
    from prismview.sources import fixtures

    with pytest.raises(ValueError):
        fixtures.wide_pairs(spark.range(5).withColumnRenamed("id", "pos"), 4)


def test_alignment_takes_the_least_margin(spark):
    w = spark.createDataFrame([("1", -0.5, 0.1, 1, 0), ("2", 0.2, -0.1, 1, 0)], "id string, mu_a double, mu_b double, correct_a int, correct_b int")
    assert {r["best"]: r["best_correct"] for r in analysis.structure_alignment(w, ("a", "b"), "mu").collect()} == {"a": 1.0, "b": 0.0}


def test_labels_and_grids(spark):
    from pyspark.sql import Row

    from prismview.operators import search

    points = spark.createDataFrame([("a", 1), ("b", None)], "id string, y int")
    ids = spark.createDataFrame([("a",)], "id string")
    assert alignment.labels_of(ids, points).collect() == [Row(id="a", y=1)]
    with pytest.raises(ValueError):
        alignment.labels_of(points.select("id"), points)
    grid = search.single_grid(spark, ("a", "b"), [(1, 1), (2, 3)]).collect()
    assert {(r["profile"], r["k0"], r["k1"], tuple(r["v_init"])) for r in grid} == {(v, *k, w) for v, w in (("a", (1.0, 0.0)), ("b", (0.0, 1.0))) for k in ((1, 1), (2, 3))}
    assert len({r["config_key"] for r in grid}) == 4
