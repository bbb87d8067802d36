"""Nearest neighbours where ids repeat, and where vectors have no clusters."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from prismview.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def answers(df, **kw):
    """By query_row: the query's id and its answers in order."""
    out = defaultdict(list)
    for r in ann.search(df, **kw).orderBy("query_row", "rank").collect():
        out[r["query_row"]].append((r["query_id"], r["rank"], r["vec_id"], r["score"]))
    return list(out.values())


def brute(rows, every, k):
    """The answers of each asking row, as sorted lists."""
    out = []
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            near = sorted((-float(ann.scores(np.array(v), np.array([w]))[0]), j) for m, (j, w) in enumerate(rows) if m != n)
            out.append([(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)])
    return sorted(out)


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 60) if i % 20]
    rows += [(20, [float(m)] * 8) for m in (1, 2, 3)] + [(40, [1.0] * 8)] * 2
    assert sorted(answers(spark.createDataFrame(rows, SCHEMA).repartition(3), target=1.0)) == brute(rows, 20, 20)


def test_one_id_may_hold_a_third_of_all_rows(spark, monkeypatch):
    # chunks of one list share that id's rows
    monkeypatch.setattr(ann, "CHUNK", 32)
    rng = np.random.default_rng(3)
    rows = [(20 if i % 3 == 0 else i, np.round(rng.standard_normal(6), 3).tolist()) for i in range(150)]
    got = answers(spark.createDataFrame(rows, SCHEMA).repartition(3), target=1.0)
    want = brute(rows, 20, 20)
    # of the multiples of 3 all are called 20, and 20 is no such multiple
    assert len(got) == len(want) and sum(g[0][0] == 20 for g in got) == 51
    pairs = lambda a: {(j, s) for _, _, j, s in a}
    hit = sum(max(len(pairs(a) & pairs(b)) for b in want) for a in got)
    assert hit >= 0.9 * sum(map(len, want))


def test_recall_without_clusters(spark):
    rng = np.random.default_rng(9)
    n, dims = 30_000, 48
    x = rng.standard_normal((n, dims)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}).to_pandas())
    got = answers(df, every=300)
    v, hit = x.astype(float), 0
    for a in got:
        q = a[0][0]
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({j for _, _, j, _ in a} & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == n // 300 and hit >= 0.9 * 20 * len(got)
