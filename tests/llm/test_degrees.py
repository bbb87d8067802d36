"""Verdicts at tables of any size, and components around nodes with very many links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismview.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def english(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").join(labels.select("doc_id"), "doc_id").orderBy("doc_id").collect()
    return [r["text"] for r in rows if len(r["text"].split()) >= 60]


@pytest.fixture(scope="module")
def junk():
    rng = random.Random(5)
    return " ".join("".join(rng.choice("{}[]=/@~^+_ab") for _ in range(7)) for _ in range(80))


@pytest.mark.parametrize("n", [5, 19, 20, 21])
def test_the_number_of_documents_switches_nothing(spark, junk, n):
    texts = english(spark)[: n - 1]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(-1, junk, "en")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(rows) == n
    assert got.pop(-1) == (False, False)
    assert all(base or kept for base, kept in got.values())


def test_small_languages_weigh_little(spark):
    texts = english(spark)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, t, f"l{n}") for n in (1, 19, 20) for i, t in enumerate(texts[:n])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(df)
    assert [refs[f"l{n}"].weight for n in (1, 19, 20)] == [pytest.approx(n / (n + quality.PRIOR)) for n in (1, 19, 20)]
    gap = [np.abs(refs[f"l{n}"].chars - refs[quality.ANY].chars).max() for n in (1, 19, 20)]
    assert max(gap) < 0.05 and abs(gap[1] - gap[2]) < 0.02


def test_one_text_alone_is_like_itself(spark, junk):
    got = quality.score(spark.createDataFrame([(1, junk, None)], "doc_id long, text string, lang string")).collect()
    assert [r["kept"] for r in got] == [True] and got[0]["char_distance"] < 0.05


@pytest.fixture
def sixteen(spark):
    """So many partitions, none joined for being small."""
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hub_is_split(spark, sixteen):
    n = 100_000
    links = spark.range(n).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = [r["count"] for r in simhash.with_least(edges).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == n and len(parts) > sixteen / 2 and max(parts) < 3 * n / sixteen
    got = simhash.components(links)
    assert got.count() == n + 1 and [r["root"] for r in got.select("root").distinct().collect()] == [-1]


def test_components_of_random_links(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, k) for k in range(300, 340)]
    root = list(range(340))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
