"""Exact dedup against brute force: the index over several batches, hot groups, killed runs and edge cases."""

import hashlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from prismview.llm import common, exactdedup

from .test_operators import documents, empty, odd_documents

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def sha(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def brute(rows):
    """rows of (doc_id, text) -> the report's rows, of rows equal in both one kept."""
    least = -(1 << 63)
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    out = []
    for h, ids in groups.items():
        best = max(ids, key=lambda i: least if i is None else i)
        at = ids.index(best)
        out += [(i, best, len(ids), k == at, h) for k, i in enumerate(ids)]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("share", [1, exactdedup.MOST_HOT])
def test_report(spark, monkeypatch, share):
    monkeypatch.setattr(exactdedup, "MOST_HOT", share)
    docs = documents(spark).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, "STRASSE ÄÖ İ") for i in range(300)] + [(None, "straSSe ÄÖ İ"), (7, "strasse äö İ")], "doc_id long, text string"))
    assert got(exactdedup.dedup(docs)) == brute([tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert exactdedup.dedup(empty(spark)).collect() == []


def test_batches_meet_the_index(spark):
    path = common.shared_path(spark, "index")
    index = exactdedup.Index.at(spark, path, 3)
    batches = {"one": [(1, "a"), (2, "A"), (3, "b")], "two": [(9, "a"), (8, "c"), (7, "c"), (None, "b"), (None, "d")], "three": [(0, "C"), (1, "e"), (1, "e")]}
    want = {"one": {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}}
    for name, rows in batches.items():
        index.add(spark.createDataFrame(rows, "doc_id long, text string"), name)
        if name in want:
            assert {tuple(r)[:4] for r in index.report(name).collect()} == want[name]
    # sizes grow with later batches, what stays does not change
    assert {tuple(r)[:4] for r in index.report("one").collect()} == {(1, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True)}
    assert {tuple(r)[:4] for r in index.report("two").collect()} == {(9, 2, 3, False), (8, 8, 3, True), (7, 8, 3, False), (None, 3, 2, False), (None, None, 1, True)}
    assert sorted(tuple(r)[:4] for r in index.report("three").collect()) == [(0, 8, 3, False), (1, 1, 2, False), (1, 1, 2, True)]


def test_added_twice_and_killed_between(spark):
    path, docs = common.shared_path(spark, "index"), documents(spark)
    index = exactdedup.Index.at(spark, path)
    index.add(docs.where("doc_id % 2 = 0"), "even")
    whole, append = got(index.report("even")), exactdedup.Index.append
    index.add(docs.where("doc_id % 2 = 0"), "even")
    assert got(index.report("even")) == whole

    def killed(self, rows, table):
        if table == "texts":
            raise KeyboardInterrupt
        append(self, rows, table)

    exactdedup.Index.append = killed
    try:
        with pytest.raises(KeyboardInterrupt):
            index.add(docs.where("doc_id % 2 = 1"), "odd")
    finally:
        exactdedup.Index.append = append
    # another session knows the folder only
    for t in ("seen", "texts"):
        spark.sql(f"DROP TABLE {index.name(t)}")
    index = exactdedup.Index.at(spark, path, 99)
    assert index.buckets == common.partitions(spark)
    index.add(docs.where("doc_id % 2 = 1"), "odd")
    both = got(index.report("even")) + got(index.report("odd"))
    assert sum(both.values()) == docs.count()
    assert sum(n for r, n in both.items() if r[3]) == len({sha(r.text) for r in docs.collect()})


@pytest.mark.parametrize("share", [1, exactdedup.MOST_HOT])
def test_what_stays_keeps_its_columns(spark, monkeypatch, share):
    monkeypatch.setattr(exactdedup, "MOST_HOT", share)
    index = exactdedup.Index.at(spark, common.shared_path(spark, "index"))
    first = spark.createDataFrame([(1, "Known", "x", 1)], "doc_id long, text string, _digest string, keep_id int")
    index.add(first, "first")
    docs = spark.createDataFrame([(5, "known", "y", 1), (6, "new", "y", 2), (7, "New", "z", 3), (7, "New", "z", 3), (None, None, "n", 4), (None, "", "n", 4)], first.schema)
    index.add(docs, "second")
    out = index.without_copies(docs, "second")
    assert out.columns == docs.columns
    rows = sorted(out.select("doc_id", F.coalesce("text", F.lit("")), "_digest", "keep_id").collect(), key=str)
    assert [tuple(r) for r in rows] == [(7, "New", "z", 3), (None, "", "n", 4)]


def test_the_anti_join_shuffles_nothing(spark):
    index = exactdedup.Index.at(spark, common.shared_path(spark, "index"))
    index.add(documents(spark), "all")
    new = index.table("seen").where("batch = 'all.0'").join(index.table("texts").hint("merge"), "digest", "left_anti")
    for df in (new, index.groups()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
