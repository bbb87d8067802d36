"""Collocations against brute force: hot prefixes, ties, edge cases."""

import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismview.llm import collocations as co

from .test_operators import documents, empty, odd_documents

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def brute(rows, least, top=co.TOP, within=100):
    """rows of (lang, text) -> the rows of collocations()."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            counts.setdefault(lang or "und", Counter()).update(tuple(ws[i : i + m]) for m in range(1, 6) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(k for p, k in f.items() if len(p) == 1)
        found = {p: k for p, k in f.items() if len(p) > 1 and k >= least}
        longer = Counter()
        for p, k in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], k)
        scored = []
        for p, a in found.items():
            if p in longer and 100 * longer[p] >= within * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_documents(spark):
    docs = documents(spark).select("lang", "text").unionByName(odd_documents(spark).select("lang", "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert got(co.collocations(docs, least=20)) == brute(rows, 20)
    assert got(co.collocations(docs.repartition(6), least=20, top=7, within=80)) == brute(rows, 20, 7, 80)


@pytest.mark.parametrize("share", [2, 60, 10**6])
def test_hot_prefixes(spark, monkeypatch, share):
    monkeypatch.setattr(co, "SHARE", (share, share))
    rng = random.Random(5)
    passage = "the same long passage of many words"
    texts = [" ".join(rng.choices(["a", "b", "the", "same", "A", "x."], k=30)) + f" {passage} " + rng.choice(["end", "END", "stop"]) for _ in range(300)] + ["a a a a a a a a"] * 40
    rows = [(rng.choice(["en", None, "und"]), t) for t in texts]
    assert got(co.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), least=30)) == brute(rows, 30)


def test_ties_go_by_phrase(spark):
    rows = [("en", "z a! a z? ￿ \U0001f642; \U0001f642 ￿")] * 5
    want = brute(rows, 5)
    assert got(co.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)) == want
    assert len({r[7] for r in want}) == 1 and [r[2] for r in want] == ["a z", "z a", "￿ \U0001f642", "\U0001f642 ￿"]


def test_exact_beyond_64_bits(spark):
    a, n = 3 * 10**12 + 7, 10**14 + 3
    row = spark.range(1).select(F.expr(f"(1000BD * cast({a}L as decimal(38,0)) * cast({n}L as decimal(38,0))) div (cast({a}L as decimal(38,0)) * cast({a + 5}L as decimal(38,0)))").alias("x")).first()
    assert row.x == 1000 * a * n // (a * (a + 5))


def test_a_collision_takes_another_seed(spark, monkeypatch):
    rows = [("en", "one two three. one two")] * 10
    docs, real, seeds = spark.createDataFrame(rows, "lang string, text string"), co.word_counts, []

    def counts(texts, seed):
        seeds.append(seed)
        if seed < 2:
            raise co.Collision(seed)
        return real(texts, seed)

    monkeypatch.setattr(co, "word_counts", counts)
    assert got(co.collocations(docs, least=10)) == brute(rows, 10)
    assert seeds == [0, 1, 2]
    frame = [("en", 1, "a"), ("fr", 1, "b"), ("en", 2, "c")]
    assert not co.collided(spark.createDataFrame(frame, "lang string, h long, word string"))
    assert co.collided(spark.createDataFrame([*frame, ("en", 2, "d")], "lang string, h long, word string"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 2), st.integers(0, 1)), min_size=1, max_size=60))
def test_rows_are_summed_exactly(rows):
    cols = [np.array(c) for c in zip(*rows, strict=True)]
    first, n = co.summed(cols)
    assert Counter({rows[i]: k for i, k in zip(first.tolist(), n.tolist(), strict=True)}) == Counter(rows)


def test_long_and_empty(spark):
    assert co.collocations(empty(spark)).collect() == []
    rows = [("en", "alpha beta gamma " * 100_000), ("en", None), (None, "")]
    assert got(co.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows, 100)
