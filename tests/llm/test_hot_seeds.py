"""Line dedup where one phrase is the seed of very many different windows."""

import random
from collections import Counter

import numpy as np
import pytest
from prismview.llm import linededup

from .test_operators import left_brute

PHRASES = 4000


def least_phrase():
    """Of many phrases of SEED words the one that most other places lose to."""
    phrases = [" ".join(f"p{i}q{k}" for k in range(linededup.SEED)) for i in range(PHRASES)]
    raw = [p.encode() for p in phrases]
    t = linededup.Texts(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1]))
    place = np.arange(PHRASES) * linededup.SEED
    return phrases[int(np.argmin(linededup.spans_hash(t.prefix, t.inverse, place, place + linededup.SEED)))]


@pytest.fixture(scope="module")
def contexts():
    """Documents with words of their own around one phrase; every fifth repeats ones of an earlier one, more or less of them."""
    rng, phrase, out = random.Random(12), least_phrase(), []
    for i in range(4000):
        left, right = ([f"{side}{i}x{k}" for k in range(30)] for side in "lr")
        if i % 5 == 4:
            j, n, m = rng.choice([i - 1, i - 2, 3]), rng.randint(0, 30), rng.randint(0, 30)
            left[30 - n :] = [f"l{j}x{k}" for k in range(30 - n, 30)]
            right[:m] = [f"r{j}x{k}" for k in range(m)]
        out.append((i, " ".join([*left, phrase, *right])))
    return out


def loads(blobs, n):
    size = sum(np.dtype(kind).itemsize for _, kind in linededup.PLACE)
    out = Counter({i: 0 for i in range(n)})
    for r in blobs.where("kind = 0").collect():
        out[r["part"]] += len(r["blob"]) // size
    return np.array([*out.values()])


def test_no_task_holds_a_hot_seed(spark, contexts):
    n = 16
    docs = spark.createDataFrame(contexts, "doc_id long, text string").repartition(6)
    rows = linededup.keyed(docs, "doc_id", "text", [])
    hot = linededup.hot_seeds(docs, linededup.MIN_WORDS, n)
    assert 1 <= len(hot) <= 2 * n / linededup.HOT
    unsplit = loads(linededup.places(rows, linededup.MIN_WORDS, n, False, hot[:0]), n)
    split = loads(linededup.places(rows, linededup.MIN_WORDS, n, False, hot), n)
    assert unsplit.sum() == split.sum() >= 4000
    assert unsplit.max() > 4 * unsplit.mean()
    assert split.max() < 2 * split.mean()


def test_hot_seeds_change_no_result(spark, contexts):
    docs = spark.createDataFrame(contexts, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["text"].split() for r in linededup.dedup(docs).collect()}
    want = left_brute(contexts, linededup.MIN_WORDS)
    assert got == want
    assert sum(len(t.split()) for _, t in contexts) - sum(map(len, want.values())) > 4000


@pytest.mark.parametrize("share", [0.0, 1e9])
def test_any_seeds_may_be_split(spark, monkeypatch, share):
    # all of those that stand twice, or none
    monkeypatch.setattr(linededup, "HOT", share or 1e-9)
    texts = [(i, " ".join(f"w{k}" for k in range(i * 7, i * 7 + 70))) for i in range(30)]
    got = {r["doc_id"]: r["text"].split() for r in linededup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == left_brute(texts, linededup.MIN_WORDS)
