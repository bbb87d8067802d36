"""The pipeline, stage by stage, against what each stage must do with its input."""

import re
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from prismview.llm import linededup, packing, quality

from .test_operators import ODD, SF, WORDS, ascii_words, base_brute, covered_brute, fingerprint_brute, roots_brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(n)))))
        docs = kept[-1][1]
    assert all(b.columns == a.columns for a, b in kept[:-1])
    (a, b) = kept[0]
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in quality.score(a).where("kept").collect()}
    (a, b) = kept[1]
    assert {(r["doc_id"], r["text"]) for r in b.collect()} == {(r["doc_id"], r["text"]) for r in linededup.dedup(a).where("text <> ''").collect()}
    (a, b) = kept[2]
    roots = roots_brute({r["doc_id"]: fingerprint_brute(r["text"]) for r in a.collect()})
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(set(roots.values()))
    (a, b) = kept[3]
    assert a.count() == b.count() and not any(base_brute(r["text"]) for r in b.collect())
    assert all(r["text"] in {x["text"] for x in a.collect()} for r in b.collect() if not re.search("<(EMAIL|IP|CARD|PHONE|SECRET)>", r["text"]))
    (a, b) = kept[4]
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in a.collect()}
    assert sum(r["length"] for r in b.collect()) == sum(r["length"] for r in packing.pack(a, WORDS).collect())


def odd_rows(spark):
    """Rows of good prose, some of them with shared ids or none, with copies, shared passages, odd texts and columns named as the operators name their own."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").collect()]
    long = [t for t in good if 60 <= len(t.split()) < 400]
    assert len(long) >= 29
    rows = [(i, t) for i, t in enumerate(long[:18])] + [(None, t) for t in long[18:22]] + [(5, t) for t in long[22:26]] + [(None, long[18]), (5, long[22]), (200, long[0])]
    rows += [(300, f"{long[1]} {long[26]}"), (None, f"{long[27]} {long[2]}"), (301, long[28] + " mail me: a.b@example.com")]
    rows += [(400 + i, t) for i, t in enumerate(ODD)] + [(None, None), (None, ""), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _kept int, _row int, rest string, text_ string"
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", n, n, "r", "x") for n, (i, t) in enumerate(rows)], schema).repartition(4)


def test_rows_through_all_stages(spark, tmp_path):
    docs = odd_rows(spark)
    columns = docs.columns

    def through(n, docs):
        path = str(tmp_path / str(n))
        corpus_pipeline.STAGES[n][1](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    def rows(df):
        return sorted(((r["doc_id"], r["text"], r["_kept"]) for r in df.collect()), key=lambda r: r[2])

    # quality: a verdict depends on text and language alone, and only the odd texts are bad
    a = through(0, docs)
    assert a.columns == columns
    gone = {r[2]: r[1] for r in rows(docs)}
    for r in rows(a):
        gone.pop(r[2])
    assert set(gone.values()) <= {*ODD}
    # line dedup, by brute force over rows in their order; rows equal in id and text are one place
    order = {r["_kept"]: (2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["h"]) for r in a.selectExpr("_kept", "doc_id", "xxhash64(text) h").collect()}
    texts = {order[n]: t for _, t, n in rows(a)}
    covered = covered_brute(sorted((place, t) for place, t in texts.items()), linededup.MIN_WORDS)
    left = {n: [w for k, w in enumerate(ascii_words(t)) if k not in covered.get(order[n], ())] for _, t, n in rows(a)}
    b = through(1, a)
    assert b.columns == columns
    assert {n: ascii_words(t) for _, t, n in rows(b)} == {n: w for n, w in left.items() if w}
    # near duplicates: one row of each component, no different text goes
    c = through(2, b)
    assert c.columns == columns
    prints = {n: fingerprint_brute(t) for _, t, n in rows(b)}
    roots = roots_brute(prints)
    kept = [n for _, _, n in rows(c)]
    assert sorted(roots[n] for n in kept) == sorted(set(roots.values()))
    assert {t for _, t, _ in rows(c)} <= {t for _, t, _ in rows(b)}
    # personal data: every row stays, and only spans change
    d = through(3, c)
    assert d.columns == columns and [(i, n) for i, _, n in rows(d)] == [(i, n) for i, _, n in rows(c)]
    assert not any(base_brute(t) for _, t, _ in rows(d)) and any("<EMAIL>" in t for _, t, _ in rows(d))
    # packing: all ids of all rows
    t = Tokenizer.from_file(WORDS)
    want, got = Counter(), Counter()
    for i, text, _ in rows(d):
        want[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    for r in through(4, d).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages_take_empty_tables(spark, tmp_path):
    docs = odd_rows(spark).limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.count() == 0


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
