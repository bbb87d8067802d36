"""Cross-tokenizer alignment against brute force over both libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismview.llm import bpe, tokenalign

from .test_operators import BYTES, documents, empty, odd_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
CHAR = {c: bytes([b]) for b, c in enumerate(bpe.byte_chars())}


def bytes_a(i):
    return b"".join(CHAR[c] for c in A.id_to_token(i))


def bytes_b(i):
    x = B.id_to_piece(i)
    return bytes([int(x[3:5], 16)]) if B.is_byte(i) else x.replace("▁", " ").encode()


def tokens(text):
    """The ids of both, with where each token ends."""
    if not text:
        return [], []
    out = []
    for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, bytes_a), (B.encode(text), bytes_b)):
        raw = [of(i) for i in ids]
        if b"".join(raw) != (" " + text).encode():
            return [], []
        out.append([*zip(ids, np.cumsum([len(x) for x in raw]).tolist(), strict=True)])
    return out


def brute(rows):
    """What digests() returns for rows of (doc_id, text), by sets of offsets."""
    made, n = [], Counter()
    for i, text in rows:
        a, b = tokens(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        links = [(x, y) for e in cuts for x, f in a if f == e for y, g in b if g == e] if len(a) < 2000 else [(dict((e, x) for x, e in a)[c], y) for c, y in ((g, y) for y, g in b) if c in set(cuts)]
        n.update(links)
        low, parts = 0, []
        for e in cuts:
            parts.append("|".join(",".join(str(x) for x, f in side if low < f <= e) for side in (a, b)))
            low = e
        made.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    return Counter((i, p, q, g, len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links), h) for i, p, q, g, links, h in made), n, most


def test_digests(spark):
    # very long words are left to test_long_texts: brute force is slow on them
    docs = documents(spark).select("doc_id", "text").where("length(text) < 3000").unionByName(odd_documents(spark).select("doc_id", "text").where("text is null or length(text) < 2000"))
    more = [(-1, "a▁b"), (-2, "  two   spaces \n\n and\ttabs "), (-3, "<|endoftext|> <s> <0x41> \x00"), (-4, "日本語の文 \U0001f642\U0001f642"), (-5, " "), (-6, "a "), (-7, "same same"), (-7, "same same")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want, n, most = brute(rows)
    assert Counter(tuple(r) for r in tokenalign.digests(docs, BYTES, PIECES).collect()) == want
    got = {(r.a_id, r.b_id): (r.n, r.best) for r in tokenalign.link_counts(docs.repartition(5), BYTES, PIECES).collect()}
    assert got == {p: (k, k == most[p[1]]) for p, k in n.items()}
    assert {r[1:] for r in want if r[0] == -1} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment(spark):
    docs = spark.createDataFrame([(1, "hello world, unbelievable tokenizers"), (2, None), (3, "日本 x")], "doc_id long, text string")
    for r in tokenalign.align(docs, BYTES, PIECES).collect():
        a, b = tokens(docs.where(docs.doc_id == r.doc_id).first().text)
        assert (r.a_ids, r.b_ids) == ([x for x, _ in a], [y for y, _ in b])
        assert r.cuts == sorted({e for _, e in a} & {e for _, e in b})
        spans = [[*zip([0, *[e for _, e in side]], [e for _, e in side], strict=False)] for side in (a, b)]
        assert [*zip(r.overlap_a, r.overlap_b, strict=True)] == sorted((i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aet \n▁é日\U0001f642<s>.'1\t\x1c\x00"), max_size=40), max_size=6))
def test_ids_equal_the_libraries(texts):
    aligner = tokenalign.Aligner.of(BYTES, PIECES)
    (c,) = aligner.chunks(texts) if texts else [aligner.chunk([])]
    for t, (s, e), (u, f) in zip(texts, tokenalign.ends(c.n_a), tokenalign.ends(c.n_b), strict=True):
        a, b = tokens(t)
        assert (c.a[s:e].tolist(), c.b[u:f].tolist()) == ([x for x, _ in a], [y for y, _ in b])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aet \n▁é日\U0001f642<s>.'1\t\x1c\x85\x00"), max_size=40), max_size=6))
def test_word_by_word_equals_whole_texts(texts):
    aligner = tokenalign.Aligner.of(BYTES, PIECES)
    whole = [(aligner.groups_of(aligner.chunk([f" {t}"])), b"".join(aligner.digits.write(aligner.chunk([f" {t}"])))) if t else ([], b"") for t in texts]
    for (rows, text), (got, digest) in zip(whole, aligner.tallied(texts), strict=True):
        assert got.tolist() == [*map(list, rows)] and digest == (hashlib.sha256(text).hexdigest() if text else "")


def test_universe_holds_every_pair():
    a, b = [b"ab", b"b", b"", b"xb"], [b"b", b"ab", b"b", b"yab"]
    u = tokenalign.Universe(a, b)
    want = sorted(i * 4 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert u.keys.tolist() == want


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "z" * 20_000), (3, "日" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokenalign.digests(docs, BYTES, PIECES).collect()}
    for r in docs.collect():
        a, b = tokens(r.text)
        assert (got[r.doc_id].n_a, got[r.doc_id].n_b) == (len(a), len(b))
        assert got[r.doc_id].n_groups == len({e for _, e in a} & {e for _, e in b})


def test_empty(spark):
    assert tokenalign.digests(empty(spark), BYTES, PIECES).collect() == []
    assert tokenalign.align(empty(spark), BYTES, PIECES).collect() == []
