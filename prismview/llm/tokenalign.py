"""Alignment of two tokenizers' ids over the bytes of a text: byte-level BPE (A) and sentencepiece BPE (B).

The texts of a chunk lie in one run of bytes. np.repeat gives every byte the token that owns it, once for A and once for B. Where the pair of owners changes,
another overlap begins; where both owners change at once, both tokenizers have a boundary, and these cuts part the tokens into groups. The two tokens that end
at a cut are a link.

No token of either reaches from the end of a word into the space after it, so a text can be aligned word by word: digests() aligns the words that a task has not
met yet, a batch's together, and joins what it knows of them. align() aligns whole texts, with the same result.

Of two tokens that end at the same byte of a text, one's bytes are the end of the other's. So the pairs that can be linked are those of the vocabularies where that
holds (Universe): some hundred thousand, whatever the corpus. That bounds the counts that a task holds, what it sends to the shuffle and what is broadcast.

Space and text are encoded by both; strings of special tokens are ordinary text. Null and empty texts: no tokens, zeros and '' in all columns; so are texts whose
bytes differ from what B gives back, as those with U+2581. Ties: pairs that share a B token's highest count are all best. Repeated rows: a result each, and each
counts. Very long texts: aligned whole. Extra columns, whatever their names: not read. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Characters of texts that are aligned at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: In place of the ids of words that B doesn't give back.
LOST = 2**32 - 1
#: Words that a worker knows at once.
CACHE_WORDS = 500_000
KEPT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair int, n long"
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, cuts array<long>, overlap_a array<int>, overlap_b array<int>"


class Pieces:
    """The ids of words by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        # a word starts with a space, or a line's end if no piece holds one, that follows what is no white space; if a piece reaches over that, the text is one word
        first = " " if any("\n" in x for x in names) else " \n"
        word = rf"[{first}]\s*\S+(?:[^\S{first}]\s*\S+)*(?:[^\S{first}]\s*\Z)?|[{first}]\s*\Z"
        self.split = re.compile(r"(?s).+" if any(re.search("[^▁]▁", x) for x in names) else word).findall

    def encode(self, words: list[str]) -> list[list[int]]:
        # the model puts a space before each, but not before nothing
        out = self.model.encode([w[w[0] == " " :] for w in words], num_threads=1)
        return [ids[1:] if w[0] == "\n" else ids or [self.space] for w, ids in zip(words, out, strict=True)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers; of one that comes back as other bytes, LOST."""
        ids = self.encode([w.decode() for w in words])
        back = [b"".join([self.bytes[i] for i in x]) for x in ids]
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [raw[s:e] if w == x else LOST.to_bytes(4, "little") for w, x, (s, e) in zip(words, back, ends(4 * np.array([len(x) for x in ids], np.int64)), strict=True)]


class Universe:
    """The pairs of ids that can end together, in order of (a, b)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        ids: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for table, tokens in zip(ids, (a, b), strict=True):
            for i, x in enumerate(tokens):
                table.setdefault(x, []).append(i)
        self.n_b = len(b)
        of_a = [i * self.n_b + j for i, x in enumerate(a) for k in range(len(x)) for j in ids[1].get(x[k:], ())]
        of_b = [i * self.n_b + j for j, x in enumerate(b) for k in range(1, len(x)) for i in ids[0].get(x[k:], ())]
        self.keys = np.unique(np.array(of_a + of_b, np.int64))

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.n_b + b)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of its B id."""
        b = self.keys % self.n_b
        most = np.zeros(self.n_b, np.int64)
        np.maximum.at(most, b, counts)
        return counts == most[b]


@dataclass
class Chunk:
    """Texts by both tokenizers: ids of all of them, and the number of tokens of each text."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray

    @cached_property
    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of A and of B that each byte belongs to."""
        return tuple(np.repeat(np.arange(len(x), dtype=np.int32), size) for x, size in ((self.a, self.size_a), (self.b, self.size_b)))

    @cached_property
    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the next byte has another owner, in A and in B."""
        return tuple(np.r_[x[1:] != x[:-1], len(x) > 0] if len(x) else np.zeros(0, bool) for x in self.owners)

    @cached_property
    def cuts(self) -> np.ndarray:
        """The last byte of each group."""
        return np.flatnonzero(self.changes[0] & self.changes[1])

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A and B that end each group."""
        return self.owners[0][self.cuts], self.owners[1][self.cuts]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token, in A and in B."""
        return tuple(np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)) for last in self.links)

    @cached_property
    def n_groups(self) -> np.ndarray:
        """The number of groups of each text: a text's end is a cut."""
        ends = np.searchsorted(self.links[0], np.cumsum(self.n_a))
        return np.diff(ends, prepend=0)

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A and B that share bytes, in order."""
        at = np.flatnonzero(self.changes[0] | self.changes[1])
        return self.owners[0][at], self.owners[1][at]


class Digits:
    """Ids in decimal with what follows them."""

    def __init__(self, n: int):
        self.comma, self.bar, self.semicolon, self.last = (np.array([b"%d%s" % (i, x) for i in range(n)], object) for x in (b",", b"|", b";", b""))

    def write(self, c: Chunk) -> Iterator[bytes]:
        """For each text its groups as a1,a2|b1;a3|b2,b3."""
        (last_a, last_b), (of_a, of_b), i, j = c.links, c.groups, np.arange(len(c.a)), np.arange(len(c.b))
        out = np.empty(len(i) + len(j), object)
        out[i + np.r_[0, last_b + 1][of_a]] = np.where(last_a[of_a] == i, self.bar[c.a], self.comma[c.a])
        ends = np.zeros(len(c.b), bool)
        ends[np.cumsum(c.n_b)[c.n_b > 0] - 1] = True
        out[j + (last_a + 1)[of_b]] = np.where(last_b[of_b] == j, np.where(ends, self.last[c.b], self.semicolon[c.b]), self.comma[c.b])
        at = 0
        for n in (c.n_a + c.n_b).tolist():
            yield b"".join(out[at : at + n].tolist())
            at += n


class Aligner:
    """Both tokenizers, loaded once for each worker."""

    loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        self.codec, self.pieces = bpe.Codec(path_a), Pieces(path_b)
        self.codec.special = None
        self.words = bpe.Words(self.pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        a, b = self.codec.merger.text, self.pieces.bytes
        self.size_a, self.size_b = (np.array([len(x) for x in tokens], np.int64) for tokens in (a, b))
        self.universe = Universe(a, b)
        self.digits = Digits(max(len(a), len(b)))

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls.loaded:
            cls.loaded[path_a, path_b] = cls(path_a, path_b)
        return cls.loaded[path_a, path_b]

    def chunks(self, texts: list[str | None]) -> Iterator[Chunk]:
        for some in blocks(texts):
            yield self.chunk([f" {t}" if t else "" for t in some])

    def chunk(self, texts: list[str]) -> Chunk:
        """texts as they are, all at once."""
        ids: list[list[np.ndarray]] = []
        for split, words in ((self.codec.split, self.codec.words), (self.pieces.split, self.words)):
            used = [split(t) for t in texts]
            words.learn(set().union(*used).difference(words.ids), used)
            ids.append([np.frombuffer(b"".join(map(words.ids.__getitem__, x)), "<u4") for x in used])
        none = np.zeros(0, "<u4")
        for k, x in enumerate(ids[1]):
            if len(x) and (x[0] == LOST or LOST in x):
                ids[0][k] = ids[1][k] = none
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
        a, b = (np.concatenate([none, *side]) for side in ids)
        return Chunk(a, b, n_a, n_b, self.size_a[a], self.size_b[b])

    def groups_of(self, c: Chunk) -> np.ndarray:
        """Of each group its pair and the numbers of tokens of A and B."""
        last_a, last_b = c.links
        return np.stack([self.universe.index(c.a[last_a], c.b[last_b]), np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)], 1)

    def learn(self, new: set[str]) -> None:
        """Adds what there is to know of words: the rows of groups_of(), and the groups as text."""
        for words in blocks([*new]):
            c = self.chunk(words)
            raw = self.groups_of(c).astype("<u4").tobytes()
            self.known.update(zip(words, zip([raw[s:e] for s, e in ends(12 * c.n_groups)], self.digits.write(c), strict=True), strict=True))

    def tallied(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text the rows of groups_of() and the digest of its groups."""
        for some in blocks(texts):
            used = [self.pieces.split(f" {t}") if t else [] for t in some]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            new = set().union(*used).difference(self.known)
            self.learn(new)
            for words in used:
                got = [self.known[w] for w in words]
                raw = [x for x, _ in got]
                if not all(raw):  # a word without groups is one that is lost
                    raw = got = []
                yield np.frombuffer(b"".join(raw), "<u4").reshape(-1, 3), sha256(b";".join([t for _, t in got])).hexdigest() if got else ""
            for w in new:
                if len(w) > bpe.CACHE_LENGTH:
                    del self.known[w]


def blocks(texts: list) -> Iterator[list]:
    """texts in order, CHUNK characters at a time or one longer text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def ends(counts: np.ndarray) -> list[tuple[int, int]]:
    at = np.cumsum(counts)
    return [*zip((at - counts).tolist(), at.tolist(), strict=True)]


def inputs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(documents.sparkSession)
    return documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))


def align(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, both tokenizers' ids, the byte offsets of the cuts in space+text, and the overlaps, as numbers of tokens of A and B that share bytes."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, names = Aligner.of(path_a, path_b), [x.split()[0] for x in ALIGNED.split(", ")]
        for batch in it:
            rows: list[list] = [[] for _ in names[1:]]
            for c in aligner.chunks(common.column(batch, "text")):
                over_a, over_b = c.overlaps()
                size = [int(c.size_a[s:e].sum()) for s, e in ends(c.n_a)]
                begin = (np.cumsum(size) - size).tolist()
                for k, ((s, e), (t, f), (g, h)) in enumerate(zip(ends(c.n_a), ends(c.n_b), ends(c.n_groups), strict=True)):
                    lo, hi = np.searchsorted(over_a, [s, e])
                    for col, x in zip(rows, (c.a[s:e].astype(np.int32), c.b[t:f].astype(np.int32), c.cuts[g:h] + 1 - begin[k], over_a[lo:hi] - s, over_b[lo:hi] - t), strict=True):
                        col.append(x)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            cols = [pa.array(x, pa.list_(kind)) for x, kind in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *cols], names=names)

    return inputs(documents, id_col, text_col).mapInArrow(work, ALIGNED)


def tallies(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over all texts, written once: a row for each document with its counts and pairs, and for each task a row (pair, n) for each pair that it met."""
    spark = documents.sparkSession

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        total = np.zeros(len(aligner.universe.keys), np.int64)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in KEPT.split(", ")]

        def made(cols: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[x] if x in cols else pa.nulls(n, kind) for x, kind in zip(names, kinds, strict=True)], names=names)

        for batch in it:
            cols: list[list] = [[] for _ in range(6)]
            for rows, digest in aligner.tallied(common.column(batch, "text")):
                pair, times = np.unique(rows[:, 0], return_counts=True)
                total[pair] += times
                # sorted pairs as differences, which compress well
                packed = (np.diff(pair, prepend=pair.dtype.type(0)), times)
                for col, x in zip(cols, (int(rows[:, 1].sum()), int(rows[:, 2].sum()), len(rows), digest, *(x.astype("<u4").tobytes() for x in packed)), strict=True):
                    col.append(x)
            n_a, n_b, groups, digests_, pairs, times = (pa.array(x, kind) for x, kind in zip(cols, [*[pa.int64()] * 3, pa.string(), pa.binary(), pa.binary()], strict=True))
            yield made({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": groups, "groups_sha256": digests_, "pairs": pairs, "times": times}, batch.num_rows)
        met = np.flatnonzero(total)
        for at in range(0, len(met), 50_000):
            some = met[at : at + 50_000]
            yield made({"pair": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())}, len(some))

    path = common.shared_path(spark, "tallies")
    inputs(documents, id_col, text_col).mapInArrow(work, KEPT).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(KEPT).parquet(path)


def counts(kept: DataFrame, path_a: str, path_b: str) -> np.ndarray:
    """How many links hold each pair of the universe, from tallies(). The driver gets one row for each pair at most."""
    rows = kept.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(Aligner.of(path_a, path_b).universe.keys), np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


def link_counts(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n, best of every pair that is linked anywhere."""
    kept = tallies(documents, path_a, path_b, id_col, text_col)
    universe, n = Aligner.of(path_a, path_b).universe, counts(kept, path_a, path_b)
    some = np.flatnonzero(n)
    cols = {"a_id": universe.keys[some] // universe.n_b, "b_id": universe.keys[some] % universe.n_b, "n": n[some], "best": universe.best(n)[some]}
    return documents.sparkSession.createDataFrame(pa.table(cols), "a_id long, b_id long, n long, best boolean")


def digests(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = documents.sparkSession
    kept = tallies(documents, path_a, path_b, id_col, text_col)
    n = counts(kept, path_a, path_b)
    sent = spark.sparkContext.broadcast((n, Aligner.of(path_a, path_b).universe.best(n)))  # nine bytes for each pair of the universe
    plain = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in it:
            n_best, count_sum = [], []
            for p, t in zip(common.column(batch, "pairs"), common.column(batch, "times"), strict=True):
                pair, times = np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)), np.frombuffer(t, "<u4").astype(np.int64)
                n_best.append(int(times[best[pair]].sum()))
                count_sum.append(int(times @ count[pair]))
            cols = [batch.column(batch.schema.get_field_index(x)) for x in plain]
            yield pa.RecordBatch.from_arrays([*cols[:5], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), cols[5]], names=[*plain[:5], "n_best", "count_sum", plain[5]])

    docs = kept.where(F.col("pair").isNull()).select(*plain, "pairs", "times")
    return docs.mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
