"""Order-preserving packing of documents into sequences of bounded length.

Documents are dealt into ranges of doc_id, tokenised, and laid end to end. A dynamic programme
over the places where a cut may fall (ends of documents, ends of sentences) minimises padding plus
a penalty for each cut inside a document; the cheapest predecessor within the window of one
sequence comes from a monotone queue, so a place costs constant time. A sequence whose length is a
power of two needs no padding, which gives each place a few further predecessors. In the last sequences of a
range every token is a place, at the price of a cut inside a sentence, so that little padding is left there too.

A run of tokens without any place longer than a sequence is cut at the sequence's length, at that price.
Null text: encoded as the empty text, so the end token alone. Null doc_id: sorts first. Repeated
rows: each is packed, and ranges may part them. Ties: the nearest cut that costs least. Very long texts: cut like any other. Extra columns, whatever
their names, are not read. Empty table: no pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import Merger, Words

#: Cost of a cut at a sentence's end, and of one inside a sentence, in tokens of padding.
SENTENCE_CUT, INNER_CUT = 16.0, 64.0
#: Tokens of which the cuts are chosen together.
BLOCK = 1 << 17


class WordTokenizer:
    """ids of a lower-casing word-level vocabulary, equal to the tokenizers library's.

    Texts of Latin letters below U+0250 (where the library's normalisation changes nothing but case and
    white space) go through a table of words; all other texts, and those that hold a special token's
    string, through the library itself.
    """

    loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = Merger(path)
        self.words = Words(self.merger)
        space = "\t\n\x0b\x0c\r \x85\xa0"
        low = [chr(c) for c in range(0x20, 0x250)] + [*space]
        letters = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "L")
        digits = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "N")
        # without the three letters below U+0250 whose lower case is another's or longer
        self.plain = re.compile("[\\t-\\r\x20-\u012f\u0132-\u017e\u0180-\u024f]*")
        self.pattern = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^{letters}{digits}{re.escape(space)}]+")
        ends = [i for w, i in self.library.get_vocab().items() if re.fullmatch(r"[^\w]*[.!?][^\w]*</w>", w)]
        self.is_end = np.zeros(self.merger.size, bool)
        self.is_end[ends] = True

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 128):
            # of each text the ids of its words, with holes where words are new; nothing where the library has to encode it
            known: list[tuple[list[str], list, list[int]] | None] = []
            new: set[str] = set()
            look = self.words.ids.get
            for t in texts[at : at + 128]:
                if not self.plain.fullmatch(t) or ("<|" in t and any(s in t for s in self.merger.added)):
                    known.append(None)
                    continue
                words = self.pattern.findall(t.lower())
                ids = [*map(look, words)]
                holes = [i for i, x in enumerate(ids) if x is None] if None in ids else []
                new.update(words[i] for i in holes)
                known.append((words, ids, holes))
            if new:
                self.words.learn(new, [[*new]])
            for t, x in zip(texts[at : at + 128], known, strict=True):
                if x is None:
                    yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                    continue
                words, ids, holes = x
                for i in holes:
                    ids[i] = self.words.ids[words[i]]
                yield b"".join(ids)


def choose_cuts(place: list[int], cost: list[float], length: int) -> list[int]:
    """The cheapest increasing choice of places, from place[0] to place[-1], with steps of at most length.

    place: increasing token positions; cost[k]: the penalty of a cut at place[k]. Steps longer than length
    must not be needed. A step costs length minus its own length, or nothing if that is a power of two.
    """
    positions = np.asarray(place)
    # of each place the earlier ones at a distance of a power of two
    target, source = [], []
    for w in (1 << k for k in range(length.bit_length()) if 1 << k <= length):
        at = np.searchsorted(positions, positions - w)
        hit = np.flatnonzero(positions[at] == positions - w)
        target.append(hit)
        source.append(at[hit])
    target, source = np.concatenate(target), np.concatenate(source)
    order = np.argsort(target, kind="stable")
    target, source = [*target[order].tolist(), len(place)], source[order].tolist()
    best, back, value, nearest = [0.0] * len(place), [0] * len(place), 0.0, 0
    queue: deque[tuple[float, int, int]] = deque([(0.0 + place[0], place[0], 0)])
    pop, append, popleft = queue.pop, queue.append, queue.popleft
    i, due = 0, target[0]
    for k in range(1, len(place)):
        p = place[k]
        low = p - length
        while queue[0][1] < low:
            popleft()
        value, _, nearest = queue[0]
        value -= low
        while due == k:
            j = source[i]
            if best[j] < value:
                value, nearest = best[j], j
            i += 1
            due = target[i]
        value += cost[k]
        best[k], back[k] = value, nearest
        value += p
        while queue and queue[-1][0] >= value:
            pop()
        append((value, p, k))
    out = [len(place) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return [place[k] for k in reversed(out)]


def places(lengths: list[int], ends: list[np.ndarray], length: int, every_from: int) -> tuple[list[int], list[float]]:
    """Where a cut may fall, from 0 to the end of all documents, and what it costs there.

    lengths: the documents' tokens; ends: places of sentence ends within each. From every_from on each token is a place.
    """
    bound = np.cumsum([0, *lengths])
    inner = np.concatenate([np.zeros(0, np.int64), *(e + at for e, at in zip(ends, bound[:-1], strict=True))])
    tail = np.arange(max(0, every_from), bound[-1])
    place = np.r_[bound, inner, tail]
    cost = np.r_[np.zeros(len(bound)), np.full(len(inner), SENTENCE_CUT), np.full(len(tail), INNER_CUT)]
    order = np.lexsort((cost, place))
    place, cost = place[order], cost[order]
    first = np.r_[True, place[1:] != place[:-1]]
    place, cost = place[first], cost[first]
    gap = np.diff(place)
    if (wide := np.flatnonzero(gap > length)).size:
        forced = np.concatenate([np.arange(place[k] + length, place[k + 1], length) for k in wide])
        place, cost = np.r_[place, forced], np.r_[cost, np.full(len(forced), INNER_CUT)]
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place.tolist(), cost.tolist()


class Packer:
    """Takes documents in order and gives their pieces."""

    def __init__(self, tokenizer: WordTokenizer, length: int, end_id: int, first_sequence: int):
        self.tokenizer, self.length, self.end, self.sequence = tokenizer, length, np.array([end_id], "<u4").tobytes(), first_sequence
        self.docs: deque[list] = deque()  # id, ids not yet cut, ids before these, all ids
        self.open = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        ids += self.end
        self.docs.append([doc_id, np.frombuffer(ids, "<u4"), 0, len(ids) // 4])
        self.open += len(ids) // 4
        if self.open >= BLOCK:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.open:
            return
        lengths = [len(d[1]) for d in self.docs]
        ends = [np.flatnonzero(self.tokenizer.is_end[d[1][:-1]]) + 1 for d in self.docs]
        place, cost = places(lengths, ends, self.length, self.open - 2 * self.length if last else self.open)
        cuts = choose_cuts(place, cost, self.length)
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]  # what follows may fill the last sequence
        yield from self.emit(cuts)

    def emit(self, cuts: list[int]) -> Iterator[tuple]:
        for size in np.diff(cuts).tolist():
            offset = 0
            while offset < size:
                doc = self.docs[0]
                n = min(size - offset, len(doc[1]))
                yield doc[0], doc[2], n, zlib.crc32(doc[1][:n].tobytes()), doc[3], self.sequence, offset, doc[1][:n]
                offset += n
                self.open -= n
                doc[1], doc[2] = doc[1][n:], doc[2] + n
                if not len(doc[1]):
                    self.docs.popleft()
            self.sequence += 1


SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(documents: DataFrame, path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Sequences follow the order of doc_id. Each range of documents is packed by one task, which holds about
    BLOCK tokens and one document at a time.
    """
    spark = documents.sparkSession
    common.small_batches(spark, 256)
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    # the hash and the row's number spread repeated ids, and repeated rows, over ranges without leaving the order of ids
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").drop("h", "n")
    schema = T.StructType([*SCHEMA, *([T.StructField("ids", T.ArrayType(T.LongType(), False))] if with_ids else [])])
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        tokenizer = WordTokenizer.of(path)
        packer = Packer(tokenizer, length, end_id, (context.partitionId() if context else 0) << 33)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*pieces, strict=True))[: len(kinds)], kinds, strict=True)], names=schema.names)

        for b in it:
            pieces: list[tuple] = []
            for doc_id, ids in zip(common.column(b, "doc_id"), tokenizer.encode([t or "" for t in common.column(b, "text")]), strict=True):
                pieces += packer.add(doc_id, ids)
            if pieces:
                yield out(pieces)
        if pieces := [*packer.flush(True)]:
            yield out(pieces)

    return rows.mapInArrow(work, schema)
