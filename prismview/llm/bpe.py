"""Byte-pair encoding and decoding in numpy, for vocabularies in the tokenizers file format.

The words of a batch lie in one flat array of symbols. A round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes each word's lowest rank and merges all its
occurrences; words without a mergeable pair leave the array. Results equal the library's.

Null text: encoded as the empty text. Empty text: no ids. Repeated rows: one result each. Ties: of overlapping occurrences of a pair the left one is merged.
Very long texts: encoded whole. Extra columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

NONE = np.int32(2**31 - 1)
#: Words beyond so many bytes are merged one by one with a heap: each round is a pass over the word, and there are as many as it has different merges.
LONG_WORD = 1 << 17
#: Words kept by a worker, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 600_000, 64
#: The pre-tokenizer of byte-level vocabularies. Fixed value of the file format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


class Merger:
    """The merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, chars = spec["model"]["vocab"], spec["model"]["merges"], byte_chars()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.byte = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.key_type = np.uint32 if self.size**2 <= 1 << 32 else np.uint64
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], self.key_type)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # what the search finds for pairs of bytes, of which the second may end a word
        left, right = np.repeat(self.byte, 512), np.tile(np.r_[self.byte, self.last], 256)
        self.byte_rank = self.rank(left, right)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        back = {c: b for b, c in enumerate(chars)}
        self.text = [b""] * self.size
        for token, i in vocab.items():
            self.text[i] = bytes(back[c] for c in token.removesuffix(self.suffix)) if self.suffix else bytes(map(back.__getitem__, token))
        for token, i in self.added.items():
            self.text[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(self.key_type) * self.key_type(self.size) + right.astype(self.key_type)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.merge_long(w).astype("<u4").tobytes()
            elif w:
                short.append(i)
            else:
                out[i] = b""
        if not short:
            return out
        length = np.array([len(words[i]) for i in short])
        flat = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        sym = self.byte[flat]
        end = np.cumsum(length)
        sym[end - 1] = self.last[flat[end - 1]]
        word = np.repeat(np.arange(len(short), dtype=np.int32), length)
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that a symbol begins
        at = np.flatnonzero(word[1:] == word[:-1])
        code = flat.astype(np.int32)
        code[end - 1] += 256
        rank[at] = self.byte_rank[code[at] * 512 + code[at + 1]]
        ids, owner = [], []
        while True:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, len(sym)])
            if (low == NONE).any():
                done = np.repeat(low == NONE, count)
                ids.append(sym[done])
                owner.append(word[done])
                if done.all():
                    break
                sym, word, rank = sym[~done], word[~done], rank[~done]
                low, count = low[low != NONE], count[low != NONE]
            pos = np.flatnonzero(rank == np.repeat(low, count))
            if len(pos) > 1:  # of overlapping occurrences every second one, from the left
                fresh = np.r_[True, (np.diff(pos) > 1) | (word[pos[1:]] != word[pos[:-1]])]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            sym[pos] = self.made[rank[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # only pairs beside a merge have changed
            pos -= np.arange(len(pos))
            at = np.r_[pos, pos[pos > 0] - 1]
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self.rank(sym[at], sym[at + 1])
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        raw = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        end = 4 * np.cumsum(np.bincount(owner, minlength=len(short)))
        for i, a, b in zip(short, [0, *end[:-1].tolist()], end.tolist(), strict=True):
            out[i] = raw[a:b]
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of pairs by rank, then position."""
        raw = np.frombuffer(word, np.uint8)
        sym = self.byte[raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        rank = self.rank(sym[:-1], sym[1:])
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], sym.tolist()
        heap = [(int(r), i, live[i], live[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def look(i: int, j: int) -> None:
            pair = (live[i], live[j])
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
            if known[pair] != NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                look(i, after[i])
            if before[i] >= 0:
                look(before[i], i)
        return np.array([x for x in live if x >= 0], np.int32)


class Words:
    """word (str) -> ids as little-endian unsigned 32-bit integers; misses of a batch are merged together."""

    def __init__(self, merger: Merger):
        self.ids: dict[str, bytes] = {}  # a plain dict: sets are compared with no other as fast
        self.merger = merger

        self.long: list[str] = []

    def learn(self, new: set[str], used: list[list[str]]) -> None:
        """Adds the new words of a batch; used: all its words, of which none may be lost."""
        gone = self.long
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        for w in gone:
            self.ids.pop(w, None)
        if gone or not self.ids:
            new = set().union(*filter(None, used)).difference(self.ids)
        words = [*new]
        self.ids.update(zip(words, self.merger.merge([w.encode() for w in words]), strict=True))
        self.long = [w for w in words if len(w) > CACHE_LENGTH]


class Codec:
    """Encodes as the tokenizers library does with add_special_tokens=False, decodes as decode(skip_special_tokens=False)."""

    loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.words = Words(self.merger)
        self.pattern = regex.compile(BYTE_LEVEL)
        # in ASCII both engines agree, and the standard one is faster
        self.ascii = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merger.added, key=len, reverse=True))) + ")") if self.merger.added else None

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def split(self, text: str) -> list[str]:
        # the separators 0x1C-0x1F are white space to Python only
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.ascii.findall(text)
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 128):
            cut = []
            for t in texts[at : at + 128]:
                parts = self.special.split(t) if self.special and any(s in t for s in self.merger.added) else [t]
                cut.append([([p] if k % 2 else self.split(p)) for k, p in enumerate(parts)])
            used = [words for parts in cut for words in parts[::2]]
            self.words.learn(set().union(*used).difference(self.words.ids), used)
            for parts in cut:
                yield b"".join(b"".join(map(self.words.ids.__getitem__, x)) if k % 2 == 0 else self.merger.added[x[0]].to_bytes(4, "little") for k, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        text = self.merger.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them, for every row."""
    return _run(documents, path, id_col, text_col, RESULT, lambda ids, text: (ids, text))


def digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 digests in place of the ids and the decoded text."""
    schema = T.StructType([*RESULT[:2], T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _run(documents, path, id_col, text_col, schema, lambda ids, text: (sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()))


def _run(documents: DataFrame, path: str, id_col: str, text_col: str, schema: T.StructType, finish) -> DataFrame:
    common.small_batches(documents.sparkSession)
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    names = schema.names

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in it:
            texts = [t or "" for t in common.column(b, "text")]
            n, first, second = [], [], []
            for ids in codec.encode(texts):
                x, y = finish(ids, codec.decode(ids))
                n.append(len(ids) // 4)
                first.append(x)
                second.append(y)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(first, pa.binary() if schema[2].dataType == T.BinaryType() else pa.string()), pa.array(second, pa.string())], names=names)

    return rows.mapInArrow(work, schema)
