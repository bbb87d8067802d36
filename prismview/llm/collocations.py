"""Collocations: frequent phrases by pattern growth over occurrence pointers, scored by their worst cut.

Four passes over the texts, all in numpy within tasks, everything between them by shuffles of what tasks have summed up:
  words    counts of words. Phrases hold frequent words only, and sums by language give n.
  pairs    counts of pairs of frequent words. A frequent phrase begins with a frequent pair at each of its words, so an occurrence reaches as far as pairs are
           frequent, five words at most.
  spread   only if a pair has more occurrences than a task's share: counts of three and four words behind such pairs.
  windows  the occurrences, dealt by their prefix: a pair, or as many more words as it takes until a prefix has no more than a share.
A task holds the occurrences of one prefix after another as pointers, counts the words that come next, projects the pointers of the frequent ones and goes on to the
right with them, depth first. What it finds of prefixes that are split over tasks is summed at the end, so their number of occurrences does not matter.

What is frequent reaches the tasks as bitmaps of fixed size by hash. A wrong bit lets an infrequent phrase pass to the next step, never a frequent one fail.
Words travel as 64-bit hashes, and the counts of all words show whether two of one language share one; then another seed is taken (Collision).

Null text: as empty, no words. Null lang: und. Ties: by phrase, in the order of UTF-8 bytes. Repeated rows: each counts. Very long texts: read whole. Extra columns,
whatever their names: not read. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Words of a phrase, its least occurrences, and phrases of a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of a bitmap: 8 MB, which is what the driver gets and sends.
BITS = 1 << 26
#: Tokens that a task looks at together, and words whose hashes or counts it holds.
TOKENS, HELD = 1 << 19, 300_000
#: Occurrences of a prefix in one task: half of a partition's mean, within these.
SHARE = (1000, 1 << 20)
#: A-Z to a-z, and what ends a piece to a byte that no UTF-8 text has.
END = b"\xff"
PLAIN = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64
#: Occurrences travel packed: those of one task, language and bin of prefixes in a row. So many bins, or four for each partition if that is more.
BINS = 1024
FIELDS = {"depth": np.int32} | {f"w{i}": np.int64 for i in range(1, LONGEST + 1)} | {"n": np.int64}
WINDOW = "bin int, lang string, " + ", ".join(f"{x} binary" for x in FIELDS)


class Collision(ValueError):
    """Two words of one language have one hash."""


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with END between pieces."""
    return (text or "").encode().translate(PLAIN).replace(END, b" \xff ").split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a and b, in that order."""
    x = a * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def bitmap(rows: DataFrame, h: str) -> np.ndarray:
    """BITS bits, those of the hashes in column h set. The driver gets BITS / 64 rows at most."""
    at = F.shiftrightunsigned(F.col(h), 6).bitwiseAND(F.lit(BITS // 64 - 1))
    bit = F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    got = rows.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, U)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(U)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h >> U(6)).astype(np.int64) & (BITS // 64 - 1)] >> (h & U(63))) & U(1) == 1


def summed(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each kind of rows, and how many rows it stands for. Exact: each column adds a number to those of the ones before."""
    kind = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        values, number = np.unique(c, return_inverse=True)
        kind = np.unique(kind * len(values) + number, return_inverse=True)[1]
    _, first, n = np.unique(kind, return_index=True, return_counts=True)
    return first, n


class Words(dict):
    """word -> 64-bit hash, 0 for END; a new word's is made when it is looked up."""

    def __init__(self, seed: int):
        super().__init__({END: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = hash_of(word, self.seed)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD:
            self.clear()
            self[END] = 0
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def hash_of(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) or 1


@dataclass
class Tokens:
    """Texts one after the other: the hash of each word, 0 where a piece ends, the number of its language in langs, and that one's hash."""

    words: np.ndarray
    lang: np.ndarray
    langs: list[str]

    @classmethod
    def read(cls, it: Iterator[pa.RecordBatch], words: Words) -> Iterator[Tokens]:
        parts: list[np.ndarray] = []
        lang: list[np.ndarray] = []
        langs: dict[str, int] = {}
        size = 0
        for b in it:
            for name, text in zip(common.column(b, "lang"), common.column(b, "text"), strict=True):
                h = words.hashes([*words_of(text), END])
                parts.append(h)
                lang.append(np.full(len(h), langs.setdefault(name, len(langs)), np.int32))
                size += len(h)
                if size >= TOKENS:
                    yield cls(np.concatenate(parts), np.concatenate(lang), [*langs])
                    parts, lang, langs, size = [], [], {}, 0
        if size:
            yield cls(np.concatenate(parts), np.concatenate(lang), [*langs])

    def prefixes(self, n: int) -> list[np.ndarray]:
        """For each place the hash of its language and first word, first two, ... n words; a text's last place is an END, and what reaches beyond means nothing."""
        h = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], U)[self.lang]
        out = []
        for k in range(n):
            h = mixed(h, np.r_[self.words[k:], np.zeros(min(k, len(self.words)), U)])
            out.append(h)
        return out

    def reach(self, words: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """How many words from each place on may belong to a frequent phrase, LONGEST at most; by words alone it's 0, 1 or 2."""
        one, two = self.prefixes(2)
        fine = (self.words != 0) & has(words, one)
        both = fine & np.r_[fine[1:], False]
        if pairs is None:
            return fine.astype(np.int8) + both
        step = both & has(pairs, two)
        out = fine.astype(np.int8)
        for k in range(1, LONGEST):
            on = np.r_[step[k - 1 :], np.zeros(min(k - 1, len(step)), bool)]
            out[(out == k) & on] = k + 1
        return out


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, h, g, word, n of every word, summed over all texts and written; h: the word's hash, g: that of language and word. Raises Collision."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, count in seen.items():
                count.pop(END, None)
                some = [*count]
                h = np.array([hash_of(w, seed) for w in some], U)
                g = mixed(np.full(len(h), xxhash.xxh64_intdigest(lang), U), h)
                names = {"lang": pa.array([lang] * len(some), pa.string()), "h": signed(h), "g": signed(g), "word": pa.array([w.decode() for w in some], pa.string()), "n": pa.array([*count.values()], pa.int64())}
                yield from pa.table(names).to_batches(50_000)
            seen.clear()

        for b in it:
            for lang, text in zip(common.column(b, "lang"), common.column(b, "text"), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = texts.mapInArrow(work, "lang string, h long, g long, word string, n long").repartition("lang", "h")
    out = written(rows.groupBy("lang", "h", "g", "word").agg(F.sum("n").alias("n")), "words")
    if collided(out):
        raise Collision(seed)
    return out


def collided(counts: DataFrame) -> bool:
    """Whether two words of one language have one hash."""
    return not counts.groupBy("lang", "h").count().where("count > 1").isEmpty()


def written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = common.shared_path(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def pair_counts(texts: DataFrame, seed: int, bits, least: int) -> DataFrame:
    """h, n: the hash of every pair of frequent words that may have least occurrences, and what they are at most."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in Tokens.read(it, Words(seed)):
            two = t.prefixes(2)[1][t.reach(bits.value) == 2]
            h, n = np.unique(two, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(h), pa.array(n, pa.int64())], names=["h", "n"])

    return texts.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def behind(texts: DataFrame, seed: int, bits, hot) -> DataFrame:
    """d, h, n: the hash of every three and four words behind a hot pair, and its occurrences or more."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in Tokens.read(it, Words(seed)):
            reach, prefix = t.reach(*bits.value), t.prefixes(LONGEST - 1)
            under = (reach > 2) & has(hot.value, prefix[1])
            for d in range(3, LONGEST):
                h, n = np.unique(prefix[d - 1][under & (reach >= d)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d, np.int32)), signed(h), pa.array(n, pa.int64())], names=["d", "h", "n"])

    return texts.mapInArrow(work, "d int, h long, n long").groupBy("d", "h").agg(F.sum("n").alias("n"))


def windows(texts: DataFrame, seed: int, bits, hot) -> DataFrame:
    """The occurrences of possible phrases, dealt into bins by their prefix. Packed are their words, 0 after the last, and how many are alike. depth: the prefix's
    words; prefixes of fewer are split over tasks. One more than all words where the whole occurrence is hot."""
    bins = max(BINS, 4 * common.partitions(texts.sparkSession))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in Tokens.read(it, Words(seed)):
            reach = t.reach(*bits.value)
            at = np.flatnonzero(reach > 1)
            if not len(at):
                continue
            words = np.r_[t.words, np.zeros(LONGEST, U)]
            cols = [np.where(reach[at] > k, words[at + k], U(0)) for k in range(LONGEST)]
            first, n = summed([t.lang[at], *cols])
            at = at[first]
            long, key, depth = reach[at].astype(np.int32), np.zeros(len(at), U), np.zeros(len(at), np.int32)
            prefix = t.prefixes(LONGEST)
            for d in range(2, LONGEST + 1):
                h = prefix[d - 1][at]
                spread = has(hot.value[d], h) if d in hot.value else np.full(len(at), d == LONGEST and LONGEST - 1 in hot.value)
                here = (depth == 0) & (~spread | (long == d))
                key[here], depth[here] = h[here], np.where(spread, d + 1, d)[here]
            bin_ = (key % U(bins)).astype(np.int32)
            order = np.argsort(bin_, kind="stable")  # by bin, language and words
            lang, bin_ = t.lang[at][order], bin_[order]
            edges = np.r_[0, np.flatnonzero((bin_[1:] != bin_[:-1]) | (lang[1:] != lang[:-1])) + 1, len(order)].tolist()
            packed = [x[order].astype(kind) for x, kind in zip((depth, *[c[first].view(np.int64) for c in cols], n), FIELDS.values(), strict=True)]
            starts = edges[:-1]
            out = [pa.array(bin_[starts]), pa.array(t.langs, pa.string()).take(pa.array(lang[starts]))]
            out += [pa.array([x[s:e].tobytes() for s, e in pairwise(edges)], pa.binary()) for x in packed]
            yield from pa.table(out, names=[x.split()[0] for x in WINDOW.split(", ")]).to_batches(2000)

    return texts.mapInArrow(work, WINDOW)


class Grower:
    """Phrases among the occurrences of one prefix after another, as rows of language, words and occurrences."""

    def __init__(self, lang: np.ndarray, depth: np.ndarray, words: list[np.ndarray], n: np.ndarray, least: int):
        self.lang, self.depth, self.words, self.n, self.least = lang, depth, words, n, least
        self.found: list[tuple[str, list[int], int]] = []

    def run(self) -> None:
        langs, number = np.unique(self.lang, return_inverse=True)
        order = np.lexsort((self.words[1], self.words[0], number))
        key = [c[order] for c in (number, self.words[0], self.words[1])]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key])) + 1
        edges = np.r_[0, change, len(order)]
        total = np.add.reduceat(self.n[order], edges[:-1])
        split = self.depth[order[edges[:-1]]] > 2
        for i in np.flatnonzero(split | (total >= self.least)).tolist():
            at = order[edges[i] : edges[i + 1]]
            self.grow(langs[number[at[0]]], [int(self.words[0][at[0]]), int(self.words[1][at[0]])], at)

    def grow(self, lang: str, prefix: list[int], at: np.ndarray) -> None:
        """at: the occurrences of prefix. Where it is split over tasks, what is here may be few."""
        self.found.append((lang, prefix, int(self.n[at].sum())))
        if len(prefix) == LONGEST:
            return
        after = self.words[len(prefix)][at]
        at, after = at[after != 0], after[after != 0]
        if not len(at):
            return
        order = np.argsort(after, kind="stable")
        at, after = at[order], after[order]
        edges = np.r_[0, np.flatnonzero(after[1:] != after[:-1]) + 1, len(at)]
        total = np.add.reduceat(self.n[at], edges[:-1])
        split = self.depth[at[edges[:-1]]] > len(prefix) + 1
        for i in np.flatnonzero(split | (total >= self.least)).tolist():
            self.grow(lang, [*prefix, int(after[edges[i]])], at[edges[i] : edges[i + 1]])


def grown(occurrences: DataFrame, least: int) -> DataFrame:
    """lang, ws, f: every phrase of two words or more with least occurrences."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def mine() -> Iterator[pa.RecordBatch]:
            cols = {x: np.frombuffer(b"".join([r[x] for r in held]), kind) for x, kind in FIELDS.items()}
            lang = np.repeat(np.array([r["lang"] for r in held], object), [len(r["depth"]) // 4 for r in held])
            g = Grower(lang, cols["depth"], [cols[f"w{i}"] for i in range(1, LONGEST + 1)], cols["n"], least)
            g.run()
            found = [*zip(*g.found, strict=True)] or [(), (), ()]
            yield from pa.table([pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["lang", "ws", "f"]).to_batches(20_000)

        for b in it:
            for r in b.to_pylist():
                if held and held[0]["bin"] != r["bin"]:
                    yield from mine()
                    held = []
                held.append(r)
        if held:
            yield from mine()

    rows = occurrences.repartition(common.partitions(occurrences.sparkSession), "bin").sortWithinPartitions("bin")
    return rows.mapInArrow(work, "lang string, ws array<long>, f long").groupBy("lang", "ws").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrases(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: lang, ws, f of every frequent phrase, single words too (ws: hashes); lang, h, word of every frequent word; lang, n."""
    spark = documents.sparkSession
    common.small_batches(spark)
    lang = F.coalesce(documents[lang_col].cast("string"), F.lit("und"))
    texts = documents.select(lang.alias("lang"), documents[text_col].cast("string").alias("text"))
    send = spark.sparkContext.broadcast
    for seed in range(64):
        try:
            counts = word_counts(texts, seed)
            break
        except Collision:
            continue
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = counts.where(F.col("n") >= least)
    bits = bitmap(frequent, "g")
    pairs = written(pair_counts(texts, seed, send(bits), least), "pairs")
    share = min(max(SHARE[0], (pairs.agg(F.sum("n")).first()[0] or 0) // (2 * common.partitions(spark))), SHARE[1])
    both = send((bits, bitmap(pairs, "h")))
    large = pairs.where(F.col("n") > share)
    hot = {2: bitmap(large, "h")}
    if not large.isEmpty():
        more = written(behind(texts, seed, both, send(hot[2])).where(F.col("n") > share), "behind")
        hot |= {d: bitmap(more.where(F.col("d") == d), "h") for d in range(3, LONGEST)}
    found = grown(windows(texts, seed, both, send(hot)), least)
    single = frequent.select("lang", F.array("h").alias("ws"), F.col("n").alias("f"))
    return written(found.unionByName(single), "phrases"), frequent.select("lang", "h", "word"), totals


def part(of: str, start: Column, size: Column) -> Column:
    return F.slice(F.col(of), start, size)


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, within: int = 100) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score. within: a phrase goes if a longer one around it has so many hundredths of its occurrences."""
    all_, words, totals = phrases(documents, text_col, lang_col, least)
    size = F.size("ws")
    candidates = all_.where(size > 1)
    # every contiguous part of two words or more, with the occurrences of the longer phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("ws", s, m))))
    inner = candidates.where(size > 2).select("lang", F.explode(spans).alias("ws"), "f").groupBy("lang", "ws").agg(F.max("f").alias("longer"))
    kept = candidates.join(inner, ["lang", "ws"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("f")))
    cuts = kept.select("lang", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", part("ws", F.lit(1), F.col("k"))).withColumn("right", part("ws", F.col("k") + 1, F.size("ws") - F.col("k")))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(all_.select("lang", F.col("ws").alias(side), F.col("f").alias(count)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    whole = "decimal(38,0)"
    score = F.expr(f"(1000BD * cast(a as {whole}) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")
    scored = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "ws", "a", "n").agg(F.min("cut").alias("cut"))
    spelt = scored.select("*", F.posexplode("ws").alias("at", "h")).join(words, ["lang", "h"])
    spelt = spelt.groupBy("lang", "ws", "a", "n", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelling"))
    rows = spelt.select("lang", F.array_join(F.col("spelling.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
