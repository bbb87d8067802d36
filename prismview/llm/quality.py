"""Quality rules: how far a document's character classes and common words lie from its language's.

References are medians over all documents of a language, so neither long documents nor any share
of junk below a half can bend them. A document is compared by Jensen-Shannon distance
(base 2, so between 0 and 1), and only where it is long enough for its histogram to mean something.

Common words are the ones in most documents of the language, by exact counts over all documents.

A language with few documents says little, so its reference is drawn towards that of all documents: of n documents the language counts n / (n + PRIOR). Limits
for common words, which have no counterpart in all documents, loosen in the same measure. So verdicts change by degrees as tables grow, and at no number of documents at once.

Null text: no words, so base_failed. Null lang: a language of its own. What is sent to every worker is bounded by MAX_LANGS references; the
character classes of documents of further languages are compared with those of all documents.
Repeated rows: one result each. Ties: of words that equally many documents hold the lesser one, by bytes. Very long texts: counted whole, in pieces.
Empty table: no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Character classes of bytes in UTF-8. Letters beyond ASCII count with the lower-case letters: a quotation in another language is
#: no sign of junk. Continuation bytes count for nothing.
CLASSES = ("lower", "upper", "space", "sentence", "symbol", "control", "digit")
SENTENCE = b".,;:!?'\"-()"
N_COMMON = 48
#: Languages that may have a reference of their own, those with the most documents.
MAX_LANGS = 2000
#: Documents for which the reference of all documents counts in that of a language.
PRIOR = 20
#: Different words, or shares, that a task counts before it sends them on.
HELD = 200_000
#: Stands for the language of all documents; their reference has character classes only.
ANY = "\x00any"
#: Steps in which a share of a histogram is counted.
BINS = 1000


@dataclass(frozen=True)
class Limits:
    """Distances beyond which a document is rejected, and the lengths from which they are applied."""

    max_char: float = 0.17
    #: the same with digits as a class of their own; in max_char they count as letters, since a number or an address is no sign of junk
    max_digit: float = 0.4
    min_chars: int = 150
    #: at full weight of the language
    max_word: float = 0.45
    min_words: int = 40
    #: least share of common words in a text, as a part of the language's usual share
    min_common: float = 0.5


def class_table() -> bytes:
    out = bytearray(256)
    for b in range(256):
        c = bytes([b])
        out[b] = 0 if c.islower() or b >= 0xC0 else 6 if c.isdigit() else 1 if c.isupper() else 2 if c in b" \t\n\x0b\x0c\r" else 3 if c in SENTENCE else 5 if b < 32 or b == 127 else 4 if b < 128 else 7
    return bytes(out)


TABLE = class_table()


def char_histogram(raw: bytes) -> np.ndarray:
    out = np.zeros(len(CLASSES) + 1, np.int64)
    for at in range(0, len(raw), 1 << 20):
        out += np.bincount(np.frombuffer(raw[at : at + (1 << 20)].translate(TABLE), np.uint8), minlength=len(out))
    return out[:-1]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, to base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of width words that the text holds twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.r_[s[1:] == s[:-1], False]
    twin[1:] |= twin[:-1].copy()
    if not twin.any():
        return 0
    at = np.sort(order[twin])
    small = ids.astype(np.uint32)
    keys = [small[i : i + width].tobytes() for i in at.tolist()]  # the hash only chooses what to compare
    count = Counter(keys)
    at = np.array([i for i, k in zip(at.tolist(), keys, strict=True) if count[k] > 1], np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def base(text: str) -> tuple[tuple[int, int, int, int, int], list[bytes], bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words; the text in UTF-8."""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(common.SPACES):
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, common.SPACES))
    return (len(words), chars, sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words)), words, raw


@dataclass
class Reference:
    chars: np.ndarray
    words: list[bytes]
    shares: np.ndarray
    #: how far the language's documents count
    weight: float = 1.0
    position: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.position = {w: i for i, w in enumerate(self.words)}


def lowered(words: list[bytes]) -> list[bytes]:
    return b" ".join(words).lower().split(b" ") if words else []


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n): how many documents hold a word, combined over about HELD different words. Word null: how many documents there are."""
    held: dict[str | None, Counter] = {}

    def give() -> Iterator[pa.RecordBatch]:
        lang, word, n = zip(*((lang, w, n) for lang, c in held.items() for w, n in c.items()), strict=True)
        yield from common.batches({"lang": lang, "word": word, "n": n}, pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]))
        held.clear()

    for b in it:
        for lang, text in zip(common.column(b, "lang"), common.column(b, "text"), strict=True):
            held.setdefault(lang, Counter()).update({*(text or "").encode().lower().split(), None})
        if sum(map(len, held.values())) > HELD:
            yield from give()
    if held:
        yield from give()


def references(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str | None, Reference]:
    """By language, for at most MAX_LANGS of N_COMMON words each. And by ANY what all documents have in common."""
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = documents.select(documents[lang_col].cast("string").alias("lang"), documents[text_col].cast("string").alias("text"))
    counts = common.checkpointed(rows.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    known = counts.where("word IS NULL").select("lang", "n")
    langs = {r["lang"] for r in known.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    chosen = spark.createDataFrame([(lang,) for lang in langs], "l string")
    # exact: each language's words stand once here, and a task keeps N_COMMON of each before they meet
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = counts.where("word IS NOT NULL").join(F.broadcast(chosen), F.col("lang").eqNullSafe(F.col("l"))).withColumn("place", place).where(F.col("place") <= N_COMMON)
    common_words: dict[str | None, list[bytes]] = {lang: [] for lang in langs} | {ANY: []}
    for r in words.select("lang", "word", "place").orderBy("place").collect():
        common_words[r["lang"]].append(bytes(r["word"]))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: {w: i for i, w in enumerate(ws, len(CLASSES))} for lang, ws in common_words.items()}
        # how many documents have a share: of each class, then of each word that they hold
        held: Counter = Counter()

        def give() -> Iterator[pa.RecordBatch]:
            lang, feature, at = zip(*held, strict=True)
            yield from common.batches({"lang": lang, "feature": feature, "bin": at, "n": [*held.values()]}, pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))
            held.clear()

        for b in it:
            for lang, text in zip(common.column(b, "lang"), common.column(b, "text"), strict=True):
                raw = (text or "").encode()
                if not raw.strip():
                    continue
                h = char_histogram(raw)
                share = [*enumerate(((h * BINS + h.sum() // 2) // h.sum()).tolist())]
                held.update((ANY, *x) for x in share)
                if lang in place and lang != ANY:
                    words, known = raw.lower().split(), place[lang]
                    share += [(known[w], -(-n * BINS // len(words))) for w, n in Counter(w for w in words if w in known).items()]
                    held.update((lang, *x) for x in share)
            if len(held) > HELD:
                yield from give()
        if held:
            yield from give()

    shares = rows.mapInArrow(work, "lang string, feature int, bin int, n long").groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))
    # a feature has at most BINS + 1 rows now; the median is the bin that holds the middle document, those without a word at zero
    shares = common.checkpointed(shares)
    totals = shares.where("feature = 0").groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("documents"))
    by_feature = shares.groupBy("lang", "feature").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("less"), "n"))).alias("bins"))
    by_feature = by_feature.join(totals, F.col("lang").eqNullSafe(F.col("l")))
    # from the greatest share down until half of the documents have as much
    middle = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("bin")), lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.when(s["n"] * 2 <= F.col("documents"), -x["less"]).otherwise(s["bin"]).alias("bin")))
    found: dict[str | None, dict[int, float]] = {}
    number: dict[str | None, int] = {}
    for r in by_feature.select("lang", "feature", "documents", middle.alias("m")).collect():
        number[r["lang"]] = r["documents"]
        found.setdefault(r["lang"], {})[r["feature"]] = r["m"]["bin"] / BINS if r["m"]["n"] * 2 > r["documents"] else 0.0
    out = {}
    all_chars = np.array([found.get(ANY, {}).get(i, 0.0) for i in range(len(CLASSES))])
    for lang, x in found.items():
        ws = common_words[lang]
        weight = 1.0 if lang == ANY else number[lang] / (number[lang] + PRIOR)
        share = np.array([x.get(i, 0.0) for i in range(len(CLASSES), len(CLASSES) + len(ws))])
        out[lang] = Reference(weight * np.array([x.get(i, 0.0) for i in range(len(CLASSES))]) + (1 - weight) * all_chars, ws, np.r_[share, max(0.0, 1 - share.sum())], weight)
    return out


def with_digits_as_letters(h: np.ndarray) -> np.ndarray:
    return np.r_[h[0] + h[6], h[1:6]]


def distances(raw: bytes, words: list[bytes], ref: Reference) -> tuple[float, float, float, float]:
    """Of the character classes, with digits as letters and as digits, and of the common words, with all other words as one; and the share of common words."""
    own = np.zeros(len(ref.words) + 1)
    known = ref.position
    low = lowered(words)
    for w, n in Counter(w for w in low if w in known).items():
        own[known[w]] = n
    common_words = own.sum()
    own[-1] = len(words) - common_words
    chars = char_histogram(raw).astype(float)
    return js_distance(with_digits_as_letters(chars), with_digits_as_letters(ref.chars)), js_distance(chars, ref.chars), js_distance(own, ref.shares), float(common_words / len(words))


def judge(text: str | None, lang: str | None, refs: dict[str | None, Reference], limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, digit_distance, word_distance, common_share (null where not compared)."""
    counts, words, raw = base(text or "")
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    char = digit = word = share = None
    lacking = False
    if (ref := refs.get(lang) or refs.get(ANY)) and words:
        c, d, w, common_share = distances(raw, words, ref)
        if counts[1] >= limits.min_chars:
            char, digit = c, d
        if ref.words and counts[0] >= limits.min_words:
            # the distance alone cannot tell a text without any common word, as all other words are one bin
            word, share = w, common_share
            lacking = share < ref.weight * limits.min_common * (1 - ref.shares[-1])
    kept = not failed and not lacking and not (char is not None and (char > limits.max_char or digit > limits.max_digit)) and not (word is not None and word > 1 - ref.weight * (1 - limits.max_word))
    return (*counts, failed, bool(kept), char, digit, word, share)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, digit_distance double, word_distance double, common_share double"


def score(documents: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The counts, distances and verdict of every document."""
    refs = references(documents, lang_col, text_col)
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[lang_col].cast("string").alias("lang"), documents[text_col].cast("string").alias("text"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in it:
            got = [judge(t, lang, refs, limits) for lang, t in zip(common.column(b, "lang"), common.column(b, "text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=names)

    return rows.mapInArrow(work, SCHEMA)


def keep(documents: DataFrame, limits: Limits = Limits(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    refs = references(documents, lang_col, text_col)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            mask = [judge(t, None if lang is None else str(lang), refs, limits)[6] for lang, t in zip(common.column(b, lang_col), common.column(b, text_col), strict=True)]
            yield b.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(work, documents.schema)
