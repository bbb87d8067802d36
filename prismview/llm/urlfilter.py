"""URL filtering: rules by host and path, and for what no rule covers a naive Bayes score of the words in the URL.

Concatenated host names are split into words by a Viterbi search under a unigram model, whose counts come from the
words of all pages. The multinomial model is trained on all pages: a page whose host holds a seed word is an example
of what to block, the others of what to allow. Both models keep all words as distributed tables, to which the
substrings of host names and the words of URLs are joined, so no worker holds a model.

Words are runs of letters of any script. A word of a host name has at most LONGEST_WORD letters, which is what a label of a host name can hold; numbers
count as one word. A host without a dot is split as it is, of others the last label is left out.

Null url or one without "://": host and path are empty, no rule fits, and the method allows it. Null html: no words.
Null page_id: stays. Repeated rows: one result each. Ties: of equally likely splits the one with the longer last word; a score of zero allows.
Very long hosts: split whole. Extra columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a word in a host name: the most that a label can have.
LONGEST_WORD = 63
#: Fixed value: words of host names that mark what to block.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "track", "tracker", "viagra", "xxx")
#: The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """The most likely split of a name into words."""

    def __init__(self, counts: dict[str, int], total: int | None = None, seen: int | None = None):
        """total and seen: the sum and the greatest of all counts, where counts are a part of them."""
        total = (sum(counts.values()) if total is None else total) + 1
        seen = max(counts.values(), default=1) if seen is None else seen
        # seed words may be rare in running text; they count as common words
        self.cost = {w: -log(c / total) for w, c in (counts | {s: max(counts.get(s, 0), seen // 20 + 1) for s in SEEDS}).items()}
        self.base = log(total)
        self.memo: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if name not in self.memo:
            if len(self.memo) > 1 << 16:
                self.memo.clear()
            self.memo[name] = self.best(name)
        return self.memo[name]

    def best(self, name: str) -> tuple[str, ...]:
        if name[:1].isnumeric():
            return ("#",)
        best, back = [0.0] + [float("inf")] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST_WORD), end):
                w = name[start:end]
                # an unknown word costs more with each letter
                c = best[start] + self.cost.get(w, self.base + 2.3 * len(w) - 1)
                if c < best[end]:
                    best[end], back[end] = c, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def pieces_of(host: Column) -> Column:
    """The runs of letters, and of digits, in a host's labels, without the last label if there are several."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(host), r"\.[^.]*\z", ""), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))


def path_words(path: str) -> list[str]:
    return ["#" if t[0].isnumeric() else "/" + t for t in re.findall(r"[^\W\d_]+|\d+", path.lower())]


def counted(rows: DataFrame, tokens, keys: str) -> DataFrame:
    """Sums by key of Counters that tokens() makes of each batch; a batch's worth is combined before the shuffle."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def give() -> Iterator[pa.RecordBatch]:
            label, word = zip(*held, strict=True)
            yield from common.batches({"label": label, "word": word, "n": [*held.values()]}, pa.schema([("label", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))

        for b in it:
            held.update(tokens(b))
            if len(held) > 200_000:
                yield from give()
                held.clear()
        if held:
            yield from give()

    return rows.mapInArrow(work, "label int, word string, n long").groupBy(*keys.split()).agg(F.sum("n").alias("n"))


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word and n: all words of the pages' text, and how often they stand there."""
    tag, word = re.compile(r"<[^<>]*>"), re.compile(r"[^\W\d_]+")

    def tokens(b: pa.RecordBatch) -> Counter:
        out: Counter = Counter()
        for t in common.column(b, "html"):
            out.update(word.findall(tag.sub(" ", (t or "").lower())))
        return Counter({(0, w): n for w, n in out.items()})

    return common.checkpointed(counted(pages.select(pages[html_col].cast("string").alias("html")), tokens, "word"))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and words, for the distinct hosts: their pieces split under the unigram model counts(word, n)."""
    total, seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    parts = hosts.select("host", F.posexplode(pieces_of(F.col("host"))).alias("at", "piece"))
    pieces = parts.select("piece").distinct()

    def substrings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {"piece": [], "word": []}
            for piece in common.column(b, "piece"):
                if piece[0].isnumeric():
                    continue
                subs = {piece[i:j] for i in range(len(piece)) for j in range(i + 1, min(len(piece), i + LONGEST_WORD) + 1)}
                out["piece"] += [piece] * len(subs)
                out["word"] += subs
                if len(out["word"]) > 100_000:
                    yield from common.batches(out, pa.schema([("piece", pa.string()), ("word", pa.string())]))
                    out = {"piece": [], "word": []}
            yield from common.batches(out, pa.schema([("piece", pa.string()), ("word", pa.string())]))

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            known = common.column(b, "known")
            model = Segmenter({x["word"]: x["n"] for xs in known for x in xs or ()}, total, seen)
            piece = common.column(b, "piece")
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.string()), pa.array([list(model.best(x)) for x in piece], pa.list_(pa.string()))], names=["piece", "words"])

    # of a piece at most LONGEST_WORD words for each of its letters
    known = pieces.mapInArrow(substrings, "piece string, word string").join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    words = pieces.join(known, "piece", "left").mapInArrow(split, "piece string, words array<string>")
    by_host = parts.join(words, "piece").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(by_host, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


SMOOTHING = 0.5


def located(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def scores(urls: DataFrame) -> DataFrame:
    """host, path and score, the log odds of block against allow by multinomial naive Bayes, for urls(host, path, words, n)."""

    def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            path = common.column(b, "path")
            words = [[*w, *path_words(p)] for w, p in zip(common.column(b, "words"), path, strict=True)]
            label = [int(any(w in SEEDS for w in ws)) for ws in common.column(b, "words")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("host")), pa.array(path, pa.string()), b.column(b.schema.get_field_index("n")), pa.array(label, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["host", "path", "n", "label", "words"])

    rows = common.checkpointed(urls.mapInArrow(tokens, "host string, path string, n long, label int, words array<string>"))
    pages = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    each = rows.select("n", "label", F.explode("words").alias("word"))
    allow, block = (F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    by_word = common.checkpointed(each.groupBy("word").agg(allow.alias("allow"), block.alias("block")))
    size, *total = by_word.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()

    def share(n: str, k: int) -> Column:
        return F.log((F.col(n) + SMOOTHING) / F.lit(total[k] + SMOOTHING * (size + 2)))

    odds = by_word.select("word", (share("block", 1) - share("allow", 0)).alias("odds"))
    prior = log((pages.get(1, 0) + 1) / (pages.get(0, 0) + 1))
    # summed in the order of the words, so that the result is the same for any partitioning
    found = rows.select("host", "path", F.posexplode("words").alias("at", "word")).join(odds, "word")
    found = found.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("at", "odds"))).alias("odds"))
    found = found.select("host", "path", F.aggregate("odds", F.lit(0.0), lambda s, x: s + x["odds"]).alias("odds"))
    return rows.select("host", "path").join(found, ["host", "path"], "left").select("host", "path", (F.lit(prior) + F.coalesce("odds", F.lit(0.0))).alias("score"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block, where no rule fits) and host_words, for every row."""
    common.small_batches(pages.sparkSession)
    rows = located(pages)
    urls = common.checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    words = common.checkpointed(host_words(urls.select("host").distinct(), unigrams(pages)))
    urls = urls.join(words, "host")
    found = scores(urls).join(words, "host").select(F.col("host").alias("h"), F.col("path").alias("p"), "score", F.array_join("words", " ").alias("host_words"))
    score = F.when(F.col("rule").isNull() & ((F.col("host") != "") | (F.col("path") != "")), F.col("score"))
    rows = rows.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"), "host_words")
