"""Removal of repeated runs by winnowing over hashes of words.

A word goes if some window of MIN_WORDS words around it, at whatever word it starts, stands earlier: in a document
before, by doc_id, or before in the same document. So runs are found wherever they start and end, in the middle of lines too,
and to their last word, and no line feeds or punctuation matter. The first place keeps its text.

Every window selects a seed: of all SEED words in a row within it those with the least hash. Equal windows
select equal seeds, and windows that select one seed stand next to each other; their zone is all they hold. A zone that
stands earlier as a whole is cut as a whole. Where zones around one seed differ, matches are extended both ways: the windows of
each zone's first place are compared one by one.

Places travel as arrays in blobs: a task sends of each content its first place only and cuts its own later ones,
so a passage that a third of all documents hold gives one place for each task. Places meet by their seed. A seed that very
many different zones share, such as a phrase that stands everywhere in other words, is found by a count over all places; its places meet by
zone instead, and its zones are all compared window by window, as they'd be anyhow. Windows meet by their own hash. So no
task gets more than its share by a seed, and what is deleted doesn't depend on which seeds are split. The texts are shuffled once, by
row, and the three passes over them share that shuffle; the count reads them where they lie.

Runs shorter than MIN_WORDS stay, so a common sentence does no harm. Null text: stays null. Empty text: stays.
Null doc_id: counts as last. Rows of one doc_id with different texts are rows of their own, in the order of a hash; with the same
text they count as one place, so neither repeats the other. A document whose whole text repeats earlier ones is left with empty text.
Extra columns keep their names, whatever those are. Empty table: no rows. Of equal windows (ties) the one with the least doc_id, then the least word, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a window; a repeated run of so many is deleted.
MIN_WORDS = 40
#: Words of a seed, of MIN_WORDS: fewer make fewer seeds, but more of them repeat by chance.
SEED = 12
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: Places that a task holds before it sends them.
HELD = 1 << 19
#: A seed with this part of a task's mean share of the places, or more, is split.
HOT = 0.25
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*common.SPACES.encode()]] = True
CODES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
U = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[U(1), np.full(n, U(base))])


POWER, INVERSE = powers(BASE, PIECE), powers(pow(BASE, -1, 1 << 64), PIECE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (POWER, INVERSE) if n <= PIECE else (powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(31)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


def prefix_sums(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * power[: len(codes)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of what lies from begin up to end, by sums of hashes times powers."""
    return mixed((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def word_spans(x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes x of texts one after another, which begin at bound[:-1]."""
    inside = np.zeros(len(x) + 1, bool)
    np.logical_not(SEPARATOR[x], out=inside[:-1])
    edge = np.empty(len(x) + 1, bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    begin, end = at[::2], at[1::2]
    # a text's last word and the next text's first one may touch
    cut = bound[(bound > 0) & (bound < len(x))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    if len(cut):
        begin, end = np.sort(np.r_[begin, cut]), np.sort(np.r_[end, cut])
    return begin, end


class Texts:
    """The words of some texts, hashed."""

    def __init__(self, x: np.ndarray, bound: np.ndarray):
        begin, end = word_spans(x, bound)
        power, inverse = _powers(len(x))
        h = spans_hash(prefix_sums(CODES[x], power), inverse, begin, end)
        #: the first word of each text, then the number of words
        self.first = np.searchsorted(begin, bound)
        self.power, self.inverse = _powers(len(h))
        self.prefix = prefix_sums(h, self.power)

    def seeds(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of min_words words, wherever it starts, the least hash of a seed; and where windows begin a zone.

        A zone ends where the least hash changes, or where the window begins with its seed, which the next one
        lacks. Windows across texts are of no zone; they are told by their start.
        """
        length = max(1, min_words * SEED // MIN_WORDS)
        n = len(self.prefix) - 1
        place = np.arange(max(0, n - length + 1))
        content = spans_hash(self.prefix, self.inverse, place, place + length)
        least = sliding_min(content, min_words - length + 1) if n >= min_words else np.zeros(0, np.uint64)
        starts = np.ones(len(least), bool)
        if len(least):
            np.logical_or(least[1:] != least[:-1], content[: len(least) - 1] == least[:-1], out=starts[1:])
            starts[self.first[:-1][self.first[:-1] < len(least)]] = True
        return least, starts

    def inside(self, min_words: int) -> np.ndarray:
        """Which windows lie within one text."""
        out = np.ones(max(0, len(self.prefix) - min_words), bool)
        stop = self.first[1:]
        for k in range(1, min_words):
            at = stop - k
            out[at[(at >= 0) & (at < len(out))]] = False
        return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each begins, then their number; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(bound: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts from one up to another that together have about PIECE bytes."""
    at = 0
    while at < len(bound) - 1:
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + PIECE, "right")) - 1)
        yield at, to
        at = to


#: How a place is sent: two hashes of what stands there, its row, its first window's first word, how many windows.
PLACE = [("seed", np.uint64), ("zone", np.uint64), ("hi", np.int64), ("lo", np.int64), ("first", np.int32), ("n", np.int32)]
#: What is known of a place: its row, its first window's first word, how many windows, and whether they are to be compared one by one.
FOUND = [("hi", np.int64), ("lo", np.int64), ("first", np.int32), ("n", np.int32), ("open", np.uint8)]
Columns = dict[str, np.ndarray]


def packed(cols: Columns, kinds: list) -> bytes:
    return b"".join(cols[name].astype(kind, copy=False).tobytes() for name, kind in kinds)


def unpacked(blobs: list[bytes], kinds: list) -> Columns:
    """The columns of several blobs, joined."""
    size = sum(np.dtype(kind).itemsize for _, kind in kinds)
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in kinds}
    for blob in blobs:
        n, at = len(blob) // size, 0
        for name, kind in kinds:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in parts.items()}


def taken(cols: Columns, at: np.ndarray) -> Columns:
    return {name: x[at] for name, x in cols.items()}


def changes(*cols: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the one before."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for x in cols:
        out[1:] |= x[1:] != x[:-1]
    return out


def dealt(cols: Columns, key: np.ndarray, kinds: list, n: int, held: int) -> Iterator[tuple[int, int, bytes]]:
    """(partition, kind, blob) of the rows, dealt by key to n partitions."""
    part = (mixed(key) % U(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cols, part = taken(cols, order), part[order]
    at = np.r_[np.flatnonzero(changes(part)), len(part)].tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(part[a]), held, packed({k: x[a:b] for k, x in cols.items()}, kinds)


def row_hash(cols: Columns) -> np.ndarray:
    return cols["lo"].view(np.uint64) ^ mixed(cols["hi"].view(np.uint64))


BLOBS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
BLOB_TYPES = "part int, kind int, blob binary"


def _batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 1 << 22 or len(held) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), BLOBS, strict=True)], schema=BLOBS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), BLOBS, strict=True)], schema=BLOBS)


def is_hot(seed: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which seeds are among hot, in order."""
    if not len(hot):
        return np.zeros(len(seed), bool)
    return hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed


def meeting(cols: Columns, hot: np.ndarray | None) -> np.ndarray:
    """What places are dealt by: their seed, or their zone where the seed is hot or, without hot, everywhere."""
    by_zone = cols["zone"] ^ mixed(cols["seed"])
    return by_zone if hot is None else np.where(is_hot(cols["seed"], hot), by_zone, cols["seed"])


def first_places(cols: Columns, n: int, hot: np.ndarray | None) -> Iterator[tuple[int, int, bytes]]:
    """The first place of each content, dealt by meeting(), as kind 0; the later ones, dealt by row, as kind 1."""
    order = np.lexsort((cols["first"], cols["lo"], cols["hi"], cols["zone"], cols["seed"]))
    cols = taken(cols, order)
    new = changes(cols["seed"], cols["zone"])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ((cols["hi"] != cols["hi"][lead]) | (cols["lo"] != cols["lo"][lead]) | (cols["first"] != cols["first"][lead]))
    yield from dealt(sent := taken(cols, new), meeting(sent, hot), PLACE, n, 0)
    gone = taken(cols, later)
    gone["open"] = np.zeros(len(gone["n"]), np.uint8)
    yield from dealt(gone, row_hash(gone), FOUND, n, 1)


def found(b: pa.RecordBatch, min_words: int, single: bool) -> Iterator[Columns]:
    """The places in rows (hi, lo, text): of all zones or, where single, of the windows of the zones in opened."""
    col = lambda name: b.column(b.schema.get_field_index(name))
    x, bound = texts_of(col("text"))
    hi, lo = col("hi").to_numpy(), col("lo").to_numpy()
    opened = col("opened") if single else None
    for a, z in pieces(bound):
        t = Texts(x[bound[a] : bound[z]], bound[a : z + 1] - bound[a])
        least, starts = t.seeds(min_words)
        if single:
            # pairs of a zone's first window and its number of windows
            zones = [np.frombuffer(o.as_buffer(), np.int32).reshape(-1, 2) for o in opened[a:z]]
            row = np.repeat(np.arange(z - a), list(map(len, zones)))
            first, windows = np.concatenate([np.zeros((0, 2), np.int32), *zones]).astype(np.int64).T
            row, at = np.repeat(row, windows), np.cumsum(windows) - windows
            first = np.repeat(first - at, windows) + np.arange(len(row))
            start = t.first[row] + first
            count, end = np.ones(len(row), np.int32), start + min_words
        else:
            starts &= (inside := t.inside(min_words))
            start = np.flatnonzero(starts)
            stop = starts.copy()
            stop |= ~inside
            edge = np.r_[np.flatnonzero(stop), len(stop)]
            count = edge[np.searchsorted(edge, start) + 1] - start
            end = start + count - 1 + min_words
            row = np.searchsorted(t.first, start, "right") - 1
            first = start - t.first[row]
        zone = spans_hash(t.prefix, t.inverse, start, end)
        yield {"seed": least[start], "zone": zone, "hi": hi[a:z][row], "lo": lo[a:z][row], "first": first.astype(np.int32), "n": count.astype(np.int32)}


def collected(it: Iterator[pa.RecordBatch], min_words: int, single: bool) -> Iterator[Columns]:
    """The places, about HELD together."""
    held: list[Columns] = []
    for b in it:
        for cols in found(b, min_words, single):
            held.append(cols)
            if sum(len(x["n"]) for x in held) > HELD:
                yield {name: np.concatenate([x[name] for x in held]) for name, _ in PLACE}
                held.clear()
    if held:
        yield {name: np.concatenate([x[name] for x in held]) for name, _ in PLACE}


def hot_seeds(documents: DataFrame, min_words: int, n: int, text_col: str = "text") -> np.ndarray:
    """In order, the seeds with HOT / n of the places sent, or more; 2 * n / HOT at most.

    A task names the seeds with half of that share of what it sends at once, so of a seed with the whole share at least half is counted.
    """
    share = HOT / n / 2

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in collected(it, min_words, False):
            order = np.lexsort((cols["zone"], cols["seed"]))
            new = changes(cols["seed"][order], cols["zone"][order])
            seed, count = np.unique(cols["seed"][order][new], return_counts=True)
            named = count >= share * count.sum()
            yield pa.RecordBatch.from_arrays([pa.array([*seed[named].view(np.int64).tolist(), None], pa.int64()), pa.array([*count[named].tolist(), int(count.sum())], pa.int64())], names=["seed", "n"])

    texts = documents.select(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), documents[text_col].cast("string").alias("text"))
    counts = common.checkpointed(texts.mapInArrow(work, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")))
    total = counts.where("seed IS NULL").select("n").first()
    named = counts.where(F.col("seed").isNotNull() & (F.col("n") >= F.greatest(F.lit(2.0), F.lit(share * (total["n"] if total else 0))))).select("seed").collect()
    return np.sort(np.array([r["seed"] for r in named], np.int64).view(np.uint64))


def places(rows: DataFrame, min_words: int, n: int, single: bool, hot: np.ndarray | None) -> DataFrame:
    """Blobs of found()."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in collected(it, min_words, single):
            yield from _batches(first_places(cols, n, hot))

    return rows.mapInArrow(work, BLOB_TYPES)


def compared(blobs: DataFrame, n: int, hot: np.ndarray | None) -> DataFrame:
    """Blobs of what is known of places, dealt by row: whatever has its content earlier; and the first places around a seed that has several contents or is hot, as open."""

    def judged(cols: Columns) -> Columns:
        order = np.argsort(cols["seed"], kind="stable")
        seed = cols["seed"][order]
        new = np.r_[changes(seed), True]
        split = is_hot(seed, hot if hot is not None else seed[:0])
        cols = taken(cols, order[~(new[1:] & new[:-1]) | split])  # what stands more than once
        order = np.lexsort((cols["first"], cols["lo"], cols["hi"], cols["zone"], cols["seed"]))
        cols = taken(cols, order)
        seed, zone = changes(cols["seed"]), changes(cols["seed"], cols["zone"])
        lead = np.flatnonzero(zone)[np.cumsum(zone) - 1]
        later = (cols["hi"] != cols["hi"][lead]) | (cols["lo"] != cols["lo"][lead]) | (cols["first"] != cols["first"][lead])
        group = np.cumsum(seed) - 1
        several = np.bincount(group[zone], minlength=len(group[-1:]) and group[-1] + 1) > 1
        if hot is not None:
            several[group[is_hot(cols["seed"], hot)]] = True
        open_ = zone & several[group]
        out = taken(cols, later | open_)
        out["open"] = open_[later | open_].astype(np.uint8)
        return out

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in it:
            rows = [*zip(*(common.column(b, c) for c in BLOBS.names), strict=True)]
            held += [blob for _, kind, blob in rows if kind == 0]
            # places that a task has found to be later itself are dealt by row already
            yield from _batches((part, 0, blob) for part, kind, blob in rows if kind)
        if held:
            out = judged(unpacked(held, PLACE))
            yield from _batches(dealt(out, row_hash(out), FOUND, n, 0))

    return blobs.repartitionById(n, "part").mapInArrow(work, BLOB_TYPES)


def by_row(blobs: DataFrame, n: int, min_words: int) -> DataFrame:
    """For each row of which something is known: row_hi, row_lo, runs (what is later, from word to word) and opened (first windows and numbers of windows)."""
    schema = pa.schema([("row_hi", pa.int64()), ("row_lo", pa.int64()), ("runs", pa.binary()), ("opened", pa.binary())])

    def gathered(pairs: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
        offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))] * 8
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(pairs, np.int32))])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in it for x in common.column(b, "blob")]
        if not held:
            return
        cols = unpacked(held, FOUND)
        cols = taken(cols, np.lexsort((cols["open"], cols["first"], cols["lo"], cols["hi"])))
        row = changes(cols["hi"], cols["lo"])
        owner = np.cumsum(row) - 1
        rows = int(row.sum())
        is_open = cols["open"] == 1
        opened = np.stack([cols["first"], cols["n"]], axis=1)[is_open]
        first, who = cols["first"][~is_open].astype(np.int64), owner[~is_open]
        end = first + cols["n"][~is_open] - 1 + min_words
        # zones that begin later end later, so a run ends where the next zone begins beyond the last end
        new = changes(who)
        new[1:] |= first[1:] > end[:-1]
        last = np.flatnonzero(np.r_[new[1:], True][: len(new)])
        runs = np.stack([first[new], end[last]], axis=1)
        out = pa.RecordBatch.from_arrays([pa.array(cols["hi"][row]), pa.array(cols["lo"][row]), gathered(runs, who[new], rows).cast(pa.binary()), gathered(opened, owner[is_open], rows).cast(pa.binary())], schema=schema)
        for at in range(0, rows, 20_000):
            yield out.slice(at, 20_000)

    return blobs.repartitionById(n, "part").mapInArrow(work, "row_hi long, row_lo long, runs binary, opened binary")


def keyed(documents: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """hi, lo (the place of a row in order: its doc_id, null last, then a hash of its text), text and rest, the other columns; dealt by hi and lo."""
    text = documents[text_col].cast("string")
    hi = F.coalesce(documents[id_col].cast("long"), F.lit(LAST))
    # one more field, of a name that no other has, for tables without other columns
    others = F.struct(F.lit(0).alias("_" * (1 + max(map(len, rest), default=0))), *(documents[c] for c in rest))
    return documents.select(hi.alias("hi"), F.xxhash64(text).alias("lo"), text.alias("text"), others.alias("rest")).repartition(common.partitions(documents.sparkSession), "hi", "lo")


def _cut(documents: DataFrame, min_words: int, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """keyed(), with what stands earlier in the table or in the document: runs, and more, which may overlap them."""
    spark = documents.sparkSession
    common.small_batches(spark)
    n = common.partitions(spark)
    rows = keyed(documents, id_col, text_col, rest)
    hot = hot_seeds(documents, min_words, n, text_col)
    known = by_row(compared(places(rows, min_words, n, False, hot), n, hot), n, min_words)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        # the right side has one row at most for each of the left's, and is small against its text
        return left.join(right.hint("shuffle_hash"), (F.col("hi") == F.col("row_hi")) & (F.col("lo") == F.col("row_lo")), how).drop("row_hi", "row_lo")

    asked = joined(rows, known.where(F.octet_length("opened") > 0), "inner")
    more = by_row(compared(places(asked, min_words, n, True, None), n, None), n, min_words)
    out = joined(rows, known.drop("opened"), "left")
    return joined(out, more.select("row_hi", "row_lo", F.col("runs").alias("more")), "left")


def union(a: bytes | None, b: bytes | None) -> np.ndarray:
    """The runs of both, joined where they meet or overlap."""
    runs = np.frombuffer((a or b"") + (b or b""), np.int32).reshape(-1, 2)
    if not (a and b):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 1])
    new = np.r_[True, runs[1:, 0] > end[:-1]]
    return np.stack([runs[new, 0], end[np.r_[new[1:], True]]], axis=1)


def cut_runs(text: bytes, begin: np.ndarray, end: np.ndarray, runs: np.ndarray) -> bytes:
    """The text without the runs of words; words lie from begin up to end."""
    out, at = [], 0
    for first, stop in runs.tolist():
        out.append(text[at : begin[first]])
        at = int(end[stop - 1])
        if stop < len(begin):  # one of the separators is enough, and a line feed rather than a space
            if first == 0 or b"\n" not in text[at : begin[stop]]:
                at = int(begin[stop])
            else:
                out[-1] = out[-1].rstrip(common.SPACES.encode())
    out.append(text[at:])
    joined = b"".join(out)
    return joined if joined.strip(common.SPACES.encode()) else b""


def _remaining(b: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
    """Of each row the text that is left (null: as it was), how many runs went and how many words."""
    runs, more = common.column(b, "runs"), common.column(b, "more")
    text = b.column(b.schema.get_field_index("text"))
    n, words, out = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64), []
    for i, (r, m) in enumerate(zip(runs, more, strict=True)):
        spans = union(r, m)
        if not len(spans):
            out.append(text[i].as_py())
            continue
        raw = text[i].as_buffer().to_pybytes()
        begin, end = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        n[i], words[i] = len(spans), int((spans[:, 1] - spans[:, 0]).sum())
        out.append(cut_runs(raw, begin, end, spans).decode())
    return out, n, words


def dedup(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without later repeated runs, n_runs and n_removed_words, for every row."""
    rows = _cut(documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].alias("text")), min_words, "doc_id", "text", ["doc_id"])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, n, gone = _remaining(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("rest")).field("doc_id"), pa.array(texts, pa.string()), pa.array(n), pa.array(gone)], names=["doc_id", "text", "n_runs", "n_removed_words"])

    return rows.mapInArrow(work, "doc_id long, text string, n_runs long, n_removed_words long")


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents, with all columns, less the later repeated runs; documents of which nothing is left go."""
    names = documents.columns
    rows = _cut(documents, min_words, "doc_id", "text", [c for c in names if c != "text"])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, n, _ = _remaining(b)
            rest = b.column(b.schema.get_field_index("rest"))
            kept = pa.array([not k or bool(t) for t, k in zip(texts, n.tolist(), strict=True)], pa.bool_())
            others = dict(zip([f.name for f in rest.type], rest.flatten(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else others[c] for c in names], names=names).filter(kept)

    return rows.mapInArrow(work, documents.schema)
