"""Near-duplicates by SimHash, searched by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. If two fingerprints differ in at most r
bits and the partitions' thresholds t_i (-1: not probed) add up, as t_i + 1, to r + 1, then in some
partition they differ in at most t_i bits. The thresholds, and how many partitions there are, come
from a dynamic programme over estimated candidate counts, so a partition whose values are shared by
many fingerprints is probed little or not at all. Candidates meet in buckets (mask, value) and are
verified there.

Equal texts share a fingerprint, and links are searched between distinct fingerprints only, so a
group of copies costs one row. A bucket beyond BUCKET fingerprints is split by further bits, again by
the pigeonhole principle, until it fits or hardly any bits are left; no pair is lost. Within a bucket
only links that join further fingerprints to a component are given, not all pairs.

Null or empty text: fingerprint zero, linked like any other. Null doc_id: takes part, but never
names a component that has other ids. Repeated rows: one result each. Ties: a bit that half the shingles set is 0. Very long texts: all their shingles count.
Extra columns, whatever their names, are not read; keep_one() keeps them. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Fingerprints that one bucket may hold before it is split.
BUCKET = 8192
#: In a bucket up to this size all its links are given.
SMALL = 16
#: Cost of a probe against that of verifying a candidate.
PROBE_COST = 20.0


def fingerprint(text: bytes, k: int, seed: int) -> int:
    """The SimHash of one text in UTF-8."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < k:
        words = [b" ".join(words)]
        k = 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", key_type: str = "long") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    common.small_batches(documents.sparkSession)
    rows = documents.select(documents[id_col].cast(key_type).alias("doc_id"), documents[text_col].cast("string").alias("text"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = [signed(fingerprint((t or "").encode(), k, seed)) for t in common.column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(work, f"doc_id {key_type}, fp long")


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in it:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel())], names=["at", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for at, n in fps.select("fp").mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(BITS, BITS)


def correlated_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size; a group starts with the strongest pair left and takes the bits closest to it."""
    q = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(q, q)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = [*range(BITS)], []
    for g in range(m):
        size = len(left) // (m - g)
        sub = corr[np.ix_(left, left)]
        i, j = divmod(int(sub.argmax()), len(left))
        group = [left[i], left[j]] if i != j else [left[0]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        groups.append(sorted(group[:size]))
        left = [b for b in left if b not in groups[-1]]
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) == total of least cost; costs[i][s] is that of t_i = s - 1."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * total
    for c in costs:
        best = [min(((best[s - u][0] + c[u], [*best[s - u][1], u - 1]) for u in range(s + 1)), key=lambda x: x[0]) for s in range(total + 1)]
    return best[total]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def flips(bits: list[int], t: int) -> list[int]:
    """The masks that change at most t of the bits."""
    out = [0]
    for b in bits:
        out += [f | 1 << b for f in out if f.bit_count() < t]
    return out


def plan(fps: DataFrame, n: int, radius: int) -> tuple[list[tuple[list[int], int]], int]:
    """Partitions (bits, threshold) to probe, and an upper bound of a bucket's size."""
    both = co_occurrence(fps)
    q = np.diag(both) / max(n, 1)
    same = q * q + (1 - q) * (1 - q)
    choices = {m: correlated_groups(both, n, m) for m in range(2, radius + 2)}
    masks = [(m, i, mask_of(g)) for m, groups in choices.items() for i, g in enumerate(groups)]
    parts = F.explode(F.array(*(F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(k))).alias("value")) for m, i, k in masks)))
    counted = fps.select(parts.alias("s")).groupBy("s.part", "s.value").count()
    pairs = {r["part"]: (r["pairs"], r["most"]) for r in counted.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"), F.max("count").alias("most")).collect()}
    best: tuple[float, list[tuple[list[int], int]], int] | None = None
    for m, groups in choices.items():
        costs = []
        for i, g in enumerate(groups):
            # expected pairs at distance s over those at distance 0: elementary symmetric sums of the odds
            odds, e = (1 - same[g]) / same[g], np.zeros(radius + 2)
            e[0] = 1
            for x in odds:
                e[1:] = e[1:] + x * e[:-1]
            exact = pairs.get(m * 100 + i, (0.0, 0))[0] + 1
            costs.append([0.0] + [exact * e[: t + 1].sum() + PROBE_COST * n * (1 if t == 0 else len(flips(g, t))) for t in range(radius + 1)])
        cost, t = allocate(costs, radius + 1)
        if best is None or cost < best[0]:
            chosen = [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0]
            most = max(pairs.get(m * 100 + i, (0, 0))[1] * (1 if x == 0 else len(flips(g, x))) for i, (g, x) in enumerate(zip(groups, t, strict=True)) if x >= 0)
            best = (cost, chosen, most)
    assert best
    return best[1], best[2]


def bucket_links(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints that give their components under the radius: a search in breadth, each step against those not yet reached."""
    a, b = [], []
    left = np.arange(len(x))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= radius
            new = left[near]
            if len(new):
                a.append(np.repeat(i, len(new)))
                b.append(new)
                frontier.extend(new.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def verify(sigs: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the buckets of (mask, value, fp)."""
    sigs = sigs.repartition(common.partitions(sigs.sparkSession), "mask", "value").sortWithinPartitions("mask", "value", "fp")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def links(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) < 2:
                return
            keep = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]) | (fp[1:] != fp[:-1])]
            mask, value, fp = mask[keep], value[keep], fp[keep]
            start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            size = np.diff(np.r_[start, len(fp)])
            group = np.repeat(np.arange(len(start)), size)
            x = fp.astype(np.uint64)
            a, b = [], []
            small = np.repeat(size <= SMALL, size)
            for d in range(1, min(SMALL, len(x))):
                at = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
                if not len(at):
                    break
                at = at[np.bitwise_count(x[at] ^ x[at + d]) <= radius]
                a.append(fp[at])
                b.append(fp[at + d])
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                i, j = bucket_links(x[s : s + n], radius)
                a.append(fp[s + i])
                b.append(fp[s + j])
            if a and sum(map(len, a)):
                yield from common.batches({"a": np.concatenate(a), "b": np.concatenate(b)}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in it:
            held = [np.r_[h, batch.column(i).to_numpy(zero_copy_only=False)] for i, h in enumerate(held)]
            mask, value, _ = held
            # the last bucket may go on in the next batch
            inner = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = inner[-1] + 1 if len(inner) else 0
            if cut:
                yield from links(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield from links(*held)

    return sigs.select("mask", "value", "fp").mapInArrow(work, "a long, b long")


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps(fp) whose components are those of all pairs at most radius bits apart."""
    n = fps.count()
    spark = fps.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    chosen, most = plan(fps, n, radius)
    probes = [(signed(mask_of(g)), signed(f)) for g, t in chosen for f in flips(g, t)]
    sig = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseXOR(F.lit(f)).bitwiseAND(F.lit(k)).alias("value")) for k, f in probes)))
    sigs = fps.select(sig.alias("s"), "fp").select("s.mask", "s.value", "fp")
    used = {signed(mask_of(g)): [b for b in range(BITS) if b not in g] for g, _ in chosen}
    out: DataFrame | None = None
    while most > BUCKET and used:
        counts = sigs.groupBy("mask", "value").count().where(F.col("count") > BUCKET)
        counts = common.checkpointed(counts.select("mask", "value"))
        if counts.isEmpty():
            break
        small = sigs.join(counts, ["mask", "value"], "left_anti")
        out = small if out is None else out.unionByName(small)
        big = sigs.join(counts, ["mask", "value"], "left_semi")
        # in what is left of a bucket's bits, radius + 1 parts: in one of them any two that are near agree
        wider: dict[int, list[int]] = {}
        cases = []
        for k, rest in used.items():
            subs = [rest[i :: radius + 1] for i in range(radius + 1)]
            cases.append(F.when(F.col("mask") == k, F.array(*(F.lit(signed(mask_of(s))) for s in subs))))
            for s in subs:
                wider[signed((k & (1 << 64) - 1) | mask_of(s))] = [b for b in rest if b not in s]
        sub = F.explode(F.coalesce(*cases)).alias("sub")
        big = big.select("mask", "value", "fp", sub)
        sigs = common.checkpointed(big.select(F.col("mask").bitwiseOR(F.col("sub")).alias("mask"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("sub"))).alias("value"), "fp"))
        used = {k: rest for k, rest in wider.items() if len(rest) > 13}
    sigs = sigs if out is None else out.unionByName(sigs)
    return verify(sigs, radius).distinct()


def with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v.

    Rows of one u are dealt by v too, first for parts of the least, then for the join, so a node with very many links is no task's alone.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(4 * common.partitions(edges.sparkSession))))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    # a node has a row for each salt that it has, at most
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    least = least.select("u", F.least("m", "u").alias("m"), F.explode("salts").alias("salt"))
    return salted.join(least.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of links (a, b): alternating large and small stars.

    Rounds grow with the logarithm of the longest path.
    """
    edges = common.checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # what large holds of u is less than u, so m is the least of them
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = common.checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_duplicates(documents: DataFrame, radius: int = 3, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", key_type: str = "long") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links reach, for every row."""
    docs = common.checkpointed(fingerprints(documents, k, seed, id_col, text_col, key_type))
    named = common.checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = common.checkpointed(components(near_links(named.select("fp"), radius)))
    grouped = named.join(roots, named.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = grouped.join(ids, "root").select("fp", "component_id")
    return docs.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    """One document of each component, with all columns: the least doc_id, null last, of rows with that id the text of least hash; of rows equal in id and text a single one stays."""
    key, kept_key = common.unused(documents, "key"), common.unused(documents, "kept")
    keyed = documents.withColumn(key, common.row_key(documents["doc_id"], documents["text"]))
    kept = near_duplicates(keyed.select(key, "text"), radius, k, seed, key, key_type="decimal(38,0)").where("doc_id = component_id").select(F.col("doc_id").alias(kept_key)).distinct()
    first = keyed.join(kept, F.col(key) == F.col(kept_key), "left_semi")
    return first.dropDuplicates([key]).drop(key)
