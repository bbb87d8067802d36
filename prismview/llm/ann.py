"""Approximate nearest neighbours by adaptive dimension scans within probed lists.

Vectors are rotated by one random orthogonal matrix and lie in lists around centres, which are fitted on a
bounded sample. A list is kept in blocks of columns. For a query the partial inner products of the list's
vectors grow block by block. With the norms they give the squared distance so far, and since the rotation is random, the
share of a squared distance that lies in the first dimensions has a known mean and deviation (a beta distribution),
whatever the vectors. A candidate whose distance so far is EPSILON deviations beyond what the query's threshold
allows is abandoned. Survivors are scored on the original vectors in double precision, the
terms added in the order of dimensions, so equal vectors have equal scores.

A query probes the lists nearest to it, as many as the sample needs for the wanted recall. Lists beyond CHUNK
vectors are cut into chunks, which tasks take apart; a query meets each chunk of a probed list, and each gives
at most k rows. A query's threshold is tightened after each first block of columns, and what it has found so far is handed on to the next
chunk of its task. A query that finds less than k in its lists probes all of them. Every vector is indexed.

Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part. Ties: the smaller vec_id first. Null vec_id: takes no part. Rows are told apart by a number, not by their ids: of rows with one id each is a
candidate of all others, those with its id too, and each that asks is answered; query_row tells their answers apart. Fewer candidates than k: all of them. Empty table: no rows.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the centres are fitted on and the probes measured with, and sample queries; chosen by a hash of the id (about so many).
SAMPLE, SAMPLE_QUERIES = 20_000, 300
CHUNK = 16_384
#: Dimensions of a column block.
BLOCK = 16
#: Deviations beyond which a candidate is abandoned.
EPSILON = 3.0
#: Share of the sample's neighbours that the probed lists must hold.
TARGET = 0.97
#: Queries of a chunk that are answered together.
TOGETHER = 64
#: Queries whose thresholds a task remembers between chunks.
REMEMBERED = 1 << 18


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles, or floats if they are such) of the rows that take part."""
    v = F.col("v")
    kind = vectors.select(vectors[vector_col].alias("v")).schema["v"].dataType.simpleString()
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>" if kind == "array<float>" else "array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    big = 1.7976931348623157e308
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False)))


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of unit length by k-means on directions."""
    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit[rng.choice(len(unit), min(n, len(unit)), replace=False)].copy()
    for _ in range(rounds):
        a = np.argmax(unit @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, a, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    """How many of the nearest lists hold the target share of the neighbours of some of the sample's vectors."""
    a = np.argmax((x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T, axis=1)
    own = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
    q = x[own]
    s = q @ x.T
    s[np.arange(len(q)), own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    rank = np.take_along_axis(place, a[top], axis=1)
    share = np.cumsum(np.bincount(rank.ravel(), minlength=len(c))) / rank.size
    return int(min(np.searchsorted(share, target) + 1, len(c)))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products with rows of v, the terms added one dimension after another."""
    out = np.zeros(len(v))
    for d in range(len(q)):
        out += q[d] * v[:, d]
    return out


class Chunk:
    """Vectors of a list, rotated, in blocks of columns."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, turn: np.ndarray):
        self.ids, self.rows, self.v, dims = ids, rows, v, v.shape[1]
        rotated = np.ascontiguousarray((v @ turn.T).T)
        self.bounds = [*range(0, dims, BLOCK), dims]
        self.blocks = [rotated[a:b] for a, b in pairwise(self.bounds)]
        length = (v * v).sum(axis=1)
        head = np.zeros(len(v))
        #: for each block's end the share of a squared distance that may lie before it, and the vectors' own part of what their products must reach there
        self.shares, self.least = [], []
        for a, b in pairwise(self.bounds[:-1]):
            head = head + (rotated[a:b] ** 2).sum(axis=0)
            share = min(1.0, b / dims + EPSILON * np.sqrt(2 * b * (dims - b) / (dims * dims * (dims + 2))))
            self.shares.append(share)
            self.least.append((head - share * length - 1e-9 * (1 + length)) / 2)

    def answers(self, asking: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, known: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query what scan() gives. The first products of all queries come from one matrix product for each block, made when a query needs it."""
        rotated = queries @ turn.T
        made: list[np.ndarray] = []

        def products(block: int) -> np.ndarray:
            while len(made) <= block:
                i = len(made)
                own = rotated[:, self.bounds[i] : self.bounds[i + 1]] @ self.blocks[i]
                made.append(own + made[-1] if made else own)
            return made[block]

        for n, (asker, q) in enumerate(zip(asking.tolist(), queries, strict=True)):
            yield self.scan(q, rotated[n], lambda block, n=n: products(block)[n], asker, k, known[n])

    def scan(self, q: np.ndarray, q_rot: np.ndarray, products: Callable[[int], np.ndarray], asker: int, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best: their places and scores. products: of the dimensions up to a block's end with all vectors. known: a score that k vectors elsewhere reach."""
        dims, n, ids, rows = len(q), len(self.ids), self.ids, self.rows

        def whole(at: np.ndarray | slice) -> np.ndarray:
            return np.where(rows[at] == asker, -np.inf, self.v[at] @ q)

        # the threshold: the k-th best of some vectors, by their whole products
        sure = np.arange(min(n, max(4 * k, 64)))
        reached = whole(slice(len(sure)))
        few = n <= 8 * len(sure)
        best = np.argsort(-reached, kind="stable")[:k]
        sure, reached = sure[best], reached[best]
        live, length = None, q_rot @ q_rot
        for i, at in enumerate(self.bounds[1:-1]):
            if live is None:
                part, bound = products(i), self.least[i]
            else:
                part, bound = part + q_rot[self.bounds[i] : at] @ self.blocks[i][:, live], self.least[i][live]
            if i == 0 and not few:  # some that look near so far tighten it
                looks = part[:1024]
                more = np.flatnonzero(part >= np.partition(looks, len(looks) - 16)[len(looks) - 16])[: 4 * k]
                more = np.setdiff1d(more, sure)
                sure, reached = np.r_[sure, more], np.r_[reached, whole(more)]
                best = np.argsort(-reached, kind="stable")[:k]
                sure, reached = sure[best], reached[best]
            least = max(known, reached[k - 1] if len(reached) == k else -np.inf)
            if not np.isfinite(least):
                continue
            # the squared distance so far, q.q + head - 2 part, against its share of that at which a vector is just as good, length + x.x - 2 least
            own = q_rot[:at] @ q_rot[:at]
            keep = part - bound >= (own - self.shares[i] * (length - 2 * least)) / 2
            left = np.count_nonzero(keep)
            if live is not None:
                live, part = live[keep], part[keep]
            elif left < n // 4:  # few enough to gather their columns; else those of all come from the matrix product
                live, part = np.flatnonzero(keep), part[keep]
            if live is not None and len(live) <= 4 * k:
                break
        else:
            if live is None:
                part = products(len(self.blocks) - 1)
                least = max(known, reached[k - 1] if len(reached) == k else -np.inf)
                live = np.flatnonzero(part >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.arange(n)
                part = part[live]
            else:
                part = part + q_rot[self.bounds[-2] :] @ self.blocks[-1][:, live]
            others = rows[live] != asker
            live, part = live[others], part[others]
            if len(live) > k:  # part is the whole product, but for rounding
                cut = np.partition(part, len(part) - k)[len(part) - k]
                live = live[part >= cut - 1e-9 * (1 + abs(cut))]
        live = np.union1d(live[rows[live] != asker], sure[np.isfinite(reached)])
        s = scores(q, self.v[live])
        best = np.lexsort((ids[live], -s))[:k]
        return live[best], s[best]


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: for each row whose id is divisible by every, its k nearest others by inner product.

    query_row is the same in all answers of a row and in those of no other; it means nothing else.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, query_row long"
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("v") == dims)
    # about SAMPLE rows, told by their ids alone; the limit only holds back an id that repeats without end
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))
    sample = rows.where(share).limit(2 * SAMPLE).toPandas().sort_values("vec_id", kind="stable")
    x = np.stack(sample["v"].to_numpy()).astype(float)
    centres = fit_centres(x, int(min(max(8, np.sqrt(n) / 8), 4096, max(1, len(x) // 16))))
    probes = probes_needed(x, centres, k, target)
    turn = rotation(dims)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(unit @ centres.T, axis=1), pa.int32())], names=["vec_id", "v", "row", "list"])

    common.small_batches(spark, 2000)
    kind = rows.schema["v"].dataType.simpleString()
    # the numbers are made once and kept, so they stay whatever is computed again
    listed = common.checkpointed(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(assign, f"vec_id long, v {kind}, row long, list int"))
    # at most as many lists as centres; a list's chunks grow with it
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    chunks = {i: -(-s // CHUNK) for i, s in sizes.items()}
    count_of = F.create_map(*(F.lit(z) for i, c in sorted(chunks.items()) for z in (i, c)))
    members = listed.select("list", F.pmod(F.xxhash64("vec_id", "row"), count_of[F.col("list")]).cast("int").alias("chunk"), F.lit(False).alias("asks"), "vec_id", "row", "v")

    def probe(lists: int):
        def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if not b.num_rows:
                    continue
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :lists]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["vec_id", "v", "row", "lists"])

        return work

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, numbers, vs, chunk = None, [], [], [], None
        known: dict[int, float] = {}
        for b in it:
            key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("list", "chunk")])
            asks = b.column(b.schema.get_field_index("asks")).to_numpy(zero_copy_only=False)
            vec, row = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("vec_id", "row"))
            v = np.stack(b.column(b.schema.get_field_index("v")).to_numpy(zero_copy_only=False)).astype(float)
            out: list[tuple] = []
            # rows that are alike in list, chunk and in whether they ask stand together
            edge = np.r_[0, np.flatnonzero((np.diff(key) != 0).any(axis=0) | (asks[1:] != asks[:-1])) + 1, len(vec)]
            for a, z in pairwise(edge.tolist()):
                if (here := tuple(key[:, a].tolist())) != now:
                    now, ids, numbers, vs, chunk = here, [], [], [], None
                if not asks[a]:
                    ids.append(vec[a:z])
                    numbers.append(row[a:z])
                    vs.append(v[a:z])
                    continue
                if not ids:
                    continue
                if chunk is None:
                    chunk = Chunk(np.concatenate(ids), np.concatenate(numbers), np.concatenate(vs), turn)
                for at in range(a, z, TOGETHER):
                    asking, names = row[at : min(z, at + TOGETHER)], vec[at : min(z, at + TOGETHER)]
                    told = chunk.answers(asking, v[at : at + len(asking)], turn, k, [known.get(x, -np.inf) for x in asking.tolist()])
                    for asker, name, (place, s) in zip(asking.tolist(), names.tolist(), told, strict=True):
                        if len(s) == k:  # no vector below this is among the k best of all
                            if len(known) > REMEMBERED:
                                known.clear()
                            known[asker] = max(known.get(asker, -np.inf), float(s[-1]))
                        out += zip([name] * len(s), chunk.ids[place].tolist(), s.tolist(), [asker] * len(s), strict=True)
            if out:
                q, w, s, r = zip(*out, strict=True)
                yield from common.batches({"query_id": q, "vec_id": w, "score": s, "query_row": r}, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("query_row", pa.int64())]))

    def found(askers: DataFrame, lists: int) -> DataFrame:
        asking = askers.mapInArrow(probe(lists), f"vec_id long, v {kind}, row long, lists array<int>")
        asking = asking.select("vec_id", "row", "v", F.explode("lists").alias("list")).where(count_of[F.col("list")].isNotNull())
        asking = asking.select("list", F.explode(F.sequence(F.lit(0), count_of[F.col("list")] - 1)).alias("chunk"), F.lit(True).alias("asks"), "vec_id", "row", "v")
        both = members.unionByName(asking).repartition(common.partitions(spark), "list", "chunk").sortWithinPartitions("list", "chunk", "asks", "vec_id", "row")
        # at most k rows of each chunk; the window keeps k of each query before the shuffle too
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        rows = both.mapInArrow(answer, "query_id long, vec_id long, score double, query_row long")
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")

    askers = listed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "row")
    near = found(askers, probes)
    if probes == len(centres):
        return near
    near = common.checkpointed(near)
    full = near.where(F.col("rank") == k).select(F.col("query_row").alias("row"))
    short = common.checkpointed(askers.join(full, "row", "left_anti").select("vec_id", "v", "row"))
    if short.isEmpty():
        return near
    return near.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(found(short, len(centres)))
