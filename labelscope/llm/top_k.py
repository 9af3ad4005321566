"""Exact top-k inner products by norm buckets.

Vectors are sorted by length over the whole table and cut into buckets, longest first. A query
whose k-th score is s needs a cosine of s / (|q| * longest) with a vector of a bucket, its *local
threshold*. Above 1 the bucket cannot matter. A high one leaves narrow ranges for each coordinate
of a unit vector: the query takes the narrowest range among the coordinates that spread most in
the bucket (coordinate pruning). A low one rules out short vectors only: the query takes the
bucket's longest vectors up to the length that could reach s (length pruning). From which threshold
on coordinates are used is decided for each bucket from the spread of its coordinates. What is
left is verified by exact integer products.

Spark deals out the work: a first pass over the longest bucket gives every query a threshold; then
query blocks meet groups of buckets, without those pairs that the thresholds rule out, and a task
holds one group and a few query blocks, all of bounded bytes. It returns k rows a query at most.
Pruning never loses a result; how much it saves depends on the data, and without any the work
is one blocked product of the query set with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow, kept
from labelscope.session import ship_package

BLOCK_BYTES = 1 << 20  # of a bucket or a query block, or one vector if that is longer
GROUP = 8  # buckets, or query blocks, that a task takes at most
PART_BYTES = 1 << 24
FOCUS = 16  # coordinates of a bucket that are kept sorted
BROADCAST_ROWS = 500_000  # of bucket groups, 40 bytes each: 20 MB
HEADS = 32  # longest buckets, one per number of dimensions, that are broadcast
EXACT = 2.0**53  # products below this are exact in double precision
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min

_ROWS = "id bigint, dim int, length double, vec binary"
_BLOCKS = "dim int, part int, seq int, longest double, ids binary, vecs binary"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors as bytes, with their length."""
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            flat = np.clip(np.floor(1024.0 * flat), -1.7e308, 1.7e308)
        for i, id_ in enumerate(ids):
            v = flat[offsets[i] : offsets[i + 1]]
            peak = np.abs(v).max(initial=0.0)
            length = peak * float(np.linalg.norm(v / peak)) if peak else 0.0
            rows.append((id_, len(v), length, v.astype("<f8").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64(), pa.binary()))],
            names=["id", "dim", "length", "vec"]) if rows else pa.RecordBatch.from_pylist([], pa.schema(
                [("id", pa.int64()), ("dim", pa.int32()), ("length", pa.float64()), ("vec", pa.binary())]))


def _pack(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted vectors of one dimension as blocks of at most so many bytes."""
    from pyspark import TaskContext

    part, seq, held, size, longest, dim_held = TaskContext.get().partitionId(), 0, [], 0, 0.0, None

    def block() -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], dtype="<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([dim_held], pa.int32()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
             pa.array([longest]), pa.array([ids], pa.binary()), pa.array([b"".join(h[1] for h in held)], pa.binary())],
            names=["dim", "part", "seq", "longest", "ids", "vecs"])

    for batch in batches:
        for id_, dim, length, vec in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (dim != dim_held or size + len(vec) + 8 > most):
                yield block()
                seq, held, size = seq + 1, [], 0
            if not held:
                dim_held, longest = dim, length
            held.append((id_, vec))
            size += len(vec) + 8
            longest = max(longest, length)
    if held:
        yield block()


def blocked(rows: DataFrame, most: int, *order) -> DataFrame:
    """Rows in range order of the given columns as a table of blocks. Ranges end with the id, so
    any number of equal lengths is spread."""
    total = rows.agg(F.coalesce(F.sum(F.length("vec") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))
    return in_arrow(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), partial(_pack, most), _BLOCKS)


class Bucket:
    """One block of candidates, longest first."""

    def __init__(self, dim: int, ids: bytes, vecs: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.x = np.frombuffer(vecs, dtype="<f8").reshape(len(self.ids), dim)
        peak = np.abs(self.x).max(axis=1, initial=0.0)
        scaled = self.x / np.where(peak > 0, peak, 1.0)[:, None]
        lengths = peak * np.sqrt((scaled * scaled).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.x, self.lengths = self.ids[order], self.x[order], lengths[order]
        self.longest = float(self.lengths[0])
        self.unit = self.x / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        spread = self.unit.std(axis=0) if dim else np.zeros(0)
        self.focus = np.argsort(-spread, kind="stable")[:FOCUS]
        # Half the width of a coordinate's range is at most the sine of the local threshold's
        # angle: coordinates are worth it once that is below their own spread.
        typical = float(np.median(spread[self.focus])) if dim else 1.0
        self.edge = np.sqrt(max(0.0, 1.0 - typical * typical))
        self._sorted = None

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sorted is None:
            order = np.argsort(self.unit[:, self.focus], axis=0, kind="stable")
            self._sorted = order, np.take_along_axis(self.unit[:, self.focus], order, axis=0)
        return self._sorted


def products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows x with an integer vector or columns q, limited to
    what a long holds. `bound` is at least the largest of |x| * |q|."""
    if bound < EXACT:
        return np.rint(x @ q).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    columns = np.array([int(v) for v in q.ravel()], dtype=object).reshape(q.shape)
    found = np.asarray(exact @ columns, dtype=object)
    top = np.iinfo(np.int64).max
    return np.array([max(-top, min(top, int(v))) for v in found.ravel()], dtype=np.int64).reshape(found.shape)


class Queries:
    """One block of queries and the best they have found so far."""

    def __init__(self, dim: int, ids: bytes, vecs: bytes, k: int, floor: bytes | None = None):
        self.ids, self.k = np.frombuffer(ids, dtype="<i8"), k
        self.q = np.frombuffer(vecs, dtype="<f8").reshape(len(self.ids), dim)
        peak = np.abs(self.q).max(axis=1, initial=0.0)
        scaled = self.q / np.where(peak > 0, peak, 1.0)[:, None]
        self.lengths = peak * np.sqrt((scaled * scaled).sum(axis=1))
        self.unit = self.q / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.floor = np.full(len(self.ids), _NONE) if floor is None else np.frombuffer(floor, dtype="<i8").copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def cosines(self, longest: float) -> np.ndarray:
        """The local threshold of each query; -1 where any vector may still do."""
        reach = self.lengths * longest
        floor = self.floor.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, floor / reach, np.where(floor > 0, 2.0, -1.0))
        return np.where(self.floor == _NONE, -1.0, np.maximum(local - SLACK * np.abs(local), -1.0))

    def offer(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates for query i: the k best different ids stay, ties to the smaller id."""
        fit = (scores >= self.floor[i]) & (ids != self.ids[i])
        if not fit.any():
            return
        ids, scores = np.concatenate([self.best[i][0], ids[fit]]), np.concatenate([self.best[i][1], scores[fit]])
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        if len(first) < len(ids):  # an id with several vectors counts once, with its best
            first.sort()
            ids, scores = ids[first], scores[first]
        self.best[i] = ids[: self.k], scores[: self.k]
        if len(self.best[i][0]) == self.k:
            self.floor[i] = max(self.floor[i], self.best[i][1][-1])

    def search(self, bucket: Bucket) -> dict[str, int]:
        """Look through one bucket; how many queries skipped it or took which way."""
        local = self.cosines(bucket.longest)
        bound = float(self.lengths.max(initial=0.0)) * bucket.longest
        took = {"skipped": int((local > 1.0).sum()), "coordinate": 0, "length": 0, "verified": 0}
        by_length = local <= 1.0
        for i, candidates in self._by_coordinate(bucket, local):
            by_length[i] = False
            took["coordinate"] += 1
            took["verified"] += len(candidates)
            if len(candidates):
                self.offer(i, bucket.ids[candidates], products(bucket.x[candidates], self.q[i], bound))
        rest = np.flatnonzero(by_length)
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                least = np.where(local[rest] > 0, local[rest] * bucket.longest, 0.0)
            ends = np.searchsorted(-bucket.lengths, -least * (1 - SLACK), side="right")
            scores = products(bucket.x[: ends.max()], self.q[rest].T, bound)
            for column, (i, end) in enumerate(zip(rest, ends)):
                took["length"] += 1
                took["verified"] += int(end)
                self.offer(i, bucket.ids[:end], scores[:end, column])
        return took

    def _by_coordinate(self, bucket: Bucket, local: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Queries for which a coordinate leaves less than half the bucket, and what it leaves."""
        some = np.flatnonzero((local <= 1.0) & (local >= bucket.edge) & (local > 0))
        if not len(some) or not len(bucket.focus):
            return
        order, values = bucket.ranges()
        angle = np.arccos(np.clip(self.unit[some][:, bucket.focus], -1, 1))
        turn = np.arccos(np.clip(local[some], -1, 1))[:, None]
        low = np.cos(np.minimum(angle + turn, np.pi)) - SLACK
        high = np.cos(np.maximum(angle - turn, 0.0)) + SLACK
        first = np.stack([np.searchsorted(values[:, f], low[:, f], "left") for f in range(len(bucket.focus))], axis=1)
        last = np.stack([np.searchsorted(values[:, f], high[:, f], "right") for f in range(len(bucket.focus))], axis=1)
        width = last - first
        narrow = width.argmin(axis=1)
        for row, i in enumerate(some):
            f = narrow[row]
            if 2 * width[row, f] > len(bucket.ids):
                continue
            candidates = order[first[row, f] : last[row, f], f]
            near = bucket.unit[candidates][:, bucket.focus]
            yield i, candidates[((near >= low[row]) & (near <= high[row])).all(axis=1)]


def _thresholds(k: int):
    """Query blocks with the k-th score each query reaches in the longest bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            floors, least = [], []
            for row in frame.itertuples():
                block = Queries(row.dim, row.ids, row.vecs, k)
                block.search(Bucket(row.dim, row.head_ids, row.head_vecs))
                floors.append(block.floor.astype("<i8").tobytes())
                # The shortest longest vector that a bucket needs to matter to any of them.
                local = block.cosines(1.0) if len(block.floor) else np.zeros(0)
                least.append(float(np.where(block.floor > 0, local, 0.0).min(initial=np.inf)) * (1 - SLACK))
            made = frame[["dim", "part", "seq", "ids", "vecs"]].copy()
            made["floor"], made["needs"] = floors, least
            yield made

    return run


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        out = []
        buckets = buckets.sort_values(["longest", "part", "seq"], ascending=[False, True, True])
        made = [Bucket(b.dim, b.ids, b.vecs) for b in buckets.itertuples()]
        for row in queries.sort_values(["part", "seq"]).itertuples():
            block = Queries(row.dim, row.ids, row.vecs, k, row.floor)
            for bucket in made:
                block.search(bucket)
            for i, (ids, scores) in enumerate(block.best):
                out.append((np.full(len(ids), block.ids[i]), ids, scores))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = narrow.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    # Of repeated rows one is enough; this also thins a hot id before its ranges are cut.
    return in_arrow(good, _placed, _ROWS).dropDuplicates(["id", "vec"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best candidates of every query, ranked from 1.

    Components become floor(1024 * x) in double precision; the score is their integer inner
    product, limited to what a long holds. Candidates are the vectors of the query's dimension
    but for those under the query's own id; ties go to the smaller id. Vectors that are null or
    hold null or non-finite components, and rows without an id, take no part. Repeated rows count
    once; an id with several vectors counts with the best of them, as query and as candidate. A
    query with fewer candidates than k gets all, one with none no row. Vectors without components
    score 0. Empty tables give an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = kept(_usable(vectors, key, vector), "vectors")
    asked = kept(_usable(queries, key, vector), "query-vectors")
    buckets = kept(blocked(rows, block_bytes, F.col("dim"), F.col("length").desc(), F.col("id")), "buckets")
    blocks = blocked(asked, block_bytes, F.col("dim"), F.xxhash64("id"), F.col("id"))

    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("part", "seq"), F.struct("longest", -F.col("part"), -F.col("seq"))).alias("at"))
    heads = buckets.join(F.broadcast(longest) if longest.count() <= HEADS else longest, "dim").filter(
        (F.col("part") == F.col("at.part")) & (F.col("seq") == F.col("at.seq"))).select(
        "dim", F.col("ids").alias("head_ids"), F.col("vecs").alias("head_vecs"))
    if longest.count() <= HEADS:  # a block each: 32 MB at most
        heads = F.broadcast(heads)
    ready = kept(
        blocks.join(heads, "dim").mapInPandas(
            _thresholds(k), "dim int, part int, seq int, ids binary, vecs binary, floor binary, needs double"),
        "query-blocks")

    group, own = F.floor(F.col("seq") / GROUP).cast("int"), ["dim", "part", "seq"]
    sides = ready.withColumns({"qpart": F.col("part"), "qgroup": group})
    about = buckets.groupBy("dim", F.col("part").alias("bpart"), group.alias("bgroup")).agg(F.max("longest").alias("reach"))
    if about.count() <= BROADCAST_ROWS:
        about = F.broadcast(about)
    pairs = kept(
        sides.select(*own, "qpart", "qgroup", "needs").join(about, "dim")
        .filter(F.col("reach") >= F.col("needs")).drop("reach", "needs"), "block-pairs")
    meet = ["dim", "bpart", "bgroup", "qpart", "qgroup"]
    left = pairs.join(ready.drop("needs"), own)
    right = pairs.select(meet).distinct().join(
        buckets.withColumns({"bpart": F.col("part"), "bgroup": group}), ["dim", "bpart", "bgroup"])
    # The two sides come from the same tables: new columns keep their names apart.
    here = [F.col(c).alias(f"g_{c}") for c in meet]
    left = left.select(*here, *[F.col(c).alias(c) for c in ("dim", "part", "seq", "ids", "vecs", "floor")])
    there = [F.col(c).alias(f"b_{c}") for c in meet]
    right = right.select(*there, *[F.col(c).alias(c) for c in ("dim", "part", "seq", "longest", "ids", "vecs")])
    found = left.groupBy(*[f"g_{c}" for c in meet]).cogroup(right.groupBy(*[f"b_{c}" for c in meet])).applyInPandas(
        _search(k), "query_id bigint, vec_id bigint, score bigint")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
