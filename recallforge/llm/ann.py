"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to unit length, rotated by a random orthogonal matrix and
stored as the signs of its coordinates with two scalars: its inner product with
its own code, and its norm.  A query, rotated and quantised to eight bits,
meets the packed bits by population counts; the ratio to the first scalar
estimates the cosine without bias, with an error bound that holds with high
probability.  Only vectors whose upper bound reaches the query's present k-th
cosine are read in full and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, portions, staged

QUERY_BITS = 8
BOUND = 2.6
BLOCK = 2048
WAVE = 8
SLICE = 1024


def rotation(width: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right, so that equal rows have equal sums in any batch."""
    return np.cumsum(x, axis=1)[:, -1]


def _width(dim: int) -> int:
    return 64 * math.ceil(dim / 64)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1).view(np.uint64)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, inner products of unit vectors with their codes, and norms."""
    norm = np.sqrt(_sums(x * x))
    unit = np.zeros((len(x), len(turn)))
    unit[:, : x.shape[1]] = x / norm[:, None]
    turned = unit @ turn
    return _pack(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(len(turn)), norm


class Queries:
    """A block of queries, rotated and quantised into bit planes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray):
        self.ids, self.x = ids, x
        self.norm = np.sqrt(_sums(x * x))
        unit = np.zeros((len(x), len(turn)))
        unit[:, : x.shape[1]] = x / self.norm[:, None]
        turned = unit @ turn
        self.width = len(turn)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-300) / (2**QUERY_BITS - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = level.sum(axis=1, dtype=np.int64) * self.step + self.width * self.low
        self.planes = [_pack(level >> b & 1) for b in range(QUERY_BITS)]

    def bounds(self, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the cosines (codes x queries) and their upper bounds."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        hits = np.zeros((len(codes), len(self.ids)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(codes[:, w, None] & plane[None, :, w]).astype(np.int32) << b
        dot = 2 * (hits * self.step + ones[:, None] * self.low) - self.total
        estimate = dot / (math.sqrt(self.width) * own[:, None])
        spread = BOUND * np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * max(1, self.width - 1)))
        return estimate, estimate + spread[:, None] + (self.step * math.sqrt(self.width) / 2)[None, :] / own[:, None]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): vectors that are not null or zero and hold finite numbers only, with an id."""
    x = F.col(vec_col).cast("array<double>")
    fit = F.size(x) > 0
    fit &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(fit)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _same_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose vectors in ``x`` have one length each."""
    for b in portions(batches):
        width = pc.list_value_length(b.column("x")).to_numpy()
        for w in np.unique(width):
            yield b if (width == w).all() else b.filter(pa.array(width == w))


def build_index(rows: DataFrame, seed: int = 5) -> DataFrame:
    """(id, x, width, code, own, norm) for every row of (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in _same_width(batches):
            x = _matrix(b.column("x"))
            wide = _width(x.shape[1])
            if wide not in turns:
                turns[wide] = rotation(wide, seed)
            codes, own, norm = encode(x, turns[wide])
            width = pa.array(np.full(len(x), x.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), width, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own), pa.array(norm)], ["id", "x", "width", "code", "own", "norm"])

    return staged(rows.mapInArrow(run, "id long, x array<double>, width int, code binary, own double, norm double"), "ann-index")


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], score[rank < k], ids[rank < k]


def _scan(block: Queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, score, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        least = np.full(len(block.ids), -np.inf)

        def exact(x: np.ndarray, norm: np.ndarray, own_ids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
            nonlocal q, score, ids
            other = own_ids[rows] != block.ids[cols]
            rows, cols = rows[other], cols[other]
            for at in range(0, len(rows), 65536):
                i, j = rows[at : at + 65536], cols[at : at + 65536]
                s = _sums(x[i] * block.x[j]) / (norm[i] * block.norm[j])
                q, score, ids = _best(np.append(q, j), np.append(score, s), np.append(ids, own_ids[i]), k)
            full, n = np.unique(q, return_counts=True)
            full = full[n >= k]
            ends = np.searchsorted(q, full, side="right") - 1
            least[full] = score[ends]

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                c = b.slice(at, SLICE)
                x, norm, own = _matrix(c.column("x")), c.column("norm").to_numpy(), c.column("own").to_numpy()
                own_ids = c.column("id").to_numpy()
                codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint64).reshape(len(x), -1)
                estimate, upper = block.bounds(codes, own)
                seen = np.zeros(estimate.shape, bool)
                if np.isinf(least).any():  # a first threshold from the best estimates
                    top = np.argpartition(-estimate, min(2 * k, len(x) - 1), axis=0)[: 2 * k + 1]
                    cols = np.broadcast_to(np.arange(len(block.ids)), top.shape)
                    seen[top, cols] = True
                    exact(x, norm, own_ids, top.ravel(), cols.ravel())
                rows, cols = np.nonzero((upper >= least) & ~seen)
                exact(x, norm, own_ids, rows, cols)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines of each query over all other rows.

    Ties go to the smaller id, a query's own id is no candidate, and fewer
    candidates give fewer rows.  Vectors that are null, zero, hold null or
    non-finite components or have no id take no part; vectors meet those of
    their own length only.  Queries that repeat an id count once (their least
    vector); rows of the table that repeat an id are candidates each.  No rows
    give an empty result.  Other columns are ignored.

    Queries are processed in blocks of bounded size, each against every row of
    the index; ``WAVE`` blocks make one job, so that jobs are large and the
    driver holds no more than a wave.
    """
    spark = vectors.sparkSession
    index = build_index(usable(vectors, id_col, vec_col), seed)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("x").alias("x")).withColumn("width", F.size("x"))
    asked = staged(asked, "ann-queries")
    plan = []  # (width, number of blocks, block)
    for width, n in sorted(map(tuple, asked.groupBy("width").count().collect())):
        plan += [(width, math.ceil(n / BLOCK), i) for i in range(math.ceil(n / BLOCK))]
    found, turns = None, {}
    for at in range(0, len(plan), WAVE):
        wave = None
        for width, blocks, i in plan[at : at + WAVE]:
            one = asked.filter((F.col("width") == width) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).orderBy("id").toPandas()  # about BLOCK rows
            if not len(one):
                continue
            if width not in turns:
                turns = {width: rotation(_width(width), seed)}
            shared = spark.sparkContext.broadcast(Queries(one["id"].to_numpy(np.int64), np.array(one["x"].tolist(), np.float64), turns[width]))

            def run(batches, shared=shared):
                yield from _scan(shared.value, k)(batches)

            hits = index.filter(F.col("width") == width).mapInArrow(run, "query_id long, vec_id long, score double")
            wave = hits if wave is None else wave.unionByName(hits)
        if wave is not None:
            wave = wave if len(plan) <= WAVE else staged(wave, "ann-hits")
            found = wave if found is None else found.unionByName(wave)
    if found is None:
        discard(index, asked)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
