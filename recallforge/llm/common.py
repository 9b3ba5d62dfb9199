"""Helpers shared by the corpus operators: reading, staging and Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every operator here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_staged: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    session (as in tests) gets a temporary folder; on a cluster, whose machines
    don't share one, this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="recallforge-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage, survives lost executors, and gives the planner file
    sizes from which it chooses its joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _staged[path] = spark
    found._staged_path = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; what isn't staged is left alone."""
    for t in tables:
        path = getattr(t, "_staged_path", None) if t is not None else None
        if path in _staged:
            _delete(_staged.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_staged() -> None:
    for path, spark in _staged.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            return


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... so that no name of it clashes with those an operator adds, and its own names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def frugal(df: DataFrame) -> DataFrame:
    """``df``; where neither the session nor the cluster names a size of Arrow batches, they have ``BATCH_ROWS`` rows at most from now on.

    Spark's own bound (64 MB) lets the buffers of two tasks and their Python
    workers take half of a small executor.  A size that was set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))
    return df


def portions(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of strings, but of one row at least.

    Whatever the size of Arrow batches, what an operator makes of one at a time stays small.
    """
    for b in batches:
        if not b.num_rows:
            continue
        total = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
                total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(total)
        first = 0
        while first < b.num_rows:
            before = int(total[first - 1]) if first else 0
            last = min(first + rows, max(first + 1, int(np.searchsorted(total, before + size, side="right"))))
            yield b.slice(first, last - first)
            first = last


#: A key with more rows than this share of all is hot; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, spread: F.Column) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row a key of it with the key's number of rows in ``n``; ``total`` sums these.

    Rows of a key with more than ``HOT_SHARE`` of all are dealt to several
    tasks by ``spread``, with a copy of the key's facts in each.  There are fewer
    than 1 / ``HOT_SHARE`` such keys, which every task may know, and less than
    twice as many copies.  Neither side's columns may share names but ``keys``,
    and keys are not null.
    """
    limit = max(1.0, total * HOT_SHARE)
    parts = F.ceil(F.col(n) / limit).cast("int")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    hot = facts.filter(F.col(n) > limit).select(*[F.col(k).alias(f"_{k}") for k in keys], parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("_part", F.coalesce(F.pmod(spread, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts", *[f"_{k}" for k in keys])
    return dealt.join(facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "_part"]).drop("_part")


def text_key(column: str = "text") -> F.Column:
    """64 bits of a text; with the id they tell the rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the ``n + 1`` offsets into them.

    Null texts have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a buffer of texts; no word crosses two texts."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, _ = word_bounds(data, offsets)
    return np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
HASH_BYTES = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.uint64(_BASE if which == "up" else _INVERSE)
        more = np.full(max(n, 2 * len(have)), base, np.uint64)
        more[0] = 1
        have = _powers[which] = np.multiply.accumulate(more)
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, with A-Z taken as a-z.

    A polynomial over random byte values modulo 2**64, by one running sum over
    the whole buffer, then mixed; equal words have equal hashes anywhere.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # in runs of about HASH_BYTES, to bound memory
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES)))
        at = int(starts[first])
        part = data[at : ends[last - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER_BYTE[part] * _power("up", len(part)), out=total[1:])
        lo, hi = starts[first:last] - at, ends[first:last] - at
        out[first:last] = (total[hi] - total[lo]) * _power("down", int(lo[-1]) + 1)[lo]
        first = last
    return mix64(out ^ (ends - starts).astype(np.uint64))
