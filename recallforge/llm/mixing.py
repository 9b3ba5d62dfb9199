"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a fractional number of copies, the target of its source
divided by the source's size.  Documents of a source trade words until one side
of the trade has a whole number of copies; the sum of words stays the same in each
trade and the expected copies of each document stay what they were.

First the large documents of a source, those above a fixed share of its words
and so a bounded number, are settled from the largest down, each by a trade with
all smaller documents of the source at once.  The small ones then trade in pairs
within buckets.  What stays fractional in a bucket (one document a source) goes
up a reduction tree, 64 buckets to one, until one document a source is left,
which a coin decides.  So a source's words miss its target by the size of a small
document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, mix64, numbered, portions, staged, text_buffer, text_key, word_counts

ROWS_PER_BUCKET = 2048
FAN_IN = 64
LARGE = 0.002
EPS = 1e-9
SAME_ROWS = 4096


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: F.Column | None = None) -> DataFrame:
    """(doc_id, source, text_key, size): words of each text; 0 for null.  ``key`` replaces the text's hash as text_key."""
    key = text_key(text_col) if key is None else key
    rows = frugal(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("text_key"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            n = word_counts(*text_buffer(b.column("text"))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("text_key"), pa.array(n)], ["doc_id", "source", "text_key", "size"])

    return rows.mapInArrow(count, "doc_id long, source string, text_key long, size long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their place by code point (null last) from 0; ranges are ordered apart, only their sizes meet on the driver."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    held = staged(sources.repartitionByRange(parts, by).withColumn("range", F.spark_partition_id()), "mix-ranges")
    sizes = dict(held.groupBy("range").count().collect())  # ``parts`` rows at most
    before, rows = 0, []
    for r in sorted(sizes):
        rows.append(F.when(F.col("range") == r, before))
        before += sizes[r]
    within = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return held.withColumn("place", within + F.coalesce(*rows, F.lit(0))).drop("range")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for the sources of ``sizes``.

    The target is ``min(most * source_size, level * weight)``; the level is
    raised until the targets sum to ``share`` times all sizes, which is where
    resharing the excess by weight ends too.  Only two sums a round go to the
    driver.
    """
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size")))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    sources = sources.withColumn("weight", F.element_at(weights, (F.pmod(F.col("place"), F.lit(len(cycle))) + 1).cast("int")))
    sources = staged(sources.withColumn("cap", F.col("source_size") * most), "mix-sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0.0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        caps, open_weight = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        higher = (total - (caps or 0.0)) / open_weight
        if higher <= level:
            break
        level = higher
    return sources.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _settle(p: list[float], *rows: int) -> None:
    for j in rows:
        p[j] = 0.0 if p[j] < EPS else 1.0 if p[j] > 1 - EPS else p[j]


def _coin(key: np.ndarray, i: int, j: int) -> float:
    return float(mix64(key[i : i + 1] ^ (key[j : j + 1] << np.uint64(1)))[0] >> np.uint64(11)) / 2**53


def _pair_off(rows: list[int], p: list[float], size: list[int], key: np.ndarray) -> None:
    """Trade between neighbours until one row at most is fractional."""
    held = None
    for i in rows:
        if held is None:
            held = i
            continue
        ratio = size[i] / size[held]
        up, down = min(1 - p[held], p[i] * ratio), min(p[held], (1 - p[i]) * ratio)
        step = up if _coin(key, held, i) * (up + down) < down else -down
        p[held] += step
        p[i] -= step / ratio
        _settle(p, held, i)
        held = next((j for j in (held, i) if 0 < p[j] < 1), None)


def _settle_large(t: pa.Table) -> pa.Table:
    """Settle the large documents of one source against all smaller ones; ``pool`` becomes the fraction that is left to each small one.

    The small documents take part as one row with their words in all.
    """
    order = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("nth", "ascending")])
    size, p, key = order["size"].to_pylist(), order["part"].to_pylist(), order["draw"].to_numpy().astype(np.uint64)
    size.append(order["source_size"][0].as_py() - sum(size))
    p.append(order["pool"][0].as_py() if size[-1] else 0.0)
    for i in range(len(size) - 1):
        rest = [j for j in range(i + 1, len(size)) if 0 < p[j] < 1]
        if not 0 < p[i] < 1 or not rest:
            continue
        words, room = sum(p[j] * size[j] for j in rest), sum((1 - p[j]) * size[j] for j in rest)
        up, down = min((1 - p[i]) * size[i], words), min(p[i] * size[i], room)
        if _coin(key, i, min(rest[0], len(key) - 1)) * (up + down) < down:
            p[i] += up / size[i]
            for j in rest:
                p[j] *= 1 - up / words
        else:
            p[i] -= down / size[i]
            for j in rest:
                p[j] += (1 - p[j]) * down / room
        _settle(p, i, *rest)
    order = order.set_column(order.schema.get_field_index("part"), "part", pa.array(p[:-1], pa.float64()))
    return order.set_column(order.schema.get_field_index("pool"), "pool", pa.array([p[-1]] * len(order), pa.float64()))


def _trade(t: pa.Table) -> pa.Table:
    """Trades in pairs within a table, source by source; at most one row a source stays fractional."""
    order = t.sort_by([("source", "ascending"), ("size", "descending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("nth", "ascending")])
    source, size = order["source"].to_pylist(), order["size"].to_pylist()
    p, key = order["part"].to_pylist(), order["draw"].to_numpy().astype(np.uint64)
    by: dict[str | None, list[int]] = {}
    for i, s in enumerate(source):
        if 0 < p[i] < 1:
            by.setdefault(s, []).append(i)
    for rows in by.values():
        _pair_off(rows, p, size, key)
    return order.set_column(order.schema.get_field_index("part"), "part", pa.array(p, pa.float64()))


def _counted(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``nth``, from 0 among rows that are equal in all columns; these are counted first, so many of them are no hot key."""
    counts = sizes.groupBy(*sizes.columns).agg(F.count("*").alias("rows"))
    some = counts.filter(f"rows <= {SAME_ROWS}")
    many = counts.filter(f"rows > {SAME_ROWS}").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SAME_ROWS).cast("long"))))
    many = many.repartition("from", *sizes.columns).withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("rows"), F.col("from") + SAME_ROWS) - 1)))
    return some.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows").unionByName(many.drop("rows", "from"))


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: F.Column | None = None) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies, taken), a row for each row of ``docs``.

    ``cycle`` is dealt to the sources by code point (null last); ``share`` is
    the mix's size against all sizes and ``most`` the most copies of a document.
    Texts that are null or without words have size 0 and none of their copies
    take words.  Equal inputs give equal results: all chance comes from hashes
    of ``seed`` and the rows, rows that are equal in all of these are numbered
    and interchangeable, and buckets follow from the number of rows alone.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    sizes = staged(word_sizes(docs, id_col, text_col, source_col, key), "mix-sizes")
    targets = source_targets(sizes, cycle, share, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate + EPS)
    part = F.greatest(rate - whole, F.lit(0.0))
    buckets = max(1, math.ceil(sizes.count() / ROWS_PER_BUCKET))
    # the source table is read from files, so the planner knows whether it is small
    known = targets.withColumnRenamed("source", "of")
    rows = _counted(sizes).join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("base", whole.cast("long")).withColumn("part", F.when((part > EPS) & (F.col("size") > 0), part).otherwise(0.0))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_key", "source", "nth").bitwiseAND(2**63 - 1))
    rows = rows.withColumn("pool", F.when(part > EPS, part).otherwise(0.0))
    large = F.col("size") > F.col("source_size") * LARGE
    # fewer than 1 / LARGE rows a source
    settled = staged(rows.filter(large).groupBy("source").applyInArrow(_settle_large, rows.schema), "mix-large")
    pools = settled.groupBy(F.col("source").alias("of")).agg(F.first("pool").alias("left_over"))
    rows = rows.filter(~large).join(pools, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.withColumn("part", F.when(F.col("part") > 0, F.coalesce("left_over", "part")).otherwise(0.0)).drop("left_over")
    idle, rows = rows.filter("part = 0 or part = 1"), rows.filter("part > 0 and part < 1")  # rows without words, and of sources that are taken whole, trade nothing
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key", "source", "nth"), F.lit(buckets)))
    fractional = (F.col("part") > 0) & (F.col("part") < 1)
    coin = F.xxhash64(F.lit(seed + 2), "draw").bitwiseAND(2**53 - 1) / 2.0**53
    tossed = F.when(fractional, (coin < F.col("part")).cast("double")).otherwise(F.col("part"))
    done, keys = settled.withColumn("part", tossed).unionByName(idle), ["bucket"]
    while True:
        rows = staged(rows.groupBy(*keys).applyInArrow(_trade, rows.schema), "mix-level")
        if buckets == 1:
            done = done.unionByName(rows.withColumn("part", tossed).drop("bucket"))
            break
        done = done.unionByName(rows.filter(~fractional).drop("bucket"))
        buckets = math.ceil(buckets / FAN_IN)
        rows = rows.filter(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        keys = ["bucket", "source"]
    copies = (F.col("base") + F.col("part").cast("long")).cast("long")
    return done.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _row_key(columns: list) -> F.Column:
    """64 bits of a whole row, nulls and maps too."""
    parts = []
    for f in columns:
        plain = "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
        parts += [F.col(f.name).isNull(), F.col(f.name) if plain else F.to_json(F.struct(f.name))]
    return F.xxhash64(*parts)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns.

    Rows are known by a hash of all their columns, so rows that differ anywhere
    keep what they hold; rows that are equal in all share their copies.
    """
    held, names = numbered(docs)
    own = {k: f"c{names.index(v)}" for k, v in {"id_col": id_col, "text_col": text_col, "source_col": source_col}.items()}
    key = _row_key(held.schema.fields)

    def keyed(df: DataFrame, id_: F.Column, source: F.Column, key: F.Column) -> DataFrame:
        # plain keys without nulls: the join's dealing of the texts then serves the distinct rows too
        return df.withColumns({"k1": F.coalesce(id_, F.lit(0)), "k2": id_.isNull(), "k3": F.coalesce(source, F.lit("")), "k4": source.isNull(), "k5": key})

    keys = ["k1", "k2", "k3", "k4", "k5"]
    mix = mix_sources(held, **own, key=key, **options)
    copies = keyed(mix, F.col("doc_id"), F.col("source"), F.col("text_key")).groupBy(*keys).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    copies = staged(copies, "mix-copies")
    rows = keyed(held, F.col(own["id_col"]).cast("long"), F.col(own["source_col"]).cast("string"), key)
    rows = rows.join(copies, keys).dropDuplicates(keys)
    if (copies.agg(F.max("copies")).first()[0] or 0) > SAME_ROWS:  # copies of very many equal rows are dealt out in parts
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(SAME_ROWS).cast("long")))
        rows = rows.withColumn("from", part).repartition("from", *keys).withColumn("copies", F.least(F.col("copies") - F.col("from"), F.lit(SAME_ROWS)))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*held.columns).toDF(*names)
