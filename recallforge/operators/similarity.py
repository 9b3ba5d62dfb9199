"""Similarity joins within a table: the similarity graph and order-dependent dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..schema import DIMS

#: Fixed value: how many accepted entries a new one is compared with.
WINDOW = 4096


def similarity_edges(entries: DataFrame, threshold: float = 0.55, max_edges: int = 200) -> DataFrame:
    """(a, b, similarity): pairs a < b whose key or content similarity reaches the threshold, the best ``max_edges``.

    All pairs are compared, but for those whose counts of set bits alone differ
    by too much; see the README for the sizes that this suits.
    """
    rows = entries.select("entry_id", "k", "c", vectors.popcount(F.col("k")).alias("pk"), vectors.popcount(F.col("c")).alias("pc"))
    room = int((1 - threshold) * DIMS)
    a = rows.select([F.col(c).alias(f"{c}_a") for c in rows.columns])
    b = rows.select([F.col(c).alias(f"{c}_b") for c in rows.columns])
    near = (F.abs(F.col("pk_a") - F.col("pk_b")) <= room) | (F.abs(F.col("pc_a") - F.col("pc_b")) <= room)
    pairs = a.join(b, (F.col("entry_id_a") < F.col("entry_id_b")) & near)
    sim = F.greatest(vectors.similarity(F.col("k_a"), F.col("k_b")), vectors.similarity(F.col("c_a"), F.col("c_b")))
    found = pairs.select(F.col("entry_id_a").alias("a"), F.col("entry_id_b").alias("b"), sim.alias("similarity")).filter(F.col("similarity") >= threshold)
    return found.orderBy(F.col("similarity").desc(), "a", "b").limit(max_edges)


def star_edges(entries: DataFrame, centre: str) -> DataFrame:
    """(a, b, similarity): an edge of similarity 1 from every entry to the node of their cartridge."""
    return entries.select(F.col("entry_id").cast("string").alias("a"), F.lit(centre).alias("b"), F.lit(1.0).alias("similarity"))


def similar_pairs(entries: DataFrame, threshold: float, vector: str = "k") -> DataFrame:
    """All pairs (a, b, similarity) with a < b and a similarity of keys (``vector`` c: contents) of at least the threshold."""
    rows = entries.select("entry_id", F.col(vector).alias("v"), vectors.popcount(F.col(vector)).alias("p"))
    a, b = (rows.select(F.col("entry_id").alias(f"entry_id_{s}"), F.col("p").alias(f"p_{s}"), *vectors.spread(F.col("v"), s)) for s in "ab")
    room = int((1 - threshold) * DIMS)
    pairs = a.join(b, (F.col("entry_id_a") < F.col("entry_id_b")) & (F.abs(F.col("p_a") - F.col("p_b")) <= room))
    return pairs.select(F.col("entry_id_a").alias("a"), F.col("entry_id_b").alias("b"), vectors.spread_similarity("a", "b").alias("similarity")).filter(F.col("similarity") >= threshold)


def greedy_dedup(entries: DataFrame, threshold: float = 0.9, window: int | None = WINDOW) -> DataFrame:
    """(entry_id, accepted): an entry is accepted unless its content is like that of one of the last ``window`` accepted before it (None: any).

    That set follows from the pairs alone.  In each round, an entry is rejected
    that an accepted one within the window is like, and one is accepted that
    nothing undecided or accepted can still reject.  Of an accepted neighbour,
    the window is known to reach it while accepted and undecided entries between
    them are fewer, and known not to once the accepted ones alone are as many.
    The earliest undecided entry is decided in every round, mostly many more are.
    """
    edges = _cut(similar_pairs(entries, threshold, "c").select("a", "b"))
    state = _cut(entries.select("entry_id", F.lit(None).cast("boolean").alias("accepted")))
    upto = Window.orderBy("entry_id").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        yes, open_ = F.coalesce("accepted", F.lit(False)).cast("int"), F.col("accepted").isNull().cast("int")
        counted = state
        if window is not None:
            counted = counted.withColumns({"least": F.coalesce(F.sum(yes).over(upto), F.lit(0)), "most": F.coalesce(F.sum(yes + open_).over(upto), F.lit(0))})
        else:
            counted = counted.withColumns({"least": F.lit(0), "most": F.lit(0)})
        left = counted.filter("accepted is null or accepted").select(F.col("entry_id").alias("a"), F.col("accepted").alias("a_in"), F.col("least").alias("a_least"), F.col("most").alias("a_most"))
        right = counted.filter("accepted is null").select(F.col("entry_id").alias("b"), F.col("least").alias("b_least"), F.col("most").alias("b_most"))
        # accepted entries from a on (itself included) and before b: at least and at most; the bounds differ by what is undecided
        met = edges.join(left, "a").join(right, "b")
        reach = F.lit(True) if window is None else (F.col("b_most") - F.col("a_most")) <= window
        gone = F.lit(False) if window is None else (F.col("b_least") - F.col("a_least")) > F.lit(window) - F.col("a_in").isNull().cast("int")
        told = met.groupBy(F.col("b").alias("entry_id")).agg(F.max(F.col("a_in").isNotNull() & reach).alias("out"), F.max(~gone).alias("blocked"))
        now = state.join(told, "entry_id", "left")
        decided = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("out"), False).when(~F.coalesce("blocked", F.lit(False)), True)
        state = _cut(now.select("entry_id", decided.alias("accepted")))
        if state.filter("accepted is null").isEmpty():
            return state


def _cut(df: DataFrame) -> DataFrame:
    from .common import cut

    return cut(df)
