"""Federation over many cartridges: routing, shards, merged search, graduation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..schema import FUZZY_THRESHOLD, MAX_ENTRIES, RECALL_POOL, SEMANTIC_THRESHOLD, SHARD_SEP
from . import memory

#: Header types that are left out of a search unless named.
PRIVATE_TYPES = ["vault", "agent"]


def in_scope(name: Column, scope: str) -> Column:
    """A cartridge of a scope: the name itself, its shards, or ``scope-...``."""
    return (name == scope) | name.startswith(f"{scope}{SHARD_SEP}") | name.startswith(f"{scope}-")


def base_name(name: Column) -> Column:
    """A shard's base name."""
    return F.regexp_replace(name, rf"{SHARD_SEP}\d+$", "")


def select_cartridges(entries: DataFrame, names: list[str] | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Entries of the named cartridges with all their shards; by default of all that are not private."""
    if names is not None:
        return entries.filter(F.col("cartridge").isin(*names) | base_name(F.col("cartridge")).isin(*names))
    if headers is None:
        return entries
    private = headers.filter(F.col("cartridge_type").isin(*PRIVATE_TYPES)).select(F.col("name").alias("cartridge"))
    return entries.join(private, "cartridge", "left_anti")


def route(rows: DataFrame, routes: dict[str, str], default: str | None = None) -> DataFrame:
    """Rows (kind) with the cartridge that their kind's name, then number, leads to, else the default; no way raises when read."""
    ways = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]).cast("map<string,string>")
    way = F.coalesce(ways[memory.kind_name(F.col("kind"))], ways[F.col("kind").cast("string")], F.lit(default).cast("string"))
    return rows.withColumn("cartridge", F.when(way.isNotNull(), way).otherwise(F.raise_error(F.concat(F.lit("no cartridge for kind "), F.col("kind").cast("string")))))


def held(entries: DataFrame) -> DataFrame:
    """(cartridge, held, top): how many entries each unsharded cartridge holds, and its greatest shard number (1 without shards)."""
    name = F.col("cartridge")
    sizes = entries.groupBy("cartridge").agg(F.count("*").alias("n"))
    number = F.regexp_extract(name, rf"{SHARD_SEP}(\d+)$", 1).try_cast("int")
    return sizes.groupBy(base_name(name).alias("base")).agg(F.sum(F.when(number.isNull(), F.col("n")).otherwise(0)).alias("held"), F.coalesce(F.max(number), F.lit(1)).alias("top")).withColumnRenamed("base", "cartridge")


def assign_shards(entries: DataFrame, max_entries: int = MAX_ENTRIES, held: DataFrame | None = None) -> DataFrame:
    """Entries with their shard's name: full blocks in order are ``name__2``, ``name__3``, ..., the rest stays ``name``.

    Entries ``held`` already come first, and numbers go on after their greatest.
    Ranks come from counts of id ranges, so no cartridge has to fit into a task.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # partitions are ranges of (cartridge, id); offsets are sums over their sizes
    ranged = entries.select("cartridge", "entry_id").repartitionByRange(parts, "cartridge", "entry_id").withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("cartridge", "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("cartridge").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cartridge")
    offsets = sizes.select("cartridge", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_total"))
    rank = Window.partitionBy("cartridge", "_part").orderBy("entry_id")
    placed = ranged.withColumn("_n", F.row_number().over(rank)).join(offsets, ["cartridge", "_part"])
    if held is None:
        placed = placed.withColumns({"_held": F.lit(0), "_top": F.lit(1)})
    else:
        placed = placed.join(held.select("cartridge", F.col("held").alias("_held"), F.col("top").alias("_top")), "cartridge", "left").fillna({"_held": 0, "_top": 1})
    block = F.floor((F.col("_held") + F.col("_before") + F.col("_n") - 1) / max_entries)
    full = F.floor((F.col("_held") + F.col("_total")) / max_entries)
    name = F.when(block < full, F.concat(F.col("cartridge"), F.lit(SHARD_SEP), (block + 1 + F.col("_top")).cast("string"))).otherwise(F.col("cartridge"))
    return placed.select("cartridge", "entry_id", block.cast("int").alias("block"), name.alias("shard"))


def rack_stats(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(cartridge, entries, percent_full): live entries and how full the cartridge is."""
    return memory.live(entries).groupBy("cartridge").agg(F.count("*").alias("entries")).withColumn("percent_full", F.round(100 * F.col("entries") / max_entries, 1))


def compact_shards(entries: DataFrame) -> DataFrame:
    """All shards of each base name as one cartridge: live entries, the first of each (content, key_norm)."""
    merged = entries.withColumn("cartridge", base_name(F.col("cartridge"))).filter(~F.col("deleted"))
    order = Window.partitionBy("cartridge", "content", "key_norm").orderBy("entry_id")
    return merged.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _per_cartridge(queries: DataFrame, entries: DataFrame, depth: int, kind: str | int | None = None, fuzzy: float = FUZZY_THRESHOLD, semantic: float = SEMANTIC_THRESHOLD, seed: str = vectors.SEED, normalize=text.normalize, embed=None) -> DataFrame:
    """Hits of every cartridge by itself: queries are asked once for each.

    ``embed`` turns query text into sign vectors for the semantic tier of
    entries with ``sk`` and ``sc``; an entry may come once from each tier.
    """
    names = entries.select("cartridge").distinct()
    asked = queries.crossJoin(names).select(F.struct("query_id", "cartridge").alias("query_id"), "query")
    # one pass: the pair of query and cartridge is the query, and only meets entries of its cartridge
    alive = memory.live(entries, kind)
    q = asked.select("query_id", "query", normalize(F.col("query")).alias("key_norm"), F.col("query_id.cartridge").alias("cartridge"))
    met = alive.select("cartridge", "key_norm", "entry_id").join(F.broadcast(q.filter("key_norm <> ''").select("query_id", "cartridge", "key_norm")), ["cartridge", "key_norm"])
    q = q.join(met.groupBy("query_id").agg(F.max("entry_id").alias("exact_id")), "query_id", "left").withColumn("room", F.lit(depth) - F.col("exact_id").isNotNull().cast("int"))
    found = q.filter("exact_id is not null").select("query_id", F.col("exact_id").alias("entry_id"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("mode"))

    def tier(vector: Column, k: str, c: str, least: float, mode: str) -> DataFrame:
        block = q.filter("room > 0").select("query_id", "cartridge", "exact_id", vector.alias("qv")).filter("qv is not null")
        block = block.select("query_id", "cartridge", "exact_id", *vectors.spread(F.col("qv"), "q"))
        own, other = F.coalesce(k, c), F.coalesce(c, k)
        rows = alive.filter(own.isNotNull()).select("cartridge", "entry_id", *vectors.spread(own, "k"), *vectors.spread(other, "c"))
        pairs = rows.join(F.broadcast(block), "cartridge").filter(F.col("entry_id") != F.coalesce("exact_id", F.lit(-1)))  # queries x cartridges, bounded by the caller's queries
        return pairs.select("query_id", "entry_id", vectors.spread_similarity("q", "k", "c").alias("confidence"), F.lit(mode).alias("mode")).filter(F.col("confidence") >= least)

    found = found.unionByName(tier(vectors.encoder(seed)(F.col("query")), "k", "c", fuzzy, "fuzzy"))
    if embed is not None:
        found = found.unionByName(tier(embed(F.col("query")), "sk", "sc", semantic, "semantic"))
    rank = Window.partitionBy("query_id").orderBy(F.col("mode") != "exact", F.col("confidence").desc(), F.col("entry_id").desc(), F.col("mode").desc())
    hits = found.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= depth)
    hits = hits.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.cartridge").alias("cartridge"), "place", "entry_id", "confidence", "mode")
    rows = alive.select("cartridge", "entry_id", "content", "source", memory.kind_name(F.col("kind")).alias("kind"), "key_norm", "meta")
    return hits.join(rows, ["cartridge", "entry_id"])


def search(queries: DataFrame, entries: DataFrame, top_k: int = 3, cartridges: list[str] | None = None, **options) -> DataFrame:
    """Hits of all cartridges merged: each gives its ``top_k``, the best come first, (cartridge, content) once, ``top_k`` in all.

    Equal confidences keep the order of cartridge names, then of their own ranks.
    """
    hits = _per_cartridge(queries, select_cartridges(entries, cartridges), top_k, **options)
    once = Window.partitionBy("query_id", "cartridge", "content").orderBy(F.col("confidence").desc(), "place")
    hits = hits.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "cartridge", "place")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("place")


def search_grouped(queries: DataFrame, entries: DataFrame, top_k: int = 3, group_key: str = "skill", recall: int = RECALL_POOL, cartridges: list[str] | None = None, **options) -> DataFrame:
    """The best hit of each (cartridge, group, content) over all cartridges."""
    hits = _per_cartridge(queries, select_cartridges(entries, cartridges), recall, **options)
    group = F.coalesce(F.col("meta")[group_key], F.concat(F.lit("#"), F.col("entry_id").cast("string")))
    best = Window.partitionBy("query_id", "cartridge", "kind", "group").orderBy(F.col("confidence").desc(), "place")
    hits = hits.withColumn("group", group).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "cartridge", "place")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("place")


def graduate(exchanges: DataFrame, facts: DataFrame, threshold: float = 0.40, grader=None, prefix: str = "fact:") -> DataFrame:
    """New facts (xid, session, key, content) from exchanges (session, xid, content, salience) not graduated before.

    ``facts`` holds the (session, xid) graduated so far, so a second run adds
    nothing.  The grader is a Column of the exchange, by default its salience
    against the threshold.
    """
    fresh = exchanges.join(facts.select("session", "xid").distinct(), ["session", "xid"], "left_anti")
    passed = fresh.filter(grader if grader is not None else F.col("salience") >= threshold)
    body = text.fact_body(F.col("content"))
    return passed.select("session", "xid", text.fact_key(body, F.col("xid"), prefix).alias("key"), body.alias("content"), "salience")


def graduation_report(exchanges: DataFrame, facts: DataFrame, threshold: float = 0.40) -> DataFrame:
    """(reviewed, promoted, skipped) of a graduation run."""
    fresh = exchanges.join(facts.select("session", "xid").distinct(), ["session", "xid"], "left_anti")
    good = F.col("salience") >= threshold
    return fresh.agg(F.count("*").alias("reviewed"), F.coalesce(F.sum(good.cast("bigint")), F.lit(0)).alias("promoted"), F.coalesce(F.sum((~good).cast("bigint")), F.lit(0)).alias("skipped"))
