"""Entries: building, deleting, compacting, and the three-tier search.

Search takes a table of queries, not one: an exact tier by hash join on the
normalised key, then a lexical and (if vectors are there) a semantic tier that
score every live entry against the queries that still have room.  Those tiers are
a nested-loop join of entries with a block of queries of bounded size; the scan
stays in generated code and each task keeps ``top_k`` rows a query before
anything is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors, text, vectors
from ..schema import FUZZY_THRESHOLD, KIND_NAMES, MIN_CONFIDENCE, RECALL_POOL, SEMANTIC_THRESHOLD, kind_number

QUERY_BLOCK = 4096


def build_entries(rows: DataFrame, seed: str = vectors.SEED, normalize=text.normalize, reject_credentials: bool = True, score_trust: bool = True, cartridge: str = "default") -> DataFrame:
    """Entries from (entry_id, content[, key, kind, source, meta, cartridge]).

    Content and key are sanitised, empty contents and (by default) contents with
    credentials are left out, a missing key is the content, and key and content
    are encoded.
    """
    has = set(rows.columns)
    col = lambda name, default: F.col(name) if name in has else default
    content = text.sanitize_content(F.col("content"))
    key = text.sanitize_key(F.coalesce(col("key", F.lit(None).cast("string")), F.col("content")))
    out = rows.select(
        F.col("entry_id").cast("bigint").alias("entry_id"),
        col("cartridge", F.lit(cartridge)).alias("cartridge"),
        content.alias("content"),
        key.alias("key"),
        F.coalesce(col("kind", F.lit(0)).cast("tinyint"), F.lit(0).cast("tinyint")).alias("kind"),
        col("source", F.lit("")).alias("source"),
        col("meta", F.create_map().cast("map<string,string>")).alias("meta"),
    ).filter(F.col("content") != "")
    if reject_credentials:
        out = out.filter(F.size(detectors.credentials(F.col("content"))) == 0)
    if score_trust:
        out = out.withColumn("trust", detectors.trust_of(F.col("content")))
    encode = vectors.encoder(seed)
    return out.withColumns({"key_norm": normalize(F.col("key")), "deleted": F.lit(False), "k": encode(F.col("key")), "c": encode(F.col("content"))})


def with_semantic(entries: DataFrame, embeddings: DataFrame, dim: int, seed: str = "semantic") -> DataFrame:
    """Entries with sign vectors ``sk`` and ``sc`` from (entry_id, key_embedding, content_embedding)."""
    sign = vectors.simhash(dim, seed=seed)
    signed = embeddings.select("entry_id", sign("key_embedding").alias("sk"), sign("content_embedding").alias("sc"))
    return entries.join(signed, "entry_id", "left")


def live(entries: DataFrame, kind: str | int | None = None) -> DataFrame:
    """Entries that are not deleted, of one kind if given."""
    found = entries.filter(~F.col("deleted"))
    return found if kind is None else found.filter(F.col("kind") == kind_number(kind))


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries with those of ``ids`` (entry_id) marked as deleted."""
    gone = ids.select("entry_id").distinct().withColumn("_gone", F.lit(True))
    return entries.join(gone, "entry_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def compact(entries: DataFrame, dedupe: bool = False) -> DataFrame:
    """Live entries only; with ``dedupe`` the first of each (content, key_norm)."""
    found = live(entries)
    if not dedupe:
        return found
    order = Window.partitionBy("content", "key_norm").orderBy("entry_id")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Both, with older entries of a new key_norm and kind marked as deleted."""
    keys = new.select("key_norm", "kind").distinct().withColumn("_new", F.lit(True))
    old = entries.join(keys, ["key_norm", "kind"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("_new", F.lit(False))).drop("_new")
    return old.unionByName(new, allowMissingColumns=True)


def stats(entries: DataFrame) -> DataFrame:
    """(kind, entries): live entries of each kind."""
    return live(entries).groupBy(kind_name(F.col("kind")).alias("kind")).agg(F.count("*").alias("entries"))


def kind_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    return F.coalesce(names[kind.cast("int")], F.lit("generic"))


def exact_hits(queries: DataFrame, entries: DataFrame, normalize=text.normalize, few: bool = False) -> DataFrame:
    """The newest live entry whose key_norm is the normalised query, at confidence 1.

    Only entries with an asked key are grouped; ``few`` queries go to the entries.
    """
    asked = queries.select("query_id", normalize(F.col("query")).alias("key_norm")).filter("key_norm <> ''")
    met = entries.select("key_norm", "entry_id").join(F.broadcast(asked) if few else asked, "key_norm")
    newest = met.groupBy("query_id").agg(F.max("entry_id").alias("entry_id"))
    return newest.select("query_id", "entry_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("mode"))


def _scored(block: DataFrame, entries: DataFrame, top_k: int, fuzzy: float, semantic: float, use_semantic: bool) -> DataFrame:
    """Rows of both tiers for a block of queries (query_id, qv[, qs], room, exact_id)."""

    def tier(q: str, k: str, c: str, least: float, mode: str) -> DataFrame:
        own, other = F.coalesce(k, c), F.coalesce(c, k)
        rows = entries.filter(own.isNotNull()).select("entry_id", *vectors.spread(own, "k"), *vectors.spread(other, "c"))
        asked = block.filter(F.col(q).isNotNull()).select("query_id", "room", "exact_id", *vectors.spread(F.col(q), "q"))
        both = rows.crossJoin(F.broadcast(asked)).filter(F.col("entry_id") != F.coalesce("exact_id", F.lit(-1)))
        scored = both.select("query_id", "entry_id", vectors.spread_similarity("q", "k", "c").alias("confidence"), F.lit(mode).alias("mode"), "room")
        return scored.filter(F.col("confidence") >= least)

    rows = tier("qv", "k", "c", fuzzy, "fuzzy")
    if use_semantic:
        rows = rows.unionByName(tier("qs", "sk", "sc", semantic, "semantic"))
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), F.col("entry_id").desc(), F.col("mode").desc())
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k).filter("place <= room").drop("place", "room")


def search(queries: DataFrame, entries: DataFrame, top_k: int = 3, kind: str | int | None = None, fuzzy: float = FUZZY_THRESHOLD, semantic: float = SEMANTIC_THRESHOLD, seed: str = vectors.SEED, normalize=text.normalize, embed=None) -> DataFrame:
    """Hits (query_id, rank, entry_id, content, confidence, source, mode, kind, key_norm, meta) for (query_id, query).

    The exact hit comes first, then the tiers fill up to ``top_k`` by confidence,
    newer entries first among equals; an entry may come once from each tier.
    ``embed`` turns query text into sign vectors for the semantic tier.  A query
    whose exact hit already fills ``top_k`` is not scanned for.
    """
    hit = "query_id bigint, rank int, entry_id bigint, content string, confidence double, source string, mode string, kind string, key_norm string, meta map<string,string>"
    if top_k <= 0:
        return queries.sparkSession.createDataFrame([], hit)
    alive = live(entries, kind)
    n = queries.count()
    exact = exact_hits(queries, alive, normalize, n <= QUERY_BLOCK)
    found = exact
    asked = queries.join(exact.select("query_id", F.col("entry_id").alias("exact_id")), "query_id", "left")
    asked = asked.withColumn("room", F.lit(top_k) - F.col("exact_id").isNotNull().cast("int")).filter("room > 0")
    asked = asked.withColumn("qv", vectors.encoder(seed)(F.col("query")))
    if embed is not None:
        asked = asked.withColumn("qs", embed(F.col("query")))
    keep = ["query_id", "qv", "room", "exact_id"] + (["qs"] if embed is not None else [])
    vecs = ["entry_id", "k", "c"] + (["sk", "sc"] if embed is not None else [])
    # blocks bound what is broadcast; most callers ask fewer queries than one block
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    for i in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = found.unionByName(_scored(block.select(*keep), alive.select(*vecs), top_k, fuzzy, semantic, embed is not None))
    order = Window.partitionBy("query_id").orderBy((F.col("mode") != "exact"), F.col("confidence").desc(), F.col("entry_id").desc(), F.col("mode").desc())
    ranked = found.withColumn("rank", F.row_number().over(order))
    # hydrate: only the hits' rows; few of them, so the planner may send them to the entries
    rows = alive.select("entry_id", "content", "source", kind_name(F.col("kind")).alias("kind"), "key_norm", "meta")
    return ranked.join(rows, "entry_id").select("query_id", "rank", "entry_id", "content", "confidence", "source", "mode", "kind", "key_norm", "meta")


def search_or_none(queries: DataFrame, entries: DataFrame, min_confidence: float = MIN_CONFIDENCE, **options) -> DataFrame:
    """Every query with its best hit, or nulls where that is below the confidence."""
    best = search(queries, entries, top_k=1, **options).filter(F.col("confidence") >= min_confidence)
    return queries.select("query_id").join(best.drop("rank"), "query_id", "left")


def best_per_group(hits: DataFrame, group_key: str, top_k: int) -> DataFrame:
    """The best hit of each (kind, meta[group_key]) of each query; hits without the key stand alone."""
    group = F.coalesce(F.col("meta")[group_key], F.concat(F.lit("#"), F.col("entry_id").cast("string"), F.lit("/"), F.col("mode")))
    grouped = hits.withColumn("grouped", F.col("meta")[group_key].isNotNull()).withColumn("group", group)
    best = Window.partitionBy("query_id", "kind", "grouped", "group").orderBy("rank")
    first = grouped.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "grouped")
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "rank")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def search_grouped(queries: DataFrame, entries: DataFrame, top_k: int = 3, group_key: str = "skill", recall: int = RECALL_POOL, **options) -> DataFrame:
    """Search ``recall`` deep, then the best hit of each group."""
    return best_per_group(search(queries, entries, top_k=recall, **options), group_key, top_k)
