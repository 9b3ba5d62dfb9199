"""Session memory: exchanges from turns, distilled keys, recall, decay and demotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import memory


def exchanges(turns: DataFrame, window: int = 8) -> DataFrame:
    """(session, xid, turn_lo, turn_hi, q, a, body) from (session, turn, role, text).

    An exchange is a run of user turns and the turn after it; a turn that isn't
    the user's stands alone if no user turn comes before it.  Blank turns don't
    count, numbers of exchanges start at 1 and of turns at 0.  A run of ``window``
    user turns or more is split where a buffer of that size would overflow.
    """
    said = turns.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy("session").orderBy("turn")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum((F.col("role") != "user").cast("int")).over(past), F.lit(0))
    rows = said.withColumn("at", F.row_number().over(order) - 1).withColumn("run", ended)
    # inside a run, every full buffer of user turns without a reply is an exchange by itself
    inside = F.row_number().over(Window.partitionBy("session", "run").orderBy("turn")) - 1
    rows = rows.withColumn("split", F.floor(inside / window))
    gathered = rows.groupBy("session", "run", "split").agg(
        F.min("at").alias("turn_lo"),
        F.max("at").alias("turn_hi"),
        F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"),
    )
    said_by = lambda user: F.array_join(F.transform(F.filter("turns", lambda t: (t["role"] == "user") == F.lit(user)), lambda t: t["text"]), " ")
    number = F.row_number().over(Window.partitionBy("session").orderBy("turn_lo"))
    q = text.strip(said_by(True))
    return gathered.select(
        "session", number.cast("bigint").alias("xid"), "turn_lo", "turn_hi",
        F.when(q == "", "context").otherwise(q).alias("q"), text.strip(said_by(False)).alias("a"),
        F.array_join(F.transform("turns", lambda t: t["text"]), " ").alias("body"),
    )


def distil(found: DataFrame) -> DataFrame:
    """Exchanges with salience, keys and the content that answers a recall."""
    q, a = F.col("q"), F.col("a")
    label = F.concat(F.lit("[turns "), F.col("turn_lo").cast("string"), F.lit("-"), F.col("turn_hi").cast("string"), F.lit("] Q: "))
    return found.withColumns({"salience": text.salience(F.col("body")), "keys": text.distilled_keys(q, a), "content": F.concat(label, text.drop_deixis(q, text.anchors_of(q, a)), F.lit(" A: "), a)})


def turn_entries(distilled: DataFrame) -> DataFrame:
    """One entry a key (entry_id, content, key, kind, source, meta); all keys of an exchange share its number."""
    rows = distilled.select("*", F.posexplode("keys").alias("place", "key"))
    meta = F.create_map(
        F.lit("session"), F.col("session").cast("string"), F.lit("exchange"), F.col("xid").cast("string"), F.lit("salience"), F.col("salience").cast("string"),
        F.lit("turns"), F.concat_ws("-", F.col("turn_lo").cast("string"), F.col("turn_hi").cast("string")),
    )
    entry = F.xxhash64("session", "xid", "place").bitwiseAND(2**63 - 1)
    return rows.select(entry.alias("entry_id"), "content", "key", F.lit(4).alias("kind"), F.lit("session").alias("source"), meta.alias("meta"))


def gather(entries: DataFrame) -> DataFrame:
    """(session, xid, content, salience): each exchange once, with its longest content and greatest salience."""
    rows = entries.select(F.col("meta")["session"].alias("session"), F.col("meta")["exchange"].cast("bigint").alias("xid"), "content", F.col("meta")["salience"].cast("double").alias("salience"))
    return rows.filter("xid is not null").groupBy("session", "xid").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"), F.max("salience").alias("salience"))


def recall(queries: DataFrame, entries: DataFrame, top_k: int = 3, gate: float = 0.0, **options) -> DataFrame:
    """The best entry of each exchange: three times ``top_k`` turn entries, gated, the first of each exchange, ``top_k`` left."""
    hits = memory.search(queries, entries, top_k=3 * top_k, kind="turn", **options).filter(F.col("confidence") >= gate)
    xid = F.concat_ws("/", F.col("meta")["session"], F.col("meta")["exchange"])
    first = Window.partitionBy("query_id", "xid").orderBy("rank")
    once = hits.withColumn("xid", xid).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("rank")
    out = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k)
    return out.select("query_id", F.col("place").alias("rank"), "xid", "confidence", "content", F.concat(F.lit("["), F.format_number("confidence", 2), F.lit("] "), "content").alias("line"))


def touch(records: DataFrame, log: DataFrame) -> DataFrame:
    """Decay records with the accesses of a recall log (xid) added."""
    more = log.groupBy("xid").agg(F.count("*").alias("_more"))
    return records.join(more, "xid", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def scored(records: DataFrame, now: Column) -> DataFrame:
    """Records (xid, salience, created_at, access_count, tier) with age in minutes and their score now."""
    minutes = (F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 60_000_000
    return records.withColumn("age_minutes", minutes).withColumn("score", scores.utility(F.col("salience"), F.col("age_minutes") / 60, F.col("access_count")))


def eviction_list(records: DataFrame, now: Column, top_k: int | None = None) -> DataFrame:
    """Records that aren't durable by ascending score: the first ``top_k``, or all below the demotion score."""
    open_ = scored(records, now).filter("tier <> 'durable'")
    if top_k is None:
        return open_.filter(F.col("score") < scores.DEMOTE_BELOW).orderBy("score", "xid")
    return open_.orderBy("score", "xid").limit(top_k)


def tier_stats(records: DataFrame, budget: int = scores.BUDGET) -> DataFrame:
    """(tier, records, accesses, over_budget)."""
    whole = records.agg((F.count("*") > budget).alias("over_budget"))
    return records.groupBy("tier").agg(F.count("*").alias("records"), F.sum("access_count").alias("accesses")).crossJoin(F.broadcast(whole))


def sparsify(entries: DataFrame, evicted: DataFrame, every_key: bool = True) -> DataFrame:
    """Entries with those of evicted exchanges (session, xid) turned into facts; with ``every_key`` off, the newest key only."""
    gone = evicted.select(F.col("session").cast("string").alias("_s"), F.col("xid").cast("string").alias("_x")).distinct().withColumn("_gone", F.lit(True))
    rows = entries.join(gone, (F.col("meta")["session"] == F.col("_s")) & (F.col("meta")["exchange"] == F.col("_x")), "left")
    last = F.max("entry_id").over(Window.partitionBy(F.col("meta")["session"], F.col("meta")["exchange"]))
    hit = F.coalesce("_gone", F.lit(False)) & (F.lit(True) if every_key else F.col("entry_id") == last)
    return rows.withColumn("kind", F.when(hit, F.lit(1)).otherwise(F.col("kind")).cast("tinyint")).withColumn("content", F.when(hit, text.fact_body(F.col("content"))).otherwise(F.col("content"))).drop("_s", "_x", "_gone")


def recent(exchanges_: DataFrame, other: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The last exchanges by number over one or two stores, each number once."""
    both = exchanges_ if other is None else exchanges_.unionByName(other)
    once = Window.partitionBy("xid").orderBy(F.col("turn_lo"))
    return both.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n").orderBy(F.col("xid").desc()).limit(n)


def forget(entries: DataFrame, n: int | None = None) -> DataFrame:
    """Turn entries marked as deleted: the ``n`` oldest, or all."""
    turns = F.col("kind") == 4
    if n is None:
        return entries.withColumn("deleted", F.col("deleted") | turns)
    oldest = memory.live(entries, "turn").orderBy("entry_id").limit(n).select("entry_id")
    return memory.delete(entries, oldest)
