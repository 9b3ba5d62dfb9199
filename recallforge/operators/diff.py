"""Comparisons of snapshots: entries, units, files, sync states, and hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may be synced.
SYNC_ALWAYS = ["facts", "skills", "docs", "agents", "vaults"]
SYNC_NEVER = ["checkpoint", "vault-audit.jsonl", "cloud.json", ".sync-state.json", "cloud.log", "agent_active", "session"]
NEVER_SYNC_TYPES = ["agent", "secret", "vault"]


def diff_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status) for (key_norm, content, kind): added, removed, updated (other content), reclassified (other kind).

    Entries without a key are compared by content; the first of a key counts; an
    entry may be both updated and reclassified.
    """

    def first(df: DataFrame, side: str) -> DataFrame:
        key = F.when(F.coalesce("key_norm", F.lit("")) != "", F.col("key_norm")).otherwise(F.col("content"))
        return df.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct("content", "kind"), "entry_id").alias(side))

    both = first(old, "old").join(first(new, "new"), "key", "full_outer")
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    marks = F.array_compact(
        F.array(
            F.when(F.col("old").isNull(), "added"),
            F.when(F.col("new").isNull(), "removed"),
            F.when(there & (F.col("old.content") != F.col("new.content")), "updated"),
            F.when(there & (F.col("old.kind") != F.col("new.kind")), "reclassified"),
        )
    )
    return both.select("key", F.explode(marks).alias("status"))


def diff_digests(old: DataFrame, new: DataFrame, name: str = "source", digest: str = "digest") -> DataFrame:
    """(name, status): added, changed or removed between two tables of digests."""
    a = old.select(F.col(name), F.col(digest).alias("_old"))
    b = new.select(F.col(name), F.col(digest).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, name, "full_outer").select(name, status.alias("status")).filter("status is not null")


def sync_status(local: DataFrame, synced: DataFrame, remote: DataFrame) -> DataFrame:
    """(remote_key, status): in_sync, local_ahead, remote_ahead or conflict.

    ``local`` has sha256, ``synced`` the sha256 and etag of the last sync, and
    ``remote`` the present etag.
    """
    s = synced.select("remote_key", F.col("sha256").alias("_sha"), F.col("etag").alias("_etag"))
    r = remote.select("remote_key", F.col("etag").alias("_now"))
    same = F.col("sha256") == F.col("_sha")
    status = (
        F.when(F.col("_sha").isNull() | F.col("_now").isNull(), "local_ahead")
        .when(same & (F.col("_now") == F.col("_etag")), "in_sync")
        .when(same, "remote_ahead")
        .when(F.col("_now") == F.col("_etag"), "local_ahead")
        .otherwise("conflict")
    )
    return local.join(s, "remote_key", "left").join(r, "remote_key", "left").select("remote_key", status.alias("status"))


def syncable(path: Column, continuity: bool = False, archives: bool = False) -> Column:
    """Whether a relative path may be synced at all."""
    top, name = F.substring_index(path, "/", 1), F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    never = name.isin(*SYNC_NEVER) | (stem.isin("session", "checkpoint") & ~F.contains(path, F.lit("/"))) | name.endswith(".tmp") | name.endswith(".lock") | (top == "secrets")
    asked = top.isin(*SYNC_ALWAYS) | (F.lit(continuity) & (path == "continuity.json")) | (F.lit(archives) & (top == "archives"))
    return ~never & asked & (path != "")


def sync_policy(cartridge_type: Column, policy: Column, readable: Column) -> Column:
    """write_through or never: an explicit policy, else the type's; what can't be read is never synced."""
    return (
        F.when(~F.coalesce(readable, F.lit(False)), "never")
        .when(policy == "local_only", "never")
        .when(policy.isin("write_through", "never"), policy)
        .when(cartridge_type.isin(*NEVER_SYNC_TYPES), "never")
        .otherwise("write_through")
    )


def canonical_record(fields: list[str]) -> Column:
    """JSON of string columns with sorted keys and ``", "`` and ``": "`` between them."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    parts = [F.concat(F.lit(f'"{n}": '), F.coalesce(quoted(F.col(n).cast("string")), F.lit("null"))) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def chain(records: DataFrame, fields: list[str], log: str = "log", order: str = "seq") -> DataFrame:
    """Records with ``prev``: the SHA-256 of the canonical record before, empty for the first of a log."""
    w = Window.partitionBy(log).orderBy(order)
    return records.withColumn("prev", F.coalesce(F.lag(F.sha2(canonical_record(fields), 256)).over(w), F.lit("")))


def verify_chain(records: DataFrame, fields: list[str], log: str = "log", order: str = "seq") -> DataFrame:
    """(log, seq, ok): whether each record's ``prev`` is the hash of the record before it."""
    w = Window.partitionBy(log).orderBy(order)
    want = F.coalesce(F.lag(F.sha2(canonical_record(fields), 256)).over(w), F.lit(""))
    return records.select(log, order, (F.col("prev") == want).alias("ok"))


def last_per(rows: DataFrame, by: str, order: str, n: int, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows of each ``by``: checkpoint trails, prunes, rings."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), *([F.col(tie).desc()] if tie else []))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def backlog(events: DataFrame, limit: int, ring: int = 256) -> DataFrame:
    """The last events of the ring, at most ``limit``, oldest first."""
    return events.orderBy(F.col("seq").desc()).limit(min(limit, ring)).orderBy("seq")


def quantiles(values: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Per group the count, the sum, and the values at rank ``int(n * q)``, counted from 0.

    Ranks come from the counts of distinct values, so equal values cost one row.
    """
    counted = values.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    ranked = counted.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(whole)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    at = lambda q: (F.floor(F.col("_n") * q) >= F.col("_lo")) & (F.floor(F.col("_n") * q) < F.col("_hi"))
    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col(value)).alias("total"), *[F.max(F.when(at(q), F.col(value))).alias(name) for name, q in points.items()])


def median_gate(runs: DataFrame, base: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """(metric, median, base, change, ok) for runs and a baseline of (metric, value): more than the tolerance worse fails."""
    middle = runs.groupBy("metric").agg(F.median("value").alias("median"))
    change = F.when(F.col("base") == 0, 0.0).otherwise((F.col("median") - F.col("base")) / F.col("base"))
    return base.select("metric", F.col("value").alias("base")).join(middle, "metric").select("metric", "median", "base", change.alias("change"), (change <= tolerance).alias("ok"))
