"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Only DataFrame functions: each address is expanded into the expressions that a
rule could be written as, the expressions meet the rules on the first bytes of
their digest, the whole digest confirms the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    ``rules`` has verdict, host and path, the path with its leading slash.  A
    rule fits its host and all subdomains where the path begins with its own.
    The longest rule wins, then the longer host, then block before allow.  A
    null url, or one without ``://``, has an empty host and path and fits no
    rule; pages without a rule get ``default``.  Rules with a null in host,
    path or verdict are ignored.  Every distinct (host, path) is judged once,
    so repeated addresses cost one expansion, and hosts and paths are cut only
    where some rule's could end, so that an address of any length gives no more
    expressions than rules have kinds of lengths.
    """
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).dropna().filter("rule_host <> ''").distinct()
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()  # kinds of lengths
    lengths, depths = sorted({r["chars"] for r in shapes}), sorted({r["labels"] for r in shapes})
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    suffixes = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in depths]))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = pages.select("host", "path").filter("host <> ''").distinct()
    asked = asked.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    asked = asked.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    known = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("rule_short", F.substring("rule_digest", 1, PREFIX_HEX))
    rank = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("n"),
        F.length("rule_host").alias("h"),
        (F.col("verdict") == "block").alias("b"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("verdict"),
    )
    found = asked.join(known, (F.col("short") == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")))
    best = found.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(F.max(rank).alias("best"))
    judged = pages.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
