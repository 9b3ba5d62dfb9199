"""Agents, projects and checkpoints: small keyed states and the packets built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diff, memory

# Sections and budgets of an agent's state.
SINGLETONS = ["identity", "instruction", "preference"]
LISTS = ["goal", "decision", "note"]
BUDGET_CHARS, TRAIL, TRAIL_READ, CHECKPOINTS, STALE_DAYS, DECISIONS = 4000, 10, 3, 50, 30, 5

STATE = "agent string, section string, key string, content string, priority int, status string, tags array<string>, updated timestamp, seq bigint"


def put(state: DataFrame, new: DataFrame) -> DataFrame:
    """State after new rows: the last row of each (agent, section, key) holds, of singleton sections without a key the last of the section.

    Rows of list sections without a key are all kept.
    """
    both = state.unionByName(new, allowMissingColumns=True)
    bad = ~F.col("section").isin(*SINGLETONS, *LISTS)
    section = F.when(bad, F.raise_error(F.concat(F.lit("unknown section: "), F.col("section")))).otherwise(F.col("section"))
    key = F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("section").isin(*SINGLETONS), F.concat(F.col("section"), F.lit("-0"))).otherwise(F.concat(F.col("section"), F.lit("-"), F.col("seq").cast("string")))
    rows = both.withColumn("section", section).withColumn("key", key)
    last = Window.partitionBy("agent", "section", "key").orderBy(F.col("seq").desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def complete(state: DataFrame, agent: str, key: str) -> DataFrame:
    """State with the row of an exact key done."""
    hit = (F.col("agent") == agent) & (F.col("key") == key)
    return state.withColumn("status", F.when(hit, "done").otherwise(F.col("status")))


def complete_by_search(state: DataFrame, agent: str, hits: DataFrame) -> DataFrame:
    """State with the one open goal or decision among the hits (content) done; none or several leave it as it is."""
    open_ = state.filter((F.col("agent") == agent) & (F.col("status") == "open") & F.col("section").isin("goal", "decision"))
    found = open_.join(hits.select("content").distinct(), "content", "left_semi").agg(F.count("*").alias("n"), F.min("key").alias("_key")).filter("n = 1").select("_key")
    rows = state.join(F.broadcast(found), (F.col("key") == F.col("_key")) & (F.col("agent") == agent), "left")
    return rows.withColumn("status", F.when(F.col("_key").isNotNull(), "done").otherwise(F.col("status"))).drop("_key")


def section_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("agent", "section").agg(F.count("*").alias("entries"))


def bootstrap(state: DataFrame, max_chars: int = BUDGET_CHARS) -> DataFrame:
    """(agent, packet): sections in order, as many lines as fit.

    Identity, instructions and preferences come first, then open goals by
    priority and date, the last five decisions, and notes.  A line that doesn't
    fit ends its section; later sections go on.
    """
    order = F.create_map(*[F.lit(x) for kv in {s: i for i, s in enumerate([*SINGLETONS, *LISTS])}.items() for x in kv])
    rows = state.filter((F.col("section") != "goal") | (F.col("status") == "open"))
    recent = Window.partitionBy("agent", "section").orderBy(F.col("updated").desc(), F.col("seq"))
    rows = rows.withColumn("_r", F.row_number().over(recent)).filter((F.col("section") != "decision") | (F.col("_r") <= DECISIONS))
    place = F.when(F.col("section") == "goal", F.struct((-F.col("priority")).cast("double").alias("a"), F.col("_r").cast("double").alias("b"))).when(F.col("section") == "decision", F.struct(F.lit(0.0).alias("a"), F.col("_r").cast("double").alias("b"))).otherwise(F.struct(F.lit(0.0).alias("a"), F.col("seq").cast("double").alias("b")))
    line = F.concat(F.lit("["), F.col("section"), F.lit("] "), F.col("content"))
    items = F.array_sort(F.collect_list(F.struct(order[F.col("section")].alias("s"), place.alias("p"), line.alias("line"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("shut"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        need = F.length(x["line"]) + 2
        skip = acc["shut"] == x["s"]
        over = acc["used"] + need > max_chars
        kept = F.struct((acc["used"] + need).alias("used"), acc["shut"].alias("shut"), F.concat(acc["lines"], F.array(x["line"])).alias("lines"))
        closed = F.struct(acc["used"].alias("used"), x["s"].alias("shut"), acc["lines"].alias("lines"))
        return F.when(skip, acc).when(over, closed).otherwise(kept)

    packed = rows.groupBy("agent").agg(items.alias("items")).withColumn("fold", F.aggregate("items", start, step))
    return packed.select("agent", F.concat(F.lit("## Agent: "), F.col("agent"), F.lit("\n"), F.array_join("fold.lines", "\n")).alias("packet"))


def trail(checkpoints: DataFrame, by: str = "project", order: str = "ts", keep: int = TRAIL, tie: str | None = None) -> DataFrame:
    """The last checkpoints of each project."""
    return diff.last_per(checkpoints, by, order, keep, tie)


def stale(projects: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    return projects.withColumn("stale", F.col("last_activity") < now - F.expr(f"interval {days} days"))


def touch_project(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Projects after new rows (project, host, model, goal, summary, last_activity): the last of each, its nulls filled from before."""
    both = projects.unionByName(new, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("project", "last_activity")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_activity"))).alias(c) for c in cols]
    return both.groupBy("project").agg(*newest, F.max("last_activity").alias("last_activity"))


def packet(projects: DataFrame, checkpoints: DataFrame, read: int = TRAIL_READ) -> DataFrame:
    """(project, packet): where a project stands, with its last checkpoints."""
    last = diff.last_per(checkpoints, "project", "ts", read).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("ts", "note")), asc=False).alias("trail"))
    lines = F.transform(F.coalesce("trail", F.array().cast("array<struct<ts:timestamp,note:string>>")), lambda t: F.concat(F.lit("- "), F.date_format(t["ts"], "yyyy-MM-dd HH:mm"), F.lit(" "), t["note"]))
    head = F.concat_ws("\n", F.concat(F.lit("project: "), F.col("project")), F.concat(F.lit("goal: "), F.col("goal")), F.concat(F.lit("summary: "), F.col("summary")))
    return projects.join(last, "project", "left").select("project", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("packet"))


def snapshot(entries: DataFrame, exchanges: DataFrame, label: str, now: Column) -> DataFrame:
    """One checkpoint row: live entries, the last ten exchanges, and an id from their content."""
    facts = entries.filter("not deleted").agg(F.count("*").alias("entries"), F.bit_xor(F.xxhash64("entry_id", "content")).alias("state"))
    last = exchanges.orderBy(F.col("xid").desc()).limit(10).agg(F.sort_array(F.collect_list(F.struct("xid", "q", "a"))).alias("recent"))
    return facts.crossJoin(last).select(F.lower(F.hex(F.xxhash64(F.lit(label), "state", "entries"))).alias("checkpoint_id"), F.lit(label).alias("label"), now.alias("created_at"), "entries", "recent")


def prune(checkpoints: DataFrame, keep: int = CHECKPOINTS) -> DataFrame:
    """The newest checkpoints, of equal times those with the larger id."""
    return checkpoints.orderBy(F.col("created_at").desc(), F.col("checkpoint_id").desc()).limit(keep)


def checkpoint_entries(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints as turn entries (entry_id, content, key, kind, source, meta), so that they are found by search."""
    meta = F.create_map(F.lit("checkpoint"), F.lit("true"), F.lit("id"), F.col("checkpoint_id"))
    number = F.xxhash64("checkpoint_id").bitwiseAND(2**63 - 1)
    return checkpoints.select(number.alias("entry_id"), F.to_json(F.struct("*")).alias("content"), F.concat(F.lit("checkpoint "), F.col("label")).alias("key"), F.lit(4).alias("kind"), F.lit("checkpoint").alias("source"), meta.alias("meta"))


def recover(queries: DataFrame, entries: DataFrame, top_k: int = 5, least: float = 0.50, recent_pool: int = 20, **options) -> DataFrame:
    """(query_id, recovered, checkpoint, confidence, recent): the best checkpoint for each question and the latest exchanges near it.

    Checkpoints are turn entries with ``checkpoint`` in their meta; exchanges are
    what the word "exchange" finds among the others, each once, the last
    ``top_k`` by number.  A question without a checkpoint has nulls.
    """
    hits = memory.search(queries, entries, top_k=2 * top_k, kind="turn", fuzzy=least, **options)
    first = Window.partitionBy("query_id").orderBy("rank")
    best = hits.filter(F.col("meta")["checkpoint"].isNotNull() & (F.col("confidence") >= least)).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    word = queries.sparkSession.createDataFrame([(0, "exchange")], "query_id bigint, query string")
    near = memory.search(word, entries.filter(F.col("meta")["checkpoint"].isNull()), top_k=recent_pool, kind="turn", fuzzy=least, **options)
    said = near.select(F.col("meta")["exchange"].try_cast("bigint").alias("exchange"), "content", "confidence", "rank").filter("exchange is not null")
    once = said.groupBy("exchange").agg(F.min_by(F.struct("content", "confidence"), "rank").alias("c"))
    last = once.select(F.struct("exchange", "c.content", "c.confidence").alias("x")).orderBy(F.col("x.exchange").desc()).limit(top_k)
    recent = last.agg(F.sort_array(F.collect_list("x"), asc=False).alias("recent"))  # one row
    found = queries.select("query_id").join(best.select("query_id", F.col("content").alias("checkpoint"), "confidence"), "query_id", "left").crossJoin(F.broadcast(recent))
    return found.select("query_id", F.col("checkpoint").isNotNull().alias("recovered"), "checkpoint", "confidence", F.when(F.col("checkpoint").isNotNull(), F.col("recent")).alias("recent"))
