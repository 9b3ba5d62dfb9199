"""Stores and racks on disk: entries as Parquet, partitioned by cartridge, with tombstones beside them.

Appending writes new files only; deleting appends ids to the tombstones;
compacting rewrites.  Spark's commit protocol makes each of these whole or void.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import detectors, text, vectors
from .operators import diff, memory, rack
from .operators.common import at_rest
from .schema import FUZZY_THRESHOLD, MAX_ENTRIES, SEMANTIC_THRESHOLD, SHARD_SEP, kind_number
from .sources import exports

COLUMNS = ["entry_id", "cartridge", "content", "key", "kind", "source", "meta", "trust", "key_norm", "k", "c"]


@dataclass
class Rack:
    """Cartridges under one folder.

    ``routes`` lead kinds (names or numbers) to cartridges and ``default`` takes
    the rest; ``normalizer`` is a comma list of steps that replaces the usual
    form of exact keys.  A cartridge that reaches ``max_entries`` is split as it
    is written.  ``mounts`` are cartridges from elsewhere and ``hidden`` ones are
    left out of what is read.
    """

    spark: SparkSession
    path: str
    routes: dict[str, str] = field(default_factory=dict)
    default: str = "main"
    seed: str = vectors.SEED
    normalizer: str = ""
    max_entries: int = MAX_ENTRIES
    mounts: dict[str, str] = field(default_factory=dict)
    hidden: set[str] = field(default_factory=set)

    def _normalize(self):
        return text.normalizer(self.normalizer) if self.normalizer else text.normalize

    def _fs(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        return jvm, jvm.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, version: int, name: str) -> str:
        return f"{self.path}/{f'v{version}/' if version else ''}{name}"

    def _version(self) -> int:
        """The version that holds: the greatest one with a mark, which is made when its files are whole; 0 without marks."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.Path(f"{self.path}/current-*"))
        return max((int(f.getPath().getName().removeprefix("current-")) for f in found or ()), default=0)

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._at(self._version(), name))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _folder(self, name: str):
        """Where a cartridge's files are."""
        jvm, _ = self._fs()
        part = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("cartridge", name)
        return jvm.Path(f"{self._at(self._version(), 'entries')}/{part}")

    def entries(self) -> DataFrame:
        """All entries of the cartridges that are mounted, with their tombstones applied."""
        rows = self._own()
        for name, path in self.mounts.items():
            more = self.spark.read.parquet(path).withColumns({"cartridge": F.lit(name), "deleted": F.lit(False)})
            rows = rows.unionByName(more, allowMissingColumns=True)
        return rows.filter(~F.col("cartridge").isin(*self.hidden)) if self.hidden else rows

    def _own(self) -> DataFrame:
        """The rack's own entries, hidden or not."""
        rows = self._read("entries")
        if rows is None:
            empty = memory.build_entries(self.spark.createDataFrame([], "entry_id bigint, content string"))
            return empty
        rows = rows.withColumn("deleted", F.lit(False))
        gone = self._read("deleted")
        return rows if gone is None else memory.delete(rows, gone)

    def add(self, rows: DataFrame, kind: str | int | None = None, cartridge: str | None = None, reject_credentials: bool = True) -> int:
        """Append (content[, key, kind, source, meta]); returns how many were kept.  Later rows are newer."""
        known = self._read("entries")
        base = 0 if known is None else (known.agg(F.max("entry_id")).first()[0] or 0)
        if kind is not None:
            rows = rows.withColumn("kind", F.lit(kind_number(kind)))
        elif "kind" not in rows.columns:
            rows = rows.withColumn("kind", F.lit(0))
        if cartridge is not None:
            rows = rows.withColumn("cartridge", F.lit(cartridge))
        elif "cartridge" not in rows.columns:
            rows = rack.route(rows, self.routes, self.default)
        rows = rows.withColumn("entry_id", F.monotonically_increasing_id() + (base + 1))
        built = memory.build_entries(rows, self.seed, self._normalize(), reject_credentials)
        built = at_rest(built.select(*COLUMNS), "added")
        self._split(built, known).write.mode("append").partitionBy("cartridge").parquet(self._at(self._version(), "entries"))
        return built.count()

    def _split(self, built: DataFrame, known: DataFrame | None) -> DataFrame:
        """New entries with the shards that take them; full cartridges become shards by a change of name.

        Where a run fails after that, entries are whole and in a shard, which
        searches of the cartridge read as well.
        """
        rows = self.spark.createDataFrame([], "cartridge string, entry_id bigint") if known is None else known.select("cartridge", "entry_id")
        held = rack.held(rows)
        grown = built.groupBy("cartridge").agg(F.count("*").alias("more")).join(held, "cartridge", "left").fillna({"held": 0, "top": 1})
        full = grown.filter(F.col("held") + F.col("more") >= self.max_entries).collect()  # a row for each folder to rename
        if not full:
            return built
        shards = at_rest(rack.assign_shards(built, self.max_entries, held), "shards")
        _, fs = self._fs()
        for r in full:
            if r["held"]:
                fs.rename(self._folder(r["cartridge"]), self._folder(f"{r['cartridge']}{SHARD_SEP}{r['top'] + 1}"))
        return built.join(shards.select("entry_id", "shard"), "entry_id").withColumn("cartridge", F.col("shard")).select(*COLUMNS)

    def create(self, name: str, overwrite: bool = False) -> Rack:
        """Mount a cartridge; one that exists keeps its entries unless it is to be overwritten."""
        _, fs = self._fs()
        if overwrite:
            self.mounts.pop(name, None)
            fs.delete(self._folder(name), True)
        if name not in self.mounts:
            fs.mkdirs(self._folder(name))
        self.hidden.discard(name)
        return self

    def register(self, name: str, path: str) -> Rack:
        """Mount a folder of entries, such as an archive, as a cartridge; raises where there is none."""
        jvm, _ = self._fs()
        at = jvm.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(path)
        self.mounts[name] = path
        self.hidden.discard(name)
        return self

    def unload(self, name: str) -> bool:
        """Leave a cartridge out of what is read; its files stay.  Whether it was there."""
        if self.mounts.pop(name, None) is not None:
            return True
        _, fs = self._fs()
        there = name not in self.hidden and fs.exists(self._folder(name))
        if there:
            self.hidden.add(name)
        return there

    def drop(self, name: str, files: bool = False) -> bool:
        """Unload a cartridge, with ``files`` for good; those of a registered folder stay."""
        own = name not in self.mounts
        found = self.unload(name)
        if files and own:
            _, fs = self._fs()
            found = fs.delete(self._folder(name), True) or found
            self.hidden.discard(name)
        return found

    def swap(self, name: str = "session", label: str = "archive") -> str:
        """Move a session with its shards to an archive of its own and start it anew; the archive's path, to be registered.

        The archive is whole before the session is emptied, so a failure in between loses nothing.
        """
        path = f"{self.path}/archives/{name}-{label}-{datetime.now():%Y%m%d%H%M%S%f}"
        rows = self._own().filter(rack.base_name(F.col("cartridge")) == name)
        shards = [r["cartridge"] for r in rows.select("cartridge").distinct().collect()]
        memory.live(rows).drop("deleted", "cartridge").write.parquet(path)
        _, fs = self._fs()
        for shard in shards:
            fs.delete(self._folder(shard), True)
        self.create(name)
        return path

    def teach(self, content: str, key: str | None = None, **options) -> int:
        return self.add(self.spark.createDataFrame([(content, key)], "content string, key string"), **options)

    def delete(self, ids: list[int]) -> None:
        self.spark.createDataFrame([(i,) for i in ids], "entry_id bigint").write.mode("append").parquet(self._at(self._version(), "deleted"))

    def search(self, texts: list[str] | DataFrame, top_k: int = 3, kind: str | int | None = None, cartridges: list[str] | None = None, fuzzy: float = FUZZY_THRESHOLD, semantic: float = SEMANTIC_THRESHOLD, embed=None) -> DataFrame:
        """Hits of all cartridges, merged, for texts or a table of queries (query_id, query); with ``embed`` also by sign vectors, where entries have them."""
        asked = texts if isinstance(texts, DataFrame) else self.spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
        entries = self.entries()
        embed = embed if {"sk", "sc"} <= set(entries.columns) else None
        return rack.search(asked, entries, top_k, cartridges, kind=kind, fuzzy=fuzzy, semantic=semantic, seed=self.seed, normalize=self._normalize(), embed=embed)

    def search_grouped(self, texts: list[str], top_k: int = 3, group_key: str = "skill") -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
        return rack.search_grouped(asked, self.entries(), top_k, group_key, seed=self.seed, normalize=self._normalize())

    def stats(self) -> DataFrame:
        return rack.rack_stats(self.entries(), self.max_entries)

    def compact(self) -> None:
        """Rewrite without tombstones, shards and repeated contents, as a new version.

        The mark of the version is made when its files are whole, so a failure
        at any point leaves one whole version that holds; the old files go last.
        """
        old = self._version()
        new = old + 1
        jvm, fs = self._fs()
        fs.delete(jvm.Path(f"{self.path}/v{new}"), True)  # of a run that failed
        rack.compact_shards(self._own()).select(*COLUMNS).write.partitionBy("cartridge").parquet(self._at(new, "entries"))
        fs.create(jvm.Path(f"{self.path}/current-{new}"), True).close()
        for name in ("entries", "deleted") if not old else (f"v{old}",):
            fs.delete(jvm.Path(f"{self.path}/{name}"), True)
        if old:
            fs.delete(jvm.Path(f"{self.path}/current-{old}"), False)

    def export(self, path: str, form: str = "json") -> None:
        made = exports.json_lines(self.entries()) if form == "json" else exports.markdown(self.entries())
        made.select("value").write.mode("overwrite").text(path)

    def diff(self, other: Rack) -> DataFrame:
        """What changed from this rack to another."""
        return diff.diff_entries(memory.live(self.entries()), memory.live(other.entries()))

    def scan_pii(self) -> DataFrame:
        return detectors.scan_pii(self.entries())


def remember(messages: list[dict], rack_: Rack, top_k: int = 5, gate: float = 0.60) -> list[dict]:
    """Chat messages with what the last user message recalls put into the system message; below the gate nothing changes."""
    asked = next((m["content"] for m in reversed(messages) if m.get("role") == "user"), None)
    if not asked:
        return messages
    hits = [h for h in rack_.search([asked], top_k).orderBy("rank").collect() if h["confidence"] >= gate]
    if not hits:
        return messages
    note = "Relevant memory:\n" + "\n".join(f"[{h['confidence']:.2f}] {h['content']}" for h in hits)
    if messages and messages[0].get("role") == "system":
        return [{**messages[0], "content": f"{messages[0]['content']}\n\n{note}"}, *messages[1:]]
    return [{"role": "system", "content": note}, *messages]
