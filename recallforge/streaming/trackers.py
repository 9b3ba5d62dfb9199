"""Trackers that compare a folder with its last snapshot, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import diff, graph, units
from ..operators.common import at_rest
from ..sources import readers


def track_once(spark: SparkSession, folder: str, snapshot: str, rules: list[str] | None = None) -> DataFrame:
    """(source, status) of a project's units against the last snapshot, which is replaced."""
    now = units.extract(readers.project_files(spark, folder), rules).select("source", "digest").dropDuplicates(["source"])
    try:
        before = spark.createDataFrame(spark.read.parquet(snapshot).collect(), "source string, digest string")
    except Exception as e:  # noqa: BLE001 - no snapshot yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = spark.createDataFrame([], "source string, digest string")
    changes = diff.diff_digests(before, now)
    rows = changes.collect()  # units of one project
    now.write.mode("overwrite").parquet(snapshot)
    return spark.createDataFrame(rows, changes.schema)


def track_graph_once(spark: SparkSession, folder: str, out: str) -> DataFrame | None:
    """(path, status) of a project's source files against the digests beside the last graph, which is built anew if any differ.

    The graph is written to ``out`` before the digests are, so a failure in
    between means one build too many and never one too few.  None without changes.
    """
    files = readers.project_files(spark, folder).select("path", F.col("content").cast("string").alias("content"))
    files = files.withColumn("language", text.language_of(F.col("path"))).filter("language is not null")
    now = at_rest(files.select("path", F.md5("content").alias("digest")), "digests")
    try:
        before = at_rest(spark.read.parquet(f"{out}/digests"), "digests")  # kept apart, for its place is written over
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = spark.createDataFrame([], "path string, digest string")
    changes = diff.diff_digests(before, now, "path")
    if changes.isEmpty():
        return None
    graph.dump(*graph.build(files), f"{out}/graph")
    now.write.mode("overwrite").parquet(f"{out}/digests")
    return changes


def watch(spark: SparkSession, folder: str, snapshot: str, checkpoint: str, on_change: Callable[[DataFrame], None], seconds: int = 5, glob: str = "*") -> StreamingQuery:
    """Rebuild whenever new files arrive: a file stream triggers :func:`track_once`, at most every few seconds."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def batch(_: DataFrame, number: int) -> None:
        changes = track_once(spark, folder, snapshot)
        if not changes.isEmpty():
            on_change(changes)

    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
