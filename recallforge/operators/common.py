"""Cutting lineage in iterative operators, and tables at rest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only on a single machine without it."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="recallforge-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint()


def at_rest(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again, for tables that several steps read; the files go when the program ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for path, spark in _held.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            return
