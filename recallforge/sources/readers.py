"""Readers that find content and key by field name: JSON lines, plain text, transcripts, cards, embedding matrices."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names by priority.
CONTENT_FIELDS = ["content", "text", "body", "answer", "value", "fact", "output", "message"]
KEY_FIELDS = ["key", "question", "query", "title", "name", "prompt", "input", "id"]
SAID_FIELDS = ["content", "text", "message"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, source): lines that are neither blank nor comments, trimmed, with their file's name."""
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    rows = spark.read.text(path).select(F.trim("value").alias("line"), name.alias("source"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _first(item: Column, names: list[str]) -> Column:
    """The first field that holds text that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(item, f"$.{n}")), F.lit("")) for n in names])


def items(rows: DataFrame, column: str = "line") -> DataFrame:
    """(content, key, meta): JSON objects by their fields, other fields as meta; any other line is content."""
    line = F.col(column)
    is_object = line.startswith("{") & F.try_parse_json(line).isNotNull()
    bare = F.when(line.startswith('"'), F.coalesce(F.try_variant_get(F.try_parse_json(line), "$", "string"), line)).otherwise(line)
    whole = F.from_json(line, "map<string,string>")
    content, key = _first(line, CONTENT_FIELDS), _first(line, KEY_FIELDS)
    rest = F.map_filter(whole, lambda k, v: ~k.isin(*CONTENT_FIELDS, *KEY_FIELDS))
    out = rows.withColumns({"content": F.when(is_object, content).otherwise(bare), "key": F.when(is_object, key), "meta": F.when(is_object, rest)})
    return out.filter("content is not null").drop(column)


def transcript(spark: SparkSession, path: str, session: str = "default") -> DataFrame:
    """(session, turn, role, text) of a JSON-lines transcript; lines that don't parse are skipped."""
    rows = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("turn"))
    said = _first(F.col("value"), SAID_FIELDS)
    return rows.select(F.lit(session).alias("session"), "turn", F.coalesce(F.get_json_object("value", "$.role"), F.lit("user")).alias("role"), said.alias("text")).filter("text is not null")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """One fact a line."""
    return lines(spark, path).select(F.col("line").alias("content"), "source")


def cards(spark: SparkSession, documents: list[str]) -> DataFrame:
    """Skill cards from JSON (or, where a YAML library is there, YAML) texts: one card or a list, keys as a list, a map's values or lines."""
    from ..operators.skills import CARD

    found = []
    for body in documents:
        try:
            value = json.loads(body)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("a card that isn't JSON needs a YAML library") from e
            value = yaml.safe_load(body)
        for c in value if isinstance(value, list) else [value]:
            if not isinstance(c, dict):
                continue
            keys = c.get("keys") or []
            keys = keys.split("\n") if isinstance(keys, str) else [x for v in keys.values() for x in (v if isinstance(v, list) else [v])] if isinstance(keys, dict) else keys
            keys = [str(k).strip() for k in keys if str(k).strip()]
            found.append((c.get("name") or "", c.get("content") or "", keys, c.get("domain", "general"), c.get("difficulty", "medium"), c.get("pattern", ""), c.get("source", "")))
    return spark.createDataFrame(found, CARD)


def project_files(spark: SparkSession, folder: str, max_bytes: int = 256_000) -> DataFrame:
    """(path, content, md5): files below a folder up to a size, with relative paths."""
    root = folder.rstrip("/").split("://")[-1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    return rows.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("path"), "content", F.substring(F.md5("content"), 1, 16).alias("md5"))


def safetensors(blob: bytes) -> dict[str, np.ndarray]:
    """Matrices of a safetensors file (F32, F16, BF16)."""
    (n,) = struct.unpack_from("<Q", blob)
    head = json.loads(blob[8 : 8 + n])
    out = {}
    for name, spec in head.items():
        if name == "__metadata__":
            continue
        a, b = spec["data_offsets"]
        raw = blob[8 + n + a : 8 + n + b]
        kind = spec["dtype"]
        if kind == "BF16":
            values = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        elif kind in ("F32", "F16"):
            values = np.frombuffer(raw, "<f4" if kind == "F32" else "<f2").astype(np.float32)
        else:
            raise ValueError(f"unsupported type: {kind}")
        out[name] = values.reshape(spec["shape"])
    return out


