"""Canonical exact fingerprints: equal after Unicode, case and white-space folding.

The digest is 256 bits of xxHash over the canonical text.  Documents that share
a digest are compared byte by byte; should two different canonical texts ever
share one, those digests are widened by SHA-256 and stay apart.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, join_counted, portions, staged, text_key

BROADCAST_ROWS = 1_000_000
BITS = 256
SAMPLE = 30
PLACE_BYTES = 32 << 20
SAME_ROWS = 4096


def canonical(text: str | None) -> str:
    """NFKC, full case folding, runs of white space to one space, ends trimmed; null is empty."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(text: str | None, clash: frozenset[str] = frozenset(), bits: int = BITS) -> str:
    """``bits`` of xxHash as hexadecimal digits; with those of SHA-256 behind if the digest is in ``clash``."""
    data = canonical(text).encode()
    wide = (xxhash.xxh3_128_hexdigest(data, seed=0) + xxhash.xxh3_128_hexdigest(data, seed=0x5DEECE66D))[: bits // 4]
    return wide + hashlib.sha256(data).hexdigest() if wide in clash else wide


def _map_text(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows of (doc_id, text) through ``make(doc_id, text) -> tuple``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            rows = [make(i, t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)], names)

    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clashes(docs: DataFrame, found: DataFrame, bits: int = BITS) -> frozenset[str]:
    """Digests in ``found`` (doc_id, fingerprint) that stand for canonical texts of different bytes.

    Only documents that share a digest are read again; the least and greatest
    canonical text of each digest differ if any two do, and both are found with
    partial aggregates, however large a group of copies is.
    """
    counts = staged(found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1"), "shared-digests")
    ids = join_counted(found.select("doc_id", "fingerprint"), counts, ["fingerprint"], "n", found.count(), F.xxhash64("doc_id"))
    ids = staged(ids.select(F.col("doc_id").alias("shared_id")).distinct(), "shared-ids")
    few = ids.count() <= BROADCAST_ROWS  # 16 MB at most; beyond it, a shuffled join
    again = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left_semi")
    texts = _map_text(again, lambda _, t: (digest(t, bits=bits), canonical(t).encode()), "fingerprint string, bytes binary")
    ends = texts.groupBy("fingerprint").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    unlike = frozenset(r[0] for r in ends.filter("least <> most").select("fingerprint").collect())
    discard(counts, ids)
    return unlike


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint), a row for each row of ``docs``; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(_map_text(rows, lambda i, t: (i, digest(t, bits=bits)), "doc_id long, fingerprint string"), "fingerprints")
    clash = clashes(rows, found, bits)
    return _map_text(rows, lambda i, t: (i, digest(t, clash, bits)), "doc_id long, fingerprint string") if clash else found


def exact_groups(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, fingerprint, first_id, n): each document's group of equal canonical texts."""
    found = fingerprints(docs, **columns)
    groups = found.groupBy(F.col("fingerprint").alias("of")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return found.join(groups, F.col("fingerprint") == F.col("of")).drop("of")


NEXT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NULL = -(2**63)


def _with_next(docs: DataFrame) -> DataFrame:
    """(place, late, doc_id, key, times, text), dealt by place: each document and, late, the one after a place's last.

    Places are ranges of (id, key) that start at a row of the table, so the row
    after a place's last is the first of the next place; that one is sent to
    both.  The last place gets the first row of all.  Null ids, and any other id
    that many rows have, spread over places by their keys; rows that are equal
    in both are counted (``times``) before they move.
    """
    rows = frugal(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min(F.struct("id", "key")).alias("first")).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = max(parts, math.ceil((facts["size"] or 0) / PLACE_BYTES))
    # about SAMPLE rows a place, chosen by hash; only where places begin depends on them
    share = min(1.0, SAMPLE * places / max(1, facts["n"]))
    drawn = rows.select("id", "key").filter(F.pmod(F.xxhash64("id", "key"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    some = sorted(map(tuple, drawn.collect()))
    bounds = sorted({some[i * len(some) // places] for i in range(1, places)}) if some else []
    ids = np.array([b[0] for b in bounds], np.int64)
    first = (facts["first"]["id"], facts["first"]["key"]) if facts["n"] else None
    fields = ["place", "late", "id", "key", "times", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            own = list(zip(b.column("id").to_pylist(), b.column("key").to_pylist(), strict=True))
            seen: dict[tuple[int, int], int] = {}
            times: list[int] = []
            at: list[int] = []
            for i, k in enumerate(own):
                if k in seen:
                    times[seen[k]] += 1
                else:
                    seen[k] = len(at)
                    at.append(i)
                    times.append(1)
            low = np.searchsorted(ids, [own[i][0] for i in at], side="left")
            high = np.searchsorted(ids, [own[i][0] for i in at], side="right")
            place = [int(h) if lo == h else bisect.bisect_right(bounds, own[i]) for lo, h, i in zip(low, high, at, strict=True)]
            late = [(j, p - 1) for j, (p, i) in enumerate(zip(place, at, strict=True)) if p and bounds[p - 1] == own[i]]
            late += [(j, len(bounds)) for j, i in enumerate(at) if own[i] == first]
            rows_ = pa.array([*at, *(at[j] for j, _ in late)], pa.int64())
            columns = [pa.array([*place, *(p for _, p in late)], pa.int64()), pa.array([False] * len(at) + [True] * len(late)), b.column("id").take(rows_), b.column("key").take(rows_), pa.array([*times, *([1] * len(late))], pa.int64()), b.column("text").take(rows_)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    dealt = rows.mapInArrow(deal, "place long, late boolean, id long, key long, times long, text string")
    return dealt.repartition("place").sortWithinPartitions("place", "late", "id", "key")


def edited_fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text.

    The edit replaces the last half (rounded down) of the code points by the
    first as many (or all) of the next document in ascending doc_id, after the
    last the first.  Null ids sort first, rows of one id by a hash of the text;
    equal rows follow each other.  A single document is its own next.  The
    likeness of two fingerprints is 1 if they are equal, and so are the canonical
    texts, else 0.  An empty table gives an empty result; other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    first_id = F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id")

    def make(clash: frozenset[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # place, id, text, fingerprint and number of the equal rows whose next comes
            out: list[tuple] = []

            def like(a: str, b: str, mark_a: str, mark_b: str) -> float:
                return float(mark_a == mark_b and canonical(a) == canonical(b))

            def add(next_text: str, next_mark: str, times: int) -> None:
                _, of, own, own_mark, _ = held
                n = len(own)
                edited = own[: n - n // 2] + next_text[: n // 2]
                edited_mark = digest(edited, clash, bits)
                row = (of, n, hashlib.sha256(edited.encode()).hexdigest(), own_mark, edited_mark, like(own, edited, own_mark, edited_mark), like(own, next_text, own_mark, next_mark))
                out.extend((*row, min(SAME_ROWS, times - at)) for at in range(0, times, SAME_ROWS))

            for b in portions(batches):
                for place, late, id_, times, text in zip(*(b.column(c).to_pylist() for c in ("place", "late", "id", "times", "text")), strict=True):
                    if held is not None and held[0] != place:
                        held = None
                    if late and held is None:
                        continue
                    text = text or ""
                    if held is not None and not late and held[1] == id_ and held[2] == text:
                        held = (*held[:4], held[4] + times)  # equal rows that came from several tasks
                        continue
                    mark = digest(text, clash, bits)
                    if held is not None:
                        if held[4] > 1:
                            add(held[2], held[3], held[4] - 1)
                        add(text, mark, 1)
                    held = None if late else (place, id_, text, mark, times)
                if len(out) >= 5000:
                    yield _batch(out)
            yield _batch(out)

        return run

    def finished(clash: frozenset[str]) -> DataFrame:
        rows = staged(_with_next(docs).mapInArrow(make(clash), f"id long, {NEXT_SCHEMA.split(', ', 1)[1]}, times long"), "edited-fingerprints")
        return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(first_id, *[f.split()[0] for f in NEXT_SCHEMA.split(", ")[1:]])

    found = finished(frozenset())
    clash = clashes(docs, found.select("doc_id", "fingerprint"), bits)
    return finished(clash) if clash else found


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = ["id", *(f.split()[0] for f in NEXT_SCHEMA.split(", ")[1:]), "times"]
    columns = list(zip(*out, strict=True)) if out else [()] * len(names)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
