"""Removal of repeated runs of lines by content-defined chunks.

A rolling hash runs over the hashes of every ``SPAN`` neighbouring lines; a
chunk ends behind such lines at one hash in ``DIVISOR``.  So boundaries depend
on neighbouring lines only, and text put in before a passage does not move those
inside it.  Chunks of several lines that occur again are removed after byte
comparison; the first occurrence stays.

Chunks at the edges of a passage also hold lines around it, and a short passage
may lie in such chunks alone.  So what chunks leave is compared at the smallest
grain too: every repeated window (two neighbouring lines that are not blank,
with the blank ones between them, or one long line) is removed wherever the same
bytes stand at an earlier place.  Chunks settle long copies with few comparisons,
windows the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, join_counted, mix64, numbered, portions, staged, text_buffer, text_key, word_counts

DIVISOR = 8
SPAN = 3
LONG_LINE = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNODD = np.uint64(pow(int(_ODD), -1, 1 << 64))
CHUNK, PAIR, SINGLE, WIDE = 0, 1, 2, 3


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and words of the lines of a batch, each line's text and its place there."""
    data, offsets = text_buffer(texts)
    raw = data.tobytes()
    cuts = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    starts = np.sort(np.concatenate([cuts + 1, offsets[:-1]]), kind="stable")
    # a text that ends in a line feed has an empty last line, and so does an empty text
    hashes = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    words = word_counts(data, np.append(starts, len(data))) if len(starts) else np.empty(0, np.int64)
    hashes = (hashes & ~np.uint64(1)) | (words > 0).astype(np.uint64)  # the last bit: the line isn't blank
    n = np.diff(np.searchsorted(cuts, offsets)) + 1
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return hashes, words, doc, place


def _spanned(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes of the lines from ``start`` to before ``end``."""
    if not len(start):
        return np.empty(0, np.uint64)
    power = np.cumprod(np.append(np.uint64(1), np.full(len(h) - 1, _ODD)))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(h), _UNODD)))
    sums = np.append(np.uint64(0), np.cumsum(mix64(h) * power))
    return mix64((sums[end] - sums[start]) * back[start] ^ mix64((end - start).astype(np.uint64)))


def chunk_bounds(h: np.ndarray, words: np.ndarray, doc: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the chunks that have two lines or more that are not blank, without blank lines at their edges."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.append(doc[1:] != doc[:-1], True)
    at = np.arange(SPAN - 1, len(h))
    at = at[doc[at] == doc[at - SPAN + 1]]
    last[at] |= _spanned(h, at - SPAN + 1, at + 1) % np.uint64(divisor) == 0
    ends = np.flatnonzero(last) + 1
    starts = np.append(0, ends[:-1])
    full = np.flatnonzero(words > 0)
    lo, hi = np.searchsorted(full, starts), np.searchsorted(full, ends)
    some = hi - lo > 1
    return full[lo[some]], full[hi[some] - 1] + 1


PLACES = "k1 long, k2 boolean, key long, place int, size int, digest long, kind byte"


def places(docs: DataFrame, divisor: int, long_line: int, bits: int) -> DataFrame:
    """Where chunks and windows of (k1, k2, key, text) stand: place is the first line, size counts the lines, ``digest`` is the rolling hash.

    Windows are two neighbouring lines that are not blank, two such lines with
    blank ones between, or one long line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            h, words, doc, place = _lines(b.column("text"))
            starts, ends = chunk_bounds(h, words, doc, divisor)
            lone = np.flatnonzero(words >= long_line)
            full = np.flatnonzero(words > 0)
            here = doc[full[1:]] == doc[full[:-1]]
            one, two = full[:-1][here], full[1:][here]
            at = np.concatenate([starts, lone, one])
            end = np.concatenate([ends, lone + 1, two + 1])
            kind = np.concatenate([np.full(len(starts), CHUNK), np.full(len(lone), SINGLE), np.where(two - one > 1, WIDE, PAIR)]).astype(np.int8)
            rolled = _spanned(h, at, end) >> np.uint64(64 - bits)
            rows = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(rows) for c in ("k1", "k2", "key")), pa.array(place[at].astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array(rolled.view(np.int64)), pa.array(kind)],
                [f.split()[0] for f in PLACES.split(", ")],
            )

    return frugal(docs).select("k1", "k2", "key", "text").mapInArrow(run, PLACES)


def repeated_spans(docs: DataFrame, divisor: int, long_line: int, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, key, spans): per document the chunks and windows that occur elsewhere too, as (kind, start, end, digest, first); and the tables to discard then."""
    found = places(docs, divisor, long_line, bits)
    same = ["digest", "kind"]
    counts = staged(found.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1"), "line-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    deal = F.xxhash64("k1", "k2", "key", "place")
    shared = staged(join_counted(found, counts, same, "n", total, deal).drop("n"), "line-places")
    place = F.struct("k2", "k1", "key", "place")
    firsts = staged(shared.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("least")), "line-firsts")
    flagged = join_counted(shared, firsts, same, "n", total, deal)
    span = F.struct("kind", F.col("place").alias("start"), (F.col("place") + F.col("size")).alias("end"), "digest", (place == F.col("least")).alias("first"))
    # equal rows of one document count as one
    return flagged.groupBy("k1", "k2", "key").agg(F.array_sort(F.collect_set(span)).alias("spans")), [counts, shared, firsts]


def cut_lines(text: str | None, spans: list[dict], unlike: frozenset[tuple[int, int]]) -> tuple[set[int], list[tuple[dict, bytes]]]:
    """The lines of a text that go, and the bytes of each span that took part.

    Spans come chunks first.  A window whose lines are gone already has nothing
    to add; one that overlaps its own first place leaves that whole.
    """
    lines = text.split("\n")
    kept = {(s["kind"], s["digest"]): s["end"] for s in spans if s["first"]}
    gone: set[int] = set()
    seen = []
    for s in spans:
        of = (s["kind"], s["digest"])
        cut = max(s["start"], kept.get(of, 0))
        if of in unlike or s["kind"] != CHUNK and not s["first"] and gone.issuperset(range(cut, s["end"])):
            continue
        seen.append((s, "\n".join(lines[s["start"] : s["end"]]).encode()))
        if not s["first"]:
            gone.update(range(cut, s["end"]))
    return gone, seen


def remove_repeated(docs: DataFrame, divisor: int = DIVISOR, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The rows and columns of ``docs`` with repeated chunks of lines cut from the text, and ``n_lines`` and ``removed_lines`` behind (in place of columns of these names).

    A chunk is removed if it has two lines or more that are not blank, or one
    line of ``long_line`` words, and its bytes occur at an earlier place; the
    place that stays is the one of the least id (null last), then the least
    line.  The same holds for every two lines with only blank ones between, so
    no run of lines that ``docs`` had earlier is left.  Where repeats overlap, a
    line goes with the earliest of them, and each line that goes stays at an
    earlier place.  Null texts stay null with no lines; an empty text has one line.  A
    text that loses all lines becomes empty.  Rows equal in id and text count
    as one document and are cut alike.  Single short lines always stay.  Should
    different bytes share a digest (of ``bits`` bits), all of these stay.
    """
    names, kinds = docs.columns, [f.dataType for f in docs.schema.fields]
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = (names.index(c) for c in (id_col, text_col))
    own_id = F.col(f"c{id_at}").cast("long")
    rows = held.withColumns({"k1": F.coalesce(own_id, F.lit(0)), "k2": own_id.isNull(), "key": text_key(f"c{text_at}")})
    spans, used = repeated_spans(rows.select("k1", "k2", "key", F.col(f"c{text_at}").cast("string").alias("text")), divisor, long_line, bits)
    cut = rows.join(spans, ["k1", "k2", "key"], "left").drop("k1", "k2", "key")
    fields = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} {k.simpleString()}" for c, k in zip(fields, kinds, strict=True)) + ", n_lines long, removed_lines long, chunk array<struct<kind:int,digest:bigint,bytes:binary>>"
    chunk_type = pa.list_(pa.struct([("kind", pa.int32()), ("digest", pa.int64()), ("bytes", pa.binary())]))

    def cutter(clash: frozenset[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                texts, n_lines, removed, chunks = [], [], [], []
                known: dict[tuple[int, int], bytes] = {}  # a batch passes equal copies of a chunk on once
                for text, found in zip(b.column(f"c{text_at}").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    gone, seen = cut_lines(text, found, clash) if text is not None and found else (set(), [])
                    new = []
                    for s, body in seen:
                        of = (s["kind"], s["digest"])
                        if known.get(of) != body:
                            known[of] = body
                            new.append({"kind": of[0], "digest": of[1], "bytes": body})
                    texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
                    n_lines.append(0 if text is None else text.count("\n") + 1)
                    removed.append(len(gone))
                    chunks.append(new or None)
                columns = [b.column(c) for c in fields]
                columns[text_at] = pa.array(texts, b.schema.field(f"c{text_at}").type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(chunks, chunk_type)], [*fields, "n_lines", "removed_lines", "chunk"])

        return run

    clash: frozenset[tuple[int, int]] = frozenset()
    while True:
        done = staged(cut.mapInArrow(cutter(clash), schema), "line-cut")
        pieces = done.filter("chunk is not null").select(F.explode("chunk").alias("c")).select("c.kind", "c.digest", "c.bytes")
        ends = pieces.groupBy("kind", "digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).filter("lo <> hi")
        unlike = frozenset(map(tuple, ends.select("kind", "digest").collect()))
        if not unlike:
            break
        clash |= unlike  # different bytes under one digest: none of them is touched
        discard(done)
    discard(*used)
    mine = ("n_lines", "removed_lines")
    return done.select(*[F.col(f).alias(n) for f, n in zip(fields, names, strict=True) if n not in mine], *mine)


def clean_lines(docs: DataFrame, **options) -> DataFrame:
    """:func:`remove_repeated` with the columns of ``docs`` alone; n_chars, if there, is counted again."""
    held, names = numbered(docs)
    own_id, own_text = (f"c{names.index(options.pop(k, d))}" for k, d in (("id_col", "doc_id"), ("text_col", "text")))
    found = remove_repeated(held, id_col=own_id, text_col=own_text, **options)
    count = F.coalesce(F.length(own_text), F.lit(0))
    return found.select(*[(count.cast(f.dataType) if n == "n_chars" else F.col(f.name)).alias(n) for f, n in zip(held.schema.fields, names, strict=True)])
