"""Packing token sequences into fixed windows by multiway differencing.

Texts become tokens, full windows are cut off, and the rests are packed in
groups of about ``group_windows`` windows by the Karmarkar-Karp method: partial
partitions with the largest spread are merged, the largest part of one with the
smallest of the other, until one partition with nearly equal windows is left.
If its largest window exceeds the capacity, the number of windows goes up by
one.  A group never leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, portions, staged

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict = {}


def merges_by_id(vocab: dict[str, int], merges: list, added: list[str]) -> bool:
    """Whether every token is a byte, an added one or made by one merge, and the merges make ids in rising order."""
    made = []
    for m in merges:
        left, right = m if isinstance(m, list) else m.split(" ")
        made.append(vocab.get(left + right, -1))
    rising = all(a < b for a, b in zip([-1, *made], made, strict=False))
    return rising and set(made) | {i for t, i in vocab.items() if len(t) == 1 or t in added} == set(vocab.values())


class Encoder:
    """Token ids of a byte-level BPE vocabulary in the JSON format of ``tokenizers``.

    Plain texts go through the same merges in ``tiktoken``, which is four times
    as fast; a text that spells an added token goes through ``tokenizers``, and
    so do all texts where the merges aren't in the order of the ids they make
    (``tiktoken`` merges by least id) or the file asks for more than byte-level
    merging.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.fast = None
        model = spec["model"]
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if plain_model and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and merges_by_id(model["vocab"], model["merges"], self.added):
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
            ranks = {bytes(spelled[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding("from-json", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(lengths: list[int], k: int) -> tuple[int, list[list[int]]]:
    """Karmarkar-Karp: split items into ``k`` windows; the largest sum and each window's items."""
    if k == 1:
        return sum(lengths), [list(range(len(lengths)))]
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        _, _, a, slots = heapq.heappop(heap)
        _, _, b, others = heapq.heappop(heap)
        sums = a + b[::-1]
        merged = [x if y is None else y if x is None else (x, y) for x, y in zip(slots, reversed(others), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, [merged[j] for j in order]))
        serial += 1
    windows = []
    for slot in heap[0][3] if heap else [None] * k:
        items, todo = [], [] if slot is None else [slot]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        windows.append(sorted(items))
    return max((sum(lengths[i] for i in w) for w in windows), default=0), windows


def windows_for(lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewest near-equal windows by differencing that keep the capacity; each item must fit by itself."""
    k = max(1, math.ceil(sum(lengths) / capacity))
    while True:
        largest, windows = difference(lengths, k)
        if largest <= capacity:
            return [w for w in windows if w]
        k += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, piece: int = 512, group_windows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a JSON file of ``tokenizers``, at the same path on every
    machine.  A document is its ids and ``end_id``.  Whole windows of it are
    sequences of their own; the rest is cut into pieces of at most ``piece``
    ids.  Null texts count as empty and give one piece with ``end_id``; rows that
    repeat an id are packed one by one; null ids stay null; an empty table
    gives no rows.  Other columns are ignored.
    """
    rows = frugal(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        serial = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def settle() -> None:
            nonlocal serial, rest, held
            for window in windows_for([r[2] for r in rest], capacity):
                at = 0
                for i in window:
                    out.append((*rest[i], serial, at))
                    at += rest[i][2]
                serial += 1
            rest, held = [], 0

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in portions(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cut = n - n % capacity
                for start in range(0, cut, capacity):
                    out.append((doc_id, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), n, serial, 0))
                    serial += 1
                for start in range(cut, n, piece):
                    part = ids[start : min(start + piece, n)]
                    rest.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), n))
                    held += len(part)
                if held >= group_windows * capacity:
                    settle()
                if len(out) >= 50_000:
                    yield emit()
        if rest:
            settle()
        yield emit()

    return rows.mapInArrow(run, SCHEMA)


def pack_staged(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """:func:`pack`, written once, so that later steps don't tokenise again."""
    return staged(pack(docs, tokenizer, **options), "packed")
