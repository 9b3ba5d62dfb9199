"""MinHash near-duplicates by an inverted join over signature coordinates.

Equal shingle sets are one class, and classes are compared through signatures
of ``COORDINATES`` minima.  A class is posted under each (coordinate, value)
pair; pairs that only one class has are of no use and go.  Two classes at the
threshold agree in at least ``MATCHES`` coordinates but for one case in some
hundred thousand, so a class with fewer shared coordinates has no partner, and
of the others only a prefix is joined: the rarest shared coordinates, so many
that two such classes have ``TOGETHER`` of them in common.

Within a posting list nothing is paired that is connected already.  Rounds link
classes to one centre each.  Of what then lies apart, pairs in short lists are
counted and go on if they meet three times; long lists are compared in blocks:
the list's largest component against the rest and the rest among themselves,
each pair in the first long list that it shares, by collisions over the whole
signature and then by sets or longer signatures that travel with the posting.
A list too long for that is first split by further coordinates: two classes at
the threshold that share one coordinate agree in one more of any ``COORDINATES -
MATCHES + 1`` others, so a class is posted under that many pairs of coordinates.
Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, mix64, numbered, portions, staged, text_buffer, text_key, word_bounds, word_hashes

COORDINATES = 48
MATCHES = 25
STAR_ROUNDS = 2
STAR_MATCHES = 32
TOGETHER = 3
SMALL = 6
BLOCK = 256
SPLIT = 8192
SET_LIMIT = 256
FINE = 256
BROADCAST_ROWS = 2_000_000
ROWS = 1024
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, 512, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes.

    Words are runs of other characters than ASCII white space with A-Z
    lower-cased; a text of fewer than ``words`` words has one shingle, its whole
    sequence, and one without words has none.
    """
    data, offsets = text_buffer(texts)
    starts, ends = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    rolled = h * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, words):
        n = max(0, len(h) - k)
        rolled[:n] = mix64(rolled[:n] + h[k:]) * np.uint64(0x9E3779B97F4A7C15)
    rolled = mix64(rolled)
    found = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = hi - lo
        if n >= words:
            s = np.sort(rolled[lo : hi - words + 1])
            found.append(s if len(s) == 1 else s[np.append(True, s[1:] != s[:-1])])
        elif n:
            found.append(mix64(np.array([xxhash.xxh64_intdigest(h[lo:hi].tobytes(), seed=n)], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    least = np.full(coordinates, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _MULTIPLY[None, :coordinates] + _ADD[None, :coordinates]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sign(docs: DataFrame, words: int, coordinates: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, sig): class is a 128-bit digest of the set; both are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, ROWS):
            sets = shingle_sets(b.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, coordinates).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "class", "sig"],
            )

    rows = frugal(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, class binary, sig binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, node) for each coordinate of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(b.num_rows, -1)
            keys = sigs.astype(np.int64) + (np.arange(sigs.shape[1], dtype=np.int64) << 32)[None, :]
            node = np.repeat(b.column("node").to_numpy(), sigs.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def prefix_postings(nodes: DataFrame, matches: int, together: int = TOGETHER) -> DataFrame:
    """(key, node): the rarest shared coordinates of each class, so many that two classes with ``matches`` in common have ``together`` of these in common."""
    posts = _postings(nodes)
    counts = posts.groupBy(F.col("key").alias("shared")).count().filter("count > 1")
    # the posting side may hold a hot key; a sort-merge join lets Spark split it
    shared = posts.join(counts, F.col("key") == F.col("shared")).select("node", F.struct("count", "key").alias("post"))
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_set("post")).alias("posts")).filter(F.size("posts") >= matches)
    prefix = F.slice("posts", F.lit(1), F.size("posts") - (matches - together))
    return lists.select("node", F.explode(prefix.getField("key")).alias("key"))


def _few(df: DataFrame) -> DataFrame:
    """A broadcast hint for a staged table of ids or pairs that was counted to be small (32 MB at most); else the planner's choice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs whose signatures agree in ``matches`` places and whose set sizes allow the threshold."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            hit = pa.array((x == y).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(hit), b.column("b").filter(hit)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sources: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union.

    Texts are read again for the documents of ``pairs`` only; while the pairs
    are few they go to the texts of their first documents, and only these and
    the texts of the second documents move.
    """
    seconds = staged(pairs.select(F.col("b").alias("node")).distinct(), "near-seconds")
    left = sources.join(_few(pairs), F.col("node") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    right = sources.join(_few(seconds), "node", "left_semi").select(F.col("node").alias("of"), F.col("text").alias("text_b"))
    both = left.join(right, F.col("b") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in portions(batches, 256):
            hit = []
            held: tuple[str, np.ndarray] | None = None
            for s, second in zip(shingle_sets(c.column("text_a"), words), c.column("text_b"), strict=True):
                second = second.as_py()
                if held is None or held[0] != second:
                    held = (second, shingle_sets(pa.array([second], pa.string()), words)[0])
                common = _common(s, held[1])
                hit.append(100 * common >= percent * (len(s) + len(held[1]) - common))
            hit = pa.array(hit)
            yield pa.RecordBatch.from_arrays([c.column("a").filter(hit), c.column("b").filter(hit)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def _payload(sources: DataFrame, live: DataFrame, words: int) -> DataFrame:
    """(node, n, small, fine): the set as 32-bit hashes if it is small, and a longer signature of bytes if it is not very small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, ROWS):
            sets = shingle_sets(b.column("text"), words)
            small = [np.unique(s >> np.uint64(32)).astype("<u4").tobytes() if len(s) <= SET_LIMIT else None for s in sets]
            fine = [(signature(s, FINE) & np.uint32(255)).astype(np.uint8).tobytes() if len(s) > SET_LIMIT // 2 else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(small, pa.binary()), pa.array(fine, pa.binary())], ["node", "n", "small", "fine"])

    return sources.join(_few(live), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, n int, small binary, fine binary")


def _others(coordinate: int, coordinates: int, matches: int) -> np.ndarray:
    """The coordinates that lists of ``coordinate`` are split by."""
    return np.delete(np.arange(coordinates), coordinate)[: coordinates - matches + 1]


def _compare(rows: list[dict], percent: int, matches: int, coordinate: int, sub: int) -> list[tuple[int, int]]:
    """Pairs of a block that lie apart, share this list (and, in a split list, its second coordinate ``sub``) first, and are near by all that travels with them."""
    comp = np.array([r["component"] for r in rows])
    side = np.array([r["side"] for r in rows])
    n = np.array([r["n"] for r in rows])
    sigs = np.frombuffer(b"".join(r["sig"] for r in rows), "<u4").reshape(len(rows), -1)
    posted = np.unpackbits(np.array([r["mask"] for r in rows], np.int64).astype("<u8").view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little")[:, : sigs.shape[1]].astype(bool)
    small = [None if r["small"] is None else np.frombuffer(r["small"], "<u4") for r in rows]
    fine = [None if r["fine"] is None else np.frombuffer(r["fine"], np.uint8) for r in rows]
    nodes = [r["node"] for r in rows]
    least = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / FINE) ** 0.5
    found, joined = [], set()
    others = _others(coordinate, sigs.shape[1], matches)
    for i in range(len(rows)):
        j = np.arange(i + 1, len(rows))
        # two sides meet, or the two halves of one block pair; never rows of one component
        j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] == 2))]
        j = j[np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent]
        if not len(j):
            continue
        same = sigs[j] == sigs[i]
        near = (same.sum(axis=1) >= matches) & (np.argmax(same & posted[j] & posted[i], axis=1) == coordinate)
        if sub >= 0:
            near &= others[np.argmax(same[:, others], axis=1)] == sub
        for k in j[near].tolist():
            if small[i] is not None and small[k] is not None:
                common = _common(small[i], small[k]) + 1  # one for a collision of 32-bit hashes
                if 100 * common >= percent * (int(n[i]) + int(n[k]) - common) and (int(comp[i]), int(comp[k])) not in joined:
                    if 100 * (common - 2) >= percent * (int(n[i]) + int(n[k]) - common + 2):
                        joined |= {(int(comp[i]), int(comp[k])), (int(comp[k]), int(comp[i]))}  # one sure link is enough
                    found.append((nodes[i], nodes[k]))
            elif fine[i] is None or fine[k] is None or (fine[i] == fine[k]).mean() >= least:
                found.append((nodes[i], nodes[k]))
    return [(min(p), max(p)) for p in found]


def _mixed(at: DataFrame, keys: list[str]) -> DataFrame:
    """Of the lists with several components, (keys, main, n_main, n_other): the largest component, its size and that of the rest."""
    sizes = at.groupBy(*keys, "component").count()
    lists = sizes.groupBy(*keys).agg(F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    return lists.select(*keys, F.col("main.component").alias("main"), F.col("main.count").alias("n_main"), (F.col("n") - F.col("main.count")).alias("n_other"))


def _apart(posts: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Postings (key, node, component) and, of the lists with several components, (key, main, n_main, n_other)."""
    at = posts.withColumn("component", F.col("node"))
    if comps is not None:
        at = posts.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return at, _mixed(at, ["key"])


def _split(at: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """(key, sub, node, component): postings of too long lists, one for each second coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, ROWS):
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(b.num_rows, -1)
            own = b.column("key").to_numpy() >> 32
            others = np.array([_others(c, sigs.shape[1], matches) for c in range(sigs.shape[1])])[own]
            subs = np.take_along_axis(sigs, others, axis=1).astype(np.int64) + (others.astype(np.int64) << 32)
            rows = pa.array(np.repeat(np.arange(b.num_rows), subs.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("key").take(rows), pa.array(subs.ravel()), b.column("node").take(rows), b.column("component").take(rows)], ["key", "sub", "node", "component"])

    return at.join(nodes.select("node", "sig"), "node").select("key", "node", "component", "sig").mapInArrow(run, "key long, sub long, node long, component long")


def _star_pairs(at: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): each class that lies apart from the main component of a list, with one centre from all its lists' main components."""
    draw = F.struct((F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("draw"), F.col("node").alias("at"))
    inside = at.join(lists, "key")
    if turn == 0:  # every class is a component of its own; the least of the list is the centre
        centre = inside.groupBy("key").agg(F.min(draw).alias("centre"))
    else:
        centre = inside.filter(F.col("component") == F.col("main")).groupBy("key").agg(F.min(draw).alias("centre"))
    met = inside.join(centre, "key").filter(F.col("node") != F.col("centre.at"))
    if turn:
        met = met.filter(F.col("component") != F.col("main"))
    one = met.groupBy("node").agg(F.min("centre").alias("centre"))
    return one.select(F.col("node").alias("a"), F.col("centre.at").alias("b"))


def _counted_pairs(at: DataFrame, lists: DataFrame, together: int) -> DataFrame:
    """(a, b): pairs that lie apart and meet in ``together`` short lists; a list of at most ``SMALL`` gives at most 15."""
    members = at.join(lists.select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("node", "component")).alias("m"))

    def later(x: F.Column) -> F.Column:
        apart = F.filter("m", lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"]))
        return F.transform(apart, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    pairs = members.select(F.explode(F.flatten(F.transform("m", later))).alias("p"))
    return pairs.groupBy("p.a", "p.b").count().filter(F.col("count") >= together).select("a", "b")


def _blocks(at: DataFrame, lists: DataFrame, nodes: DataFrame, payload: DataFrame, matches: int) -> DataFrame:
    """Postings dealt to blocks of bounded size: (key, sub, block, side, node, component, n, sig, mask, small, fine)."""
    # one bit for each coordinate that a class is posted under
    masks = at.groupBy(F.col("node").alias("of")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))").alias("mask"))
    size = F.col("n_main") + F.col("n_other")
    keys = ["key", "sub"]
    rows = at.join(lists.filter(size <= SPLIT), "key").withColumn("sub", F.lit(-1).cast("long"))
    long = lists.filter(size > SPLIT)
    if not long.isEmpty():
        parts = staged(_split(at.join(long.select("key"), "key"), nodes, matches), "near-split")
        rows = rows.unionByName(parts.join(_mixed(parts, keys), keys))
    rows = rows.withColumn("other", F.col("component") != F.col("main"))
    n_m, n_o = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_main", "n_other"))
    place = F.pmod(F.xxhash64("node"), F.when(F.col("other"), n_o).otherwise(n_m)).cast("int")
    rows = rows.withColumns({"m": n_m, "o": n_o, "i": place})
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    block = lambda x, y, kind: F.concat_ws("/", kind, x.cast("string"), y.cast("string"))
    small = size <= 2 * BLOCK
    i = F.col("i")
    with_rest = F.transform(upto(F.col("o")), lambda j: F.struct(block(F.least(i, j), F.greatest(i, j), F.lit("o")).alias("block"), F.when(i == j, 2).when(i < j, 0).otherwise(1).alias("side")))
    with_main = F.transform(upto(F.col("m")), lambda j: F.struct(block(i, j, F.lit("m")).alias("block"), F.lit(0).alias("side")))
    of_main = F.transform(upto(F.col("o")), lambda j: F.struct(block(j, i, F.lit("m")).alias("block"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.lit("").alias("block"), F.lit(2).alias("side")))
    dealt = rows.withColumn("to", F.explode(F.when(small, whole).when(F.col("other"), F.concat(with_rest, with_main)).otherwise(of_main)))
    dealt = dealt.select(*keys, "to.block", "to.side", "node", "component")
    facts = nodes.select(F.col("node").alias("of"), "sig").join(payload.withColumnRenamed("node", "of"), "of").join(masks, "of")
    return dealt.join(facts, F.col("node") == F.col("of")).drop("of")


def _compare_blocks(blocks: DataFrame, percent: int, matches: int) -> DataFrame:
    """Candidate pairs of all blocks; a task reads block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple[int, int]] = []

        def settle() -> None:
            if len(held) > 1 and any(r["component"] != held[0]["component"] for r in held):
                out.extend(_compare(held, percent, matches, held[0]["key"] >> 32, held[0]["sub"] >> 32))
            held.clear()

        for b in batches:
            for row in b.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("key", "sub", "block")):
                    settle()
                held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        settle()
        columns = list(zip(*out, strict=True)) if out else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return blocks.repartition("key", "sub", "block").sortWithinPartitions("key", "sub", "block").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node reachable over ``links`` (a, b), for nodes that have links.

    Least labels spread over links and jump along labels; the rounds grow with
    the logarithm of the longest path.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-edges")
    before = labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), label)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        moved = staged(moved.join(jump, "now").select("node", F.least("now", "far").alias("component"), (F.least("now", "far") < F.col("component")).alias("moved")), label)
        discard(before)
        labels, before = moved.select("node", "component"), moved
        if moved.filter("moved").isEmpty():
            discard(edges)
            return labels


def _sources(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(node, text) without repeated rows; texts move only for ids that several rows have."""
    often = staged(known.groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("node"), "near-often")
    if often.isEmpty():
        discard(often)
        return rows
    some = staged(rows.join(often, "node", "left_semi").withColumn("key", text_key()).dropDuplicates(["node", "key"]).drop("key"), "near-distinct")
    return rows.join(often, "node", "left_anti").unionByName(some)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Documents are linked at a Jaccard similarity of ``similarity`` of their
    distinct shingles of ``words`` words; component_id is the least doc_id that
    links reach, and kept tells whether that is the document itself.  Texts that are null, empty or
    without words have no shingles and no links.  Rows that repeat a doc_id are
    one document with the links of all of them.  A null doc_id has no
    component and is not kept.  Other columns are ignored; an empty table gives
    an empty result.
    """
    signed = staged(sign(docs, words, coordinates, id_col, text_col), "near-signed")
    known = signed.filter("class is not null and doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("node"))
    classes = staged(classes, "near-classes")
    member = known.select("doc_id", "class").join(classes, "class").select("doc_id", "node")
    least = F.min(F.struct("n_shingles", "sig"))
    nodes = known.select(F.col("doc_id").alias("node"), "class", "n_shingles", "sig").join(classes, ["node", "class"], "left_semi").groupBy("node", "class").agg(least.alias("one"))
    nodes = staged(nodes.select("node", "one.n_shingles", "one.sig"), "near-nodes")
    posts = staged(prefix_postings(nodes, matches), "near-posts")
    sources = _sources(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")), known)
    percent = round(100 * similarity)
    links, comps = None, None
    for turn in range(STAR_ROUNDS + 1):
        at, lists = _apart(posts, comps)
        if turn < STAR_ROUNDS:
            stars = staged(_star_pairs(at, lists, turn), "near-stars")
            pairs = staged(_agreeing(stars, nodes, percent, max(matches, STAR_MATCHES)), "near-pairs")
            discard(stars)
        else:
            # a pair shares a long list, or all that it shares are short ones
            lists = staged(lists, "near-lists")
            size = F.col("n_main") + F.col("n_other")
            counted = staged(_counted_pairs(at, lists.filter(size <= SMALL), TOGETHER), "near-counted")
            long = lists.filter(size > SMALL)
            at = staged(at.join(long.select("key"), "key"), "near-long")
            live = staged(at.select("node").distinct(), "near-live")
            payload = staged(_payload(sources, live, words), "near-payload")
            met = _compare_blocks(_blocks(at, long, nodes, payload, matches), percent, matches)
            pairs = staged(met.union(_agreeing(counted, nodes, percent, matches)).distinct(), "near-pairs")
            discard(lists, counted, at, live, payload, posts)
        if pairs.isEmpty():
            continue
        found = staged(_confirm(pairs, sources, words, percent), "near-links")
        discard(pairs)
        links = found if links is None else links.union(found)
        comps = components(links, "near-components")
    # rows that repeat an id may be in several classes: these are one document
    lowest = member.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(F.col("doc_id").alias("of"), "lo")
    merged = staged(member.join(lowest, F.col("doc_id") == F.col("of")).filter("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), "near-merged")
    if not merged.isEmpty():
        comps = components(merged if links is None else links.union(merged), "near-components")
    out = signed.withColumnRenamed("class", "own").join(classes, F.col("own") == F.col("class"), "left")
    if comps is not None:
        out = out.join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("node", F.coalesce("component", "node"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with the same columns; one row of each group of near duplicates stays.

    Rows without an id, and rows whose id others have too, are told apart by
    their texts: equal texts under one id (or without one) are one document, of
    which one row stays.  Of several texts under one id one goes by that id, the
    others, and those without one, are documents of their own behind all ids.
    Rows without a shingle have no duplicates and all stay.
    """
    held, names = numbered(docs)
    own_id, own_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    id_ = F.col(own_id).cast("long")
    ids = held.select(id_.alias("of")).groupBy("of").agg(F.count("*").alias("n")).filter("n > 1 or of is null").select("of")
    ids = staged(ids, "near-ids")
    if ids.isEmpty():
        gone = near_duplicates(held, id_col=own_id, text_col=own_text, **options).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
        return held.join(gone, F.col(own_id) == F.col("gone"), "left_anti").toDF(*names)
    # ids of their own, above all that are given out, for (id, text)
    made = F.lit(2**62) + F.xxhash64(F.coalesce(id_, F.lit(0)), id_.isNull(), text_key(own_text)).bitwiseAND(2**62 - 1)
    least = held.join(ids, id_.eqNullSafe(F.col("of")), "left_semi").groupBy(id_.alias("of")).agg(F.min(text_key(own_text)).alias("least"))
    node = F.when(F.col("least").isNull() | id_.isNotNull() & (text_key(own_text) == F.col("least")), id_).otherwise(made)
    marked = held.join(staged(least, "near-least"), id_.eqNullSafe(F.col("of")), "left").withColumn("node_id", node).drop("of", "least")
    found = staged(near_duplicates(marked, id_col="node_id", text_col=own_text, **options), "near-found")
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = marked.join(gone, F.col("node_id") == F.col("gone"), "left_anti")
    several = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again")
    several = staged(several, "near-several")
    once = left.join(several, F.col("node_id") == F.col("again"), "left_anti")
    one = left.join(several, F.col("node_id") == F.col("again"), "left_semi").dropDuplicates(["node_id"])
    return once.unionByName(one).select(*held.columns).toDF(*names)
