"""Hidden Markov language model over words, trained by Baum-Welch across partitions.

A word is emitted in two steps: a latent state emits a word class, the class
emits the word by its smoothed count.  The most frequent words are classes of
their own, the others share classes by their last letters, so the states have
something to tell languages and registers apart by.  States start from kinds of
text, found by spherical k-means over pieces of all training documents.  Expected counts of each
Baum-Welch pass are summed over all training documents; the scaled forward
recursion then gives the exact likelihood of each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, portions, staged, text_buffer, word_bounds, word_hashes
from .lang_id import folds

STATES = 8
OWN = 1024
ENDINGS = 1024
HEAD = 1 << 19
PASSES = 2
KIND_ROUNDS = 5
PIECE = 250
ANCHORS = 64
CHUNK = 1_000_000
SEGMENT = 2_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, ending numbers, and the bounds of each text among them."""
    data, offsets = text_buffer(texts)
    starts, ends = word_bounds(data, offsets)
    lower = _LOWER[data]
    code = np.zeros(len(starts), np.uint32)
    for back in (3, 2, 1):
        at = ends - back
        code = code * np.uint32(257) + np.where(at >= starts, lower[np.maximum(at, 0)].astype(np.uint32) + 1, 0).astype(np.uint32)
    ending = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32) % ENDINGS
    return word_hashes(data, starts, ends).view(np.int64), ending, np.searchsorted(starts, offsets)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, ending, n): counts of the distinct words of all rows of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> pa.RecordBatch:
            w, e, n = (np.concatenate(c) for c in zip(*held, strict=True))
            word, at, back = np.unique(w, return_index=True, return_inverse=True)
            held.clear()
            return word, e[at], np.bincount(back, weights=n, minlength=len(word)).astype(np.int64)

        for b in portions(batches, 2048):
            h, ending, _ = words_of(b.column("text"))
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((word, ending[first], n.astype(np.int64)))
            size += len(word)
            if size > 4_000_000:
                part = merged()
                held, size = [part], len(part[0])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["word", "ending", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["word", "ending", "n"])

    parts = frugal(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, ending int, n long")
    return parts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What every task knows of the vocabulary: at most ``HEAD`` frequent words and the class totals."""

    head: np.ndarray
    count: np.ndarray
    own_class: np.ndarray
    log_class: np.ndarray
    docs: int
    tokens: int
    types: int

    @property
    def classes(self) -> int:
        """One for the end, one for each own word, one for each ending."""
        return 1 + OWN + ENDINGS

    def look_up(self, words: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, counts (0 if not in the head), and whether the head has the word."""
        if not len(self.head):
            return (1 + OWN + ending).astype(np.int32), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        known = self.head[at] == words
        own = np.where(known, self.own_class[at], -1)
        return np.where(own >= 0, 1 + own, 1 + OWN + ending).astype(np.int32), np.where(known, self.count[at], 0), known


def gather(vocab: DataFrame, docs: int, head: int = HEAD) -> Words:
    """The vocabulary's totals over all words, and its most frequent words, all of about one count or none."""
    level = F.floor(F.log2("n") * 16).cast("int")  # at most 1,024 of them, however many counts there are
    sizes = {r[0]: r[1:] for r in vocab.groupBy(level.alias("level")).agg(F.count("*"), F.sum("n")).collect()}
    room, least = head, 2**31 - 1
    for at in sorted(sizes, reverse=True):
        room -= sizes[at][0]
        if room < 0:
            break
        least = at
    top = vocab.filter(level >= least).select("word", "ending", "n").toPandas()
    word, count = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    order = np.lexsort((word, -count))
    own = np.full(len(word), -1, np.int64)
    own[order[:OWN]] = np.arange(min(OWN, len(word)))
    mass, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for ending, n, k in vocab.groupBy("ending").agg(F.sum("n"), F.count("*")).collect():
        mass[ending], types[ending] = n, k
    mass -= np.bincount(top["ending"].to_numpy(np.int64)[order[:OWN]], weights=count[order[:OWN]], minlength=ENDINGS)
    types -= np.bincount(top["ending"].to_numpy(np.int64)[order[:OWN]], minlength=ENDINGS)
    by = np.argsort(word)
    tokens, distinct = (sum(x[i] for x in sizes.values()) for i in (1, 0))
    return Words(word[by], count[by], own[by], np.log10(mass + types + 1), docs, int(tokens) + docs, int(distinct) + (docs > 0))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Maximum a posteriori parameters; the small additions keep every text possible."""
        emit = emit + 0.05
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def none(cls, states: int, classes: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))


def _by_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from the longest down, their starts, and how many reach each step."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    n = n[order]
    order, n = order[n > 0], n[n > 0]
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    return order, starts[order], alive


def _transfers(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence the matrix that takes the states before its first word to those after its last, scaled, and the logarithm of the scale."""
    order, starts, alive = _by_length(starts, ends)
    states = len(model.start)
    a, log = np.repeat(np.eye(states)[None], len(order), axis=0), np.zeros(len(order))
    for t, k in enumerate(alive.tolist()):
        step = (a[:k] * model.emit[classes[starts[:k] + t]][:, None, :]).reshape(-1, states) @ model.move
        step = step.reshape(k, states, states)
        scale = step.sum(axis=(1, 2))
        a[:k] = step / scale[:, None, None]
        log[:k] += np.log(scale)
    back = np.argsort(order)
    return a[back], log[back]


@dataclass
class Segments:
    """Sequences cut into segments of bounded length, with what the rest of its sequence tells each of them.

    ``entry`` holds the shares of the states before a segment's first word given
    all words before it, ``after`` the likelihood of all words behind it by the
    state of the next one (zeros at an end), each exact up to a factor.  So
    segments give the counts of their whole sequences, in any order.
    """

    bounds: np.ndarray
    first: np.ndarray
    entry: np.ndarray
    after: np.ndarray
    likelihood: dict[int, float]  # natural logarithms, of the sequences that were cut


def segments(classes: np.ndarray, bounds: np.ndarray, model: Model, most: int) -> Segments:
    cut = _cut(bounds, most)
    first = np.isin(cut[:-1], bounds[:-1])
    entry = np.repeat(model.start[None], len(first), axis=0)
    after = np.zeros_like(entry)
    likelihood: dict[int, float] = {}
    docs = np.flatnonzero(np.diff(bounds) > most)
    lows, highs = np.searchsorted(cut, bounds[docs], side="right") - 1, np.searchsorted(cut, bounds[docs + 1])
    parts = np.concatenate([np.arange(lo, hi) for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True)]) if len(docs) else np.empty(0, np.int64)
    moves, logs = _transfers(classes, cut[parts], cut[parts + 1], model)
    at = 0
    for doc, lo, hi in zip(docs.tolist(), lows.tolist(), highs.tolist(), strict=True):
        own, total, now = moves[at : at + hi - lo], float(logs[at : at + hi - lo].sum()), model.start
        at += hi - lo
        for i in range(hi - lo):
            entry[lo + i] = now
            now = now @ own[i]
            total += math.log(now.sum())
            now = now / now.sum()
        behind = np.ones(len(now))
        for i in range(hi - lo - 1, 0, -1):
            behind = own[i] @ behind
            behind = behind / behind.sum()
            after[lo + i - 1] = behind
        likelihood[doc] = total
    return Segments(cut, first, entry, after, likelihood)


def forward(classes: np.ndarray, bounds: np.ndarray, model: Model, most: int | None = None) -> np.ndarray:
    """Natural log likelihood of each class sequence by the scaled forward recursion.

    Sequences longer than ``most`` go segment by segment, all segments at once;
    the value is the same.
    """
    most = SEGMENT if most is None else most
    out = np.zeros(len(bounds) - 1)
    n = np.diff(bounds)
    if (n > most).any():
        for doc, value in segments(classes, bounds, model, most).likelihood.items():
            out[doc] = value
    order, starts, alive = _by_length(bounds[:-1], bounds[1:])
    short = n[order] <= most
    order, starts, alive = order[short], starts[short], alive[:most] - int((~short).sum())
    if not len(order):
        return out
    alpha = model.start * model.emit[classes[starts]]
    scale = alpha.sum(axis=1)
    alpha /= scale[:, None]
    total = np.log(scale)
    for t, k in enumerate(alive[1:].tolist(), 1):
        if not k:
            break
        alpha = (alpha[:k] @ model.move) * model.emit[classes[starts[:k] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:k] += np.log(scale)
    out[order] = total
    return out


def expect(classes: np.ndarray, bounds: np.ndarray, model: Model, into: Counts, entry: np.ndarray | None = None, after: np.ndarray | None = None, first: np.ndarray | None = None) -> None:
    """Add the expected counts of the sequences (forward and backward recursion) to ``into``.

    ``entry``, ``after`` and ``first`` are those of :class:`Segments`; without
    them, each sequence stands by itself.
    """
    order, starts, alive = _by_length(bounds[:-1], bounds[1:])
    if not len(order):
        return
    states = len(model.start)
    alphas = np.empty((len(classes), states), np.float32)
    scales = np.empty(len(classes), np.float32)
    alpha = np.repeat(model.start[None], len(order), axis=0) if entry is None else entry[order]
    for t, k in enumerate(alive.tolist()):
        at = starts[:k] + t
        alpha = (alpha if t == 0 else alpha[:k] @ model.move) * model.emit[classes[at]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        alphas[at], scales[at] = alpha, scale
        into.log_likelihood += float(np.log(scale).sum())
    gamma = alphas  # becomes the posterior in place, from the end
    beta = np.ones((len(order), states))
    if after is not None and (more := np.flatnonzero(after[order].any(axis=1))).size:
        last = bounds[1:][order[more]] - 1
        next_ = after[order[more]]
        ahead = next_ @ model.move.T
        weight = (alphas[last] * ahead).sum(axis=1)
        into.move += ((alphas[last] / weight[:, None]).T @ next_) * model.move  # the step over the cut
        beta[more] = ahead / weight[:, None]
        gamma[last] = alphas[last] * beta[more]
    for t in range(len(alive) - 1, 0, -1):
        k = alive[t]
        at = starts[:k] + t
        step = model.emit[classes[at]] * beta[:k] / scales[at][:, None]
        before = alphas[at - 1]
        into.move += (before.T @ step) * model.move
        beta[:k] = step @ model.move.T
        gamma[at - 1] = before * beta[:k]
    begun = starts if first is None else starts[first[order]]
    into.start += gamma[begun].sum(axis=0, dtype=np.float64)
    for s in range(states):
        into.emit[:, s] += np.bincount(classes, weights=gamma[:, s], minlength=len(into.emit))


def sequences(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences of texts with their ends: (classes, bounds, word hashes, counts, known), the last three without ends."""
    h, ending, bounds = words_of(texts)
    cls, count, known = words.look_up(h, ending)
    n = np.diff(bounds)
    out = np.zeros(len(cls) + len(n), np.int32)
    out[np.arange(len(cls)) + np.repeat(np.arange(len(n)), n)] = cls
    return out, bounds + np.arange(len(bounds)), h, count, known


def _cut(bounds: np.ndarray, most: int) -> np.ndarray:
    """Bounds with long sequences cut into runs of ``most`` words."""
    if (np.diff(bounds) <= most).all():
        return bounds
    more = [np.arange(a, b, most) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.append(np.concatenate(more), bounds[-1])


PREPARED = "row long, doc_id long, train boolean, n_tokens long, n_known long, counts double, inside double, classes binary, word long, times long"


def prepare(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text", train: F.Column | None = None) -> DataFrame:
    """What training and scoring need of each document, so that texts are read once after the counting.

    A row a document with its class sequence, its known tokens and the sums of
    the logarithms that the head's counts give; and a row for each distinct word
    of it that the head lacks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by HEAD words
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = frugal(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), flag.alias("train"))
    names = [f.split()[0] for f in PREPARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        serial = TaskContext.get().partitionId() << 36
        for part in portions(batches):
            cls, bounds, h, count, known = sequences(part.column("text"), w)
            n = np.diff(bounds) - 1
            doc = np.repeat(np.arange(len(n)), n)
            word_cls = cls[np.arange(len(h)) + doc]
            logs = np.log10(count + 1)
            inside = np.bincount(doc, weights=np.where(word_cls > OWN, logs - w.log_class[np.maximum(word_cls - 1 - OWN, 0)], 0.0), minlength=len(n))
            counts = np.bincount(doc, weights=logs, minlength=len(n)) + math.log10(w.docs + 1)
            found = np.bincount(doc, weights=known, minlength=len(n)).astype(np.int64) + (w.docs > 0)
            row = serial + np.arange(len(n))
            serial += len(n)
            none = pa.nulls(len(n), pa.int64())
            raw = pa.array([c.tobytes() for c in np.split(cls.astype("<i2"), bounds[1:-1])] if len(n) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row), part.column("doc_id"), part.column("train"), pa.array(n + 1), pa.array(found), pa.array(counts), pa.array(inside), raw, none, none], names)
            if w.types <= len(w.head) + 1:
                continue
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((h[rare], doc[rare]))]
            if len(order):
                at = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
                times = np.diff(np.append(at, len(order)))
                none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(row[doc[order[at]]]), *none, pa.array(h[order[at]]), pa.array(times)], names)

    return staged(rows.mapInArrow(run, PREPARED), "lm-prepared")


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences of a batch end to end, and their bounds."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i2").astype(np.int32), np.cumsum([0, *(len(r) // 2 for r in raw)])


def _summed(prepared: DataFrame, add, height: int, width: int) -> np.ndarray:
    """The ``height`` x ``width`` sums that ``add(classes, bounds, into)`` makes of the class sequences of all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((height, width))
        for b in portions(batches, 1 << 20, 2 * CHUNK):
            add(*_classes(b.column("classes")), into)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *(pa.array(into[:, s]) for s in range(width))], ["at", *(f"s{s}" for s in range(width))])

    rows = prepared.filter("train and classes is not null").select("classes")
    parts = rows.mapInArrow(run, "at int, " + ", ".join(f"s{s} double" for s in range(width)))
    total = parts.groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(width)]).toPandas()
    out = np.zeros((height, width))
    out[total["at"].to_numpy(np.int64)] = total[[f"s{s}" for s in range(width)]].to_numpy()
    return out


def baum_welch_pass(prepared: DataFrame, words: Words, model: Model) -> tuple[Model, float]:
    """One pass over all training rows: expected counts by partition, summed, and normalised."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)  # classes x states
    states, k = len(model.start), words.classes

    def add(cls: np.ndarray, bounds: np.ndarray, into: np.ndarray) -> None:
        found = Counts(into[k + states], into[k : k + states], into[:k])
        cut = segments(cls, bounds, shared.value, SEGMENT)
        bounds, at = cut.bounds, 0
        while at < len(bounds) - 1:  # in runs of about CHUNK words
            to = min(len(bounds) - 1, max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK))))
            expect(cls[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], shared.value, found, cut.entry[at:to], cut.after[at:to], cut.first[at:to])
            at = to
        into[-1] += found.log_likelihood

    rows = _summed(prepared, add, k + states + 2, states)
    return Model.from_counts(rows[k + states], rows[k : k + states], rows[:k]), float(rows[-1, 0])


def _pieces(cls: np.ndarray, bounds: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class counts of pieces of at most ``PIECE`` words, and the same at length 1, in blocks of pieces."""
    bounds = _cut(bounds, PIECE)
    bounds = bounds[np.append(True, np.diff(bounds) > 0)]
    for at in range(0, len(bounds) - 1, 256):
        part = bounds[at : at + 257]
        n = len(part) - 1
        own = np.repeat(np.arange(n), np.diff(part))
        seen = np.bincount(own * classes + cls[part[0] : part[-1]], minlength=n * classes).reshape(n, classes).astype(np.float32)
        yield seen, seen / np.sqrt(np.einsum("ij,ij->i", seen, seen))[:, None]


def warm_start(prepared: DataFrame, words: Words, states: int, rounds: int = KIND_ROUNDS, seed: int = 3) -> Model:
    """A starting point from kinds of text: spherical k-means over pieces of all training rows.

    The first centres are profiles of pieces that hold a frequent word, each as
    unlike those before it as can be.
    """
    context = prepared.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    k = words.classes

    def profiles(cls: np.ndarray, bounds: np.ndarray, into: np.ndarray) -> None:
        for seen, unit in _pieces(cls, bounds, k):
            into += unit.T @ (seen[:, 1 : 1 + ANCHORS] > 0).astype(np.float32)

    found = _summed(prepared, profiles, k, ANCHORS).T if words.docs else np.zeros((0, k))
    found = found[found.any(axis=1)]
    found /= np.sqrt((found**2).sum(axis=1, keepdims=True))
    mean = rng.random((states, k))
    near = np.zeros(len(found))
    for s in range(min(states, len(found))):
        mean[s] = found[int(np.argmin(near)) if s else 0]
        near = np.maximum(near, found @ mean[s])
    mean /= np.sqrt((mean**2).sum(axis=1, keepdims=True))
    emit = np.zeros((k, states))
    for _ in range(rounds if words.docs else 0):
        shared = context.broadcast(mean.astype(np.float32))  # states x classes

        def add(cls: np.ndarray, bounds: np.ndarray, into: np.ndarray, shared=shared) -> None:
            for seen, unit in _pieces(cls, bounds, k):
                of = np.eye(states, dtype=np.float32)[np.argmax(unit @ shared.value.T, axis=1)]
                into[:, :states] += unit.T @ of
                into[:, states:] += seen.T @ of

        sums = _summed(prepared, add, k, 2 * states)
        emit, size = sums[:, states:], np.sqrt((sums[:, :states] ** 2).sum(axis=0))
        mean[size > 0] = (sums[:, :states].T)[size > 0] / size[size > 0, None]
    # unequal shares, so that states differ even where all pieces are of one kind
    emit = emit + emit.sum(axis=1, keepdims=True) * 0.04 / states * rng.random((k, states))
    return Model.from_counts(np.zeros(states), np.eye(states) * 50 + rng.random((states, states)), emit)


@dataclass
class LanguageModel:
    words: Words
    model: Model
    vocab: DataFrame
    passes: list[float] = field(default_factory=list)


def _counted(docs: DataFrame, head: int) -> tuple[DataFrame, Words]:
    vocab = staged(vocabulary(docs), "lm-vocabulary")
    return vocab, gather(vocab, docs.count(), head)


def _trained(prepared: DataFrame, vocab: DataFrame, words: Words, states: int, passes: int) -> LanguageModel:
    model = warm_start(prepared, words, states)
    likelihoods = []
    for _ in range(passes if words.docs else 0):
        model, value = baum_welch_pass(prepared, words, model)
        likelihoods.append(value)
    return LanguageModel(words, model, vocab, likelihoods)


def fit(docs: DataFrame, states: int = STATES, passes: int = PASSES, head: int = HEAD, text_col: str = "text") -> LanguageModel:
    """Train on all rows of ``docs``; a null text counts as empty."""
    docs = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    vocab, words = _counted(docs, head)
    return _trained(prepare(docs, words), vocab, words, states, passes)


def score(docs: DataFrame, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    base_score is the add-one unigram log10 probability; score that of the
    hidden Markov model.  Null texts count as empty and have their end as only
    token.  With nothing to learn from, every token is unknown.  Other columns
    are ignored.
    """
    return _scores(prepare(docs, lm.words, id_col, text_col), lm)


def _scores(prepared: DataFrame, lm: LanguageModel) -> DataFrame:
    words = lm.words
    shared = prepared.sparkSession.sparkContext.broadcast(lm.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in portions(batches, 1 << 20, 2 * CHUNK):
            cls, bounds = _classes(b.column("classes"))
            hidden = forward(cls, bounds, m) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hidden, pa.float64())], [*b.schema.names[:-1], "hidden"])

    least = int(words.count.min()) if len(words.count) else 2**62
    rest = lm.vocab.filter(F.col("n") < least).select(F.col("word").alias("of"), "n")
    more = prepared.filter("word is not null").select("row", "word", "times").join(rest, F.col("word") == F.col("of"))
    more = more.groupBy(F.col("row").alias("of_row")).agg(F.sum("times").alias("rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_counts"))
    main = prepared.filter("classes is not null").select("row", "doc_id", "n_tokens", "n_known", "counts", "inside", "classes")
    main = main.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, counts double, inside double, hidden double")
    main = main.join(more, F.col("row") == F.col("of_row"), "left")
    extra = F.coalesce("rare_counts", F.lit(0.0))
    return main.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + extra - F.col("n_tokens") * math.log10(words.tokens + words.types + 1)).alias("base_score"),
        (F.col("hidden") + F.col("inside") + extra).alias("score"),
    )


def train_and_score(docs: DataFrame, parts: int = 7, held: int = 2, states: int = STATES, passes: int = PASSES, head: int = HEAD) -> DataFrame:
    """:func:`score` of every document with ``held_out``, by a model of those whose crc32(doc_id as text) mod ``parts`` is not ``held``; a null id is in no fold."""
    docs = docs.select("doc_id", "text")
    trains = folds("doc_id", parts) != held
    own = docs.filter(trains).select(F.coalesce("text", F.lit("")).alias("text"))
    vocab, words = _counted(own, head)
    prepared = prepare(docs, words, train=trains)
    found = _scores(prepared, _trained(prepared, vocab, words, states, passes))
    return found.withColumn("held_out", F.coalesce(folds("doc_id", parts) == held, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
