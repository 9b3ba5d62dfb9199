"""Language identification as mixture inference over byte n-grams.

Training counts hashed byte trigrams of lower-cased text for each language over
all training documents.  A document's language proportions are the maximum
likelihood mixture of these models, found by expectation maximisation over its
distinct n-grams.  Languages join the set one by one while each raises the log
likelihood by more than its penalty; the prediction is the largest proportion.

The model goes to every task while it has few languages.  More are kept in
shards, hashed by language: each step of the inference (the best single
language, and each further one) then passes the documents' state through all
shards, one after the other, with the same result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, portions, staged

BUCKETS = 1 << 15
#: Languages whose model goes to a task at once: 64 MB of doubles.
SHARD = 256
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
_LETTER = r"\p{L}"


def folds(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


_FLATTEN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str | None, buckets: int) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text, ASCII other than letters taken as space."""
    data = b" ".join((text or "").lower().encode().translate(_FLATTEN).split())
    x = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return (((code * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            at, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return at, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(at)).astype(np.int64)

        def passed(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            langs = pa.array(list(names), pa.string()).take(pa.array(at // buckets))
            return pa.RecordBatch.from_arrays([langs, pa.array(at % buckets), pa.array(n)], ["lang", "bucket", "n"])

        for b in portions(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen, n = np.unique(grams(text, buckets), return_counts=True)
                parts.append((seen + names.setdefault(lang, len(names)) * buckets, n))
                size += len(seen)
                if size > HELD:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield passed(*parts[0])
                        names, parts, size = {}, [], 0
        if parts:
            yield passed(*merged())

    return frugal(docs).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Bucket probabilities of some languages; its size is languages times buckets."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T) if langs else np.zeros((counts.shape[1], 0))
        self.buckets = counts.shape[1]

    @classmethod
    def of(cls, rows: DataFrame, buckets: int) -> LanguageModel:
        """From (lang, bucket, n) of a bounded number of languages."""
        rows = rows.select("lang", "bucket", "n").toPandas()
        langs = sorted(set(rows["lang"]))
        counts = np.zeros((len(langs), buckets))
        counts[rows["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
        return cls(langs, counts)

    def mixture(self, text: str, penalty: float = 3.0, rounds: int = 30) -> tuple[dict[str, float], float]:
        """Proportions of the chosen languages and the log likelihood for each n-gram above that of uniform buckets.

        ``penalty`` times the logarithm of the number of n-grams is the price of
        one more language.
        """
        g = grams(text, self.buckets)
        if not len(g) or not self.langs:
            return {}, 0.0
        state = Mixture(*np.unique(g, return_counts=True))
        while state.open:
            state.meet(self)
            state.step(penalty, rounds)
        return state.result(self.buckets)


class Mixture:
    """The inference of one document: ``meet`` all languages, ``step``, and again while it is ``open``."""

    def __init__(self, seen: np.ndarray, n: np.ndarray):
        self.seen, self.n, self.size = seen, n, int(n.sum())
        self.langs: list[str] = []
        self.share, self.q, self.level = np.empty(0), np.empty((len(seen), 0)), -np.inf
        self.best: tuple[float, str, np.ndarray] | None = None
        self.open = True

    def meet(self, model: LanguageModel) -> None:
        """Remember the language of ``model`` that fits best by itself, or that the present mixture would gain most from at the margin."""
        if not self.open or not model.langs:
            return
        p = model.p[self.seen]
        gain = self.n @ (p / (self.q @ self.share)[:, None]) if self.langs else self.n @ np.log(p)
        for i in np.argsort(-gain, kind="stable").tolist():
            if model.langs[i] not in self.langs:
                # of equals, the language that sorts first
                if self.best is None or (-gain[i], model.langs[i]) < (-self.best[0], self.best[1]):
                    self.best = (float(gain[i]), model.langs[i], p[:, i].copy())
                return

    def step(self, penalty: float, rounds: int) -> None:
        """Take the remembered language into the set if that is worth its price."""
        best, self.best = self.best, None
        if not self.open:
            return
        if not self.langs:
            if best is None:
                self.open = False
                return
            self.level, self.langs, self.share, self.q = best[0], [best[1]], np.ones(1), best[2][:, None]
            return
        self.open = False
        price = penalty * np.log(self.size + 1)
        if best is None or best[0] <= self.size:  # no mixture with any further language is likelier
            return
        q, w = np.column_stack([self.q, best[2]]), np.append(self.share * 0.9, 0.1)
        last = -np.inf
        for _ in range(rounds):
            mixed = q @ w
            now = float(self.n @ np.log(mixed))
            if now - last < 1e-3 * price:
                break
            last = now
            w = w * ((self.n / mixed) @ q) / self.size
        if now - self.level > price:
            self.langs, self.share, self.q, self.level, self.open = [*self.langs, best[1]], w, q, now, True

    def result(self, buckets: int) -> tuple[dict[str, float], float]:
        if not self.langs:
            return {}, 0.0
        return {lang: float(w) for lang, w in zip(self.langs, self.share, strict=True)}, self.level / self.size + math.log(buckets)


class Shards:
    """A model of more languages than a task takes at once: counts at rest, dealt to shards by a hash of the language."""

    def __init__(self, rows: DataFrame, number: int, buckets: int):
        self.rows, self.number, self.buckets = rows, number, buckets

    def __iter__(self) -> Iterator[LanguageModel]:
        for i in range(self.number):
            yield LanguageModel.of(self.rows.filter(F.pmod(F.xxhash64("lang"), F.lit(self.number)) == i), self.buckets)


def fit(docs: DataFrame, buckets: int = BUCKETS, shard: int = SHARD) -> LanguageModel | Shards:
    """Learn from all rows of (lang, text) whose lang and text are not null."""
    rows = staged(gram_counts(docs.filter("lang is not null and text is not null"), buckets), "lang-counts")
    langs = rows.select("lang").distinct().count()
    if langs <= shard:
        model = LanguageModel.of(rows, buckets)
        discard(rows)
        return model
    return Shards(rows, math.ceil(2 * langs / shard), buckets)  # half full on average


def _answer(names: list, rows: list[tuple[dict[str, float], float]], columns: list[pa.Array]) -> pa.RecordBatch:
    top = [max(sorted(found), key=found.get, default="und") for found, _ in rows]
    scores = [min(1.0, max(0.0, found.get(t, 0.0))) for t, (found, _) in zip(top, rows, strict=True)]
    more = [pa.array(top, pa.string()), pa.array(scores, pa.float64()), pa.array([fit for _, fit in rows], pa.float64()), pa.array([list(found.items()) for found, _ in rows], pa.map_(pa.string(), pa.float64()))]
    return pa.RecordBatch.from_arrays([*columns, *more], [*names, "lang_pred", "score", "fit", "shares"])


def predict(docs: DataFrame, model: LanguageModel | Shards, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(lang_pred, score, fit, shares, ...keep, id), a row for each row of ``docs``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned.  The score is the proportion of the predicted language; ``shares``
    holds all proportions and ``fit`` the log likelihood for each n-gram above
    uniform chance.  Ties go to the language that sorts first.
    """
    rows = frugal(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(text_col).rlike(_LETTER), F.lit(False)).alias("_letters"), *[F.col(k) for k in keep if k not in (id_col,)])
    kept = [c for c in rows.columns if c not in ("_text", "_letters")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    if isinstance(model, Shards):
        return _predict_by_shards(rows, model, kept, fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SHARD languages x buckets doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in portions(batches):
            found = [m.mixture(text) if letters and text else ({}, 0.0) for text, letters in zip(b.column("_text").to_pylist(), b.column("_letters").to_pylist(), strict=True)]
            yield _answer(kept, found, [b.column(c) for c in kept])

    return rows.mapInArrow(run, f"{fields}, {ANSWER}")


ANSWER = "lang_pred string, score double, fit double, shares map<string,double>"


def _predict_by_shards(rows: DataFrame, model: Shards, kept: list[str], fields: str, penalty: float = 3.0, rounds: int = 30) -> DataFrame:
    """The same for a model in shards; a document's state travels with it, pickled, from shard to shard."""
    context = rows.sparkSession.sparkContext
    buckets = model.buckets

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            states = []
            for text, letters in zip(b.column("_text").to_pylist(), b.column("_letters").to_pylist(), strict=True):
                g = grams(text, buckets) if letters else np.empty(0, np.int64)
                state = Mixture(*np.unique(g, return_counts=True))
                state.open = len(g) > 0
                states.append(pickle.dumps(state))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(states, pa.binary()), pa.array([pickle.loads(x).open for x in states])], [*kept, "_state", "_open"])

    def passed(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                states = [pickle.loads(x) for x in b.column("_state").to_pylist()]
                for state in states:
                    state.meet(shared.value)
                    if last:
                        state.step(penalty, rounds)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([pickle.dumps(x) for x in states], pa.binary()), pa.array([x.open for x in states])], [*kept, "_state", "_open"])

        return run

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            yield _answer(kept, [pickle.loads(x).result(buckets) for x in b.column("_state").to_pylist()], [b.column(c) for c in kept])

    schema = f"{fields}, _state binary, _open boolean"
    state = staged(rows.mapInArrow(start, schema), "lang-state")
    done = [state.filter("not _open")]
    state = state.filter("_open")
    while not state.isEmpty():
        for i, one in enumerate(model):
            state = staged(state.mapInArrow(passed(context.broadcast(one), i == model.number - 1), schema), "lang-state")
        done.append(state.filter("not _open"))
        state = state.filter("_open")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.mapInArrow(end, f"{fields}, {ANSWER}")


def train_and_predict(docs: DataFrame, parts: int = 3, held: int = 1, buckets: int = BUCKETS, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares): every document judged by a model that learns from the training folds.

    A document trains unless crc32(doc_id as text) mod ``parts`` is ``held``; a
    null id is in no fold: it neither trains nor is held out.
    """
    fold = folds("doc_id", parts)
    model = fit(docs.filter(fold != held).select("lang", "text"), buckets, shard)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(folds("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "shares", "fit")


def keep_identified(docs: DataFrame, least_fit: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` written in a learned language, with the same columns.

    Rejected are texts without letters, and texts no likelier under the mixture
    of languages than under uniform chance.  Where nothing was learned (no
    labelled row in the training folds), only texts without letters go.
    """
    fold = folds("doc_id", options.get("parts", 3))
    model = fit(docs.filter(fold != options.get("held", 1)).select("lang", "text"), options.get("buckets", BUCKETS), options.get("shard", SHARD))
    columns = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    if isinstance(model, LanguageModel) and not model.langs:
        return held.filter(F.col(f"c{columns.index('text')}").rlike(_LETTER)).toDF(*columns)
    found = predict(held, model, f"c{columns.index('doc_id')}", f"c{columns.index('text')}", tuple(held.columns))
    return found.filter(f"lang_pred <> 'und' and fit > {least_fit}").select(*held.columns).toDF(*columns)
