import collections
import itertools
import math
import random
import zlib

import numpy as np

from recallforge.llm import hmm_lm as lm

DOCS = "doc_id bigint, text string"


def rows_of(words):
    rng = random.Random(3)
    out = []
    for i in range(240):
        own = words[:400] if i % 2 else words[400:800]
        out.append((i, " ".join(rng.choice(own) for _ in range(rng.randint(0, 60))).title()))
    return out


def base(rows):
    tok = {i: (t or "").encode().lower().split() for i, t in rows}
    c, n = collections.Counter(), 0
    for i in tok:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tok[i])
            n += 1
    total, types = sum(c.values()) + n, len(c) + 1
    out = {}
    for i, t in tok.items():
        s = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t) + math.log10((n + 1) / (total + types + 1))
        out[i] = (len(t) + 1, sum(w in c for w in t) + 1, total, s)
    return out


def test_base_scores_equal_a_loop_and_the_model_beats_them(spark, words):
    rows = rows_of(words) + [(500, None), (501, ""), (502, "never seen before"), (503, "A\x0bB a")]
    df = spark.createDataFrame(rows, DOCS)
    want = base(rows)
    for head in (50, 1 << 19):  # most words by the join, or none
        got = lm.train_and_score(df, head=head).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-9 * max(1, -w[3])
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_forward(seq, m):
    return math.log(sum(m.start[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.move[a, b] * m.emit[c, b] for a, b, c in zip(p, p[1:], seq[1:], strict=False)) for p in itertools.product(range(len(m.start)), repeat=len(seq))))


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    m = lm.Model.from_counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    seqs = [[0, 1, 2, 3], [4], [2, 2, 1], [], [3, 0]]
    flat, bounds = np.array([x for s in seqs for x in s], np.int32), np.cumsum([0, *map(len, seqs)])
    got = lm.forward(flat, bounds, m)
    assert all(abs(g - (brute_forward(s, m) if s else 0)) < 1e-9 for g, s in zip(got, seqs, strict=True))
    counts = lm.Counts.none(3, 5)
    lm.expect(flat, bounds, m, counts)
    move, start, emit = np.zeros((3, 3)), np.zeros(3), np.zeros((5, 3))
    for s in filter(None, seqs):
        total = math.exp(brute_forward(s, m))
        for p in itertools.product(range(3), repeat=len(s)):
            w = m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[c, b] for a, b, c in zip(p, p[1:], s[1:], strict=False)) / total
            start[p[0]] += w
            for x, c in zip(p, s, strict=True):
                emit[c, x] += w
            for a, b in zip(p, p[1:], strict=False):
                move[a, b] += w
    assert np.allclose(counts.move, move, atol=1e-5) and np.allclose(counts.start, start, atol=1e-5) and np.allclose(counts.emit, emit, atol=1e-5)


def test_each_pass_raises_the_likelihood(spark, words):
    df = spark.createDataFrame(rows_of(words), DOCS).select("text").repartition(3)
    fitted = lm.fit(df, states=4, passes=3)
    assert fitted.passes == sorted(fitted.passes)


def test_the_model_is_a_distribution_over_words(spark, words):
    rows = rows_of(words)[:60]
    fitted = lm.fit(spark.createDataFrame(rows, DOCS).select("text"), states=3, passes=1)
    w = fitted.words
    inside = np.zeros(lm.ENDINGS)
    shared = w.own_class < 0
    import pyarrow as pa

    vocab = sorted({x.lower() for _, t in rows for x in t.split()})
    h, ending, _ = lm.words_of(pa.array([" ".join(vocab)]))
    cls, count, known = w.look_up(h, ending)
    assert known.all() and shared.sum() == max(0, len(vocab) - lm.OWN)
    for c, n in zip(cls, count, strict=True):
        if c > lm.OWN:
            inside[c - 1 - lm.OWN] += 10 ** (math.log10(n + 1) - w.log_class[c - 1 - lm.OWN])
    assert (inside <= 1 + 1e-9).all() and np.allclose(fitted.model.emit.sum(axis=0), 1) and np.allclose(fitted.model.move.sum(axis=1), 1)


def test_long_sequences_in_segments():
    m = lm.Model.from_counts(np.ones(2), np.ones((2, 2)), np.ones((3, 2)))
    assert lm._cut(np.array([0, 5, 12]), 4).tolist() == [0, 4, 5, 9, 12] and lm._cut(np.array([0, 3]), 4).tolist() == [0, 3]
    assert np.isfinite(lm.forward(np.zeros(50_000, np.int32), np.array([0, 50_000]), m)).all()


def test_odd_rows(odd, none, crowded):
    got = lm.train_and_score(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6))
    assert lm.train_and_score(none).count() == 0 and lm.train_and_score(crowded).count() == odd.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.train_and_score(spark.createDataFrame([(held, "a b")], DOCS)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9


def test_long_documents_alone_tell_states_apart(spark, words):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[:400] if i % 2 else words[400:800]) for _ in range(6000))) for i in range(2)]
    assert all(len(t) > 20_000 for _, t in rows)
    fitted = lm.fit(spark.createDataFrame(rows, DOCS).select("text"), states=2, passes=1)
    emit = fitted.model.emit[1 : 1 + lm.OWN]
    kind = emit[:, 0] > emit[:, 1]
    assert np.abs(emit[:, 0] - emit[:, 1]).sum() > 1 and 300 < kind.sum() < 900


def test_segments_give_the_counts_of_whole_sequences():
    rng = np.random.default_rng(4)
    m = lm.Model.from_counts(rng.random(4), rng.random((4, 4)) ** 3, rng.random((9, 4)) ** 3)
    n = [0, 3, 57, 1, 200, 10, 0, 21, 20, 2]
    bounds = np.cumsum([0, *n])
    flat = rng.integers(0, 9, bounds[-1]).astype(np.int32)
    whole, parts = lm.Counts.none(4, 9), lm.Counts.none(4, 9)
    lm.expect(flat, bounds, m, whole)
    for most in (1, 7, 10):
        parts = lm.Counts.none(4, 9)
        cut = lm.segments(flat, bounds, m, most)
        at = len(cut.bounds) // 2  # in two runs, as segments may be in any order
        for lo, hi in ((at, len(cut.bounds) - 1), (0, at)):
            lm.expect(flat[cut.bounds[lo] : cut.bounds[hi]], cut.bounds[lo : hi + 1] - cut.bounds[lo], m, parts, cut.entry[lo:hi], cut.after[lo:hi], cut.first[lo:hi])
        assert np.allclose(whole.start, parts.start, atol=1e-4) and np.allclose(whole.move, parts.move, atol=1e-3) and np.allclose(whole.emit, parts.emit, atol=1e-3)
        assert abs(whole.log_likelihood - parts.log_likelihood) < 1e-3
        assert np.allclose(lm.forward(flat, bounds, m, most), lm.forward(flat, bounds, m, 10**9), atol=1e-9)


def test_a_long_text_is_one_sequence(spark, words, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(words[:300]) for _ in range(400 if i % 5 == 0 else 30))) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    short = lm.fit(df)
    monkeypatch.setattr(lm, "SEGMENT", 10**6)
    whole = lm.fit(df)
    assert np.allclose(short.model.move, whole.model.move, atol=1e-4) and np.allclose(short.model.start, whole.model.start, atol=1e-4)
