import numpy as np

from recallforge.llm import ann

VEC = "vec_id bigint, embedding array<float>"


def brute(rows, ids, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max({len(v) for _, v in good}, key=lambda w: (sum(len(v) == w for _, v in good), -w))
    good = [(i, v) for i, v in good if len(v) == width]
    out = {}
    for q, x in good:
        if q in ids:
            s = sorted(((-(x @ v) / np.sqrt((x @ x) * (v @ v)), i) for i, v in good if i != q))[:k]
            out[q] = [(i, -c) for c, i in s]
    return out


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((12, 48))
    rows = [(i, (centre[i % 12] + rng.standard_normal(48) * 0.6).astype(np.float32).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()
    want = brute(rows, set(range(0, 1200, 50)), 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in by[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)
    scores = dict((q, dict(w)) for q, w in want.items())
    assert all(abs(s - scores[q][v]) < 1e-12 for q in by for v, s in by[q].values() if v in scores[q])


def test_ties_few_candidates_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [1.0]), (None, [1.0, 0.0]), (12, [float("inf"), 0.0]), (13, []), (100, [3.0]), (150, [1.0, 2.0, 3.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame(rows, VEC)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0), (0, 4, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 2, 0.0), (50, 3, 3, 0.0), (50, 4, 3, 0.0), (100, 1, 11, 1.0)]
    extra = spark.createDataFrame([(0, [1.0, 0.0], "a", 1, 2), (1, [1.0, 1.0], "b", 3, 4)], VEC + ", id string, x int, score int")
    assert [r.vec_id for r in ann.nearest(extra, extra.filter("vec_id = 0"), 5).collect()] == [1]


def test_many_equal_vectors_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(3000)], VEC)
    got = ann.nearest(df, df.filter("vec_id = 50"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
    empty = spark.createDataFrame([], VEC)
    assert ann.nearest(empty, empty, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0])], VEC)
    assert ann.nearest(one, one, 5).count() == 0


def test_the_estimate_is_within_its_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((400, 100)), rng.standard_normal((20, 100))
    turn = ann.rotation(128)
    codes, own, _ = ann.encode(x, turn)
    estimate, upper = ann.Queries(np.arange(20), q, turn).bounds(codes, own)
    true = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    assert (upper >= true).mean() > 0.98 and abs((estimate - true).mean()) < 0.01


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)], VEC)
    q = df.filter("vec_id % 5 = 0")
    whole = sorted(map(tuple, ann.nearest(df, q, 3).collect()))
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert sorted(map(tuple, ann.nearest(df, q, 3).collect())) == whole
    monkeypatch.setattr(ann, "WAVE", 2)
    assert sorted(map(tuple, ann.nearest(df, q, 3).collect())) == whole
