import random

import pytest
from pyspark.sql import functions as F

from recallforge.llm import near_dup as nd

DOCS = "doc_id bigint, text string"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def check(spark, rows, n=2, **options):
    got = nd.near_duplicates(spark.createDataFrame(rows, DOCS), words=n, **options).collect()
    want = brute(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, n)) for _, t in rows)
    return got


def family(rng, words, size, length, edits):
    base = [rng.choice(words) for _ in range(length)]
    out = []
    for _ in range(size):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = rng.choice(words[:40])
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(6)
    texts = []
    for size, length, edits in ((90, 100, 16), (40, 300, 40), (30, 12, 2), (25, 60, 5), (20, 5, 1), (12, 700, 60)):
        texts += family(rng, words, size, length, edits)
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    texts += [texts[0]] * 30 + ["", None, "one", "one", "one two", "ONE  two", "two one"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_components_equal_brute_force(spark, corpus):
    check(spark, corpus)


def test_components_with_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    check(spark, corpus)


def test_components_with_split_lists(spark, corpus, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "SPLIT", 12)
    check(spark, corpus)


def test_five_words(spark, corpus):
    check(spark, corpus, n=5)


def test_borders_of_the_threshold(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w[: 20 + i])) for i in range(12)]  # sets of 19, 20, ... shingles, one inside the next
    check(spark, rows)


def test_shingle_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A b\x0bC", "a B c", "a bc", "abc", "", None, "x", "x x x x"]
    sets = [set(s.tolist()) for s in nd.shingle_sets(pa.array(texts), 2)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and not sets[2] & sets[3] and not sets[4] and not sets[5] and len(sets[6]) == 1 and len(sets[7]) == 1


def test_batches_of_few_words():
    import pyarrow as pa

    for n in range(7):
        text = " ".join("abcdef"[:n])
        assert [len(x) for x in nd.shingle_sets(pa.array([text]), 5)] == [max(min(n, 1), n - 4)]


def test_odd_rows(spark, odd, none, crowded):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(spark, rows)
    assert nd.near_duplicates(none).count() == 0 and nd.keep_one(none).count() == 0
    kept = nd.keep_one(crowded)
    assert kept.columns == crowded.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert [x.text for x in kept.collect() if x.doc_id is None] == [None]


def test_rows_of_one_id_with_different_texts_are_one_document(spark, words):
    rng = random.Random(3)
    a, b = (" ".join(rng.choice(words) for _ in range(50)) for _ in range(2))
    rows = [(5, a), (5, b), (3, a), (4, b), (9, "alone")]
    got = {(r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, DOCS), words=2).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a bigint, b bigint").withColumn("a", F.col("a"))
    got = {r.node: r.component for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_row_of_each_group_stays(spark, words):
    rng = random.Random(13)
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (2, b + " end", 4), (3, c, 5), (3, c, 6), (3, "quite another text", 7), (None, "", 8), (None, "", 9), (4, "x", 10), (5, "x", 11)]
    kept = sorted(r.n for r in nd.keep_one(spark.createDataFrame(rows, DOCS + ", n int")).collect())
    assert len({1, 2} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1 and 3 not in kept and 4 in kept and 11 not in kept
    many = spark.createDataFrame([(None, a, 0)] * 500 + [(1, a, 1)], DOCS + ", n int")
    assert [r.n for r in nd.keep_one(many).collect()] == [1]
