import random

from pyspark.sql import functions as F

from recallforge.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def targets(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    """Resharing by weight until no target is above its cap."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_words_near_them(spark, words):
    rng = random.Random(0)
    rows = []
    for i in range(3000):
        s = "big" if i % 3 == 0 else rng.choice(["a", "b", "é", "z", None])
        rows.append((i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(1.2)) + 1)), s))
    found = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    want = targets(sums)
    taken, largest = {}, {}
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    assert len(found) == len(rows) and all(abs(taken[s] - want[s]) <= min(largest[s], 0.02 * want[s] + 3) for s in want)


def test_reruns_agree_and_copies_have_their_probability(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    one = sorted((r.doc_id, r.copies) for r in mixing.mix_sources(df).collect())
    assert one == sorted((r.doc_id, r.copies) for r in mixing.mix_sources(df.repartition(7)).collect())
    rate = {}
    for seed in range(6):
        for r in mixing.mix_sources(df, cycle=(3, 1), share=1.0, seed=seed).collect():
            rate.setdefault(r.source, []).append(r.copies)
    t = targets({s: sum(1 + i % 7 for i in range(400) if f"s{i % 2}" == s) for s in ("s0", "s1")}, (3, 1), 1.0)
    for s, c in rate.items():
        n = sum(1 + i % 7 for i in range(400) if f"s{i % 2}" == s)
        assert abs(sum(c) / len(c) - t[s] / n) < 0.08


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (i % 9), "s" if i % 4 else None) for i in range(300)]
    found = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 300
    for s in ("s", None):
        got = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in got) - got[0].target) <= 8


def test_odd_rows(odd, none, crowded):
    found = mixing.mix_sources(odd).collect()
    assert len(found) == odd.count() and all(r.taken == 0 for r in found if r["size"] == 0)
    assert mixing.mix_sources(none).count() == 0 and mixing.apply_mix(none).count() == 0
    mixed = mixing.apply_mix(crowded)
    copies = mixing.mix_sources(crowded, key=mixing._row_key(crowded.schema.fields)).agg(F.sum("copies")).first()[0]
    assert mixed.columns == crowded.columns and mixed.count() == copies
    assert mixing.apply_mix(odd).schema.simpleString() == odd.schema.simpleString()


def test_words_are_cut_at_ascii_space_only(spark):
    rows = [(1, "a\x0bb\x0cc d\te\r\nf", "s"), (2, "one\u00a0two", "s"), (3, "\x1f", "s")]
    got = {r.doc_id: r["size"] for r in mixing.word_sizes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 6, 2: 1, 3: 1}


def test_rows_that_differ_keep_what_they_hold(spark):
    rows = [(1, "a b c", "s", f"l{i}", {"k": i}) for i in range(40)] + [(None, "x y", "s", None, None)] * 40
    df = spark.createDataFrame(rows, DOCS + ", lang string, more map<string,int>")
    one = sorted(map(str, mixing.apply_mix(df, cycle=(1,), share=0.75).collect()))
    assert one == sorted(map(str, mixing.apply_mix(df.repartition(5), cycle=(1,), share=0.75).collect()))
    assert len(set(one)) > 25 and set(one) <= {str(r) for r in df.collect()}
    whole = [str(r) for r in mixing.apply_mix(df, cycle=(1,), share=2.0).collect()]
    assert sorted(whole) == sorted(str(r) for r in df.collect() for _ in (0, 1))


def test_very_many_equal_rows_are_numbered(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a b", "s")] * 5000 + [(1, "c", "s")], DOCS)
    for most in (4096, 64):
        monkeypatch.setattr(mixing, "SAME_ROWS", most)
        found = mixing.mix_sources(df, cycle=(1,), share=0.5).collect()
        assert len(found) == 5001 and abs(sum(r.taken for r in found) - found[0].target) <= 2
        assert mixing.apply_mix(df, cycle=(1,), share=0.5).count() == sum(mixing.mix_sources(df, cycle=(1,), share=0.5, key=mixing._row_key(df.schema.fields)).select("copies").toPandas()["copies"])


def by_hand(found, seed=11):
    """Pivotal rounding in one list a source: the words that copies take, by a plain loop of trades."""
    rng, taken = random.Random(seed), {}
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s and r["size"]]
        p = {i: r.target / r.source_size % 1 for i, r in enumerate(own)}
        whole = {i: int(r.target / r.source_size) for i, r in enumerate(own)}
        open_ = [i for i in p if 0 < p[i] < 1]
        while len(open_) > 1:
            a, b = open_[-2:]
            x, y = own[a]["size"], own[b]["size"]
            up, down = min((1 - p[a]) * x, p[b] * y), min(p[a] * x, (1 - p[b]) * y)
            step = up if rng.random() * (up + down) < down else -down
            p[a], p[b] = p[a] + step / x, p[b] - step / y
            for i in (a, b):
                p[i] = round(p[i]) if abs(p[i] - round(p[i])) < 1e-9 else p[i]
            open_ = [i for i in open_ if 0 < p[i] < 1]
        taken[s] = sum((whole[i] + (p[i] > 0.5)) * r["size"] for i, r in enumerate(own))
    return taken


def test_as_near_to_the_targets_as_a_plain_loop(spark, sf):
    found = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    target, taken = {r.source: r.target for r in found}, {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    plain = by_hand(found)
    largest = {s: max(r["size"] for r in found if r.source == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(abs(taken[s] - target[s]) for s in target) <= sum(abs(plain[s] - target[s]) for s in target)
