import random

from recallforge.llm import line_dedup as ld

DOCS = "doc_id bigint, text string"


def run(spark, rows):
    return {r.doc_id: (r.text, r.removed_lines) for r in ld.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()}


def test_a_passage_between_lines_of_its_own_is_removed_from_later_documents(spark):
    p = ["the first line of a passage", "and its second line"]
    rows = [(i, "\n".join([f"own {i} a", *p, f"own {i} b"])) for i in range(1, 6)]
    got = run(spark, rows)
    assert got[1] == (rows[0][1], 0)
    assert all(got[i] == (f"own {i} a\nown {i} b", 2) for i in range(2, 6))


def test_single_short_lines_stay_and_long_ones_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    got = run(spark, [(1, f"x1\nshort\ny1\n{long}"), (2, f"x2\nshort\ny2\n{long}"), (3, f"{long}\nz")])
    assert got[1][1] == 0 and got[2] == ("x2\nshort\ny2", 1) and got[3] == ("z", 1)


def test_inserted_text_does_not_shift_boundaries(spark):
    rng = random.Random(4)
    body = [f"line {i} {rng.random()}" for i in range(80)]
    moved = ["new head", *body[:30], "new middle", *body[30:]]
    got = run(spark, [(1, "\n".join(body)), (2, "\n".join(moved))])
    assert got[1][1] == 0 and got[2] == ("new head\nnew middle", 80)


def test_repeats_within_a_document(spark):
    got = run(spark, [(1, "a b\nc d\nmid\na b\nc d")])
    assert got[1] == ("a b\nc d\nmid", 2)


def test_a_passage_inside_a_shared_run_is_found_by_its_count(spark):
    p = ["common one", "common two", "common three"]
    near = ["h1 h", "h2 h", *p, "t1 t", "t2 t"]
    rows = [(1, "\n".join(near)), (2, "\n".join([*near[:-1], "t3 t"])), (3, "\n".join(["u u", *p, "v v"]))]
    got = run(spark, rows)
    assert got[3] == ("u u\nv v", 3) and got[1][1] == 0


def test_no_repeated_pair_is_left(spark, words):
    rng = random.Random(9)
    shared = [[" ".join(rng.choice(words) for _ in range(6)) for _ in range(rng.randint(2, 9))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            lines += [f"own {i} {rng.random()}"] + (rng.choice(shared) if rng.random() < 0.7 else [])
        rows.append((i, "\n".join(lines)))
    got = run(spark, rows)
    pairs = [(a, b) for t, _ in got.values() for a, b in zip(t.split("\n"), t.split("\n")[1:], strict=False)]
    inside = {(a, b) for s in shared for a, b in zip(s, s[1:], strict=False)}
    assert sum(p in inside for p in pairs) == len({p for p in pairs if p in inside})
    owns = [x for _, t in rows for x in t.split("\n") if x.startswith("own")]
    assert sorted(owns) == sorted(x for t, _ in got.values() for x in t.split("\n") if x.startswith("own"))


def test_odd_rows(spark, odd, none, crowded):
    got = ld.remove_repeated(odd).collect()
    assert len(got) == odd.count()
    by = [(r.doc_id, r.text, r.n_lines) for r in got]
    assert (4, None, 0) in by and (5, "", 1) in by and ld.remove_repeated(none).count() == 0
    assert {r.doc_id for r in got if r.removed_lines} <= {1, 2, 3, None}
    assert ld.clean_lines(crowded).columns == crowded.columns and ld.clean_lines(crowded).count() == odd.count()
    assert ld.remove_repeated(crowded).count() == odd.count()
    assert ld.clean_lines(odd).schema.simpleString() == odd.schema.simpleString()


def left_by_hand(rows, long_line=50):
    """What stays if both lines of every pair (blank ones between or not) and every long line that stand at an earlier place go."""
    first, out = {}, {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        full = [p for p, x in enumerate(lines) if x.split()]
        for p, q in [*zip(full, full[1:], strict=False), *((p, p) for p in full if len(lines[p].split()) >= long_line)]:
            at = first.setdefault(tuple(lines[p : q + 1]), (i, p, q))
            if at != (i, p, q):
                gone |= {x for x in range(p, q + 1) if at[0] != i or x > at[2]}
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def chunks_by_hand(lines, hashes, divisor):
    """(start, end) of the chunks of one document by a loop over its lines."""
    import numpy as np

    bounds, found = [0], []
    for i in range(len(lines)):
        inside = i >= ld.SPAN - 1 and int(ld._spanned(np.array(hashes[i - ld.SPAN + 1 : i + 1], np.uint64), np.array([0]), np.array([ld.SPAN]))[0]) % divisor == 0
        if inside or i == len(lines) - 1:
            bounds.append(i + 1)
    for a, b in zip(bounds, bounds[1:], strict=False):
        full = [x for x in range(a, b) if lines[x].split()]
        if len(full) > 1:
            found.append((full[0], full[-1] + 1))
    return found


def test_chunks_equal_a_loop_and_do_not_shift():
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["\n".join(rng.choice(["", " ", f"line {rng.random()}", "same"]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    h, words, doc, place = ld._lines(pa.array(texts))
    starts, ends = ld.chunk_bounds(h, words, doc, 4)
    got = [(int(doc[a]), int(place[a]), int(place[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]
    want = [(i, a, b) for i, t in enumerate(texts) for a, b in chunks_by_hand(t.split("\n"), h[doc == i].tolist(), 4)]
    assert got == want and len(want) > 100
    body = [f"line {i} {rng.random()}" for i in range(60)]
    h, words, doc, place = ld._lines(pa.array(["\n".join(body), "\n".join(["new", "lines", *body])]))
    starts, ends = ld.chunk_bounds(h, words, doc, 4)
    one, two = ({(int(place[a]) - 2 * d, int(place[b - 1]) + 1 - 2 * d) for a, b in zip(starts, ends, strict=True) if doc[a] == d} for d in (0, 1))
    assert len(one & two) >= len(one) - 2 > 5


def test_equal_to_a_loop(spark, words):
    rng = random.Random(21)
    long = [" ".join(rng.choice(words) for _ in range(55)) for _ in range(3)]
    shared = [[rng.choice(["", "  ", rng.choice(long), " ".join(rng.choice(words) for _ in range(4))]) for _ in range(rng.randint(2, 20))] for _ in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += [f"own {i} {rng.random()}"] * rng.randint(0, 2) + (rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.7 else ["", rng.choice(long)])
        rows.append((i, "\n".join(lines)))
    got = run(spark, rows)
    assert {i: t for i, (t, _) in got.items()} == left_by_hand(rows)
    assert sum(n for _, n in got.values()) > 300


def test_no_fragment_of_a_passage_is_left(spark):
    p = [f"p{i} of the passage" for i in range(1, 6)]
    rows = [(i, "\n".join([f"own {i}", *p, f"end {i}"])) for i in range(3)] + [(3, "\n".join(["own 3", *p[1:3], "end 3"]))]
    got = run(spark, rows)
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"own {i}\nend {i}", 5 if i < 3 else 2) for i in (1, 2, 3))


def test_a_clash_of_digests_touches_nothing_it_should_not(spark):
    rng = random.Random(3)
    passage = ["x y z", "u v w"]
    rows = [(i, "\n".join([f"a {rng.random()}", f"b {rng.random()}", *passage, f"c {rng.random()}"])) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    assert all(r.text == rows[r.doc_id][1] and r.removed_lines == 0 for r in ld.remove_repeated(df, bits=3).collect())  # eight digests
    some = {r.doc_id: r.text for r in ld.remove_repeated(df, bits=12).collect()}
    assert all(set(rows[i][1].split("\n")) - set(t.split("\n")) <= set(passage) for i, t in some.items())
    hot = [(i, "\n".join(["x y z", "u v w"])) for i in range(3000)] + [(9999, "x y z\nu v w\nown")]
    got = {r.doc_id: r.text for r in ld.remove_repeated(spark.createDataFrame(hot, DOCS).repartition(5)).collect()}
    assert got[0] == hot[0][1] and got[9999] == "own" and set(got.values()) == {"", hot[0][1], "own"} and sum(t == hot[0][1] for t in got.values()) == 1


def test_nested_passages_with_falling_counts(spark):
    p = [f"passage line {i}" for i in range(1, 6)]
    sizes = [5] * 4 + [4] * 2 + [3] * 2 + [2] * 2  # counts of pairs 10, 8, 6, 4
    rows = [(i, "\n".join([f"own {i} a", *p[:n], f"own {i} b"])) for i, n in enumerate(sizes)]
    got = run(spark, rows)
    assert got[0] == (rows[0][1], 0)
    assert all(got[i] == (f"own {i} a\nown {i} b", n) for i, n in enumerate(sizes) if i)
    turned = [(9 - i, t) for i, t in rows]  # the shortest first: each line stays once
    left = "\n".join(t for t, _ in run(spark, turned).values()).split("\n")
    assert all(left.count(x) == 1 for x in p)


def test_near_copies_edited_at_different_lines(spark):
    rng = random.Random(11)
    rows = []
    for g in range(4):
        body = [f"group {g} line {i}" for i in range(35)]
        for c in range(12):
            own = list(body)
            for x in rng.sample(range(35), rng.randint(0, 4)):
                own[x] = f"edit {g} {c} {x}"
            rows.append((100 * g + c, "\n".join(own)))
    got = run(spark, rows)
    assert {i: t for i, (t, _) in got.items()} == left_by_hand(rows)
    assert {x for t, _ in got.values() for x in t.split("\n") if x} == {x for _, t in rows for x in t.split("\n")}


def test_a_long_line_goes_from_copied_documents_and_within_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"alone\n{long}\nend")]
    for g in range(3):
        rows += [(10 * g + c, f"head {g}\n{long}\ntail {g}") for c in (10, 11)]
    rows.append((99, "\n".join(["x", *[f"{long} again"] * 6, "y"])))
    got = run(spark, rows)
    assert got[1][1] == 0 and all(got[10 * g + 10] == (f"head {g}\ntail {g}", 1) and got[10 * g + 11] == ("", 3) for g in range(3))
    assert got[99] == (f"x\n{long} again\ny", 5)


def test_lines_with_blank_ones_between_and_overlapping_repeats(spark):
    rows = [(1, "a a\n\n\nb b\nc1"), (2, "o2\na a\n\n\nb b"), (3, "a a\n\nb b"), (4, "z z\nz z\nz z"), (5, "c1\n\nd"), (6, "u\nc1\n\n")]
    got = run(spark, rows)
    assert got[1][1] == 0 and got[2] == ("o2", 4) and got[3] == (rows[2][1], 0)
    assert got[4] == ("z z\nz z", 1) and got[5][1] == 0 and got[6][1] == 0
