import hashlib
import unicodedata

from recallforge.llm import fingerprint as fp

DOCS = "doc_id bigint, text string"


def plain(rows):
    """Edited texts by a loop over the documents in order of id."""
    rows = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in rows]
    out = {}
    for k, (i, _) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        out[i] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), fp.digest(a), fp.digest(edited), float(fp.digest(a) == fp.digest(edited)), float(fp.digest(a) == fp.digest(b)))
    return out


def test_edited_texts_equal_a_loop(spark):
    rows = [(i * 3, (f"text {i} é🙂 " * (i % 50)) if i % 11 else None) for i in range(500)] + [(1, "same"), (2, "same"), (4, "SAME  "), (5, "x")]
    got = fp.edited_fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    want = plain(rows)
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)


def test_single_document_and_none(spark):
    assert tuple(fp.edited_fingerprints(spark.createDataFrame([(7, "ab cd")], DOCS)).first())[1:3] == (5, hashlib.sha256(b"ab ab").hexdigest())
    assert fp.edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_canonical_form():
    same = ["Straße  X", "STRASSE x", " strasse\u00a0x\n", "ﬆrasse x"]
    assert len({fp.digest(s) for s in same}) == 1
    assert fp.digest("é") == fp.digest("e\u0301") != fp.digest("e") and fp.digest(None) == fp.digest("") == fp.digest(" \n")
    t = "Ǆ ﬁ ½"
    assert fp.canonical(t) == " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def test_a_clash_is_told_apart(spark):
    texts = [f"text {i % 300}" for i in range(400)] + ["TEXT 7"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    by: dict = {}
    for r in fp.fingerprints(df, bits=8).collect():  # 256 digests for 300 texts
        by.setdefault(r.fingerprint, set()).add(fp.canonical(texts[r.doc_id]))
    assert len(by) == 300 and all(len(x) == 1 for x in by.values()) and any(len(x) > 2 for x in by)
    rows = sorted(fp.edited_fingerprints(df, bits=8).collect(), key=lambda r: r.doc_id)
    wide = sorted(fp.edited_fingerprints(df).collect(), key=lambda r: r.doc_id)
    assert [r[:3] + (r.near_edited, r.near_next) for r in rows] == [r[:3] + (r.near_edited, r.near_next) for r in wide]
    assert len({r.fingerprint for r in rows}) == 300 == len({r.fingerprint for r in wide})


def test_many_rows_of_one_id(spark, monkeypatch):
    rows = [(None, None)] * 3000 + [(None, f"null {i}") for i in range(500)] + [(5, "same text")] * 1000 + [(5, f"other {i}") for i in range(300)] + [(9, "end")]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    monkeypatch.setattr(fp, "SAME_ROWS", 100)
    got = fp.edited_fingerprints(df).collect()
    keyed = {(r.doc_id, r.text): r.key for r in df.select("doc_id", "text", fp.text_key().alias("key")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, keyed[r]))
    texts = [t or "" for _, t in order]
    want = sorted(str((i, len(a), hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest(), float(a == b))) for (i, _), a, b in zip(order, texts, [*texts[1:], texts[0]], strict=True))
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.near_next)) for r in got) == want


def test_groups_and_odd_rows(odd, none, crowded):
    got = fp.exact_groups(odd).collect()
    assert len(got) == odd.count() and {r.first_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert fp.exact_groups(none).count() == 0
    assert fp.edited_fingerprints(odd).count() == odd.count() == fp.edited_fingerprints(crowded).count()
