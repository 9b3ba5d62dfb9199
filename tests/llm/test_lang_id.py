import zlib

import numpy as np

from recallforge.llm import lang_id

SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then the whole thing goes on with another sentence about weather",
    "de": "der schnelle braune fuchs springt über den faulen hund und danach geht das ganze mit einem weiteren satz über das wetter weiter",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis tout continue avec une autre phrase sur la météo",
}


def corpus(n=90):
    rows = []
    for i in range(n):
        lang = list(SENTENCES)[i % 3]
        w = SENTENCES[lang].split()
        rows.append((i, " ".join(w[(i + j * 7) % len(w)] for j in range(25)), lang))
    return rows


def model():
    counts = np.zeros((3, lang_id.BUCKETS))
    for i, lang in enumerate(sorted(SENTENCES)):
        counts[i] = np.bincount(lang_id.grams(SENTENCES[lang] * 20, lang_id.BUCKETS), minlength=lang_id.BUCKETS)
    return lang_id.LanguageModel(sorted(SENTENCES), counts)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = lang_id.train_and_predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(held) > 10 and all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in held)


def test_labels_of_held_out_documents_are_not_read(spark):
    rows = corpus()
    lie = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in lang_id.train_and_predict(spark.createDataFrame(x, "doc_id bigint, text string, lang string")).collect()) for x in (rows, lie))
    assert a == b


def test_mixtures():
    m = model()
    half, _ = m.mixture(SENTENCES["en"] + " " + SENTENCES["de"])
    assert set(half) == {"en", "de"} and 0.35 < half["en"] < 0.65 and abs(sum(half.values()) - 1) < 1e-9
    only, fit = m.mixture(SENTENCES["fr"])
    assert set(only) == {"fr"} and fit > 1
    assert m.mixture("") == ({}, 0.0) and m.mixture("zzqxj wvkqz xxzzq")[1] < 0


def test_odd_rows(odd, none, crowded):
    got = {r.doc_id: r for r in lang_id.train_and_predict(odd).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 8)) and lang_id.train_and_predict(odd).count() == odd.count()
    assert all(not r.held_out for r in lang_id.train_and_predict(odd).filter("doc_id is null").collect())
    assert lang_id.train_and_predict(none).count() == 0
    kept = lang_id.keep_identified(crowded)
    assert kept.columns == crowded.columns and {4, 5, 6, 8}.isdisjoint(r.doc_id for r in kept.collect())
    assert lang_id.keep_identified(none).count() == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in lang_id.train_and_predict(df).collect()} == {"und"}


def by_hand(m, text, penalty=3.0):
    """Greedy forward choice of languages with plain loops of expectation maximisation."""
    g = lang_id.grams(text, m.buckets)
    if not len(g) or not m.langs:
        return {}
    logs = [float(np.log(m.p[g, i]).sum()) for i in range(len(m.langs))]
    chosen, share = [max(range(len(logs)), key=lambda i: (logs[i], -i))], [1.0]
    level = logs[chosen[0]]
    while len(chosen) < len(m.langs):
        mixed = sum(w * m.p[g, i] for i, w in zip(chosen, share, strict=True))
        gain = {i: float((m.p[g, i] / mixed).sum()) for i in range(len(m.langs)) if i not in chosen}
        more = max(gain, key=lambda i: (gain[i], -i))
        if gain[more] <= len(g):
            break
        now, w = -np.inf, [*(0.9 * x for x in share), 0.1]
        for _ in range(30):
            parts = [x * m.p[g, i] for i, x in zip([*chosen, more], w, strict=True)]
            before, now = now, float(np.log(sum(parts)).sum())
            if now - before < 1e-3 * penalty * np.log(len(g) + 1):
                break
            w = [float((x / sum(parts)).mean()) for x in parts]
        if now - level <= penalty * np.log(len(g) + 1):
            break
        chosen, share, level = [*chosen, more], w, now
    return {m.langs[i]: w for i, w in zip(chosen, share, strict=True)}


def test_the_inference_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    m = lang_id.fit(spark.createDataFrame([(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1], "lang string, text string"))
    texts = [r.text for r in docs[:60]] + [docs[i].text[:2000] + " " + docs[i + 7].text[:2000] for i in range(20)]
    for t in texts:
        got, want = m.mixture(t)[0], by_hand(m, t)
        assert list(got) == list(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    mixed = [len(m.mixture(t)[0]) for t in texts]
    assert max(mixed) > 1 or len(m.langs) < 2


def test_held_out_accuracy_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in lang_id.train_and_predict(docs).collect() if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_shards_change_nothing(spark, odd, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet").limit(60)):
        rows = lambda d: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9), round(r.fit, 9), sorted((k, round(v, 9)) for k, v in r.shares.items())) for r in d.collect())
        assert rows(lang_id.train_and_predict(docs, shard=1)) == rows(lang_id.train_and_predict(docs))


def test_a_label_for_every_document(spark):
    rows = [(i, t, f"{lang}-{i}") for i, t, lang in corpus(400)]
    got = lang_id.train_and_predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), shard=64).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and all(r.lang_pred[:2] == rows[r.doc_id][2][:2] for r in held)


def test_nothing_learned_keeps_what_has_letters(spark):
    rows = [(1, "some text", None), (2, "123", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in lang_id.keep_identified(df).collect()] == [1]
    assert {r.lang_pred for r in lang_id.train_and_predict(df).collect()} == {"und"}
