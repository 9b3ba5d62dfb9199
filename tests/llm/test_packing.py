import random
import zlib

import numpy as np
import pytest

from recallforge.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string"


def reference(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def verify(rows, want):
    """Pieces cover each document once, windows are gapless and within capacity; returns the filling."""
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(want)
    for i, parts in by.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            ids = np.array(want[i][p.start : p.start + p.length], "<u4")
            assert p.start == at and len(ids) == p.length > 0 and p.doc_tokens == len(want[i]) and p.ids_crc32 == zlib.crc32(ids.tobytes())
            at += p.length
        assert at == len(want[i])
    for parts in windows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return sum(map(len, want.values())) / (2048 * len(windows))


def test_packing_is_whole_and_dense(spark, words):
    rng = random.Random(1)
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    found = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1), PATH).collect()
    assert verify(found, dict(zip([i for i, _ in rows], reference([t for _, t in rows]), strict=True))) > 0.97


def test_ids_equal_the_tokenizer(words):
    enc = packing.encoder(PATH)
    texts = ["", " ", "a  b\n\n c", "don't I'll 12345 ²³", "é漢字🙂\u200d🙂", "<|endoftext|> in a text", "x" * 5000, "\r\n\t  \x0b end ", "ñ" * 300 + " !!" * 50]
    assert [[*enc(t).tolist(), 1] for t in texts] == reference(texts)


def test_differencing():
    rng = random.Random(2)
    for k in (1, 2, 7, 40):
        lengths = [rng.randint(1, 500) for _ in range(6 * k)]
        largest, windows = packing.difference(lengths, k)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths))) and len(windows) == k
        assert largest == max(sum(lengths[i] for i in w) for w in windows) <= sum(lengths) / k + 60
    assert packing.windows_for([2048] * 3, 2048) == [[0], [1], [2]] or len(packing.windows_for([2048] * 3, 2048)) == 3
    assert len(packing.windows_for([1500] * 5, 2048)) == 5 and packing.windows_for([], 2048) == []


def test_odd_rows(spark, odd, none, crowded):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = packing.pack(odd, PATH).collect()
    assert sum(r.length for r in found) == sum(len(x) for x in reference([t for _, t in rows]))
    assert [r.length for r in found if r.doc_id == 4] == [1] == [r.length for r in found if r.doc_id == 5]
    assert packing.pack(none, PATH).count() == 0 and packing.pack(crowded, PATH).count() == len(found)
