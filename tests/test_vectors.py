import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from recallforge.functions import vectors
from recallforge.schema import DIMS


def plain(text, seed="recallforge-v1"):
    t = text.strip().lower()
    if not t:
        return 0
    t = f"  {t}  "
    grams = [t[i : i + 3] for i in range(len(t) - 2)]
    sums = [0] * DIMS
    for g in grams:
        bits = int.from_bytes(b"".join(hashlib.sha256(f"{seed}:{g}:{i}".encode()).digest() for i in range(4)), "big")
        for d in range(DIMS):
            sums[d] += bits >> (DIMS - 1 - d) & 1
    return sum(1 << (DIMS - 1 - d) for d in range(DIMS) if 2 * sums[d] > len(grams))


def test_encoding_is_the_majority_of_trigram_vectors():
    for t in ["auth middleware", "a", "  Repository Pattern ", "naïve Ärger", ""]:
        assert int.from_bytes(vectors.encode_text(t), "big") == plain(t)


def test_typo_is_nearer_than_unrelated():
    sim = lambda a, b: 1 - (plain(a) ^ plain(b)).bit_count() / DIMS
    assert sim("auth middleware", "auth middleware") == 1.0
    typo, other = sim("auth middleware", "auth midleware"), sim("auth middleware", "banana pancake")
    assert typo > 0.75 > 0.65 > other > 0.35


def test_hamming_in_spark_equals_python(spark):
    rng = random.Random(3)
    rows = [(i, rng.randbytes(128), rng.randbytes(128)) for i in range(50)]
    to = lambda b: vectors.to_longs(b).tolist()
    df = spark.createDataFrame([(i, to(a), to(b)) for i, a, b in rows], "i int, a array<bigint>, b array<bigint>")
    got = {r.i: r.h for r in df.select("i", vectors.hamming(F.col("a"), F.col("b")).alias("h")).collect()}
    assert got == {i: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() for i, a, b in rows}


def test_rotation_moves_bits(spark):
    bits = random.Random(5).randbytes(128)
    whole = int.from_bytes(bits, "big")
    df = spark.createDataFrame([(vectors.to_longs(bits).tolist(),)], "a array<bigint>")
    for by in (0, 1, 63, 64, 200, 1023):
        got = df.select(vectors.rotate(F.col("a"), by).alias("r")).first().r
        want = ((whole << by) | (whole >> (DIMS - by))) & ((1 << DIMS) - 1)
        assert np.array(got, np.int64).astype(">i8").tobytes() == want.to_bytes(128, "big")


def test_sign_vectors_need_whole_finite_input(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0])], "i int, e array<float>")
    got = {r.i: r.s for r in df.select("i", vectors.simhash(2, 64)("e").alias("s")).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and got[4] is None
    m = vectors.projection(2, 64, "semantic")
    want = np.packbits(np.array([500000, -250000]) @ m > 0).view(">i8").astype(np.int64).tolist()
    assert got[1] == want


def test_static_embedding_matches_longest_pieces():
    e = vectors.StaticEmbedding({"run": 0, "##ning": 1, "fast": 2}, np.array([[0, 255], [255, 0], [10, 10]], np.uint8), np.ones(3, np.float32), np.zeros(3, np.float32))
    assert e.pieces("xyz, fast") == ["fast"]
    assert e.pieces("running fast") == ["run", "##ning", "fast"]
    assert abs(np.linalg.norm(e.embed("running fast")) - 1) < 1e-6 and not e.embed("").any()
