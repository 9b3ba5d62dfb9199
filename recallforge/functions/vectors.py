"""Binary hypervectors: trigram encoding, majority bundles, Hamming similarity, sign projections.

A vector is an array of 16 longs (most significant bit first).  Encoding needs a
majority over hashes of trigrams, which no built-in aggregate gives, so it runs
in an Arrow UDF with a cache of trigram vectors in each worker; comparing is a sum of
``bit_count(a ^ b)`` over longs and stays in generated code.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DIMS, NGRAM, SEED, WORDS

_CACHE_GRAMS = 200_000
_atoms: dict[tuple[str, int], dict[str, np.ndarray]] = {}


def atom(token: str, seed: str = SEED, dims: int = DIMS) -> bytes:
    """The vector of one token: SHA-256 of ``seed:token:i`` for i = 0, 1, ..., cut to ``dims`` bits."""
    need = dims // 8
    return b"".join(hashlib.sha256(f"{seed}:{token}:{i}".encode()).digest() for i in range(-(-need // 32)))[:need]


def trigrams(text: str, n: int = NGRAM) -> list[str]:
    t = text.strip().lower()
    if not t:
        return []
    t = " " * (n - 1) + t + " " * (n - 1)
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def _bits(token: str, seed: str, dims: int) -> np.ndarray:
    known = _atoms.setdefault((seed, dims), {})
    if token not in known:
        if len(known) >= _CACHE_GRAMS:
            known.clear()
        known[token] = np.unpackbits(np.frombuffer(atom(token, seed, dims), np.uint8))
    return known[token]


def encode_text(text: str | None, seed: str = SEED, dims: int = DIMS) -> bytes:
    """Majority of the vectors of all trigrams; a bit is set if strictly more than half have it; blank text gives zeros."""
    grams = trigrams(text or "")
    if not grams:
        return bytes(dims // 8)
    counts: dict[str, int] = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    total = np.zeros(dims, np.float32)
    names = list(counts)
    for at in range(0, len(names), 2048):
        part = names[at : at + 2048]
        total += np.array([counts[g] for g in part], np.float32) @ np.stack([_bits(g, seed, dims) for g in part]).astype(np.float32)
    return np.packbits(2 * total > len(grams)).tobytes()


def to_longs(vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, ">i8").astype(np.int64)


def encoder(seed: str = SEED, dims: int = DIMS):
    """An Arrow UDF from text to its vector as longs."""

    @F.pandas_udf("array<bigint>")
    def encode(s: pd.Series) -> pd.Series:
        seen: dict[str | None, np.ndarray] = {}
        for t in s.unique():
            seen[t] = to_longs(encode_text(t, seed, dims))
        return s.map(seen)

    return encode


def hamming(a: Column, b: Column, words: int = WORDS) -> Column:
    """Differing bits of two arrays of longs."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)])


def similarity(a: Column, b: Column, dims: int = DIMS) -> Column:
    return F.lit(1.0) - hamming(a, b, dims // 64) / F.lit(float(dims))


def spread(a: Column, prefix: str, words: int = WORDS) -> list[Column]:
    """A vector's longs as columns of their own, for scans that compare many pairs.

    Array accesses in the inner loop make a method that the JVM won't compile;
    plain columns that are never null keep it short.
    """
    return [F.coalesce(F.get(a, F.lit(i)), F.lit(0).cast("bigint")).alias(f"{prefix}{i}") for i in range(words)]


def spread_hamming(a: str, b: str, words: int = WORDS) -> Column:
    """Differing bits of two vectors that were spread under these prefixes."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(words)])


def spread_similarity(q: str, *others: str, dims: int = DIMS) -> Column:
    """The greatest similarity of a spread vector to some others."""
    near = [spread_hamming(q, o, dims // 64) for o in others]
    return F.lit(1.0) - (F.least(*near) if len(near) > 1 else near[0]) / F.lit(float(dims))


def popcount(a: Column, words: int = WORDS) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i]) for i in range(words)])


def rotate(a: Column, by: int, words: int = WORDS) -> Column:
    """Cyclic shift of a vector to the left by ``by`` bits."""
    whole, part = divmod(by % (64 * words), 64)

    def word(i: int) -> Column:
        x, y = a[(i + whole) % words], a[(i + whole + 1) % words]
        return x if part == 0 else F.shiftleft(x, part).bitwiseOR(F.shiftrightunsigned(y, 64 - part))

    return F.array(*[word(i) for i in range(words)])


def layout3d(a: Column) -> tuple[Column, ...]:
    """Three coordinates from bits 0-23, 24-47 and 48-71: their means from -1 to 1, times 15."""
    first, second = a[0], a[1]
    mask = F.lit((1 << 24) - 1)
    x = F.bit_count(F.shiftrightunsigned(first, 40).bitwiseAND(mask))
    y = F.bit_count(F.shiftrightunsigned(first, 16).bitwiseAND(mask))
    z = F.bit_count(first.bitwiseAND(F.lit((1 << 16) - 1))) + F.bit_count(F.shiftrightunsigned(second, 56))
    return tuple((c / 24.0 * 2 - 1) * 15 for c in (x, y, z))


def sign_parity(j: Column, d: Column, seed: str) -> Column:
    """+1 or -1 for input dimension j and output bit d, by hash parity: a Rademacher matrix that SQL can rebuild."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), j.cast("string"), d.cast("string"))), 8, 1), 16, 10).cast("int")
    return F.when(h % 2 == 1, 1).otherwise(-1)


def projection(dim: int, bits: int, seed: str) -> np.ndarray:
    """The matrix of :func:`sign_parity`, dim x bits."""
    m = np.empty((dim, bits), np.int64)
    for j in range(dim):
        for d in range(bits):
            m[j, d] = 1 if int(hashlib.md5(f"{seed}:{j}:{d}".encode()).hexdigest()[7], 16) % 2 else -1
    return m


def simhash(dim: int, bits: int = DIMS, seed: str = "semantic", scale: int = 1_000_000):
    """An Arrow UDF from a float vector to the sign bits of its projections as longs.

    Components are scaled to whole numbers first, so sums are exact and equal in
    any order; a bit is set if the sum is above zero.  Vectors of other lengths
    or with null or non-finite components give null.
    """
    matrix = projection(dim, bits, seed)

    @F.pandas_udf("array<bigint>")
    def encode(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            x = None if v is None else np.array(v, np.float64)
            if x is None or len(x) != dim or not np.isfinite(x).all():
                out.append(None)
                continue
            whole = np.rint(x.astype(np.float32).astype(np.float64) * scale).astype(np.int64)
            out.append(np.packbits(whole @ matrix > 0).view(">i8").astype(np.int64))
        return pd.Series(out)

    return encode


class StaticEmbedding:
    """Mean of token vectors from a table of rows, scaled to unit length.

    ``vocab`` maps WordPiece tokens to rows of ``codes`` (whole numbers from 0 to 255)
    with a scale and a minimum for each row.
    """

    def __init__(self, vocab: dict[str, int], codes: np.ndarray, scales: np.ndarray, minima: np.ndarray, max_tokens: int = 256):
        self.vocab, self.codes, self.scales, self.minima, self.max_tokens = vocab, codes, scales, minima, max_tokens

    def pieces(self, text: str) -> list[str]:
        """Greedy longest matches of each word, later pieces with ``##``."""
        out: list[str] = []
        for word in "".join(ch if ch.isalnum() or ch in "-_" else " " for ch in text.lower()).split():
            at, found = 0, []
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.vocab), None)
                if end is None:
                    found = []
                    break
                found.append(("##" if at else "") + word[at:end])
                at = end
            out += found
        return out[: self.max_tokens]

    def embed(self, text: str) -> np.ndarray:
        rows = [self.vocab[p] for p in self.pieces(text or "")]
        if not rows:
            return np.zeros(self.codes.shape[1], np.float32)
        mean = (self.codes[rows].astype(np.float32) * self.scales[rows, None] + self.minima[rows, None]).mean(axis=0)
        norm = float(np.linalg.norm(mean))
        return mean / norm if norm else mean

    def udf(self):
        @F.pandas_udf("array<float>")
        def embed(s: pd.Series) -> pd.Series:
            return s.map(lambda t: self.embed(t).tolist())

        return embed
