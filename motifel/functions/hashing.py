"""The two hashes of k-mers: MurmurHash3 x64 128 (first word, key of 8 bytes) and Wang's invertible one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.functions import dna
from motifel.functions.bits import add64, bits, mul64, rotl, shr, xorshift

#: Fixed values of MurmurHash3 x64 128 and of its finaliser.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SEED = 42


def murmur(df: DataFrame, key: str, out: str, seed: int = SEED) -> DataFrame:
    """df with a column ``out``: the first word of the hash of the 8 bytes of the BIGINT ``key``.
    Each product is a projection of its own, so that none is computed twice."""
    k, x, y = "__murmur_k", "__murmur_x", "__murmur_y"
    length = 8
    both = seed ^ length
    df = df.withColumn(k, mul64(F.col(key), C1)).withColumn(k, mul64(rotl(F.col(k), 31), C2))
    df = df.withColumn(x, add64(F.col(k).bitwiseXOR(bits(both)), bits(both))).withColumn(y, add64(F.col(x), bits(both)))
    for factor in (F1, F2):
        df = df.withColumns({x: xorshift(F.col(x), 33), y: xorshift(F.col(y), 33)})
        df = df.withColumns({x: mul64(F.col(x), factor), y: mul64(F.col(y), factor)})
    df = df.withColumns({x: xorshift(F.col(x), 33), y: xorshift(F.col(y), 33)})
    return df.withColumn(out, add64(F.col(x), F.col(y))).drop(k, x, y)


def murmur_numpy(keys: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The same for an array of uint64."""
    u = np.uint64
    both = u(seed ^ 8)
    k = keys * u(C1)
    k = (k << u(31)) | (k >> u(33))
    k *= u(C2)
    x = (k ^ both) + both
    out = np.zeros_like(x)
    for h in (x, x + both):
        h = h ^ (h >> u(33))
        h *= u(F1)
        h ^= h >> u(33)
        h *= u(F2)
        h ^= h >> u(33)
        out += h
    return out


#: The steps of Wang's hash in order, as (factor, added) or the width of a xorshift.
WANG = [((1 << 21) - 1, -1), 24, (265, 0), 14, (21, 0), 28, ((1 << 31) + 1, 0)]


def _masked(n_bits: int):
    return bits((1 << n_bits) - 1)


def wang(df: DataFrame, key: str, out: str, n_bits: int) -> DataFrame:
    """df with the hash of the lowest n_bits of ``key`` as ``out``; one to one on n_bits."""
    df = df.withColumn(out, F.col(key).bitwiseAND(_masked(n_bits)))
    for step in WANG:
        if isinstance(step, int):
            df = df.withColumn(out, xorshift(F.col(out), step))
        else:
            df = df.withColumn(out, mul64(F.col(out), step[0])).withColumn(out, add64(F.col(out), bits(step[1])).bitwiseAND(_masked(n_bits)))
    return df


def wang_inverse(df: DataFrame, key: str, out: str, n_bits: int) -> DataFrame:
    """Undoes ``wang``: factors by their inverse mod 2^n_bits, xorshifts by shifting on until nothing is left."""
    df = df.withColumn(out, F.col(key))
    for step in reversed(WANG):
        if isinstance(step, int):
            x = F.col(out)
            for shift in range(step, n_bits, step):
                x = x.bitwiseXOR(shr(F.col(out), shift))
            df = df.withColumn(out, x)
        else:
            back = pow(step[0], -1, 1 << n_bits)
            df = df.withColumn(out, add64(F.col(out), bits(-step[1]))).withColumn(out, mul64(F.col(out), back).bitwiseAND(_masked(n_bits)))
    return df


def kmer_to_hash(df: DataFrame, kmer: str, out: str, k: int) -> DataFrame:
    """df with the invertible hash of the k-mers of a text column."""
    code = "__kmer_code"
    return wang(df.withColumn(code, dna.encode(F.col(kmer), k)), code, out, 2 * k).drop(code)


def hash_to_kmer(df: DataFrame, hashed: str, out: str, k: int) -> DataFrame:
    """The k-mers of such hashes."""
    code = "__kmer_code"
    return wang_inverse(df, hashed, code, 2 * k).withColumn(out, dna.decode(F.col(code), k)).drop(code)
