"""numpy kernels over batches of sequences: codes, k-mers, window hashes."""

from __future__ import annotations

import numpy as np

from motifel.functions.hashing import murmur_numpy

_INVALID = 255
TILE = 1 << 15
"""Starts of k-mers that are worked on at once."""
_CODE = np.full(256, _INVALID, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "TtUu", "Gg")):
    for _c in _pair:
        _CODE[ord(_c)] = _i


def codes(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all sequences behind each other, an invalid code after each; and where each starts."""
    joined = np.frombuffer(b"\xff".join([*seqs, b""]), np.uint8)
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    return _CODE[joined], np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]


def invalid_signs(seqs: list[bytes]) -> int:
    """Characters of UTF-8 texts that are no base."""
    joined = np.frombuffer(b"".join(seqs), np.uint8)
    return int(((_CODE[joined] == _INVALID) & (joined & 0xC0 != 0x80)).sum())


def valid_at(code: np.ndarray, k: int) -> np.ndarray:
    """Where k bases in a row are valid."""
    if len(code) < k:
        return np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(code == _INVALID)])
    return bad[k:] == bad[:-k]


def mers(code: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mer at each place (of no meaning where not valid), put together from runs whose lengths double."""
    u = np.uint64
    f = (code & 3).astype(np.uint64)
    r = f ^ u(2)
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total_f = total_r = None
    have, width = 0, 1
    while True:
        if k & width:
            if total_f is None:
                total_f, total_r = f, r
            else:
                m = min(len(total_f), len(f) - have)
                total_f = (total_f[:m] << u(2 * width)) | f[have : have + m]
                total_r = total_r[:m] | (r[have : have + m] << u(2 * have))
            have += width
        if have == k:
            break
        m = len(f) - width
        f, r = (f[:m] << u(2 * width)) | f[width:], r[:m] | (r[width:] << u(2 * width))
        width *= 2
    return np.minimum(total_f[:n], total_r[:n])


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def _tiled(code: np.ndarray, k: int, values) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of each valid k-mer; values(codes) gives those of some starts at a time, so that
    what is between fits in a core's cache."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a in range(0, len(code) - k + 1, TILE):
        tile = code[a : a + TILE + k - 1]
        at = np.flatnonzero(valid_at(tile, k))
        found.append((at + a, values(tile)[at]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def kmer_values(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, canonical k-mer) of each valid k-mer."""
    return _tiled(code, k, lambda tile: mers(tile, k))


def minimizer_hashes(code: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the k-mer, smallest hash of its canonical m-mers) for each valid k-mer."""
    return _tiled(code, k, lambda tile: window_minimum(murmur_numpy(mers(tile, m)), k - m + 1))
