"""Word shingles of whole texts as 64-bit hashes, and their fast similarity sketches.

Texts are hashed a batch at a time by array operations: a polynomial hash per word (A-Z
lower-cased), mixed, and a mix of five consecutive word hashes per shingle.
"""

from __future__ import annotations

import numpy as np

from frostline.llm.pretokens import _powers

WORDS = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[data]
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(max(1 << 16, 1 << (len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text one after the other, set sizes).

    A text of fewer words gives its whole word sequence as one shingle, one without words
    none.
    """
    hashes, counts = word_hashes(texts)
    firsts = np.cumsum(counts) - counts
    n_shingles = np.where(counts >= words, counts - words + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    at = np.repeat(firsts - (np.cumsum(n_shingles) - n_shingles), n_shingles) + np.arange(len(owner))
    value = np.zeros(len(owner), np.uint64)
    for k in range(words):
        value = mix(value + hashes[at + k])
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        whole = np.zeros(1, np.uint64)
        for h in hashes[firsts[i] : firsts[i] + counts[i]]:
            whole = mix(whole + h)
        whole = mix(whole + np.uint64(counts[i]))
        value, owner = np.append(value, whole), np.append(owner, i)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def sketches(values: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each set: (sets, bins) of 64-bit coordinates.

    In the first ``bins`` rounds every element falls into one bin by the round's hash and
    competes there with the round as the most significant part; in round ``bins + j`` every
    element goes to bin ``j``. A bin keeps its smallest entry, so later rounds matter only
    for bins still empty, and after at most ``2 * bins`` rounds none is. Empty sets keep the
    largest value everywhere.
    """
    n = len(sizes)
    empty = np.uint64(2**64 - 1)
    out = np.full(n * bins, empty, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    low = np.uint64(48)  # the low 48 bits compete, the high ones carry the round
    for i in range(2 * bins):
        if not len(owner):
            break
        h = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bin_ = (h >> low).astype(np.int64) % bins if i < bins else np.full(len(h), i - bins)
        entry = (h & np.uint64(2**48 - 1)) | np.uint64(i) << low
        np.minimum.at(out, owner * bins + bin_, entry)
        open_ = (out.reshape(n, bins) == empty).any(axis=1)
        if not open_.all():
            still = open_[owner]
            values, owner = values[still], owner[still]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` coordinates; bands have keys of their own."""
    n, bins = sketch.shape
    bands = bins // rows
    grouped = sketch[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        key = mix(key + grouped[:, :, k])
    return key


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if not len(a) or not len(b):
        return False
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
