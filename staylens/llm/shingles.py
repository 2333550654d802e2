"""Words and occurrence-labelled word k-mers of texts as 64-bit hashes (NumPy, per text).

Words are the runs between ASCII white space of the UTF-8 text, as they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Generations, map_arrow, slices, worker_memo

#: Words in each of the two generations of the memo of word hashes (about 190 bytes each).
MEMO_WORDS = 150_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(Generations):
    def value_of(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)



def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.split()
    known = worker_memo("words", lambda: _Words(MEMO_WORDS))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text that has words is one run."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + words[j:n - k + 1 + j]
    return mix(out + np.uint64(k))


def labelled(x: np.ndarray) -> np.ndarray:
    """Each value made unique by its occurrence number in the text."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return x
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, mix(x + occurrence * MULTIPLIER), x)


def digest(raw: bytes) -> bytes:
    """A 128-bit hash of the word sequence."""
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def with_digest(plain: DataFrame) -> DataFrame:
    """(text, digest) of the rows (id, text) that have words; texts are binary."""
    def run(batches):
        for b in slices(batches):
            digests = [digest(t) if t and t.split() else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(digests, pa.binary())], ["text", "digest"])

    return map_arrow(plain, run, "text binary, digest binary").where(F.col("digest").isNotNull())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}
_INVERSE = pow(int(MULTIPLIER), -1, 1 << 64)


def range_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ranges of ``length`` words at ``starts``, from one prefix sum."""
    n = len(words)
    for base in (int(MULTIPLIER), _INVERSE):
        if base not in _POWERS or len(_POWERS[base]) <= n:
            _POWERS[base] = _powers(base, max(4096, 2 * n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _POWERS[_INVERSE][:n], out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * _POWERS[int(MULTIPLIER)][starts] + np.uint64(length))
