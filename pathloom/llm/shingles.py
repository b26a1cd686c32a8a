"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
SLICE = 2 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        limit = SLICE + (sizes[at - 1] if at else 0)
        to = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text.

    Words are runs without ASCII white space, with A-Z in lower case. A text of fewer words has its whole
    sequence as one shingle; without words, or null, its set is empty.
    """
    for piece in _slices(texts.fill_null("").cast(pa.large_string())):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(piece))
        found = lists.flatten().dictionary_encode()
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
        hashes = known[found.indices.to_numpy()]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        real = hashes != 0
        if not real.all():
            offsets = np.append(0, np.cumsum(real))[offsets]
            hashes = hashes[real]
        n = len(hashes) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(words):
            if n > 0:
                rolled = mixed(rolled * ODD + hashes[j : j + n])
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if end - begin >= words:
                one = np.sort(rolled[begin : end - words + 1])
                yield one[np.append(True, one[1:] != one[:-1])]
            elif end > begin:
                whole = np.full(1, end - begin, np.uint64)
                for j in range(begin, end):
                    whole = mixed(whole * ODD + hashes[j : j + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)
