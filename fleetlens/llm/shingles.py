"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .arrowio import texts

WORDS = 5

# Odd multipliers, one per place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range, one to one."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words, and the hash of every word after lower-casing A-Z."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts(column)))
    coded = words.flatten().dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.zeros(1, bool)
    places = coded.indices.to_numpy()
    keep = full[places]
    offsets = words.offsets.to_numpy()
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[offsets - offsets[0]], table[places[keep]]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than a shingle the whole sequence is one."""
    offsets, hashes = word_hashes(column)
    total = len(hashes)
    sums = np.zeros(max(0, total - WORDS + 1), np.uint64)
    for place in range(WORDS):
        sums += mixed(hashes[place:total - WORDS + 1 + place] + PLACES[place]) * PLACES[place] if len(sums) else sums
    sums = mixed(sums)
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if stop - start >= WORDS:
            out.append(np.unique(sums[start:stop - WORDS + 1]))
        elif stop > start:
            short = xxhash.xxh3_64_intdigest(hashes[start:stop].tobytes(), seed=stop - start)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
