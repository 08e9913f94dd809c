"""Cross-polytope hashes of vectors: pseudo-rotations by sign flips and fast Hadamard transforms, then the nearest signed axis."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

ROUNDS = 3
"""Sign flips and transforms that make up one pseudo-rotation."""


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x


@lru_cache(maxsize=256)
def signs(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (ROUNDS, width)).astype(np.float32) * 2 - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows, each times the power of two that brings its largest component near one: directions stay exactly, and products stay finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """The vectors, padded with zeros to a power of two, under the pseudo-rotation of this seed (up to a factor)."""
    rows, size = vectors.shape
    width = 1 << max(0, size - 1).bit_length()
    x = np.zeros((rows, width), np.float32)
    x[:, :size] = vectors
    for flip in signs(seed, width):
        x = hadamard(x * flip) / np.float32(np.sqrt(width))
    return x


def nearest_axes(vectors: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` nearest signed axes, nearest first: axis ``i`` is ``i``, its opposite ``i`` plus the width."""
    x = rotated(scaled(vectors), seed)
    both = np.concatenate([x, -x], axis=1)
    if probes == 1:
        return np.argmax(both, axis=1)[:, None]
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of fixed-size vectors, all components there, as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)
