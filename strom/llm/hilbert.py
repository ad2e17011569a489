"""Places of points along a Hilbert curve, for whole arrays of points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the curve of each row of ``cells`` (n x dimensions, 0 <= cell < 2**bits); bits x dimensions may be up to 63."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    dims = len(x)
    # undo the rotations and reflections of the finer and finer cubes, from the largest on
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            set_here = (x[d] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_here, low, swap)
            if d:
                x[d] ^= swap
        q >>= 1
    # Gray code
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | ((x[d] ^ turn) >> bit & 1)
    return key
