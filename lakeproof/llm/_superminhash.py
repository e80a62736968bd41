"""SuperMinHash signatures (Ertl, 2017) of ragged sets of 64-bit hashes.

Each element walks its own random permutation of the m slots; step j offers the value j + r with r in [0, 1). A set stops at the
first j that exceeds its largest slot, so large sets take a step or two and small ones at most m. All sets of a batch
take a step together. Fisher-Yates swaps are traced back through the steps before, so that no permutation is stored.
"""

from __future__ import annotations

import numpy as np

from lakeproof.llm._words import U, mix

_FULL = U((1 << 64) - 1)
_TRACED = 6


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Array len(sets) x m of slots, (step << 32) | 32 random bits; empty sets keep all ones."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), m), _FULL, dtype=U)
    rows = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    flat = out.reshape(-1)
    swaps: list[np.ndarray] = []
    places = None
    for j in range(m):
        if not len(rows):
            break
        bits = mix(elements + U(0x5851F42D4C957F2D * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((bits >> U(32)) * U(m - j) >> U(32)).astype(np.int64)).astype(np.int32)
        if places is None and j < _TRACED:
            slot = k.copy()
            for i in range(j - 1, -1, -1):
                np.copyto(slot, i, where=swaps[i] == slot)
            swaps.append(k)
        else:
            line = np.arange(len(rows))
            if places is None:
                places = np.tile(np.arange(m, dtype=np.int16), (len(rows), 1))
                for i, s in enumerate(swaps):
                    moved = places[:, i].copy()
                    places[:, i] = places[line, s]
                    places[line, s] = moved
            slot = places[line, k].astype(np.int32)
            places[line, k] = places[:, j]
        np.minimum.at(flat, rows * m + slot, (U(j) << U(32)) | (bits & U(0xFFFFFFFF)))
        most = out.max(axis=1)
        open_ = (most >> U(32) > U(j)) & (sizes > 0)
        if j + 1 < m and not open_.all():
            live = open_[rows]
            if not live.all():
                rows, elements, swaps = rows[live], elements[live], [s[live] for s in swaps]
                places = places[live] if places is not None else None
    return out


def bands(sig: np.ndarray, n_bands: int, width: int) -> np.ndarray:
    """A 64-bit key for each band of ``width`` slots; bands never share keys but by chance."""
    out = np.zeros((len(sig), n_bands), dtype=U)
    for i in range(width):
        out = mix(out + sig[:, i : n_bands * width : width])
    return mix(out + np.arange(n_bands, dtype=U) * U(0x9E3779B97F4A7C15))
