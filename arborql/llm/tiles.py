"""Components within a block of rows, in numpy."""

from __future__ import annotations

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes over edges (a, b): hooking with pointer jumping."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(lab, np.maximum(la, lb), low)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab
