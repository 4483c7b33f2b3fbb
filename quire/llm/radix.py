"""Groups of equal strings by passes of digits, the most significant first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def equal_groups(bucket: np.ndarray, digit: Callable[[int, np.ndarray], np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, group): the places of those strings that have an equal, group by group in order of their digits, and the number of each one's group.

    The first pass deals strings by `bucket`, which equal strings share. Each later one orders the strings of a group by the digit of that pass, parts the group where digits differ and
    drops what is alone. A group whose digits are all equal needs no sort. After the last pass a group's strings agree in all digits.
    """
    order = np.argsort(bucket)
    b = bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = b[1:] != b[:-1]
    order, new = _several(order, new)
    for k in range(passes):
        if not len(order):
            break
        d = digit(k, order)
        differs = np.zeros(len(order), bool)
        differs[1:] = ~new[1:] & (d[1:] != d[:-1])
        if differs.any():
            group = np.cumsum(new) - 1
            mixed = np.flatnonzero(np.bincount(group[differs], minlength=group[-1] + 1)[group])
            to = mixed[np.lexsort((d[mixed], group[mixed]))]
            order[mixed], d[mixed] = order[to], d[to]
            new[1:] |= d[1:] != d[:-1]
            order, new = _several(order, new)
    return order, np.cumsum(new) - 1


def _several(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the groups of one."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return order[~alone], new[~alone]
