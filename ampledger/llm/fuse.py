"""Static 3-wise binary fuse filters over 64-bit keys, built and probed with numpy.

A filter holds one byte per slot and about 1.13-1.25 slots per key; a key that was not
put in passes with probability 1/256. Peeling runs in waves over whole arrays: all slots
that hold one key at the time are peeled together.
"""

from __future__ import annotations

import math

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # 64-bit finaliser constants


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    length = 4 if n < 8 else min(2 ** int(math.log(n) / math.log(3.33) + 2.25), 2**18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return length, max(3, math.ceil(n * factor / length) + 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """(3, n): one slot in each of three segments that follow one another."""
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    base, mask = first * np.uint64(length), np.uint64(length - 1)
    return np.stack(
        [
            base + (h & mask),
            base + np.uint64(length) + ((h >> np.uint64(18)) & mask),
            base + np.uint64(2 * length) + ((h * _M1 >> np.uint64(40)) & mask),
        ]
    ).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray, max_tries: int = 100) -> dict:
    """Filter over distinct uint64 ``keys`` (repeats are dropped; none gives an empty filter)."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(1, max_tries + 1):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        order = _peel(_slots(h, length, segments), length * segments)
        if order is not None:
            break
        if seed % 20 == 0:
            segments += max(1, segments // 8)
    else:
        raise RuntimeError("no peelable arrangement found")
    slots, prints, cells = _slots(h, length, segments), _print(h), np.zeros(length * segments, np.uint8)
    for which, at in reversed(order):  # slots owned within a wave are disjoint from the others' slots
        own = slots[:, which]
        cells[at] = 0
        cells[at] = prints[which] ^ cells[own[0]] ^ cells[own[1]] ^ cells[own[2]]
    return {"seed": seed, "length": length, "segments": segments, "cells": cells.tobytes()}


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = slots.shape[1]
    count, owner = np.zeros(size, np.int32), np.zeros(size, np.int64)
    for row in slots:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(owner, row, np.arange(n))
    waves, left, ready = [], n, np.flatnonzero(count == 1)
    while len(ready):
        which, first = np.unique(owner[ready], return_index=True)
        waves.append((which, ready[first]))
        left -= len(which)
        touched = slots[:, which]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(owner, row, which)
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    return waves if left == 0 else None


def contains(f: dict, keys: np.ndarray) -> np.ndarray:
    h = _mix(keys.astype(np.uint64), f["seed"] * 0x9E3779B97F4A7C15 & (2**64 - 1))
    cells, own = np.frombuffer(f["cells"], np.uint8), _slots(h, f["length"], f["segments"])
    return (cells[own[0]] ^ cells[own[1]] ^ cells[own[2]]) == _print(h)
