"""XXH64 of many byte ranges at once, with numpy."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(acc, lane):
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """The XXH64 of ``buffer[start : start + length]`` for each range, as uint64."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    fours = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    length = length.astype(np.int64)
    with np.errstate(over="ignore"):
        base = np.uint64(seed)
        acc = np.full(len(start), base + _P5, np.uint64)
        stripes = length // 32
        left = np.flatnonzero(stripes)
        if len(left):
            lanes = [np.full(len(left), v, np.uint64) for v in (base + _P1 + _P2, base + _P2, base, base - _P1)]
            order = np.argsort(stripes[left], kind="stable")
            left = left[order]
            counts, where = stripes[left], start[left]
            for k in range(int(counts[-1])):
                live = slice(int(np.searchsorted(counts, k, "right")), None)
                for i, lane in enumerate(lanes):
                    lane[live] = _mixed(lane[live], eights[where[live] + 32 * k + 8 * i])
            whole = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                whole = (whole ^ _mixed(np.uint64(0), lane)) * _P1 + _P4
            acc[left] = whole
        acc += length.astype(np.uint64)
        at, rest = start + 32 * stripes, length % 32
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * (k + 1))
            some = acc[live] ^ _mixed(np.uint64(0), eights[at[live] + 8 * k])
            acc[live] = _turn(some, 27) * _P1 + _P4
        at += rest // 8 * 8
        live = np.flatnonzero(rest & 4)
        some = acc[live] ^ (fours[at[live]].astype(np.uint64) * _P1)
        acc[live] = _turn(some, 23) * _P2 + _P3
        at += rest & 4
        for k in range(3):
            live = np.flatnonzero((rest & 3) > k)
            some = acc[live] ^ (padded[at[live] + k].astype(np.uint64) * _P5)
            acc[live] = _turn(some, 11) * _P1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        return acc ^ (acc >> np.uint64(32))
