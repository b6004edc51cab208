"""Patched frame-of-reference coding of unsigned 32-bit values in blocks.

A block holds BLOCK values (the last may hold fewer, filled up with its minimum). The minimum is
subtracted; the low ``width`` bits of each value are packed as bit planes, where ``width`` is enough
for PERCENTILE of the block's values; the others are exceptions, kept as position and high bits.

    block:  minimum u32, width u8, exceptions u16 | planes, BLOCK / 8 bytes each
            | exception positions u16 | exception high bits u32             (little endian)
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, PERCENTILE = 1024, 90
HEAD = struct.Struct("<IBH")


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact below 2**53."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode(values: np.ndarray) -> list[bytes]:
    """The blocks of the values, in order."""
    if not len(values):
        return []
    short = -len(values) % BLOCK
    tail_minimum = values[len(values) - len(values) % BLOCK :].min() if short else 0
    rows = np.concatenate([values.astype(np.uint32), np.full(short, tail_minimum, np.uint32)]).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    widths = bit_lengths(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        part = rest[own]
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        planes = [np.packbits(((part >> np.uint32(k)) & 1).astype(np.uint8), axis=1) for k in range(width)]
        packed = np.stack(planes, axis=1) if planes else np.empty((len(own), 0, BLOCK // 8), np.uint8)
        where, places = np.nonzero(high)
        ends = np.searchsorted(where, np.arange(len(own) + 1))
        for i, row in enumerate(own.tolist()):
            places_here = places[ends[i] : ends[i + 1]]
            out[row] = b"".join(
                (
                    HEAD.pack(int(low[row]), int(width), len(places_here)),
                    packed[i].tobytes(),
                    places_here.astype("<u2").tobytes(),
                    high[i, places_here].astype("<u4").tobytes(),
                )
            )
    return out


def decode(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at these bytes."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    low = np.array([h[0] for h in heads], np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    out = np.zeros((len(heads), BLOCK), np.uint32)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        size = int(width) * BLOCK // 8
        raw = np.stack([np.frombuffer(data, np.uint8, size, int(starts[i]) + HEAD.size) for i in own])
        bits = np.unpackbits(raw.reshape(len(own), int(width), BLOCK // 8), axis=2)
        part = np.zeros((len(own), BLOCK), np.uint32)
        for k in range(width):
            part |= bits[:, k].astype(np.uint32) << np.uint32(k)
        for i, row in enumerate(own.tolist()):
            n = heads[row][2]
            if n:
                at = int(starts[row]) + HEAD.size + size
                places = np.frombuffer(data, "<u2", n, at)
                part[i, places] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width)
        out[own] = part
    return (out + low[:, None]).ravel()
