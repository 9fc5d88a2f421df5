"""Lossless compact form of many rings: rectangles as templates and corners, other shapes as scaled deltas.

Layout of a block (little endian): one byte codec, u32 parts, u32 vertices, then by codec
  0 raw    f32 coordinates
  1 rect   u16 number of sizes, f32 pairs (width, height), per ring u16 size and f32 corner
  2 delta  f64 scale, then zigzag varints of rounded coordinates minus those of the vertex before
after varint part lengths. A codec is used only where decoding gives back every f32 bit.
"""
from __future__ import annotations

import struct

import numpy as np

RAW, RECT, DELTA = 0, 1, 2
SCALES = (1.0, 16.0, 256.0, 4096.0, 65536.0)


def _varints(values) -> bytes:
    out = bytearray()
    for v in values:
        v = int(v)
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _read_varints(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(v)
    return out, at


def _rect(x: np.ndarray, lengths) -> bytes | None:
    """Rings of five corners from the lower left, counter-clockwise or clockwise as the first ring has them."""
    if not len(lengths) or set(lengths) != {5}:
        return None
    r = x.reshape(-1, 5, 2)
    size = r[:, 2] - r[:, 0]
    sizes, which = np.unique(size, axis=0, return_inverse=True)
    if len(sizes) > 65535 or not np.array_equal(_unrect(r[:, 0], sizes[which.ravel()]), r):
        return None
    return struct.pack("<H", len(sizes)) + sizes.astype("<f4").tobytes() + which.astype("<u2").tobytes() + r[:, 0].astype("<f4").tobytes()


def _unrect(corner: np.ndarray, size: np.ndarray) -> np.ndarray:
    far = (corner + size).astype(np.float32)
    x0, y0, x1, y1 = corner[:, 0], corner[:, 1], far[:, 0], far[:, 1]
    return np.stack([np.stack(p, 1) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))], 1)


def encode(flat, lengths) -> bytes:
    """flat: f32 x, y interleaved; lengths: vertices per part."""
    x = np.asarray(flat, np.float32)
    head = struct.pack("<II", len(lengths), len(x) // 2) + _varints(lengths)
    if body := _rect(x, list(lengths)):
        return bytes([RECT]) + head + body
    for scale in SCALES if len(x) and np.isfinite(x).all() and np.abs(x).max() < 2**31 else ():
        whole = np.rint(x.astype(np.float64) * scale).astype(np.int64)
        if np.array_equal((whole / scale).astype(np.float32).view(np.uint32), x.view(np.uint32)):
            delta = np.diff(whole.reshape(-1, 2), axis=0, prepend=np.zeros((1, 2), np.int64)).ravel()
            return bytes([DELTA]) + head + struct.pack("<d", scale) + _varints((delta << 1) ^ (delta >> 63))
    return bytes([RAW]) + head + x.astype("<f4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, list[int]]:
    codec = data[0]
    parts, vertices = struct.unpack_from("<II", data, 1)
    lengths, at = _read_varints(data, 9, parts)
    if sum(lengths) != vertices:
        raise ValueError("part lengths overrun the vertices")
    if codec == RAW:
        return np.frombuffer(data, "<f4", 2 * vertices, at), lengths
    if codec == RECT:
        (n,) = struct.unpack_from("<H", data, at)
        sizes = np.frombuffer(data, "<f4", 2 * n, at + 2).reshape(n, 2)
        at += 2 + 8 * n
        which = np.frombuffer(data, "<u2", parts, at)
        corner = np.frombuffer(data, "<f4", 2 * parts, at + 2 * parts).reshape(parts, 2)
        return _unrect(corner, sizes[which]).astype(np.float32).ravel(), lengths
    if codec == DELTA:
        (scale,) = struct.unpack_from("<d", data, at)
        zig, _ = _read_varints(data, at + 8, 2 * vertices)
        z = np.array(zig, np.int64).reshape(-1, 2)
        return (((z >> 1) ^ -(z & 1)).cumsum(axis=0) / scale).astype(np.float32).ravel(), lengths
    raise ValueError(f"unknown codec {codec}")
